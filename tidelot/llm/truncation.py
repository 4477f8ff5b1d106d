"""Texts that stop before the end of what their source held.

(1) Near-copies, for every text (`copies`): a text that ends inside a longer near-copy is incomplete.
(2) Texts without such a copy are scored by closing terminality, learned from all texts: where nearly
all texts that open alike close alike, a text without that closing is open; a mark left by a cut
counts unless its word ends lines elsewhere; a text that just stops must stop with a word that ends
lines (a rare word leans on words of its shape) on a line as long as others that begin alike, or with
words that many texts close with. Texts in self-describing formats (`formats`) also show by their own
counts whether something is missing or all is there.

Estimates are shrunk by constants that weigh less the more there is to count: no rule is switched by
size. Null, empty and blank texts are never cases. Repeated texts are judged alike. All counts cover
all texts, whole; keys are hashes of whole words and lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import ne
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelot.llm.copies import ENTRY, Anchors, early_ends, hashed_words, slices, split_words, strings_of, word_hashes
from tidelot.llm.formats import announced
from tidelot.session import broadcast_if_small, materialise, scratch_dir, spread

#: A word that ends a line in a smaller share of its uses is no closing word; on a finished line; with a mark left on.
TERMINAL, TERMINAL_LINE, TERMINAL_MARK = 0.12, 0.03, 0.2
#: Uses of a word that its shape's share counts for.
SHAPE_WEIGHT = 4
#: Share of lines that begin alike and are as short, below which a line is too short; a line that none is as short as counts for a part of one.
SHORT_LINE, UNSEEN_LINE = 0.005, 0.25
#: Share of all texts, beyond a text and one copy, from which equal last words are a usual way to close.
USUAL = 0.0005
#: A class has a closing if this share of its texts (and of `CLASS_WEIGHT` more) end in keys that `KEY_SHARE` of it, beyond one text, end in.
CLASS_SHARE, KEY_SHARE, CLASS_WEIGHT = 0.6, 0.05, 5

# A line that version control adds behind a text, and marks that tools leave where they cut.
PROVENANCE = re.compile(r"\n?\(cherry picked from commit [0-9a-f]{7,40}\)\s*$")
MARK = re.compile(r"(?:\.\.\.|…|\[…\]|\[(?:\.\.\.|truncated|cut|snip)\]|\((?:truncated|cut)\))\s*$", re.I)
_PICKED, _MARK_SIGNS = "(cherry picked from commit ", 11  # how a provenance line begins; signs of the longest mark
SOFT_MARK = "..."  # also common in complete texts
# Signs that leave a text blank, and those that begin the lines of a body or a hunk; but these name a file.
_INVISIBLE = " \t\r\n\f\v ​‌‍⁠　﻿"
_BODY = (" ", "\t", "+", "-", "")
_NAMES = ("--- ", "+++ ")

_PLAIN = bytes.maketrans((ascii_letters + digits).encode(), b"a" * 52 + b"0" * 10)
_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")


def key_of(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def opening(text: str) -> str:
    """Class of a text: its first word without numbers."""
    words = text.split(None, 1)
    return without_numbers(words[0]) if words else ""


def closing(text: str) -> str:
    """Closing key: the last two words without numbers."""
    return " ".join(without_numbers(w) for w in text.rsplit(None, 2)[-2:])


@lru_cache(1 << 16)
def without_numbers(word: str) -> str:
    return _DIGITS.sub("#", word)


@lru_cache(1 << 16)
def shape(word: str) -> str:
    """A word's pattern: runs of letters and of digits become one sign each."""
    return _DIGITS.sub("#", _LETTERS.sub("a", word))


def shapes_of(words: list[str]) -> tuple[list[str], list[bool]]:
    """`shape` of each word, and whether it has a number in it; those of plain signs all at once, a line each, as no word holds a line's end."""
    x = np.frombuffer("\n".join(words).encode().translate(_PLAIN), np.uint8)
    runs = np.append(True, x[1:] != x[:-1]) if len(x) else np.empty(0, bool)
    signs = x[runs | ((x != ord("a")) & (x != ord("0")))].tobytes().decode()
    shapes = signs.replace("0", "#").split("\n")[: len(words)]
    numbered = list(map(ne, signs.split("\n"), shapes))
    for i, w in enumerate(words):
        if not w.isascii():
            shapes[i], numbered[i] = shape(w), bool(_DIGITS.search(w))
    return shapes, numbered


def closing_word(text: str) -> str:
    """The last word, with a mark that stands for the cut left on."""
    words = text.rsplit(None, 1)
    return words[-1] if words else ""


def line_key(line: str) -> str:
    """What lines that begin alike share: the first word without numbers."""
    words = line.split(None, 1)
    return without_numbers(words[0]) if words else ""


@lru_cache(1 << 16)
def word_key(word: str) -> str:
    """A word by itself if it has no number in it, else its shape."""
    return shape(word) if _DIGITS.search(word) else word


def is_body(line: str) -> bool:
    return line[:1] in _BODY and line[:4] not in _NAMES


class Facts:
    """What one text says about its own end."""

    __slots__ = ("change", "closes", "last", "mark", "missing", "newline", "opens", "outside", "whole", "word")

    def __init__(self, text: str):
        body = PROVENANCE.sub("\n", text) if _PICKED in text else text
        self.opens, self.closes = opening(body), closing(body)
        _, self.missing, self.whole, self.outside, self.change = announced(body)
        m = MARK.search(body, max(0, len(body.rstrip()) - _MARK_SIGNS))
        self.mark = 0 if not m else 1 if m[0].strip() == SOFT_MARK else 2
        self.last = body.rstrip().rsplit("\n", 1)[-1]
        self.word = closing_word(body)
        if self.mark == 1 and self.last.strip() == SOFT_MARK:
            self.mark = 0  # a line of its own stands for left-out lines
        self.newline = body.endswith("\n")


#: What is true of a text, as bits of `flags`; its mark is in the bits above.
_FLAGS = ("numbered", "missing", "whole", "change", "newline", "names", "signed")
_DOC = {
    "doc_id": pa.int64(), "source": pa.string(), "text_hash": pa.int64(), "opens": pa.int64(), "closes": pa.int64(), "flags": pa.int64(),
    "word": pa.int64(), "shape": pa.int64(), "line_key": pa.int64(), "line_words": pa.int64(), "line_signs": pa.int64(),
}
_COUNT = {"key": pa.int64(), "number": pa.int64(), "n": pa.int64(), "n_ends": pa.int64()}
_KINDS = {"doc": _DOC, "anchor": ENTRY, "word": _COUNT, "words": _COUNT, "signs": _COUNT}
_SPARK = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
#: Columns of all kinds of rows: the nth field of a type is in the nth column of that type, so that few columns are empty.
_PLACES = {kind: {f: f"{_SPARK[t]}_{list(fields.values())[:i].count(t)}" for i, (f, t) in enumerate(fields.items())} for kind, fields in _KINDS.items()}
_SURVEY = pa.schema([("survey", pa.int32()), *{_PLACES[kind][f]: t for kind, fields in _KINDS.items() for f, t in fields.items()}.items()])
_DDL = ", ".join(f"`{f.name}` {_SPARK[f.type]}" for f in _SURVEY)
#: Rows that are sent on together, and words that are hashed together.
_SLICE, _WORDS = 50_000, 1 << 17


def _columns(kind: str, columns: dict) -> Iterator[pa.RecordBatch]:
    """Rows of a kind from some of its columns."""
    n, number = len(next(iter(columns.values()))), list(_KINDS).index(kind)
    placed = {_PLACES[kind][f]: x for f, x in columns.items()}
    for at in range(0, n, _SLICE):
        k = min(_SLICE, n - at)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number, np.int32))] + [pa.array(placed[f.name][at : at + k], f.type) if f.name in placed else pa.nulls(k, f.type) for f in list(_SURVEY)[1:]], schema=_SURVEY)


def _anchors(anchors: Anchors, hashes: np.ndarray, n: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    end, at = np.cumsum(n), 0
    while at < len(n):
        begin = end[at] - n[at]
        upto = max(at + 1, int(np.searchsorted(end, begin + _WORDS, "right")))
        part = anchors.records(hashes[at:upto], n[at:upto], words[begin : end[upto - 1]])
        yield from _columns("anchor", {c: part.column(c) for c in ENTRY})
        at = upto


def _signed(h: np.ndarray) -> np.ndarray:
    """Hashes as `key_of` gives them."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _counts(lines: list[str], unfinished: list[int]) -> tuple[pa.Table, pa.Table]:
    """Per different word of some lines its key, its shape's, its uses and how often it ends a line; per header line its key, words and signs. Unfinished lines say nothing of how lines end."""
    strings = pa.array(lines, pa.string())
    n, ids, words = split_words(strings)
    end, full, names = np.cumsum(n), n > 0, strings_of(words)
    full[unfinished] = False
    shapes, numbered = shapes_of(names)
    shape_of = pa.array(shapes, pa.string()).dictionary_encode()
    shape_keys = _signed(word_hashes(strings_of(shape_of.dictionary)))[shape_of.indices.to_numpy()]
    keys = np.where(numbered, shape_keys, _signed(word_hashes(names)))  # as in `word_key`
    count = lambda x: np.bincount(x, minlength=len(names))
    by_word = pa.table({"key": keys, "number": shape_keys, "n": count(ids), "n_ends": count(ids[end[full] - 1])}).filter(pc.field("n") > 0)  # a blank line has a word without uses

    starts = lambda signs: np.any([pc.starts_with(strings, x).to_numpy(zero_copy_only=False) for x in signs], axis=0)
    header = full & (starts(_NAMES) | ~starts([x for x in _BODY if x]))  # as in `is_body`
    used, which = np.unique(ids[(end - n)[header]], return_inverse=True)
    line_keys = _signed(word_hashes([without_numbers(names[i]) for i in used.tolist()]))[which]
    return by_word, pa.table({"key": line_keys, "words": n[header], "signs": pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)[header]})


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text, the anchors of each different text of a batch, and per batch the counts, outside of hunks, of words and of header lines' lengths that all texts are judged by."""
    anchors = Anchors()
    for b in batches:
        seen, docs, counts = set(), [], []
        for at, upto in slices(b.column(2)):
            hashes, different, lines, unfinished = [], [], [], []
            for doc_id, source, text in zip(b.column(0).to_numpy()[at:upto].tolist(), *(strings_of(b.column(i).slice(at, upto - at)) for i in (1, 2)), strict=True):
                if not text.strip(_INVISIBLE):
                    continue
                text_hash = key_of(text)
                if text_hash not in seen:
                    seen.add(text_hash)
                    hashes.append(text_hash)
                    different.append(text)
                f = Facts(text)
                if not f.whole:
                    last = next((i for i in range(len(f.outside) - 1, -1, -1) if f.outside[i].strip()), None)
                    if last is not None:
                        unfinished.append(len(lines) + last)  # the last line says nothing of how lines end
                lines += f.outside
                k = None if is_body(f.last) else line_key(f.last)
                names, signed = k is not None and k.endswith("-by:"), k is not None and k[:1] in "-+@="
                flags = ("#" in f.closes) | f.missing << 1 | f.whole << 2 | f.change << 3 | f.newline << 4 | names << 5 | signed << 6 | f.mark << len(_FLAGS)
                docs.append((doc_id, source, text_hash, key_of(f.opens), key_of(f.closes), flags, key_of(word_key(f.word)), key_of(shape(f.word)), None if k is None else key_of(k), len(f.last.split()), len(f.last)))
            yield from _anchors(anchors, np.array(hashes, np.int64), *hashed_words(pa.array(different, pa.string())))
            counts.append(_counts(lines, unfinished))
        if docs:
            yield from _columns("doc", dict(zip(_DOC, zip(*docs, strict=True), strict=True)))
            by_word, by_line = (pa.concat_tables(x) for x in zip(*counts, strict=True))
            by_word = by_word.group_by(["key", "number"], use_threads=False).aggregate([("n", "sum"), ("n_ends", "sum")]).combine_chunks()
            yield from _columns("word", dict(zip(_COUNT, (by_word.column(c).to_numpy() for c in ("key", "number", "n_sum", "n_ends_sum")), strict=True)))
            for kind in ("words", "signs"):
                x = by_line.group_by(["key", kind], use_threads=False).aggregate([([], "count_all")])
                yield from _columns(kind, {"key": x.column("key").to_numpy(), "number": x.column(kind).to_numpy(), "n": x.column("count_all").to_numpy()})


def least_usual(lengths: DataFrame, name: str) -> DataFrame:
    """(`line_key`, `name`): the least length that is usual among header lines that begin alike, where there are enough to know. Ordered per key are its different lengths only."""
    per = lengths.groupBy("key", "number").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key")
    upto = F.sum("n").over(w.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumns({"upto": upto + UNSEEN_LINE, "total": SHORT_LINE * (F.sum("n").over(w) + UNSEEN_LINE)})
    return per.filter((F.col("total") > UNSEEN_LINE) & (F.col("upto") >= F.col("total"))).groupBy(F.col("key").alias("line_key")).agg(F.min("number").alias(name))


def look_up(rows: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """Left join to a dictionary that is broadcast where it is small; otherwise rows without a key are spread first, and adaptive execution splits hot keys."""
    facts = broadcast_if_small(materialise(facts, name))
    own = F.coalesce(F.col(key), F.xxhash64("doc_id"))  # matches nothing, and spreads what has no key
    return rows.withColumn("_key", own).join(facts.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def terminality(docs: DataFrame, words: DataFrame, words_per_line: DataFrame, signs_per_line: DataFrame) -> DataFrame:
    """`doc_id`, `source`, `text_hash` and by what a text is open: `announced`, `marked`, `unclosed` or `stops` (null: by nothing)."""
    by_word = words.groupBy("key", "number").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"))
    by_shape = by_word.groupBy(F.col("number").alias("shape")).agg((F.sum("n_ends") / F.sum("n")).alias("shape_ends"))
    by_shape = by_shape.join(docs.select("shape").distinct(), "shape", "left_semi")
    by_word = by_word.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("uses"), F.sum("n_ends").alias("ends")).join(docs.select("word").distinct(), "word", "left_semi")
    lines = least_usual(words_per_line, "least_words").join(least_usual(signs_per_line, "least_signs"), "line_key", "full")

    ends = docs.groupBy("opens", "closes", "numbered").agg(F.count(F.lit(1)).alias("n"))
    usual = ends.filter("not numbered").groupBy("closes").agg(F.sum("n").alias("n")).filter(F.col("n") - 2 >= USUAL * docs.agg(F.count(F.lit(1))).scalar()).select("closes", F.lit(True).alias("is_usual"))
    classes = ends.groupBy("opens").agg(F.sum("n").alias("class_n"))
    keys = ends.join(classes, "opens").filter(F.col("n") - 1 >= KEY_SHARE * F.col("class_n"))
    closed = keys.groupBy("opens").agg((F.sum("n") >= CLASS_SHARE * (F.first("class_n") + CLASS_WEIGHT)).alias("has_closing"))
    pair = lambda o, c: F.xxhash64(o, c).alias("_pair")
    keys = keys.select(pair("opens", "closes"), F.lit(True).alias("is_key"))

    x = docs.withColumn("_pair", pair("opens", "closes"))
    for facts, key in ((closed.filter("has_closing"), "opens"), (keys, "_pair"), (usual, "closes"), (by_word, "word"), (by_shape, "shape"), (lines, "line_key")):
        x = look_up(x, facts, key, f"facts-{key.strip('_')}")
    x = x.fillna(False, ["has_closing", "is_usual", "is_key"]).fillna(0, ["uses", "ends", "shape_ends", "least_words", "least_signs"])
    ends_lines = (F.col("ends") + SHAPE_WEIGHT * F.col("shape_ends")) / (F.col("uses") + SHAPE_WEIGHT)
    marked = (F.col("mark") == 2) | ((F.col("mark") == 1) & (F.col("ends") <= TERMINAL_MARK * F.col("uses")))
    whole = F.col("whole") | (F.col("change") & F.col("newline"))
    people = F.col("newline") & F.col("names")  # people's names are of any length
    short = (F.col("line_words") < F.col("least_words")) | (F.col("line_signs") < F.col("least_signs"))  # unknown beginnings have 0
    stops = ~(F.col("is_usual") & ~F.col("signed")) & ((ends_lines < F.when(F.col("newline"), TERMINAL_LINE).otherwise(TERMINAL)) | short) & ~whole & ~people
    by: Column = F.when(F.col("missing"), "announced").when(marked, "marked").when(F.col("has_closing") & ~F.col("is_key"), "unclosed").when(~F.col("has_closing") & stops, "stops")
    return x.select("doc_id", "source", "text_hash", by.alias("by"))


def find_incomplete(documents: DataFrame) -> DataFrame:
    """(`doc_id`, `source`, `evidence`, `incomplete`) of every text that is not null or blank; `documents` has `doc_id`, `text`, `source`.

    `evidence` is 'copy' where a longer near-copy shows the end, else what `terminality` finds, null where nothing.
    """
    texts = spread(documents.filter("text is not null and doc_id is not null").select("doc_id", F.col("source").cast("string"), "text"), "doc_id")
    path = scratch_dir(documents.sparkSession, "text-survey")
    texts.mapInArrow(_survey, _DDL).write.partitionBy("survey").parquet(path)
    survey = documents.sparkSession.read.schema(_DDL).parquet(path)  # each kind is a folder, read by itself
    part = lambda kind: survey.filter(F.col("survey") == list(_KINDS).index(kind)).select(*(F.col(c).alias(f) for f, c in _PLACES[kind].items()))
    docs = part("doc").withColumns({f: F.col("flags").bitwiseAND(1 << i) != 0 for i, f in enumerate(_FLAGS)} | {"mark": F.shiftright("flags", len(_FLAGS))}).drop("flags")
    copies = materialise(early_ends(texts, docs.select("doc_id", "text_hash"), part("anchor")), "early-ends")
    matched = broadcast_if_small(copies)
    unmatched = docs.join(matched, "text_hash", "left_anti")
    scored = terminality(unmatched, part("word"), part("words"), part("signs"))
    found = docs.join(matched, "text_hash", "left_semi").select("doc_id", "source", F.lit("copy").alias("evidence"))
    return found.unionByName(scored.select("doc_id", "source", F.col("by").alias("evidence"))).withColumn("incomplete", F.col("evidence").isNotNull())
