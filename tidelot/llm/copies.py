"""Copies that end early: texts that are near-copies of a longer text up to where they stop.

A copy that was cut may have lost any part of its original, so whole texts need not be similar. What
is similar is the copy and the original up to where the copy ends, and min-hash meets there: of a
band's hash values over a text's five-word shingles, the least of any beginning of the text is one
of its *record minima* (positions lower than all before). A text of n words has about ln(n) of them.
So every text puts its record minima of all bands into buckets, and a text looks its overall minima
up: that one is a record of its original too, unless the two beginnings differ in just that place.

A bucket holds the texts that go on alike for `RUN` words from such a position. Its members are not
paired: they are sorted by what follows (hashes of successive blocks, then length), where a text's
continuations stand right behind it, and each text is aligned with the first that is longer by enough.
The sort is by range, so no bucket is one task and work grows with rows, not with pairs. Every pair
is verified on whole texts: at least 0.8 of the shingles of the copy and of the other text up to the
copy's end are the same, and the other goes on for `GOES_ON` words that are no trailer.

That is the short way to most copies. A text whose first continuations are not verified is compared
with all other texts of its buckets (`others`), by what every verified pair must share: one of any so
many of the copy's shingles that the rest is less than 0.8. The rarest are taken, so that what many
texts hold makes no pairs; a copy of whose shingles others hold less than 0.8, or none of the last, has
no pair. Nothing is left out by this.

A last word may itself be cut and is not hashed. Texts of fewer than SKIP + RUN + 1 words are not
looked up. Equal texts are one. Empty input gives empty output.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelot.session import broadcast_if_small, estimated_bytes, materialise, spread

SHINGLE, SIMILARITY = 5, 0.8
BANDS = 4
#: Words from a minimum on that a bucket's members share; minima in the first words of a text say nothing.
RUN, SKIP = 8, 4
#: Words by which the longer text must go on.
GOES_ON = 6
#: Holders of a copy's keys, counted once for each key, up to which no more keys are asked for.
FEW = 4
#: Keys beyond those of which a pair must share one; each of them asks for one more that is shared.
MORE = 8
#: Candidates of a text that are verified at once; the next ones only if none of them is a copy's original, to the last.
ROUNDS = (4, 64, (1 << 31) - 1)
# Lines that version control adds behind a whole text.
TRAILER = re.compile(r"^\s*(?:[A-Z][A-Za-z-]+-by: .*|\(cherry picked from commit .*|-- ?|\d+(?:\.\d+)+|Patch set \d+: \w+|\\ No newline at end of file)\s*$")

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Ends of blocks behind a run: 16 blocks of 16 words, 16 of 32 and so on, so that a text of any length has a short list.
_BLOCK_ENDS = np.cumsum(np.concatenate([[0], *(np.full(16, 16 << i) for i in range(26))]))


#: Bits of a hash that minima are compared by; the others number the texts of a batch.
_BITS = 44


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def slices(strings: pa.Array, n_bytes: int = 1 << 23, most: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of strings that are worked on together: of so many bytes in all, or one string."""
    end, at = np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(end):
        upto = int(np.searchsorted(end, (end[at - 1] if at else 0) + n_bytes, "right"))
        upto = min(max(upto, at + 1), at + most)
        yield at, upto
        at = upto


def split_words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of strings as `str.split` gives them: how many each string has, the number of each word end to end, and the different words by their numbers."""
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(strings))
    n, words = np.diff(parts.offsets.to_numpy()), parts.flatten().dictionary_encode()
    ids, blank = words.indices.to_numpy(), pc.index(words.dictionary, "").as_py()
    if blank >= 0:  # a blank string has one empty word
        n = n - (ids[np.cumsum(n) - n] == blank)
        ids = ids[ids != blank]
    return n.astype(np.int64), ids, words.dictionary


def strings_of(strings: pa.Array) -> list[str]:
    """The same as `to_pylist`, in a fraction of its time."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def hashed_words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each string has, and the hash of each word end to end."""
    n, ids, words = split_words(strings)
    return n, word_hashes(strings_of(words))[ids]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Record minima of texts. Hashes of words are kept per worker."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        self.a = rng.integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)
        self.b = rng.integers(1, 1 << 63, BANDS, np.uint64)
        self.words = _WordHashes()
        self.power, self.inverse = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self._powers(1 << 10)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            both = []
            for base in (_BASE, _BASE_INVERSE):
                p = np.full(2 * n, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.power, self.inverse = both

    def sums(self, words: list[str]) -> np.ndarray:
        """Prefix sums from which the hash of any stretch of words follows."""
        if len(self.words) > 1 << 20:
            self.words.clear()
        return self.sums_of(np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)))

    def sums_of(self, hashes: np.ndarray) -> np.ndarray:
        """The same, of words given by their hashes."""
        n = len(hashes)
        self._powers(n + 1)
        q = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.power[:n], out=q[1:])
        return q

    def stretch(self, q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((q[end] - q[start]) * self.inverse[start])

    def shingles(self, words: list[str]) -> np.ndarray:
        """Hash of each five words in order."""
        m = len(words) - SHINGLE + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        q = self.sums(words)
        return _mix((q[SHINGLE:] - q[:m]) * self.inverse[:m])

    def table(self, texts: list[tuple[int, list[str]]]) -> pa.RecordBatch:
        """The record minima of texts, given as hash and words, in the columns of `ENTRY`."""
        words = word_hashes(list(chain.from_iterable(w for _, w in texts)))
        return self.records(np.array([h for h, _ in texts], np.int64), np.array([len(w) for _, w in texts], np.int64), words)

    def records(self, hashes: np.ndarray, n: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        """The same of texts given by their hashes, their numbers of words, and the hashes of these.

        Texts lie end to end in one array. A running minimum starts again with each text because the
        texts' numbers, falling, are the highest bits of what is compared.
        """
        long = n > SKIP + RUN
        if not long.any():
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in ENTRY.values()], names=list(ENTRY))
        keep = np.repeat(long, n)
        keep[np.cumsum(n)[n > 0] - 1] = False  # a last word may be cut
        hashes, n = hashes[long], n[long] - 1
        end = np.cumsum(n)
        q = self.sums_of(words[keep])
        text_of = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(np.arange(len(text_of)) + RUN <= end[text_of])  # where a run fits in
        text_of = text_of[at]
        falling = (np.uint64(len(n)) - text_of.astype(np.uint64)) << np.uint64(_BITS)
        s = _mix((q[at + SHINGLE] - q[at]) * self.inverse[at])
        record, least = np.zeros(len(at), bool), np.zeros(len(at), bool)
        for a, b in zip(self.a, self.b, strict=True):
            x = s * a + b
            x = falling | (x ^ x >> np.uint64(31)) >> np.uint64(64 - _BITS)
            low = np.minimum.accumulate(x)
            lower = np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]]))
            record[lower] = True
            t = text_of[lower]
            least[lower[np.concatenate([t[1:] != t[:-1], [True]])]] = True  # a text's last record is its minimum
        keep = np.flatnonzero(record & (at - (end - n)[text_of] >= SKIP))
        p, t = at[keep], text_of[keep]
        n_blocks = np.searchsorted(_BLOCK_ENDS, end[t] - p - RUN, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(n_blocks)])
        within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n_blocks)
        start = np.repeat(p + RUN, n_blocks)
        blocks = self.stretch(q, start + _BLOCK_ENDS[within], start + _BLOCK_ENDS[within + 1]).astype(np.uint32).astype(">u4")
        follows = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(blocks.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(self.stretch(q, p, p + RUN).view(np.int64)), follows, pa.array(end[t] - p), pa.array(least[keep]), pa.array(hashes[t])], names=list(ENTRY))


ENTRY = {"bucket": pa.int64(), "follows": pa.binary(), "left": pa.int64(), "looked_up": pa.bool_(), "text_hash": pa.int64()}
_ORDER = ["bucket", "follows", "left", "text_hash"]
_STREAM = {"kind": pa.string(), "part": pa.int64(), "bucket": pa.int64(), "follows": pa.binary(), "left": pa.int64(), "text_hash": pa.int64(), "other": pa.int64()}


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each looked-up row of a sorted stream with the first row behind it that goes on (kind 'pair').

    Rows that wait when the stream ends are of kind 'waits': what they wait for lies in another task.
    The first rows of the stream's first bucket, one of each length until one resolves all that can wait, are of kind 'head'.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    waiting: deque[tuple] = deque()  # (follows, left, text): each begins all rows that come while it waits, lengths grow
    bucket_here, head, head_open, least = None, -1, True, 0
    for b in batches:
        out: list[tuple] = []
        for bucket, follows, left, looked_up, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != bucket_here:
                if bucket_here is not None:
                    head_open = False
                else:
                    least = left
                waiting.clear()
                bucket_here = bucket
            if head_open and left != head:
                head = left
                out.append(("head", part, bucket, follows, left, text, None))
                head_open = left < least + GOES_ON
            while waiting and not follows.startswith(waiting[-1][0]):
                waiting.pop()
            while waiting and left >= waiting[0][1] + GOES_ON:
                out.append(("pair", None, None, None, None, waiting.popleft()[2], text))
            if looked_up and not (waiting and waiting[-1][2] == text):
                waiting.append((follows, left, text))
        yield _stream(out)
    yield _stream([("waits", part, bucket_here, follows, left, text, None) for follows, left, text in waiting])


def _stream(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_STREAM)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STREAM.values(), strict=True)], names=list(_STREAM))


def _resolve(waits: list[tuple], heads: dict[int, list[tuple]]) -> list[tuple]:
    """(part, follows, left, other) of what rows of one task wait for, from the heads of later tasks."""
    out, parts = [], sorted(heads)
    for part, bucket, follows, left in waits:
        for p in parts[bisect_right(parts, part) :]:
            fits = [h for h in heads[p] if h[0] == bucket and h[1].startswith(follows)]
            hit = next((h[3] for h in fits if h[2] >= left + GOES_ON), None)
            if hit is not None:
                out.append((part, follows, left, hit))
            if hit is not None or len(fits) < len(heads[p]):
                break
    return out


def neighbours(entries: DataFrame) -> DataFrame:
    """(`text_hash`, `other`): texts to align, from rows of `Anchors.entries` with their text's hash.

    Range partitions split a bucket anywhere. The driver sees, per task, at most GOES_ON + 1 heads and as many lengths that wait.
    """
    spark = entries.sparkSession
    rows = entries.select(*ENTRY).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    ddl = "kind string, part bigint, bucket bigint, follows binary, left bigint, text_hash bigint, other bigint"
    found = materialise(rows.mapInArrow(_neighbours, ddl), "sorted-neighbours")
    heads: dict[int, list[tuple]] = {}
    for r in found.filter("kind = 'head'").orderBy("part", *_ORDER).collect():
        heads.setdefault(r["part"], []).append((r["bucket"], bytes(r["follows"]), r["left"], r["text_hash"]))
    waits = found.filter("kind = 'waits'")
    keys = ["part", "bucket", "follows", "left"]
    known = _resolve([(r["part"], r["bucket"], bytes(r["follows"]), r["left"]) for r in waits.select(*keys).distinct().collect()], heads)
    ends = spark.createDataFrame(known, "part bigint, follows binary, left bigint, other bigint")
    edge = waits.drop("other").join(F.broadcast(ends), ["part", "follows", "left"])
    pairs = found.filter("kind = 'pair'").select("text_hash", "other").unionByName(edge.select("text_hash", "other"))
    return pairs.filter("text_hash <> other").distinct()


def compare(copy: str, other: str, anchors: Anchors) -> bool:
    """Whether the first text is a near-copy of the second up to where it ends, and the second goes on."""
    a, b = copy.split(), other.split()
    x, y = anchors.shingles(a[:-1]), anchors.shingles(b)  # the copy's last word may be cut
    if not len(x) or not len(y) or set(x[-SHINGLE:].tolist()).isdisjoint(y.tolist()):
        return False  # what follows the copy's last common shingle is at most a shingle
    at = {s: i for i, s in enumerate(x.tolist())}
    where = [(at[s], j) for j, s in enumerate(y.tolist()) if s in at]
    last = max(i for i, _ in where)
    for j in sorted((j for i, j in where if i == last), reverse=True):  # the copy's end may occur more than once in the other
        begin = max(0, j - last)
        u, v = np.unique(x[: last + 1]), np.unique(y[begin : j + 1])
        both = len(np.intersect1d(u, v, assume_unique=True))
        if both < SIMILARITY * (len(u) + len(v) - both):
            continue
        spans = re.finditer(r"\S+", other)
        tail = other[next(s for k, s in enumerate(spans) if k == j + SHINGLE - 1).end() :]
        rest = sum(len(line.split()) for line in tail.split("\n") if not TRAILER.match(line))
        return rest - (len(a) - last - SHINGLE) >= GOES_ON
    return False


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for b in batches:
        hashes, copies, others = (b.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, s, t in zip(hashes, copies, others, strict=True) if compare(s, t, anchors)], pa.int64())], names=["text_hash"])


def _parts_of(texts: DataFrame) -> int:
    """Bits of a shingle's hash that name its part: a part holds the shingles of about two MB of stored texts."""
    return min(16, max(2, math.ceil(math.log2(max(1, estimated_bytes(texts) >> 21)))))


def _value(h: np.ndarray, bits: int) -> np.ndarray:
    """31 bits of a hash behind those of its part. What meets by chance is verified for nothing, but nothing is lost."""
    return ((h >> np.uint64(33 - bits)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def _level(n: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact up to 128, then eight levels to each doubling."""
    return np.where(n <= 128, n, np.minimum(255, 128 + np.ceil(8 * np.log2(np.maximum(n, 1) / 128)))).astype(np.uint8)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _blobs(schema: dict[str, pa.DataType], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None if (x := r.get(c)) is None else x.tobytes() if isinstance(x, np.ndarray) else x for r in rows], t) for c, t in schema.items()], names=list(schema))


#: Shingles of the texts of a batch in a part (`at`: a text's number in the batch, `hashes`: values, lowest bit: the text goes on), or, without these, the texts themselves.
_HELD = {"part": pa.int32(), "batch": pa.int64(), "at": pa.binary(), "hashes": pa.binary(), "texts": pa.binary(), "reach": pa.binary()}
#: Besides texts, passed on: for a batch in a part how many others hold each shingle (`held`), for a part who holds what more than one text has.
_MET = {"kind": pa.string(), "part": pa.int32(), "batch": pa.int64(), "at": pa.binary(), "held": pa.binary(), "texts": pa.binary(), "reach": pa.binary(), "hashes": pa.binary(), "upto": pa.binary(), "batches": pa.binary(), "refs": pa.binary()}
_KEYS = {"part": pa.int32(), "hash": pa.int64(), "text_hash": pa.int64(), "more": pa.int64()}
_TASK, _NUMBER = 40, 16  #: bits right of a task's number and of a batch's in that of a text
_DDL = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"`{c}` {_DDL[t]}" for c, t in schema.items())


def _shingles_of(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        anchors, batch = Anchors(), TaskContext.get().partitionId() << _TASK
        for b in batches:
            texts = b.column(0).to_numpy()
            for i, j in slices(b.column(1)):
                yield _blobs(_HELD, _held_by(anchors, bits, batch, texts[i:j], *hashed_words(b.column(1).slice(i, j - i))))
                batch += 1 << _NUMBER

    return of


def _held_by(anchors: Anchors, bits: int, batch: int, texts: np.ndarray, n: np.ndarray, words: np.ndarray) -> list[dict]:
    """Rows of `_HELD` for some texts. Of a text with m shingles the last holds its last word, which is not the copy's, and behind all but the last GOES_ON + 1 it goes on."""
    end = np.cumsum(n)
    at = np.repeat(np.arange(len(n), dtype=np.int32), n)
    m = np.maximum(n - SHINGLE + 1, 0)
    where = np.arange(len(words)) - (end - n)[at]
    fits = np.flatnonzero(where < m[at])
    at, where = at[fits], where[fits]
    q = anchors.sums_of(words)
    h = _mix((q[fits + SHINGLE] - q[fits]) * anchors.inverse[fits])
    goes_on = where < m[at] - GOES_ON - 1
    core = where < np.minimum(np.maximum(1, m - SHINGLE), m - 1)[at]
    at = at << 2 | goes_on << 1 | core
    order = np.argsort(h, kind="stable")  # of equal hashes those of a text stay together
    h, at = h[order], at[order]
    first = _starts(h, at >> 2)
    flags = np.bitwise_or.reduceat(at & 3, first) if len(first) else at
    h, at = h[first], at[first] >> 2
    reach = np.ceil(SIMILARITY * np.bincount(at[flags & 1 > 0], minlength=len(n)) - 1e-9).astype(np.int32)  # shingles that both must have
    rows = [{"part": (batch >> _NUMBER) % (1 << bits), "batch": batch, "texts": texts, "reach": reach}]
    part = (h >> np.uint64(64 - bits)).astype(np.uint16)
    values = _value(h, bits) << np.uint32(1) | (flags >> 1).astype(np.uint32)
    at = at.astype(np.uint16)
    order = np.argsort(at, kind="stable")
    order = order[np.argsort(part[order], kind="stable")]  # in a part text by text, which is smaller when compressed
    part, at, values = part[order], at[order], values[order]
    cuts = np.append(_starts(part), len(part))
    rows += [{"part": int(part[i]), "batch": batch, "at": at[i:j], "hashes": values[i:j]} for i, j in pairwise(cuts)]
    return rows


def _meet(table: pa.Table) -> pa.Table:
    """One part: how many other texts hold each shingle and go on, and the holders of those that several texts have."""
    rows = table.to_pylist()
    out = [{"kind": "texts", **{k: r[k] for k in ("batch", "texts", "reach")}} for r in rows if r["hashes"] is None]
    rows = [r for r in rows if r["hashes"] is not None]
    if rows:
        all_values = np.concatenate([np.frombuffer(r["hashes"], np.uint32) for r in rows])
        sizes = np.array([len(r["at"]) // 2 for r in rows])
        order = np.argsort(all_values >> np.uint32(1), kind="stable")
        value, on = all_values[order] >> np.uint32(1), (all_values[order] & np.uint32(1)).astype(np.int64)
        first = _starts(value)
        n, n_on = np.diff(np.append(first, len(value))), np.add.reduceat(on, first)
        held = np.empty(len(value), np.uint8)
        held[order] = _level(np.repeat(n_on, n) - on)
        cuts = np.cumsum(sizes)
        out += [{"kind": "held", "batch": r["batch"], "part": r["part"], "at": r["at"], "held": held[c - k : c]} for r, k, c in zip(rows, sizes, cuts, strict=True)]
        several = (n > 1) & (n_on > 0)
        keep = order[np.repeat(several, n) & (on > 0)]
        kind = np.uint32 if len(rows) <= 1 << 16 else np.uint64
        refs = np.repeat(np.arange(len(rows), dtype=kind), sizes)[keep] << kind(_NUMBER) | np.concatenate([np.frombuffer(r["at"], np.uint16) for r in rows])[keep]
        batches = np.array([r["batch"] for r in rows], np.int64)
        out.append({"kind": "holders", "part": rows[0]["part"], "hashes": value[first[several]], "upto": np.cumsum(n_on[several]), "batches": batches, "refs": refs})
    return pa.Table.from_batches([_blobs(_MET, out)])


def _able(table: pa.Table) -> pa.Table:
    """Of one batch the texts of whose shingles others hold as many as a pair must share, with how many hold each, in the order of hashes."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"] if r["held"] is not None else -1)
    texts, reach = np.frombuffer(rows[0]["texts"], np.int64), np.frombuffer(rows[0]["reach"], np.int32)
    at = np.concatenate([np.empty(0, np.uint16), *(np.frombuffer(r["at"], np.uint16) for r in rows[1:])])
    held = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(r["held"], np.uint8) for r in rows[1:])])
    able = (np.bincount(at[held > 0], minlength=len(texts)) >= reach) & (reach > 0)
    order = np.argsort(at, kind="stable")
    held, cuts = held[order], np.cumsum(np.bincount(at, minlength=len(texts)))
    some = np.flatnonzero(able)
    return pa.table({"text_hash": pa.array(texts[some]), "held": pa.array([held[cuts[i - 1] if i else 0 : cuts[i]].tobytes() for i in some], pa.binary())})


def _keys_of(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per copy the shingles of which a pair must share more than `more`: the rarest, without those that no other text holds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for b in batches:
            out: list[tuple] = []
            for text_hash, text, held in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                full = anchors.shingles(text.split())
                x, every = full[:-1], np.unique(full)
                if not len(x):
                    continue
                own = np.unique(x)
                n = np.frombuffer(held, np.uint8)[np.searchsorted(every, own)]
                reach = math.ceil(SIMILARITY * len(np.unique(x[: max(1, len(x) - SHINGLE + 1)])) - 1e-9)
                if np.count_nonzero(n) < reach or not n[np.searchsorted(own, x[-SHINGLE:])].any():
                    continue
                order, n_keys = np.argsort(n, kind="stable"), len(own) - reach + 1
                more = 0 if n[order[:n_keys]].sum(dtype=np.int64) <= FEW else min(MORE, len(own) - n_keys)
                keys = own[order[: n_keys + more]][n[order[: n_keys + more]] > 0]
                out += zip((keys >> np.uint64(64 - bits)).tolist(), _value(keys, bits).tolist(), [text_hash] * len(keys), [more] * len(keys), strict=True)
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KEYS.values(), strict=True)], names=list(_KEYS))

    return of


def _keys_together(table: pa.Table) -> pa.Table:
    """The keys of a part as one row."""
    value, text, more = (table.column(c).to_numpy() for c in ("hash", "text_hash", "more"))
    order = np.lexsort((text, value))
    blob = lambda x, t: pa.array([x[order].astype(t).tobytes()], pa.binary())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "keys": blob(value, np.uint32), "copies": blob(text, np.int64), "mores": blob(more, np.uint8)})


_FACING = {"bucket": pa.int32(), "copies": pa.binary(), "mores": pa.binary(), "refs": pa.binary()}


def _holders_of(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each key the copies that ask for it and the texts that hold it, by buckets of copies."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                hashes, upto, batch = np.frombuffer(r["hashes"], np.uint32), np.frombuffer(r["upto"], np.int64), np.frombuffer(r["batches"], np.int64)
                refs = np.frombuffer(r["refs"], np.uint32 if len(batch) <= 1 << 16 else np.uint64).astype(np.int64)
                keys, texts, mores = np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["mores"], np.uint8)
                bucket = (texts & ((1 << bits) - 1)).astype(np.int32)
                order = np.lexsort((bucket, keys))
                keys, texts, mores, bucket = keys[order], texts[order], mores[order], bucket[order]
                found = np.searchsorted(hashes, keys)
                rows: list[dict] = []
                for i, j in pairwise(np.append(_starts(keys, bucket), len(keys))):
                    k = found[i]
                    if k < len(hashes) and hashes[k] == keys[i]:
                        some = refs[upto[k - 1] if k else 0 : upto[k]]
                        rows.append({"bucket": int(bucket[i]), "copies": texts[i:j], "mores": mores[i:j], "refs": batch[some >> _NUMBER] + (some & ((1 << _NUMBER) - 1))})
                    if len(rows) == 1 << 10 or j == len(keys):
                        yield _blobs(_FACING, rows)
                        rows = []

    return of


def _near(table: pa.Table) -> pa.Table:
    """Of one bucket of copies the pairs that share more than `more` keys."""
    of: dict[int, tuple[int, list[np.ndarray]]] = {}
    for texts, mores, refs in zip(*(table.column(c).to_pylist() for c in ("copies", "mores", "refs")), strict=True):
        refs = np.frombuffer(refs, np.int64)
        for text, more in zip(np.frombuffer(texts, np.int64).tolist(), mores, strict=True):
            of.setdefault(text, (more, []))[1].append(refs)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for text, (more, lists) in of.items():
        refs, n = np.unique(np.concatenate(lists), return_counts=True)
        refs = refs[n > more]
        left.append(np.full(len(refs), text, np.int64))
        right.append(refs)
    return pa.table({"text_hash": np.concatenate(left), "ref": np.concatenate(right)})


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for batch, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(texts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(batch + np.arange(len(x))), pa.array(x)], names=["ref", "other"])


def others(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """(`text_hash`, `other`): all pairs of `copies` and `texts` that `compare` may verify, without most of those that it can not.

    Both have `text_hash`, each once, and `text`; copies are among the texts. Of a copy's shingles others must hold as many as a
    pair must share, and one of the last. Then a pair must share one of so many that the rest is less than it must share, of which
    the rarest are taken; of `more` than these, as many more. Shingles travel as arrays, a part of all hashes to a task.
    """
    bits = _parts_of(texts)
    held = spread(texts.select("text_hash", "text"), "text_hash").mapInArrow(_shingles_of(bits), _ddl(_HELD))
    met = materialise(held.groupBy("part").applyInArrow(_meet, _ddl(_MET)), "met-shingles")
    facts = met.filter("kind in ('texts', 'held')").select("batch", "part", "at", "held", "texts", "reach")
    able = materialise(facts.groupBy("batch").applyInArrow(_able, "text_hash bigint, held binary"), "able-copies")
    keys = copies.select("text_hash", "text").join(broadcast_if_small(able), "text_hash").select("text_hash", "text", "held")
    keys = keys.mapInArrow(_keys_of(bits), _ddl(_KEYS)).groupBy("part").applyInArrow(_keys_together, "part int, keys binary, copies binary, mores binary")
    keys = materialise(keys, "copy-keys")
    facing = met.filter("kind = 'holders'").select("part", "hashes", "upto", "batches", "refs").join(broadcast_if_small(keys), "part")
    near = facing.mapInArrow(_holders_of(bits), _ddl(_FACING)).groupBy("bucket").applyInArrow(_near, "text_hash bigint, ref bigint")
    near = materialise(near, "near-pairs")
    numbers = met.filter("kind = 'texts'").select("batch", "texts").mapInArrow(_numbered, "ref bigint, other bigint")
    return numbers.join(broadcast_if_small(near), "ref").filter("text_hash <> other").select("text_hash", "other")


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(`text_hash`) of `pairs`, as written to files, that `compare` verifies. Where the pairs are few, only their texts move."""
    copy, longer = found.select("text_hash", F.col("text").alias("copy")), found.select(F.col("text_hash").alias("other"), F.col("text").alias("longer"))
    copy = copy.join(broadcast_if_small(pairs.select("text_hash", "other")), "text_hash")
    longer = longer.join(broadcast_if_small(pairs.select("other")), "other", "left_semi")
    return copy.join(longer, "other").select("text_hash", "copy", "longer").mapInArrow(_verify, "text_hash bigint").distinct()


def early_ends(texts: DataFrame, hashes: DataFrame, entries: DataFrame) -> DataFrame:
    """(`text_hash`) of texts that end inside a longer near-copy.

    `texts` has `doc_id` and `text`, `hashes` has `doc_id` and `text_hash`. Texts of either side are
    looked up by a list of ids, broadcast where that is small, so that only these texts move.
    """
    buckets = entries.groupBy("bucket").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("z"), F.max("looked_up").alias("any")).filter("a < z and any").select("bucket")
    entries = materialise(entries.join(broadcast_if_small(materialise(buckets, "shared-buckets")), "bucket", "left_semi"), "shared-entries")
    members = entries.groupBy("text_hash").agg(F.max("looked_up").alias("looked_up"))
    ids = hashes.join(broadcast_if_small(materialise(members, "bucket-members")), "text_hash").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("looked_up").alias("looked_up"))
    found = texts.select("doc_id", "text").join(broadcast_if_small(materialise(ids, "copy-ids")), "doc_id").select("text_hash", "looked_up", "text")
    found = materialise(found, "copy-texts")
    done = materialise(_verified(materialise(neighbours(entries), "first-pairs"), found), "first-copies")
    rest = found.filter("looked_up").join(broadcast_if_small(done), "text_hash", "left_anti")
    rank = F.row_number().over(Window.partitionBy("text_hash").orderBy("other"))
    pairs = materialise(others(found, rest).withColumn("rank", rank), "other-pairs")
    ids = pairs.select("text_hash").unionByName(pairs.select(F.col("other").alias("text_hash"))).distinct()
    found = materialise(found.join(broadcast_if_small(materialise(ids, "paired-ids")), "text_hash", "left_semi"), "paired-texts")  # what the rounds read
    for after, upto in zip((0, *ROUNDS), ROUNDS, strict=False):
        more = pairs.filter((F.col("rank") > after) & (F.col("rank") <= upto)).join(broadcast_if_small(done), "text_hash", "left_anti")
        done = done.unionByName(materialise(_verified(more.select("text_hash", "other"), found), "more-copies"))
    return done
