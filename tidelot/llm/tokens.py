"""Encoding a text column with a public byte-level tokenizer, and decoding it again.

Texts travel as Arrow batches; the tokenizer is loaded once per Python worker. Null and empty
texts give the empty list. Strings of special tokens inside a text are ordinary text. Texts are
encoded whole, whatever their length; a worker encodes `BATCH_CHARS` characters at a time, so its
memory follows the longest text and not the batch. A kept column named like a result column gives
way to the result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless a caller names another file.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
BATCH_CHARS = 1 << 20
#: What the ByteLevel pre-tokenizer splits by, possessive where that changes nothing, and runs of blanks too long for a backtracking matcher.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LONG = 10_000
_LONG_BLANK = re.compile(r"\s{%d}" % _LONG)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> dict[str, int]:
    """Character to byte in a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for 256, 257 and on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes by token id; special tokens are their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table, special = byte_alphabet(), {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    size = 1 + max([*spec["model"]["vocab"].values(), *special])
    out = [b""] * size
    for token, i in spec["model"]["vocab"].items():
        out[i] = special[i].encode() if i in special else bytes(table[c] for c in token)
    for i, s in special.items():
        out[i] = s.encode()
    return out


def _in_merge_order(spec: dict) -> bool:
    """Whether a file holds plain byte-level BPE whose ids are its merges' order: then ranks of bytes say all."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and model.get("type") == "BPE" and all(t["special"] for t in spec.get("added_tokens", []))
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(m, -1) for m in merged]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return all(a < b for a, b in zip([255, *ids], ids, strict=False)) and model["vocab"].keys() - special == {*byte_alphabet(), *merged} - special


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids: by tiktoken where it is there and the file allows, which gives the same ids in a quarter of the time."""
    t = load(path)
    by_library = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    try:
        import tiktoken
    except ImportError:
        return by_library
    if not _in_merge_order(spec):
        return by_library
    special = {t["id"] for t in spec.get("added_tokens", [])}
    ranks = {b: i for i, b in enumerate(token_bytes(path)) if b and i not in special}
    fast = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [by_library([x])[0] if len(x) >= _LONG and _LONG_BLANK.search(x) else fast(x) for x in texts]


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive slices of about `BATCH_CHARS` characters, nulls as empty texts."""
    now, size = [], 0
    for t in texts:
        now.append(t or "")
        size += len(now[-1])
        if size >= BATCH_CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def _lists(parts: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(parts), np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, text: str, keep: list[str], tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(`keep`, `ids`): token ids of each text, without special tokens."""
    keep = [c for c in keep if c != "ids"]
    rows = df.select(*keep, F.col(text).alias("_text"))
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for b in batches:
            at = 0
            for part in _slices(b.column(len(keep)).to_pylist()):
                ids = _lists(ids_of(part))
                head = b.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*(head.column(i) for i in range(len(keep))), ids], names=[*keep, "ids"])

    return rows.mapInArrow(work, ddl)


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(`keep`, `n_tokens`)."""
    keep = [c for c in keep if c != "n_tokens"]
    rows = df.select(*keep, F.col(text).alias("_text"))
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(tokenizer)
        for b in batches:
            n = [len(e) for part in _slices(b.column(len(keep)).to_pylist()) for e in t.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(work, ddl)


def offsets(ids: list[int], text: str, table: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Byte starts and ends, and the characters they touch: a token that ends inside a character reaches to its end."""
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # character that each byte belongs to
    if not len(ends):
        return [], [], [], []
    return starts.tolist(), ends.tolist(), char[starts].tolist(), (char[ends - 1] + 1).tolist()


def encode_with_offsets(df: DataFrame, text: str, keep: list[str], tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(`keep`, `ids`, `byte_start`, `byte_end`, `char_start`, `char_end`), offsets half-open, in the text's UTF-8 bytes and characters."""
    names = ["ids", "byte_start", "byte_end", "char_start", "char_end"]
    keep = [c for c in keep if c not in names]
    rows = df.select(*keep, F.col(text).alias("_text"))
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} array<int>" for n in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, table = load(tokenizer), token_bytes(tokenizer)
        for b in batches:
            at = 0
            for part in _slices(b.column(len(keep)).to_pylist()):
                ids = [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
                spans = [offsets(i, s, table) for i, s in zip(ids, part, strict=True)]
                head = b.slice(at, len(part))
                at += len(part)
                cols = [_lists(ids), *(_lists([s[k] for s in spans]) for k in range(4))]
                yield pa.RecordBatch.from_arrays([*(head.column(i) for i in range(len(keep))), *cols], names=[*keep, *names])

    return rows.mapInArrow(work, ddl)


def decode(df: DataFrame, ids: str, keep: list[str], tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """(`keep`, `text`, `lead`, `tail`): the text of token ids.

    A slice of a document's ids may begin or end inside a character: those bytes are not guessed at
    but given as `lead` and `tail`, so that neighbouring slices join exactly. Null gives null text.
    """
    keep = [c for c in keep if c not in ("text", "lead", "tail")]
    rows = df.select(*keep, F.col(ids).alias("_ids"))
    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "text string, lead binary, tail binary"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_bytes(tokenizer), pa.large_binary())
        for b in batches:
            ids = b.column(len(keep))
            flat = table.take(ids.flatten())
            ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(ids), 0).to_numpy()]))
            raw = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat), pa.scalar(b"", pa.large_binary()))
            texts = [(None, None, None) if not known else split_characters(r) for r, known in zip(raw.to_pylist(), ids.is_valid().to_pylist(), strict=True)]
            cols = [pa.array([x[k] for x in texts], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, "text", "lead", "tail"])

    return rows.mapInArrow(work, ddl)


def split_characters(raw: bytes) -> tuple[str, bytes, bytes]:
    """Whole characters of a byte slice, and the bytes of a character begun before it or not finished in it."""
    a = 0
    while a < min(3, len(raw)) and raw[a] & 0xC0 == 0x80:
        a += 1
    z = len(raw)
    for back in range(1, min(4, z - a) + 1):
        first = raw[z - back]
        if first & 0xC0 != 0x80:
            need = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if need > back:
                z -= back
            break
    return raw[a:z].decode("utf-8", "replace"), raw[:a], raw[z:]
