"""Distinct counts from registers of minimum exponential hash values.

Every identifier gets k independent Exp(1) values from its hash; register j of a set holds the
least j-th value of its members, which is Exp(n) for n different members. Registers of a union
are the elementwise minimum, so partial sketches merge in any order and repeated identifiers
change nothing. The registers' sum is Gamma(k, rate n): (k - 1) / sum is an unbiased count with
relative standard error 1 / sqrt(k - 2), and gamma quantiles over the sum bound n.

A sketch of at most k / 2 members keeps their hashes, from which the registers follow, and so takes
eight bytes a member; the estimate is always that of the registers.

Rows with a null identifier are left out; null keys form groups of their own; a group without rows has no sketch. One distinct
identifier, or a billion, take the same k registers. Each task folds its rows into at most
`MAX_OPEN` groups before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Groups that a task holds open before it passes its partial sketches on.
MAX_OPEN = 4096
#: Ways that partial sketches of one group are merged in parallel before the last merge.
FAN = 16

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def exponentials(hashes: np.ndarray, k: int) -> np.ndarray:
    """(len(hashes), k) float32 Exp(1) values: a counter-based 64-bit mixer over (hash, register)."""
    x = hashes.astype(np.uint64)[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    unit = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return (-np.log(unit)).astype(np.float32)


#: What a sketch's bytes begin with: its members' hashes while they take less room than registers, or the registers.
_FEW, _MANY = b"h", b"r"


def pack(hashes: np.ndarray | None, registers: np.ndarray | None) -> bytes:
    return _FEW + hashes.tobytes() if registers is None else _MANY + registers.tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(hashes, None) or (None, registers)."""
    return (np.frombuffer(raw, np.int64, offset=1), None) if raw[:1] == _FEW else (None, np.frombuffer(raw, np.float32, offset=1))


def registers_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Least exponential values of a set of hashes, in steps of bounded memory."""
    out = np.full(k, np.inf, np.float32)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, exponentials(hashes[at : at + 2048], k).min(axis=0), out=out)
    return out


class _Groups:
    """Sketches by group key, passed on when too many are open."""

    def __init__(self, schema: pa.Schema, k: int):
        self.schema, self.k, self.open = schema, k, {}

    def fold(self, key: tuple, hashes: np.ndarray | None, registers: np.ndarray | None) -> None:
        """Unite a group with hashes, or with registers."""
        mine, low = self.open.get(key, (None, None))
        if hashes is not None:
            mine = hashes if mine is None else np.concatenate([mine, hashes])
        if registers is not None:
            low = registers.copy() if low is None else np.minimum(low, registers)
        if mine is not None and (low is not None or 2 * len(mine) > self.k):
            mine = np.unique(mine)
            if low is not None or 2 * len(mine) > self.k:
                more = registers_of(mine, self.k)
                low, mine = more if low is None else np.minimum(low, more), None
        self.open[key] = (mine, low)

    def flush(self, but: tuple | None = None) -> pa.RecordBatch:
        """Pass on all groups, except the one named `but`, which sorted input may go on with."""
        kept = {but: self.open.pop(but)} if but is not None else {}
        keys = list(self.open)
        packed = [pack(h if h is None else np.unique(h), r) for h, r in self.open.values()]
        cols = [[key[i] for key in keys] for i in range(len(self.schema) - 1)] + [packed]
        self.open = kept
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)


def _arrow_schema(df: DataFrame, keys: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(StructType([df.schema[k] for k in keys])), pa.field("registers", pa.binary())])


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "registers binary"])


def sketch(df: DataFrame, keys: list[str], identifier: str, k: int = 1024) -> DataFrame:
    """One mergeable sketch per group: (`keys`, `registers`). `identifier` is hashed to 64 bits JVM-side."""
    if k < 3:
        raise ValueError("k must be at least 3")
    rows = df.filter(F.col(identifier).isNotNull()).select(*keys, F.xxhash64(identifier).alias("_h"))
    schema = _arrow_schema(rows, keys)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(schema, k)
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for i in range(len(keys)):
                d = b.column(i).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]  # never above the number of rows
            h = b.column(len(keys)).to_numpy(zero_copy_only=False)
            pairs, where = np.unique(np.rec.fromarrays([code, h]), return_index=True)
            code, h = pairs["f0"], pairs["f1"]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            shown = pa.array(where[starts])
            names = list(zip(*(b.column(i).take(shown).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * len(starts)
            for key, a, z in zip(names, starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True):
                groups.fold(key, h[a:z], None)
                if len(groups.open) > MAX_OPEN:
                    yield groups.flush()
        yield groups.flush()

    return merge(rows.mapInArrow(partials, _ddl(rows, keys)), keys, k)


def merge(sketches: DataFrame, keys: list[str], k: int = 1024) -> DataFrame:
    """Union of sketches per group (null keys form a group): each task merges its own, then `FAN` ways per group, then one."""
    schema = _arrow_schema(sketches, keys)
    ddl = _ddl(sketches, keys)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(schema, k)
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * b.num_rows
            for key, raw in zip(names, b.column(len(keys)), strict=True):
                groups.fold(key, *unpack(raw.as_py()))
                if len(groups.open) > MAX_OPEN:
                    yield groups.flush(but=key)
        yield groups.flush()

    local = sketches.select(*keys, "registers").mapInArrow(combine, ddl)
    salted = local.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    wide = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys).drop("_salt").mapInArrow(combine, ddl)
    if not keys:
        return wide.repartition(1).mapInArrow(combine, ddl)  # at most FAN rows
    return wide.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(combine, ddl)


def counts(sketches: DataFrame, k: int = 1024, confidence: float = 0.95) -> DataFrame:
    """Unbiased `estimate` with `ci_low`, `ci_high` and `relative_error` (one standard error) per sketch.

    Gamma quantiles by the Wilson-Hilferty cube, good to six digits for k of 100 and more.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    quantile = lambda s: k * (1 - 1 / (9 * k) + s * z / (3 * k**0.5)) ** 3

    @F.pandas_udf("double")
    def total(r):
        def one(raw: bytes) -> float:
            few, low = unpack(raw)
            return float((registers_of(few, k) if low is None else low).sum(dtype=np.float64))

        return r.map(one)

    s = F.col("_sum")
    out = sketches.withColumn("_sum", total("registers"))
    return out.withColumns(
        {"estimate": (k - 1) / s, "ci_low": quantile(-1) / s, "ci_high": quantile(1) / s, "relative_error": F.lit((k - 2) ** -0.5)}
    ).drop("_sum")
