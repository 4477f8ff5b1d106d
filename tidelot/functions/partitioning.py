"""Kafka's key partitioner: 32-bit murmur2 of the key's bytes, without sign, modulo the partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
SEED, MULTIPLIER = 0x9747B28C, 0x5BD1E995


def murmur2_many(keys: list[bytes]) -> np.ndarray:
    """Hashes of many keys at once: keys of one length are rows of a matrix, mixed column by column in wrapping 32-bit arithmetic."""
    out = np.zeros(len(keys), np.uint32)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    m = np.uint32(MULTIPLIER)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), int(size))
        whole = int(size) // 4
        words = np.ascontiguousarray(raw[:, : whole * 4]).view("<u4") if whole else np.zeros((len(rows), 0), np.uint32)
        h = np.full(len(rows), SEED ^ int(size), np.uint32)
        for w in words.T:
            k = w * m
            h = h * m ^ (k ^ k >> np.uint32(24)) * m
        rest = raw[:, whole * 4 :].astype(np.uint32)
        if rest.shape[1]:
            for i in range(rest.shape[1]):
                h ^= rest[:, i] << np.uint32(8 * i)
            h *= m
        h ^= h >> np.uint32(13)
        h *= m
        out[rows] = h ^ h >> np.uint32(15)
    return out


def murmur2(key: str | Column) -> Column:
    """Hash as a bigint within 0 and 2^32 - 1; null for a null key."""

    @F.pandas_udf("bigint")
    def hashed(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype="Int64")
        if known.any():
            out[known] = murmur2_many([x.encode() for x in s[known]]).astype(np.int64)
        return out

    return hashed(key)


def partition_of(key: str | Column, partitions: int) -> Column:
    return F.pmod(murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(partitions)).cast("int")


def balanced_ids(count: int, partitions: int, prefix: str = "LOT-", candidates: int = 999) -> list[str]:
    """The first `count` ids prefix01, prefix02, ... that put no more than their share in any partition."""
    names = [f"{prefix}{n:02d}" for n in range(1, candidates + 1)]
    places = (murmur2_many([n.encode() for n in names]) & np.uint32(0x7FFFFFFF)) % np.uint32(partitions)
    share, used, out = -(-count // partitions), [0] * partitions, []
    for name, place in zip(names, places.tolist(), strict=True):
        if len(out) < count and used[place] < share:
            used[place] += 1
            out.append(name)
    if len(out) < count:
        raise ValueError("not enough candidates")
    return out
