"""Keyed upserts: which version of a key stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """The row of each key that is greatest by `best` (nulls least); a null key is no key and is dropped.

    Aggregated as one struct, so that map tasks pass on one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    x = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    x = x.groupBy(*keys).agg(F.max(F.struct(*(b.alias(f"_b{i}") for i, b in enumerate(best)), *rest)).alias("_m"))
    return x.select(*keys, *(F.col(f"_m.{c}").alias(c) for c in rest)).select(*df.columns)


def closed_is_final(windows: DataFrame, order: list[Column]) -> DataFrame:
    """Windows by lot and start after all upserts in `order`: the last one wins, but an open one never replaces a closed one."""
    return keep_one(windows, ["lot_id", "window_start"], [F.col("closed"), *order])


def merge(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], final: Column | None = None) -> DataFrame:
    """`stored` after the rows of `batch` were upserted; rows with `final` are only replaced by rows with it."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    best = ([final] if final is not None else []) + [F.col("_new"), *order]
    return keep_one(both, keys, best).drop("_new")


def insert_missing(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`stored` and, of each key that it lacks, the row greatest by `order`."""
    first = keep_one(batch, keys, order)
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))
