"""Continuous periods covered by overlapping intervals, and the gaps between them.

Two levels, so that an entity with any number of intervals is never one task's work: intervals
are cut at the borders of fixed time shards and merged per (entity, shard); only pieces that
touch a shard border, at most two per entity and shard, are stitched per entity.

Intervals are half-open [start, end) in microseconds. Rows with a null entity or bound, and rows
that end at or before their start, cover nothing. Touching intervals are one period. Ties and
repeated rows change nothing. An empty input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelot.functions.timing import HOUR_US, cell_of
from tidelot.operators import scans
from tidelot.session import materialise


def _islands(df: DataFrame, by: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Merge intervals that overlap or touch within each group."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_intervals(df: DataFrame, entity: str, start: Column, end: Column, shard_us: int = 6 * HOUR_US) -> DataFrame:
    """Maximal covered periods: (`entity`, `s`, `e`).

    An interval sends its first and last shard as pieces. The whole shards between them stay one span,
    however long: spans are collapsed to the furthest reach per (entity, first whole shard) and merged
    with the pieces that touch shard borders; pieces inside of shards that a span covers are dropped,
    found by a running maximum of the spans' reach.
    """
    if shard_us <= 0:
        raise ValueError("shard_us must be positive")
    base = df.select(F.col(entity).alias("k"), start.alias("s"), end.alias("e"))
    base = base.filter(F.col("k").isNotNull() & (F.col("e") > F.col("s")))
    base = base.select("k", "s", "e", cell_of("s", shard_us).alias("a"), cell_of("e - 1", shard_us).alias("b"))
    ends = base.select(
        "k",
        F.explode(
            F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("shard"), "s", "e"))).otherwise(
                F.array(
                    F.struct(F.col("a").alias("shard"), F.col("s").alias("s"), ((F.col("a") + 1) * shard_us).alias("e")),
                    F.struct(F.col("b").alias("shard"), (F.col("b") * shard_us).alias("s"), F.col("e").alias("e")),
                )
            )
        ).alias("p"),
    ).select("k", "p.*")
    spans = base.filter(F.col("b") > F.col("a") + 1).groupBy("k", (F.col("a") + 1).alias("s")).agg(F.max("b").alias("e"))
    touches = (F.col("s") == F.col("shard") * shard_us) | (F.col("e") == (F.col("shard") + 1) * shard_us)
    local = _islands(ends, ["k", "shard"]).select("k", "s", "e", F.col("shard").alias("at"), F.lit(None).cast("bigint").alias("reach"), touches.alias("border"))
    whole = _islands(spans, ["k"]).select("k", (F.col("s") * shard_us).alias("s"), (F.col("e") * shard_us).alias("e"), F.col("s").alias("at"), F.col("e").alias("reach"), F.lit(True).alias("border"))
    pieces = materialise(whole.unionByName(local).withColumn("block", cell_of("at", 1024)), "interval-pieces")
    inner = scans.scan(pieces.filter("not border or reach is not null"), ["k"], "block", ["at", "s", "e"], tops={"covered": "reach"}).filter("not border")
    inner = inner.filter(F.col("covered").isNull() | (F.col("covered") <= F.col("at"))).select("k", "s", "e")
    border = _islands(pieces.filter("border").select("k", "s", "e"), ["k"])
    return inner.unionByName(border).select(F.col("k").alias(entity), "s", "e")


def interval_gaps(periods: DataFrame, entity: str, max_gap_us: int | None = None, shard_us: int = 6 * HOUR_US) -> DataFrame:
    """Uncovered spans between successive periods of an entity: (`entity`, `s`, `e`).

    The next period of a shard's last one comes from per-shard summaries (first start), one row
    per entity and shard, so no window runs over all periods of an entity.
    """
    p = periods.select(F.col(entity).alias("k"), "s", "e", cell_of("s", shard_us).alias("shard"))
    first = p.groupBy("k", "shard").agg(F.min("s").alias("first_s"))
    following = first.select("k", "shard", F.lead("first_s").over(Window.partitionBy("k").orderBy("shard")).alias("next_shard_s"))
    inside = p.withColumn("next_s", F.lead("s").over(Window.partitionBy("k", "shard").orderBy("s")))
    gaps = inside.join(following, ["k", "shard"]).select("k", F.col("e").alias("s"), F.coalesce("next_s", "next_shard_s").alias("e"))
    gaps = gaps.filter(F.col("e").isNotNull())
    if max_gap_us is not None:
        gaps = gaps.filter(F.col("e") - F.col("s") <= max_gap_us)
    return gaps.select(F.col("k").alias(entity), "s", "e")


def latest_version(df: DataFrame, key: str, version: str, payload: list[str]) -> DataFrame:
    """Of each key the row with the latest version; among equal versions the greatest payload, for a defined result."""
    rows = df.filter(F.col(key).isNotNull() & F.col(version).isNotNull())
    best = rows.groupBy(key).agg(F.max(F.struct(version, *payload)).alias("_v"))
    return best.select(key, "_v.*")
