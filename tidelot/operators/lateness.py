"""Event-time aggregates that late records correct until a cut-off.

Messages of an entity are judged in arrival order against the highest event time that arrived
before. That running maximum is a two-level scan: windows over (entity, arrival shard), plus the
maximum of all earlier shards taken from one summary row per entity and shard.

The state of a period is a multiset: how often each value was accepted. A late record adds to a
count, so medians, distincts and extremes are re-derived exactly and never from a sketch. Counts
of disjoint batches add up, which makes states mergeable.

`LatenessTable` stores both: the multisets by day of their period, and the highest event time of each
entity and arrival shard. A batch is judged against what was heard before it, its multiset is added
to the stored ones, and only days whose counts change are replaced. Rows that arrived before rows
already stored change how those are judged: the shards from the earliest such arrival on are judged
again as they were and as they are, and the difference is added.

Rows without entity, event time or arrival are left out. Equal arrivals are ordered by `seq`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelot.functions.timing import DAY_US, HOUR_US, cell_of, floor_to
from tidelot.operators.store import VersionedTable
from tidelot.session import Staging, at_once


def heard_before(df: DataFrame, entity: str, event_us: str, arrival_us: str, seq: str, shard_us: int = HOUR_US, carried: DataFrame | None = None) -> DataFrame:
    """`df` plus `heard_us`: the entity's highest event time among rows that arrived before (null for the first).

    `carried` (`entity`, `top`) holds what entities heard before the first row of `df`.
    """
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in [entity, event_us, arrival_us, seq]))
    rows = rows.withColumn("_shard", cell_of(f"`{arrival_us}`", shard_us))
    summary = rows.groupBy(entity, "_shard").agg(F.max(event_us).alias("_top"))
    carry = summary.select(entity, "_shard", F.max("_top").over(Window.partitionBy(entity).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    if carried is not None:
        carry = carry.join(carried.select(F.col("entity").alias(entity), "top"), entity, "left").withColumn("_carry", F.greatest("_carry", "top")).drop("top")
    inside = Window.partitionBy(entity, "_shard").orderBy(arrival_us, seq).rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumn("_local", F.max(event_us).over(inside)).join(carry, [entity, "_shard"])
    # `greatest` skips nulls: the first row of a shard hears only what earlier shards carried.
    return scanned.withColumn("heard_us", F.greatest("_local", "_carry")).drop("_local", "_carry", "_shard")


def classify(df: DataFrame, event_us: str, window_us: int, cutoff_us: int) -> DataFrame:
    """`df` with `window_start_us`, `late` (its window had ended) and `rejected` (beyond the cut-off after that)."""
    end = F.col("window_start_us") + window_us
    heard = F.coalesce(F.col("heard_us"), F.lit(-(1 << 62)))
    return df.withColumn("window_start_us", floor_to(f"`{event_us}`", window_us)).withColumns({"late": heard >= end, "rejected": heard > end + cutoff_us})


def multiset(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """State of classified rows: per (`keys`, `value`) how many were on time, late but accepted, and rejected."""
    count = lambda c: F.count_if(c).alias
    ok = ~F.col("rejected")
    return df.groupBy(*keys, value.alias("value")).agg(
        count(ok & ~F.col("late"))("n_on_time"), count(ok & F.col("late"))("n_corrected"), count(F.col("rejected"))("n_rejected")
    )


def merge_states(keys: list[str], *states: DataFrame) -> DataFrame:
    """The multiset of all rows behind several states."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy(*keys, "value").agg(*(F.sum(c).alias(c) for c in ("n_on_time", "n_corrected", "n_rejected")))


def period_counts(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per period: accepted and rejected rows, and how many of either came late."""
    accepted = F.col("n_on_time") + F.col("n_corrected")
    return state.groupBy(*keys).agg(
        F.sum(accepted).alias("n_accepted"), F.sum("n_rejected").alias("n_rejected"), F.sum(F.col("n_corrected") + F.col("n_rejected")).alias("n_late")
    )


def period_statistics(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per period, over accepted rows with a value: count, distinct, least, greatest and lower median by cumulative counts."""
    rows = state.withColumn("_n", F.col("n_on_time") + F.col("n_corrected")).filter("_n > 0 and value is not null")
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_upto": upto, "_all": F.sum("_n").over(w)})
    middle = F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("value"))
    return rows.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.min(middle).alias("median")
    )


class LatenessTable:
    """Multisets per entity and period that batches are folded into; rows are (`entity`, `ts`, `arrival`, `seq`, `counted`, `value`), times in microseconds.

    Rows with `counted` false are heard but belong to no period.
    """

    _COUNTS = ("n_on_time", "n_corrected", "n_rejected")

    def __init__(self, spark: SparkSession, root: str, window_us: int, cutoff_us: int, shard_us: int = HOUR_US, part_us: int = DAY_US):
        self.window_us, self.cutoff_us, self.shard_us, self.part_us = window_us, cutoff_us, shard_us, part_us
        counts = "entity string, window_start_us bigint, value bigint, n_on_time bigint, n_corrected bigint, n_rejected bigint"
        self.table = VersionedTable(spark, root, {"counts": counts, "tops": "entity string, shard bigint, top bigint"})

    def _multiset(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        heard = heard_before(rows, "entity", "ts", "arrival", "seq", self.shard_us, carried).filter("counted")
        return multiset(classify(heard, "ts", self.window_us, self.cutoff_us), ["entity", "window_start_us"], F.col("value"))

    def apply(self, added: DataFrame, batch: int, removed: DataFrame | None = None, kept: Callable[[int], DataFrame] | None = None) -> bool:
        """Fold a batch in; False if it was committed before.

        `removed` are rows of earlier batches that no longer hold. `kept(since)` gives the rows of earlier
        batches that hold and arrived at `since` or later; without it all rows must arrive after those stored.
        """
        state = self.table.state()
        if state["last_batch"] is not None and batch <= state["last_batch"]:
            return False
        with Staging(self.table.spark, "lateness-batch") as staging:
            self._fold(added, batch, removed, kept, state, staging)
        return True

    def _fold(self, added: DataFrame, batch: int, removed: DataFrame | None, kept: Callable[[int], DataFrame] | None, state: dict, staging: Staging) -> None:
        cols = ["entity", "ts", "arrival", "seq", "counted", "value"]
        clean = lambda df: df.select(*cols).filter("entity is not null and ts is not null and arrival is not null and seq is not null")
        shard = cell_of("arrival", self.shard_us)
        new = staging.write(clean(added), "added")
        gone = None if removed is None else staging.write(clean(removed), "removed")
        both = new if gone is None else new.unionByName(gone)
        points = staging.write(both.groupBy("entity").agg(F.min(shard).alias("point")), "points")
        since = points.agg(F.min("point")).first()[0]
        before = self.table.read(state=state, kind="tops")
        carried = staging.write(before.join(points, "entity").filter("shard < point").groupBy("entity").agg(F.max("top").alias("top")), "carried")
        tail = None
        if kept is not None and since is not None:  # from the shard of the earliest change on, what is stored is judged again
            tail = clean(kept(since * self.shard_us)).join(points, "entity").filter(shard >= F.col("point")).select(*cols)
            tail = staging.write(tail, "tail")
        now = new if tail is None else staging.write(tail.unionByName(new), "now")
        delta = self._multiset(now, carried)
        was = [x for x in (tail, gone) if x is not None]
        if was:
            less = self._multiset(was[0] if len(was) == 1 else was[0].unionByName(was[1]), carried)
            delta = merge_states(["entity", "window_start_us"], delta, less.select("entity", "window_start_us", "value", *((-F.col(c)).alias(c) for c in self._COUNTS)))
        some = " or ".join(f"{c} <> 0" for c in self._COUNTS)
        delta = staging.write(delta.filter(some), "delta")
        day = cell_of("window_start_us", self.part_us)
        touched = [f"counts:{r['d']}" for r in delta.select(day.alias("d")).distinct().collect()]  # bounded by the batch's time span
        merged = merge_states(["entity", "window_start_us"], self.table.read(touched, state, "counts"), delta).filter(some)
        tops = now.groupBy("entity", shard.alias("shard")).agg(F.max("ts").alias("top"))
        part = F.expr(f"shard div {max(1, self.part_us // self.shard_us)}")
        renewed = [f"tops:{r['d']}" for r in both.select(shard.alias("shard")).select(part.alias("d")).distinct().collect()]
        later = [p for p in self.table.parts(state, "tops") if since is not None and int(p.split(":")[1]) >= since // max(1, self.part_us // self.shard_us)]
        renewed = sorted({*renewed, *later})
        stored = self.table.read(renewed, state, "tops").join(points, "entity", "left").filter("point is null or shard < point").drop("point")
        made = at_once({"counts": lambda: self.table.write(merged, day, "counts"), "tops": lambda: self.table.write(stored.unionByName(tops), part, "tops")})
        put = {f"{kind}:{d}": {"path": f, "stats": {}} for kind, folders in made.items() for d, f in folders.items()}
        self.table.vacuum(self.table.commit(state, put, drop=[*touched, *renewed], batch=batch))

    def state(self) -> DataFrame:
        """(`entity`, `window_start_us`, `value`, `n_on_time`, `n_corrected`, `n_rejected`)."""
        return self.table.read(kind="counts")
