"""Sessions: events of a key that follow each other by at most a gap.

`session_cells` reduces events to one row per key and gap-wide cell before the shuffle: two events
in one cell are never more than a gap apart, so a cell lies within one session, and a key with any
number of events is at most (time span / gap) rows. `SessionTable` keeps sessions as a table
that batches are folded into.

Events with a null key column or time are left out. Ties and repeated rows fall into one session
(and count once per row). Events exactly a gap apart share a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelot.functions.timing import DAY_US, cell_of
from tidelot.operators.store import VersionedTable


def session_cells(df: DataFrame, keys: list[str], ts_us: str, gap_us: int, also: list[str] = ()) -> DataFrame:
    """(`keys`, `also`, `s`, `e`, `n`): first, last and number of events per gap-wide cell."""
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in [*keys, ts_us]))
    cells = rows.groupBy(*keys, *also, cell_of(f"`{ts_us}`", gap_us).alias("_cell"))
    return cells.agg(F.min(ts_us).alias("s"), F.max(ts_us).alias("e"), F.count(F.lit(1)).alias("n")).drop("_cell")


def join_spans(spans: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Merge spans (`s`, `e`, `n`) of a key whose distance is at most the gap."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("s") - reach > gap_us), 1).otherwise(0))
    marked = marked.withColumn("_session", F.sum("_new").over(w))
    merged = marked.groupBy(*keys, "_session").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
    return merged.drop("_session")


def sessionize(df: DataFrame, keys: list[str], ts_us: str, gap_us: int) -> DataFrame:
    """All sessions of a finished input in one pass."""
    return join_spans(session_cells(df, keys, ts_us, gap_us), keys, gap_us)


class SessionTable:
    """Sessions stored by day of their start; a batch rewrites only the days it can reach.

    A batch is reduced to local sessions. Stored days whose span lies within a gap of the batch's
    span are read (the manifest holds each day's first start and last end), merged with the local
    sessions, which joins stored sessions that the batch bridges, and replaced in one commit.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], gap_us: int, part_us: int = DAY_US):
        self.keys, self.gap_us, self.part_us = keys, gap_us, part_us
        schema = ", ".join([*(f"`{k}` string" for k in keys), "s bigint", "e bigint", "n bigint"])
        self.table = VersionedTable(spark, root, schema)

    def apply(self, spans: DataFrame, batch: int, again: DataFrame | None = None) -> bool:
        """Fold local spans (`keys`, `s`, `e`, `n`) in; False if that batch was committed before.

        `again` holds all spans of keys of which events were withdrawn: their stored sessions are dropped
        and made from these, and `spans` must not hold those keys.
        """
        state = self.table.state()
        if state["last_batch"] is not None and batch <= state["last_batch"]:
            return False
        local = join_spans(spans if again is None else spans.unionByName(again), self.keys, self.gap_us)
        # One row per day bounds what the driver sees by the batch's time span.
        day = cell_of("s", self.part_us)
        reach = local.groupBy(day.alias("d")).agg(F.min("s").alias("lo"), F.max("e").alias("hi")).collect()
        near = lambda p: any(p["lo"] <= r["hi"] + self.gap_us and r["lo"] - self.gap_us <= p["hi"] for r in reach)
        days = {str(r["d"]) for r in reach}
        touched = [name for name, p in state["parts"].items() if again is not None or name in days or near(p["stats"])]
        stored = self.table.read(touched, state)
        if again is not None:
            stored = stored.join(again.select(*self.keys).distinct(), self.keys, "left_anti")
        merged = join_spans(stored.unionByName(local.select(*stored.columns)), self.keys, self.gap_us)
        # A merged session starts in a day of the batch or where a touched session started: no other day is written.
        folders = self.table.write(merged, day)
        put = {}
        if folders:
            base = next(iter(folders.values())).rpartition("/")[0]
            wrote = self.table.spark.read.schema("s bigint, e bigint, _part string").option("basePath", base).parquet(base)
            stats = {r["_part"]: r for r in wrote.groupBy("_part").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).collect()}
            put = {d: {"path": f, "stats": {"lo": stats[d]["lo"], "hi": stats[d]["hi"]}} for d, f in folders.items()}
        new = self.table.commit(state, put, drop=touched, batch=batch)
        self.table.vacuum(new)
        return True

    def sessions(self) -> DataFrame:
        return self.table.read()
