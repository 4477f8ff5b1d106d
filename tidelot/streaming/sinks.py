"""Sinks for `foreachBatch` that may see a batch again: state moves by one atomic commit that names the batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelot.functions.timing import DAY_US, cell_of
from tidelot.operators import upserts
from tidelot.operators.redelivery import MessageStore
from tidelot.operators.sessions import SessionTable, session_cells
from tidelot.operators.store import VersionedTable
from tidelot.streaming.processor import OccupancyTable


class UpsertTable:
    """Rows by key, partitioned by day of a time in microseconds; a batch rewrites the days it touches.

    `final` marks rows that only rows with it replace. Of a key's rows in one batch the greatest by
    `order` counts, and final ones before others. A key's day must not change.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], day_of: str, order: list[str], final: str | None = None):
        self.table = VersionedTable(spark, root, schema)
        self.keys, self.day, self.order, self.final = keys, cell_of(f"`{day_of}`", DAY_US), order, final

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        state = self.table.state()
        if state["last_batch"] is not None and batch_id <= state["last_batch"]:
            return False
        rows = batch.select(*self.table.schema.fieldNames())
        days = [str(r["_day"]) for r in rows.select(self.day.alias("_day")).distinct().collect()]  # bounded by the batch's time span; `write` refuses rows without a day
        best: list[Column] = [F.col(c) for c in self.order]
        merged = upserts.merge(self.table.read(days, state), rows, self.keys, best, F.col(self.final) if self.final else None)
        folders = self.table.write(merged, self.day)
        self.table.vacuum(self.table.commit(state, {d: {"path": p, "stats": {}} for d, p in folders.items()}, batch=batch_id))
        return True

    def read(self) -> DataFrame:
        return self.table.read()


WINDOW_SCHEMA = "lot_id string, window_start bigint, area_us bigint, covered_us bigint, min_occupied bigint, max_occupied bigint, entries bigint, exits bigint, occupied bigint, closed boolean, latest_arrival_us bigint"


def window_table(spark: SparkSession, root: str) -> UpsertTable:
    """Windows of an `OccupancyTable`: within a batch the widest coverage is the newest; closed is final."""
    return UpsertTable(spark, root, WINDOW_SCHEMA, ["lot_id", "window_start"], "window_start", ["covered_us", "area_us"], "closed")


def split_outputs(windows: UpsertTable, side: str) -> Callable[[OccupancyTable, int], None]:
    """What follows a fold: windows are upserted, late rows and signals appended under `side`/<kind>/batch=<id>, each batch once."""

    def write(table: OccupancyTable, batch: int) -> None:
        for kind in ("late", "signals"):
            table.output(kind, batch).write.mode("overwrite").parquet(f"{side}/{kind}/batch={batch}")
        windows.apply(table.output("results", batch), batch)

    return write


def fold_sessions(table: SessionTable, keys: list[str], ts_us: str) -> Callable[[DataFrame, int], None]:
    """Fold each micro-batch of events into a session table."""
    return lambda batch, batch_id: table.apply(session_cells(batch, keys, ts_us, table.gap_us), batch_id) and None


def fold_deliveries(store: MessageStore) -> Callable[[DataFrame, int], None]:
    """Fold each micro-batch of deliveries into a message store."""
    return lambda batch, batch_id: store.apply(batch, batch_id) and None


def notify(senders: list[Callable[[list[dict]], None]], limit: int = 1000) -> Callable[[DataFrame, int], None]:
    """Hand alert rows to senders, in pages of `limit`; a sender that fails does not stop the others or the stream."""

    def send(batch: DataFrame, batch_id: int) -> None:
        page: list[dict] = []
        for row in batch.toLocalIterator():
            page.append(row.asDict(recursive=True))
            if len(page) == limit:
                _deliver(senders, page)
                page = []
        if page:
            _deliver(senders, page)

    return send


def _deliver(senders: list[Callable[[list[dict]], None]], page: list[dict]) -> int:
    failures = 0
    for s in senders:
        try:
            s(page)
        except Exception:  # a notifier must not stop the pipeline
            failures += 1
    return failures
