"""At-least-once deliveries reduced to exactly one message per identifier, batch by batch.

The store keeps winners in partitions by the batch that first brought the identifier, and an
index from identifier to partition, itself in buckets by the identifier's hash. A batch is reduced
to its own winners, looked up in the buckets it touches, and combined only with the partitions the index names; partitions whose winners change are rewritten, identifiers never seen
before form a new partition, and one manifest publishes winners, index and surplus together.

Deliveries without an identifier are messages of their own and are not indexed. Deliveries
without an arrival cannot be ranked and are left out. Equal arrivals go by offset, then partition.
Repeated batches are skipped. Empty batches change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelot.operators.messages import RANK, first_delivered, ranked
from tidelot.operators.store import VersionedTable
from tidelot.session import Staging, at_once, scratch_dir

#: Buckets of the identifier index.
BUCKETS = 16


def bucket_of(id_: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS))


class MessageStore:
    """One message per identifier; `payload` names the columns kept beside the arrival (null-id rows included)."""

    def __init__(self, spark: SparkSession, root: str, payload: dict[str, str] | None = None, id_col: str = "event_id"):
        self.spark, self.id_col, self.payload = spark, id_col, payload or {}
        columns = "ingest_ts timestamp, kafka_offset bigint, kafka_partition int" + "".join(f", `{c}` {t}" for c, t in self.payload.items())
        self.columns = [*RANK, *self.payload]
        kinds = {
            "messages": f"id binary, part int, {columns}", "index": "id binary, part int", "surplus": "kafka_partition int, kafka_offset bigint",
            "moved": f"was struct<{columns.replace(' ', ':').replace(',:', ',')}>, now struct<{columns.replace(' ', ':').replace(',:', ',')}>",
        }
        self.table = VersionedTable(spark, root, kinds)

    def apply(self, deliveries: DataFrame, batch: int) -> bool:
        """Fold one batch in; False if it was committed before."""
        state = self.table.state()
        if state["last_batch"] is not None and batch <= state["last_batch"]:
            return False
        with Staging(self.spark, "message-batch") as staging:
            self._fold(deliveries, batch, state, staging)
        return True

    def _fold(self, deliveries: DataFrame, batch: int, state: dict, staging: Staging) -> None:
        cols, t = self.columns, self.table
        incoming = staging.write(first_delivered(deliveries, list(self.payload), self.id_col), "winners")
        # The join is on log positions, which are unique: no identifier's copies gather anywhere.
        position = ["kafka_partition", "kafka_offset"]
        lost = ranked(deliveries).select(*position).join(incoming.select(*position), position, "left_anti").distinct()
        fresh, put = incoming, {}
        if any(p.startswith("index:") for p in state["parts"]):
            touched = {f"index:{r['b']}" for r in incoming.select(bucket_of("id").alias("b")).filter("b is not null").distinct().collect()}  # at most BUCKETS
            seen = t.read([p for p in t.parts(state, "index") if p.rsplit(":", 1)[0] in touched], state, "index")
            known = staging.write(incoming.join(seen, "id"), "known")
            named = [f"messages:{r['part']}" for r in known.select("part").distinct().collect()]  # at most one per batch
            history = t.read(named, state, "messages").select("id", F.struct(*cols).alias("was"))
            pairs = known.select("id", "part", F.struct(*cols).alias("now")).join(history, "id")
            rank = lambda c: F.struct(*(f"{c}.{r}" for r in RANK))
            pairs = staging.write(pairs.select("*", (rank("now") < rank("was")).alias("moves"), (rank("now") > rank("was")).alias("loses")), "pairs")
            moved = pairs.filter("moves")
            changed = [f"messages:{r['part']}" for r in moved.select("part").distinct().collect()]
            if changed:
                new = t.read(changed, state, "messages").join(moved.select("id", "now"), "id", "left")
                new = new.select("id", "part", *(F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in cols))
                put = {f"messages:{p}": {"path": f, "stats": state["parts"][f"messages:{p}"]["stats"]} for p, f in t.write(new, F.col("part"), "messages").items()}
                put[f"moved:{batch}"] = {"path": t.write(moved, kind="moved")[""], "stats": {}}
                lost = lost.unionByName(moved.select("was.kafka_partition", "was.kafka_offset"))
            lost = lost.unionByName(pairs.filter("loses").select("now.kafka_partition", "now.kafka_offset"))
            fresh = incoming.join(known.select("id"), "id", "left_anti")
        here = (incoming if fresh is incoming else staging.write(fresh, "fresh")).withColumn("part", F.lit(batch))
        made = at_once({
            "newest": lambda: here.agg(F.max(F.unix_micros("ingest_ts"))).first()[0], "messages": lambda: t.write(here, kind="messages")[""], "surplus": lambda: t.write(lost, kind="surplus")[""],
            "index": lambda: t.write(here.filter("id is not null"), bucket_of("id"), "index"),
        })
        put[f"messages:{batch}"] = {"path": made["messages"], "stats": {"newest": made["newest"]}}
        put[f"surplus:{batch}"] = {"path": made["surplus"], "stats": {}}
        put |= {f"index:{b}:{batch}": {"path": path, "stats": {}} for b, path in made["index"].items()}
        t.vacuum(t.commit(state, put, batch=batch))

    def messages(self) -> DataFrame:
        return self.table.read(kind="messages")

    def surplus(self) -> DataFrame:
        """Deliveries that are not their identifier's message."""
        return self.table.read(kind="surplus")

    def added(self, batch: int) -> DataFrame:
        """Messages that batch `batch`, the last one applied, brought or put in another's place."""
        state = self.table.state()
        new = self.table.read([f"messages:{batch}"], state, "messages").select(*self.columns)
        return new.unionByName(self.table.read([f"moved:{batch}"], state, "moved").select("now.*")) if self.moved(batch) else new

    def kept(self, batch: int, since_us: int) -> DataFrame:
        """Messages from before batch `batch` that it left in place, of arrival `since_us` or later; partitions that ended before are not read."""
        state = self.table.state()
        parts = [p for p in self.table.parts(state, "messages") if p != f"messages:{batch}" and (state["parts"][p]["stats"]["newest"] or since_us) >= since_us]
        old = self.table.read(parts, state, "messages").select(*self.columns).filter(F.col("ingest_ts") >= F.timestamp_micros(F.lit(since_us)))
        position = ["kafka_partition", "kafka_offset"]
        return old.join(self.table.read([f"moved:{batch}"], state, "moved").select("now.*").select(*position), position, "left_anti") if self.moved(batch) else old

    def removed(self, batch: int) -> DataFrame:
        """Messages that batch `batch` put another delivery in the place of."""
        return self.table.read([f"moved:{batch}"], kind="moved").select("was.*")

    def moved(self, batch: int) -> bool:
        return f"moved:{batch}" in self.table.state()["parts"]


def replay(store: MessageStore, deliveries: DataFrame, batch_col: str, increments: int) -> None:
    """Feed a finished log to a store as consecutive ranges of `batch_col`; rows without a batch come first."""
    for i, rows in enumerate(ranges_of(deliveries, batch_col, increments)):
        store.apply(rows, i)


def ranges_of(deliveries: DataFrame, batch_col: str, increments: int) -> list[DataFrame]:
    return batch_ranges(deliveries, batch_col, increments, *deliveries.agg(F.min(batch_col), F.max(batch_col)).first())


def batch_ranges(df: DataFrame, batch_col: str, increments: int, lo: int | None, hi: int | None) -> list[DataFrame]:
    """`df` cut into `increments` ranges of `batch_col`, filtered so that Parquet statistics skip the other ranges."""
    if lo is None:
        return [df]
    step = max(1, -(-(hi - lo + 1) // increments))
    b = F.col(batch_col)
    cuts = [lo + i * step for i in range(1, increments) if lo + i * step <= hi]
    lows, highs = [None, *cuts], [*cuts, None]
    conds = []
    for a, z in zip(lows, highs, strict=True):
        c = F.lit(True) if a is None else b >= a
        c = c if z is None else c & (b < z)
        conds.append((c | b.isNull()) if a is None else c)
    return [df.filter(c) for c in conds]


def new_store(spark: SparkSession, payload: dict[str, str] | None = None) -> MessageStore:
    return MessageStore(spark, scratch_dir(spark, "message-store"), payload)
