"""Alerts: threshold latches with hysteresis, lifecycles and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelot.functions.numbers import rounded_ratio
from tidelot.operators import scans


def hysteresis(
    readings: DataFrame, key: str, at: str, seq: list[str], fraction: str, raise_at: float = 0.90, clear_at: float = 0.85, shard: str | None = None, keep: tuple[str, ...] = (), latched: DataFrame | None = None
) -> DataFrame:
    """Edges of a latch: (`key`, `at`, columns of `seq`, `keep`, `state`) where it is raised at `raise_at` or above and cleared at `clear_at` or below.

    Readings in between keep the state; the first state is cleared, or raised for the keys of `latched`
    (see `restore`). Readings older than one already seen (by `at` in order of `seq`) are stale and
    ignored; equal ones count. `shard` is a column that does not decrease with `seq` and shares a busy key out.
    """
    if clear_at <= 0 or raise_at > 1 or clear_at >= raise_at:
        raise ValueError(f"a latch can not be raised at {raise_at} and cleared at {clear_at}")
    x = readings.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(fraction).isNotNull())
    rest = list(dict.fromkeys(c for c in (*seq, *keep) if c != at))
    x = x.select(key, at, *rest, F.col(fraction).alias("_fraction"), (F.col(shard) if shard else F.lit(0)).alias("_shard"))
    x = scans.scan(x, [key], "_shard", seq, tops={"_newest": at}).filter(F.col("_newest").isNull() | (F.col(at) >= F.col("_newest")))
    decided = x.withColumn("state", F.when(F.col("_fraction") >= raise_at, "RAISED").when(F.col("_fraction") <= clear_at, "CLEARED")).filter("state is not null")
    edges = scans.scan(decided.drop("_newest"), [key], "_shard", seq, lags={"_was": "state"})
    first = F.lit("CLEARED")
    if latched is not None:
        edges = edges.join(latched.select(key, F.lit("RAISED").alias("_latched")).distinct(), key, "left")
        first = F.coalesce("_latched", F.lit("CLEARED"))
    return edges.filter(F.col("state") != F.coalesce("_was", first)).select(key, at, *rest, "state")


def restore(history: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """(`key`, `alert_id`) of latches that a log of alerts (`key`, `alert_id`, `state`, `seq` columns) leaves raised: those whose newest row is a raise."""
    newest = history.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(seq)), F.col("state").alias("_state"), F.col("alert_id").alias("_id"))).alias("m"))
    return newest.filter("m._state = 'RAISED'").select(key, F.col("m._id").alias("alert_id"))


def full_lot_alerts(edges: DataFrame, seq: list[str], latched: DataFrame | None = None) -> DataFrame:
    """Alert rows of a lot's edges (`lot_id`, `at_us`, `current_occupied`, `capacity`, `state` and `seq` columns).

    A raise is named by lot, kind and second; a clear has the name of the raise before it (from `latched`
    for the first). Shares are whole percents, halves to even. Edges are few: one window per lot.
    """
    own = F.concat_ws("|", "lot_id", F.lit("FULL_LOT"), F.floor(F.col("at_us") / 1_000_000).cast("string"))
    x = edges.withColumn("_own", F.when(F.col("state") == "RAISED", own))
    name = F.coalesce("_own", F.lag("_own").over(Window.partitionBy("lot_id").orderBy(*seq)))
    if latched is not None:
        x = x.join(latched.select("lot_id", F.col("alert_id").alias("_latched")), "lot_id", "left")
        name = F.coalesce(name, F.col("_latched"))
    tenths = rounded_ratio(100 * F.col("current_occupied").cast("bigint"), F.col("capacity").cast("bigint"), 1)
    # The wording of alerts.
    wording = F.when(F.col("state") == "RAISED", " full: ").otherwise(" has space again: ")
    used = F.concat_ws("/", F.col("current_occupied").cast("string"), F.col("capacity").cast("string"))
    text = F.concat(F.lit("Lot "), "lot_id", wording, F.bround(tenths).cast("int").cast("string"), F.lit("% ("), used, F.lit(" slots)"))
    return x.select(name.alias("alert_id"), F.lit("FULL_LOT").alias("kind"), "state", "lot_id", F.lit(None).cast("string").alias("sensor_id"), "at_us", text.alias("message"), tenths.alias("occupancy_pct"))


def sensor_alerts(signals: DataFrame) -> DataFrame:
    """Alert rows of sensors that fell silent or came back (`lot_id`, `sensor_id`, `silent`, `last_seen`, `at`; microseconds): named by lot, sensor and the second last seen."""
    minutes = F.bround((F.col("at") - F.col("last_seen")) / 60e6).cast("bigint").cast("string")
    # The wording of alerts.
    text = F.when(F.col("silent"), F.concat(F.lit("Sensor "), "sensor_id", F.lit(" silent for "), minutes, F.lit(" min"))).otherwise(F.concat(F.lit("Sensor "), "sensor_id", F.lit(" reporting again")))
    name = F.concat_ws("|", "lot_id", "sensor_id", F.floor(F.col("last_seen") / 1_000_000).cast("string"))
    state = F.when(F.col("silent"), "RAISED").otherwise("CLEARED")
    return signals.select(name.alias("alert_id"), F.lit("SENSOR_OFFLINE").alias("kind"), state.alias("state"), "lot_id", "sensor_id", F.col("at").alias("at_us"), text.alias("message"))


def pair_edges(edges: DataFrame, key: str, at: str, seq: list[str]) -> DataFrame:
    """(`key`, `raised_at`, `cleared_at`) from alternating edges; `cleared_at` is null while raised. Edges are few: one window per key."""
    w = Window.partitionBy(key).orderBy(*seq)
    x = edges.withColumn("cleared_at", F.lead(at).over(w)).filter("state = 'RAISED'")
    return x.select(key, F.col(at).alias("raised_at"), "cleared_at")


def lifecycle(messages: DataFrame) -> DataFrame:
    """One row per alert from RAISED and CLEARED messages (`alert_id`, `state`, `at`, `seq`, `message`), as keyed upserts leave it.

    The first raise sets the row and later raises change nothing; the first clear ends it; a clear that
    comes before any raise makes a row that was raised when it was cleared. The last clear's text stays.
    """
    first, cleared = F.col("state") == "RAISED", F.col("state") == "CLEARED"
    x = messages.filter("alert_id is not null").groupBy("alert_id").agg(
        F.min_by("at", "seq").alias("raised_at"),
        F.min_by(F.when(cleared, F.col("at")), F.when(cleared, F.col("seq"))).alias("cleared_at"),
        F.coalesce(F.max_by(F.when(cleared, F.col("message")), F.when(cleared, F.col("seq"))), F.min_by("message", "seq")).alias("message"),
        F.max(cleared).alias("_cleared"),
        F.count_if(first).alias("n_raised"),
    )
    return x.select("alert_id", F.when(F.col("_cleared"), "cleared").otherwise("active").alias("status"), "raised_at", "cleared_at", "message")
