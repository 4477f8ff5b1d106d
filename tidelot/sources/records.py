"""Records as JSON in a log: schemas, strict and lenient parsing, dead letters, encoding, compacted topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelot.operators import upserts
from tidelot.operators.validation import event_error

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(ddl: str) -> T.StructType:
    """A schema from 'name type, ...', without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


EVENT = _struct("event_id string, event_type string, sensor_id string, lot_id string, slot_id string, status string, vehicle_token string, event_ts timestamp, ingest_ts timestamp")
LOT = _struct("lot_id string, name string, personality string, capacity int, slot_ids array<string>, columns int, latitude double, longitude double")
WINDOW = _struct(
    "lot_id string, window_start timestamp, window_end timestamp, capacity int, avg_occupied double, avg_occupancy_pct double, min_occupied int, max_occupied int, "
    "entries int, exits int, unique_vehicles_est double, closed boolean, current_occupied int, emitted_at timestamp, latest_ingest_ts timestamp"
)
ALERT = _struct("alert_id string, kind string, state string, lot_id string, sensor_id string, ts timestamp, message string, occupancy_pct double")
ALERT_ROW = _struct(
    "alert_id string, kind string, lot_id string, sensor_id string, status string, raised_at timestamp, cleared_at timestamp, message string, occupancy_pct double, updated_at timestamp"
)
LATE = T.StructType([T.StructField("event", EVENT), *_struct("window_start timestamp, watermark timestamp, late_by_s double, routed_at timestamp").fields])
DEAD = _struct("original_hex string, error string, source_partition int, source_offset bigint, failed_at timestamp")

#: A time with its zone, as text.
ZONED = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)$"
ERROR_LENGTH = 500


def _time(text: str) -> Column:
    return F.when(F.col(text).rlike(ZONED), F.try_to_timestamp(F.col(text)))


def parse_strict(log: DataFrame) -> DataFrame:
    """`log` (`value` binary, and any other columns) with the event's fields and `error`: null only for a valid event.

    Malformed JSON, missing or surplus fields, times without a zone, and broken rules are errors. A column
    of `log` that is named like a field gives way to it.
    """
    names = EVENT.fieldNames()
    log = log.drop(*names)
    text = F.col("value").cast("string")
    # One pass over the text for all fields, one for its keys.
    fields = F.json_tuple("_text", *names).alias(*("_ets" if n == "event_ts" else "_its" if n == "ingest_ts" else n for n in names))
    x = log.withColumn("_text", text).select(*log.columns, F.json_object_keys("_text").alias("_keys"), fields)
    x = x.withColumns({"event_ts": _time("_ets"), "ingest_ts": _time("_its")})
    surplus = F.size(F.array_except("_keys", F.array(*map(F.lit, names)))) > 0
    needed = [n for n in names if n not in ("status", "vehicle_token")]
    missing = F.size(F.array_except(F.array(*map(F.lit, needed)), "_keys")) > 0
    error = F.when(F.col("_keys").isNull(), "malformed JSON").when(missing, "missing field").when(surplus, "surplus field").otherwise(event_error())
    return x.withColumn("error", error).drop("_keys", "_ets", "_its")


def parse_slot_reports(log: DataFrame) -> DataFrame:
    """Lenient reading of occupancy reports for live views: (`lot_id`, `slot_id`, `status`, `event_ts`); anything else is skipped.

    Bytes are searched for the type before any JSON is parsed, as most of the log is heartbeats.
    """
    x = log.filter(F.contains(F.col("value").cast("string"), F.lit('"OCCUPANCY"')))
    e = F.from_json(F.col("value").cast("string"), "event_type string, lot_id string, slot_id string, status string, event_ts string")
    x = x.select(e.alias("e")).select("e.*").withColumn("event_ts", _time("event_ts"))
    return x.filter("event_type = 'OCCUPANCY' and status in ('OCCUPIED', 'FREE') and lot_id is not null and slot_id is not null and event_ts is not null").drop("event_type")


def dead_letters(parsed: DataFrame, failed_at: Column) -> DataFrame:
    """Rows of `parse_strict` with an error, as dead letters; the log has `partition` and `offset`."""
    return parsed.filter("error is not null").select(
        F.lower(F.hex("value")).alias("original_hex"), F.substring("error", 1, ERROR_LENGTH).alias("error"), F.col("partition").cast("int").alias("source_partition"), F.col("offset").cast("bigint").alias("source_offset"), failed_at.alias("failed_at")
    )


def encode_events(events: DataFrame) -> DataFrame:
    """(`key`, `value`, `partition`, `offset`) as a producer writes them: times in milliseconds with zone, nulls kept."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    fields = [iso(n).alias(n) if n.endswith("_ts") else F.col(n) for n in EVENT.fieldNames()]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return events.select(F.col("lot_id").cast("binary").alias("key"), value.cast("binary").alias("value"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))


def compacted(log: DataFrame, tombstones: bool = False) -> DataFrame:
    """Last value of each key. A null value deletes its key where `tombstones`, else it is skipped."""
    x = log if tombstones else log.filter("value is not null")
    return upserts.keep_one(x, ["key"], [F.col("partition"), F.col("offset")]).filter("value is not null")


def late_records(judged_late: DataFrame, routed_at: Column) -> DataFrame:
    """Late rows of a judged stream as records of the late topic."""
    t = lambda c: F.timestamp_micros(c)
    event = F.struct(
        F.hex("event_id").alias("event_id"), "event_type", "sensor_id", "lot_id", "slot_id", "status", "vehicle_token", t("ts").alias("event_ts"), t("arrival").alias("ingest_ts")
    )
    by = F.floor((F.col("watermark") - F.col("ts")) / 1000 + 0.5) / 1000
    return judged_late.select(event.alias("event"), t("window_start").alias("window_start"), t("watermark").alias("watermark"), by.alias("late_by_s"), routed_at.alias("routed_at"))
