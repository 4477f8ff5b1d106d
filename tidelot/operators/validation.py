"""Validation of events: fields, spellings and rules between fields, with a reason for each rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelot.operators.messages import canonical_word

#: Text fields that must be present and not empty.
REQUIRED = ("event_id", "sensor_id", "lot_id", "slot_id")


def field_error() -> Column:
    """Why an event's fields cannot be used, or null. Spellings are compared in canonical form."""
    kind, status = canonical_word("event_type"), canonical_word("status")
    out = F.lit(None).cast("string")
    checks = [(F.col("event_ts").isNull() | F.col("ingest_ts").isNull(), "timestamp missing or without zone")]
    checks += [(status.isNotNull() & ~status.isin("OCCUPIED", "FREE"), "unknown status")]
    checks += [(kind.isNull() | ~kind.isin("OCCUPANCY", "HEARTBEAT"), "unknown event_type")]
    checks += [(F.coalesce(F.col(c), F.lit("")) == "", f"{c} missing") for c in reversed(REQUIRED)]
    for cond, text in checks:  # the last that applies is outermost
        out = F.when(cond, F.lit(text)).otherwise(out)
    return out


def rule_error() -> Column:
    """Which rule between event_type, status and vehicle_token an event breaks, or null."""
    kind, status, token = canonical_word("event_type"), canonical_word("status"), F.col("vehicle_token")
    return (
        F.when((kind == "OCCUPANCY") & status.isNull(), "occupancy without status")
        .when((kind == "HEARTBEAT") & (status.isNotNull() | token.isNotNull()), "heartbeat with status or token")
        .when((status == "OCCUPIED") & token.isNull(), "occupied without token")
        .when((status == "FREE") & token.isNotNull(), "free with token")
    )


def event_error() -> Column:
    return F.coalesce(field_error(), rule_error())


def is_valid() -> Column:
    """The same as a null `event_error`, in as few evaluations of each spelling as a filter on every row should cost."""
    kind, status, token = canonical_word("event_type"), canonical_word("status"), F.col("vehicle_token")
    report = ((status == "OCCUPIED") & token.isNotNull()) | ((status == "FREE") & token.isNull())
    present = F.col("event_ts").isNotNull() & F.col("ingest_ts").isNotNull()
    for c in REQUIRED:
        present = present & (F.col(c) != "")
    beat = F.col("status").isNull() & token.isNull()
    return F.coalesce(present & (((kind == "HEARTBEAT") & beat) | ((kind == "OCCUPANCY") & report)), F.lit(False))


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(is_valid())


def error_counts(events: DataFrame) -> DataFrame:
    """Rows per reason; valid rows have the reason 'valid'."""
    return events.groupBy(F.coalesce(event_error(), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
