"""Event-time arithmetic on bigint microseconds since 1970-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def cell_of(expr: str, width_us: int) -> Column:
    """Number of the cell [n * width, (n + 1) * width) that holds `expr`; floors for instants before 1970 too."""
    if width_us <= 0:
        raise ValueError("width_us must be positive")
    return F.expr(f"(({expr}) - pmod(({expr}), {width_us}L)) div {width_us}L")


def floor_to(expr: str, width_us: int) -> Column:
    """Start of that cell."""
    if width_us <= 0:
        raise ValueError("width_us must be positive")
    return F.expr(f"({expr}) - pmod(({expr}), {width_us}L)")


def local_hour(micros: str, zone: str) -> Column:
    """Hour of the day at an instant, in a zone."""
    return F.hour(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def local_weekday(micros: str, zone: str) -> Column:
    """Day of the week at an instant, in a zone; Monday is 0. Both need a session in UTC."""
    return F.weekday(F.from_utc_timestamp(F.timestamp_micros(micros), zone))
