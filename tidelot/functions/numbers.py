"""Rounding and labels. Fixed-point numbers are whole multiples, halves up, so that every engine agrees on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hundredths(c: str | Column) -> Column:
    return F.floor(_col(c) * 100 + 0.5)


def thousandths(c: str | Column) -> Column:
    return F.floor(_col(c) * 1000 + 0.5)


def permille(part: str | Column, whole: str | Column) -> Column:
    """Thousandths of the whole; null without a part or for a whole of 0."""
    return F.when(_col(whole) > 0, F.floor(_col(part) * 1000 / _col(whole) + 0.5))


def half_even(c: str | Column, digits: int) -> Column:
    """Round halves to even, as far as the decimal form of a double shows a half."""
    return F.bround(_col(c), digits)


def rounded_ratio(part: Column, whole: Column, digits: int) -> Column:
    """`part / whole` of whole numbers, not negative, rounded to `digits` by whole-number arithmetic, halves to even: exact, and the same in every engine."""
    scaled = part * 10**digits
    q = F.floor(scaled / whole).cast("bigint")
    q = q - F.when(q * whole > scaled, 1).when((q + 1) * whole <= scaled, -1).otherwise(0)  # the quotient of doubles may be off by one
    twice = 2 * (scaled - q * whole)
    up = (twice > whole) | ((twice == whole) & (F.pmod(q, F.lit(2)) == 1))
    return (q + up.cast("int")) / 10**digits


def line_heights(values: Column, height: int = 24, pad: int = 3, least_range: int = 1000) -> Column:
    """Heights, in tenths, at which a small line chart shows `values` (an array of whole numbers, newest last): the range is at least `least_range`, centred on the values, and starts at 0 or above."""
    lo, hi = F.array_min(values), F.array_max(values)
    span = F.greatest(hi - lo, F.lit(least_range))  # twice the half range
    low = F.greatest(F.lit(0), lo + hi - span)  # twice the least value shown
    inside = lambda v: F.greatest(F.lit(0), F.least(2 * v - low, 2 * span))
    return F.transform(values, lambda v: F.floor(10 * (height - pad) - inside(v) * (10 * (height - 2 * pad)) / (2 * span) + 0.5))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(_col(c)), _col(c))


def fill_label(percent: Column, full: float = 90, filling: float = 75) -> Column:
    return F.when(percent.isNull(), "No data").when(percent >= full, "Full").when(percent >= filling, "Filling").otherwise("Space")


def duration_text(seconds: str | Column) -> Column:
    """'42 s', '7 min' or '3 h 05 min'."""
    s = F.floor(_col(seconds)).cast("bigint")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min", minutes)).otherwise(F.format_string("%d h %02d min", hours, minutes))


def rate_text(per_second: str | Column) -> Column:
    """'950 /s' or '97.1k /s'."""
    r = _col(per_second).cast("double")
    return F.when(r < 1000, F.format_string("%.0f /s", r)).otherwise(F.format_string("%.1fk /s", r / 1000))


def percent_text(percent: str | Column, digits: int = 0) -> Column:
    return F.when(_col(percent).isNotNull(), F.format_string(f"%.{digits}f%%", _col(percent).cast("double")))


def iso_seconds(micros: str | Column) -> Column:
    """'2016-02-01T03:55:00+00:00', as instants are written in keys; the session's zone must be UTC."""
    return F.date_format(F.timestamp_micros(_col(micros)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def window_key(lot: str | Column, start_us: str | Column) -> Column:
    """Key of a window in keyed logs: lot and start."""
    return F.concat_ws("|", _col(lot), iso_seconds(start_us))
