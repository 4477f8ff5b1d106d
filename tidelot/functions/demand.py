"""Piecewise-linear curves over the hour of the day, and the kinds of lot they are given for."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (hour, share occupied) by kind of lot, on weekdays and at weekends; median stay in seconds and its log-normal sigma.
CURVES = {
    ("office", False): [(0, 0.04), (6, 0.05), (7, 0.20), (9.5, 0.92), (12, 0.90), (12.5, 0.74), (13.5, 0.76), (14.5, 0.90), (17, 0.80), (19, 0.12), (21, 0.06), (24, 0.04)],
    ("office", True): [(0, 0.03), (10, 0.06), (14, 0.10), (20, 0.05), (24, 0.03)],
    ("mall", False): [(0, 0.02), (9, 0.04), (11, 0.35), (13, 0.55), (16, 0.50), (18, 0.78), (20.5, 0.72), (22, 0.15), (24, 0.03)],
    ("mall", True): [(0, 0.02), (9, 0.05), (11, 0.55), (14, 0.90), (19, 0.93), (21, 0.60), (22.5, 0.12), (24, 0.03)],
    ("station", False): [(0, 0.08), (5, 0.10), (6.5, 0.40), (9, 0.88), (16.5, 0.85), (18, 0.60), (20, 0.25), (24, 0.10)],
    ("station", True): [(0, 0.08), (8, 0.15), (12, 0.32), (18, 0.30), (24, 0.10)],
}
STAYS = {"office": (7.5 * 3600, 0.35), "mall": (1.5 * 3600, 0.60), "station": (5.0 * 3600, 0.50)}


def segments(spark: SparkSession) -> DataFrame:
    """The curves as rows (`personality`, `weekend`, `h0`, `v0`, `h1`, `v1`): a fixed, small table."""
    rows = [(p, w, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for (p, w), curve in CURVES.items() for a, b in zip(curve, curve[1:], strict=False)]
    return spark.createDataFrame(rows, "personality string, weekend boolean, h0 double, v0 double, h1 double, v1 double")


def target(df: DataFrame, personality: str, weekend: str, hour: str) -> DataFrame:
    """`df` with `target`, the curve's value at an hour within 0 and 24; null for an unknown kind or hour."""
    s = F.broadcast(segments(df.sparkSession).withColumnsRenamed({"personality": "_p", "weekend": "_w"}))
    at = (F.col(personality) == F.col("_p")) & (F.col(weekend) == F.col("_w")) & (F.col(hour) >= F.col("h0")) & ((F.col(hour) < F.col("h1")) | ((F.col(hour) == 24) & (F.col("h1") == 24)))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(hour) - F.col("h0")) / (F.col("h1") - F.col("h0"))
    return df.join(s, at, "left").withColumn("target", value).drop("_p", "_w", "h0", "v0", "h1", "v1")


def _by_kind(personality: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(personality == name, float(value)).otherwise(out)
    return out


def median_stay(personality: Column) -> Column:
    """Median stay in seconds."""
    return _by_kind(personality, {k: median for k, (median, _) in STAYS.items()})


def sigma_stay(personality: Column) -> Column:
    """Sigma of the log-normal stay."""
    return _by_kind(personality, {k: sigma for k, (_, sigma) in STAYS.items()})


def mean_stay(personality: Column) -> Column:
    """Mean stay in seconds of a log-normal stay."""
    return _by_kind(personality, {k: median * exp(sigma**2 / 2) for k, (median, sigma) in STAYS.items()})
