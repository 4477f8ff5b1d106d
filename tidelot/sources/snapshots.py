"""Occupancy snapshots as CSV, and their replay as arrivals and departures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT = "SystemCodeNumber string, Capacity int, Occupancy int, LastUpdated string"


def read_snapshots(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """(`lot_id`, `ts`, `capacity`, `occupied`) from a CSV file; its times are local to `zone`. Lines that do not parse are dropped."""
    x = spark.read.schema(SNAPSHOT).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    local = F.try_to_timestamp("LastUpdated", F.lit("yyyy-MM-dd HH:mm:ss"))
    x = x.select(F.col("SystemCodeNumber").alias("lot_id"), F.unix_micros(F.to_utc_timestamp(local, zone)).alias("ts"), F.col("Capacity").alias("capacity"), F.col("Occupancy").alias("occupied"))
    return x.filter("lot_id is not null and ts is not null and occupied is not null")


def replay(snapshots: DataFrame) -> DataFrame:
    """(`lot_id`, `ts`, `status`): as many reports between two snapshots as their difference, spread evenly; the first only sets the start.

    A lot's snapshots are bounded by time over their interval, so they are ordered in one window.
    """
    w = Window.partitionBy("lot_id").orderBy("ts")
    x = snapshots.withColumns({"_was": F.lag("occupied").over(w), "_from": F.lag("ts").over(w)}).filter(F.col("_was").isNotNull() & (F.col("_was") != F.col("occupied")))
    x = x.withColumn("_n", F.abs(F.col("occupied") - F.col("_was"))).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = F.col("_from") + F.floor((F.col("ts") - F.col("_from")) * F.col("_i") / (F.col("_n") + 1))
    return x.select("lot_id", at.alias("ts"), F.when(F.col("occupied") > F.col("_was"), "OCCUPIED").otherwise("FREE").alias("status"))
