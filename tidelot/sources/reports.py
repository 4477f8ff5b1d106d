"""Small results written for people and scripts: one JSON line or CSV row per result row."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib import request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_summary(log: DataFrame) -> DataFrame:
    """One row for a produced log with `fault` and `partition`: messages, messages by fault and by partition."""
    count = lambda by: log.groupBy(by.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))))  # noqa: E731 - a row per fault or partition
    faults, parts = count(F.coalesce("fault", F.lit("none"))).scalar(), count(F.col("partition").cast("string")).scalar()
    return log.agg(F.count(F.lit(1)).alias("messages")).select("messages", faults.alias("by_fault"), parts.alias("by_partition"))


def console_sender(write: Callable[[str], object] = print) -> Callable[[list[dict]], None]:
    """A sender for `streaming.sinks.notify` that writes a line per alert."""
    return lambda page: [write(f"{a.get('state')} {a.get('kind')} {a.get('lot_id')}: {a.get('message')}") for a in page] and None


def webhook_sender(url: str, timeout_s: float = 5, open_url: Callable = request.urlopen) -> Callable[[list[dict]], None]:
    """A sender that posts each page of alerts as one JSON array."""

    def send(page: list[dict]) -> None:
        body = json.dumps(page, default=str).encode()
        with open_url(request.Request(url, body, {"Content-Type": "application/json"}, method="POST"), timeout=timeout_s):
            pass

    return send
