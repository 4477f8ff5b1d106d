"""Mixing sources to target shares of a total size, by pivotal dependent rounding.

A source with share p of a total M and size T is used p * M / T times, at most `max_repeats`. Every
record gets the whole part of that rate as copies; the fraction is rounded by the pivotal method:
two records with fractional probabilities exchange mass, at random and unbiased, until one of
them is 0 or 1. Mass is counted in tokens, so a source's tokens never change: only the last record
left over in a source is rounded alone, and the source misses its target by less than that record.

Blocks of records (at most about `BLOCK` each) are rounded independently; each leaves at most one
fractional record, and those are rounded in a tree whose fan-in is `FAN_IN`.

Records of sources without a target, with a null source or without tokens are not selected.
Targets without records stay unfilled and keep their row in the report. Repeated target rows
of one source are added up, with the least of their caps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelot.session import materialise

BLOCK = 20_000
FAN_IN = 256


def pivotal(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round probabilities to 0 or 1 while the sum of size * prob stays; returns them and the position left fractional, or -1."""
    prob, carry = prob.copy(), -1
    draws = rng.random(len(prob))
    for i in range(len(prob)):
        if not 0.0 < prob[i] < 1.0:
            continue
        if carry < 0:
            carry = i
            continue
        a, b = size[carry], size[i]
        up = min((1 - prob[carry]) * a, prob[i] * b)  # mass that can move to the carried record
        down = min(prob[carry] * a, (1 - prob[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        prob[carry] += move / a
        prob[i] -= move / b
        for j in (carry, i):  # the bounds are exact up to rounding of the division
            if prob[j] < 1e-12:
                prob[j] = 0.0
            elif prob[j] > 1 - 1e-12:
                prob[j] = 1.0
        carry = next((j for j in (carry, i) if 0.0 < prob[j] < 1.0), -1)
    return prob, carry


def allocate(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies per record and source.

    Without a `total`, the largest one at which every source that has records reaches its share
    within its cap. With one, capped sources give all they may and the others share the rest by target.
    """
    live = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not live:
        return {}
    weight = sum(t[0] for t in live.values())
    if total is None:
        total = min(t[1] * sizes[s] * weight / t[0] for s, t in live.items())
    want, open_, left = {}, dict(live), float(total)
    while open_:
        w = sum(t[0] for t in open_.values())
        full = [s for s, t in open_.items() if left * t[0] / w > t[1] * sizes[s]]
        if not full:
            want |= {s: left * t[0] / w for s, t in open_.items()}
            break
        for s in full:
            want[s] = float(open_.pop(s)[1] * sizes[s])
            left -= want[s]
    return {s: min(float(live[s][1]), want[s] / sizes[s]) for s in live}


def _rounder(seed: int, level: int, last: bool):
    """Rounds one block of a level; the last level's block also decides its left-over record. The draws depend on seed, level, source and block only."""

    def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["block"].iloc[0]), *str(pdf["source"].iloc[0]).encode()])
        prob, rest = pivotal(pdf["n_tokens"].to_numpy(float), pdf["prob"].to_numpy(float), rng)
        if last and rest >= 0:
            prob[rest] = float(rng.random() < prob[rest])
        return pdf.assign(prob=prob)

    return rounds


def select_mix(records: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, report) from `records` (`doc_id`, `source`, `n_tokens`) and `targets` (`source`, `target_share`, `max_repeats`).

    selection: `doc_id`, `source`, `n_tokens`, `copies` of at least 1. report: a row per target with
    available, wanted and selected tokens and the share reached; selected and wanted tokens differ by
    no more than the source's longest document.
    """
    spark = records.sparkSession
    named = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in named.collect()}  # one row per source with a target
    records = records.filter((F.col("n_tokens") > 0) & F.col("source").isin(list(wanted)))
    stats = {r["source"]: r for r in records.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("most")).collect()}
    rates = allocate({s: r["tokens"] for s, r in stats.items()}, wanted, total_tokens)

    def by_source(values: dict, kind: str):
        if not values:
            return F.lit(None).cast(kind)
        pairs = [F.lit(x) for s, v in values.items() for x in (s, v)]
        return F.element_at(F.create_map(*pairs), F.col("source")).cast(kind)

    blocks = {s: max(1, -(-stats[s]["docs"] // BLOCK)) for s in rates}
    base = records.withColumn("rate", by_source(rates, "double")).filter("rate > 0")
    base = base.withColumns({"whole": F.floor("rate"), "prob": F.col("rate") - F.floor("rate")})
    block = F.pmod(F.xxhash64("doc_id"), by_source(blocks, "bigint"))
    work = base.withColumn("block", block).select("source", "block", "doc_id", "n_tokens", "whole", "prob")
    level, width, done = 0, max(blocks.values(), default=1), None
    while True:
        last = width == 1
        rounded = materialise(work.groupBy("source", "block").applyInPandas(_rounder(seed, level, last), work.schema), f"pivotal-{level}")
        sure = rounded.filter("prob = 0 or prob = 1")
        done = sure if done is None else done.unionByName(sure)
        if last:
            break
        work = rounded.filter("prob > 0 and prob < 1").withColumn("block", F.expr(f"block div {FAN_IN}L"))
        width, level = -(-width // FAN_IN), level + 1
    picked = done.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("prob")).cast("bigint").alias("copies")).filter("copies > 0")
    used = picked.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_selected"), F.max("copies").alias("most_repeats"))
    available = [(s, float(w), int(c), int(stats[s]["tokens"]) if s in stats else 0, rates.get(s, 0.0) * stats[s]["tokens"] if s in stats else 0.0, int(stats[s]["most"]) if s in stats else 0) for s, (w, c) in wanted.items()]
    schema = "source string, target_share double, max_repeats int, tokens_available bigint, tokens_wanted double, longest_doc bigint"
    report = spark.createDataFrame(available, schema).join(F.broadcast(used), "source", "left")  # a row per target on either side
    report = report.fillna(0, ["docs", "copies", "tokens_selected", "most_repeats"])
    whole = used.agg(F.sum("tokens_selected")).scalar()
    report = report.withColumn("actual_share", F.coalesce(F.col("tokens_selected") / whole, F.lit(0.0)))
    return picked, report
