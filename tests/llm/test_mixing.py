import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelot.llm import mixing


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 40).astype(float)
    prob = rng.random(40)
    draws = []
    for seed in range(400):
        p, rest = mixing.pivotal(size, prob, np.random.default_rng(seed))
        assert np.isclose((p * size).sum(), (prob * size).sum())
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != rest)
        draws.append(p)
    assert np.abs(np.mean(draws, axis=0) - prob).max() < 0.12


def test_allocate():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "gone": (0.1, 1)}
    r = mixing.allocate({"a": 1000, "b": 100, "c": 100}, t)
    used = {s: r[s] * n for s, n in (("a", 1000), ("b", 100), ("c", 100))}
    assert r["b"] == 2 and used["a"] / used["b"] == pytest.approx(5 / 3) and used["c"] / used["b"] == pytest.approx(2 / 3)
    r = mixing.allocate({"a": 1000, "b": 100, "c": 100}, t, total=1500)  # b is at its cap, the others share the rest
    assert r["b"] == 2 and r["a"] * 1000 == pytest.approx(1300 * 5 / 7) and r["c"] * 100 == pytest.approx(1300 * 2 / 7)
    r = mixing.allocate({"a": 1000, "b": 100, "c": 100}, t, total=9000)
    assert (r["a"], r["b"], r["c"]) == (1, 2, 4)
    assert mixing.allocate({}, t) == {} and mixing.allocate({"a": 0}, t) == {}


def records(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"), (F.col("id") % 97).alias("n_tokens"))
    extra = spark.createDataFrame([(9001, None, 5), (9002, "unknown", 5), (9003, "big", 0), (9004, "big", None)], "doc_id bigint, source string, n_tokens bigint")
    return df.unionByName(extra).withColumns({"rate": F.lit("clash"), "block": F.lit("clash"), "copies": F.lit("clash")})


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 2), (None, 0.1, 1)]


def test_shares_caps_and_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)  # several levels
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    picked, report = mixing.select_mix(records(spark), targets)
    rows = {r["source"]: r for r in report.collect()}
    for s, share, cap in TARGETS[:3]:
        assert rows[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.003) and rows[s]["most_repeats"] <= cap
    assert rows["absent"]["tokens_selected"] == 0 and rows["absent"]["actual_share"] == 0
    got = picked.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(r["copies"] >= 1 for r in got)
    again = {(r["doc_id"], r["copies"]) for r in mixing.select_mix(records(spark), targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    picked, report = mixing.select_mix(records(spark).limit(0), targets)
    assert picked.count() == 0 and report.count() == 4 and report.agg(F.sum("actual_share")).first()[0] == 0
    picked, report = mixing.select_mix(records(spark), targets.limit(0))
    assert picked.count() == 0 and report.count() == 0
