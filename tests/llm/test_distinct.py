import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelot.llm import distinct


def test_estimates_are_unbiased_and_intervals_cover(spark):
    sizes = [1, 5, 50, 500, 5000]
    df = spark.range(len(sizes) * 12).select((F.col("id") % len(sizes)).cast("int").alias("i"), F.col("id").alias("g"))
    df = df.withColumn("n", F.element_at(F.array(*map(F.lit, sizes)), F.col("i") + 1))
    df = df.select("g", "n", F.explode(F.sequence(F.lit(1), "n")).alias("x")).withColumn("id", F.concat_ws(":", "g", "x"))
    df = df.unionByName(df.filter("x % 3 = 0"))  # repeats change nothing
    c = distinct.counts(distinct.sketch(df.withColumn("registers", F.lit("clash")), ["g", "n"], "id", 512), 512).collect()
    assert len(c) == len(sizes) * 12
    rel = np.array([r["estimate"] / r["n"] - 1 for r in c])
    assert abs(rel.mean()) < 4 / np.sqrt(510 * len(c)) and rel.std() < 1.5 / np.sqrt(510)
    assert np.mean([r["ci_low"] <= r["n"] <= r["ci_high"] for r in c]) > 0.85
    assert c[0]["relative_error"] == pytest.approx(510**-0.5)


def test_merge_of_parts_equals_the_whole(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("k"), F.col("id").cast("string").alias("v"))
    whole = distinct.sketch(df, ["k"], "v", 64)
    parts = [distinct.sketch(df.filter(F.crc32("v") % 3 == i), ["k"], "v", 64) for i in range(3)]
    merged = distinct.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"], 64)
    as_dict = lambda d: {r["k"]: bytes(r["registers"]) for r in d.collect()}
    assert as_dict(whole) == as_dict(merged)
    total = distinct.merge(whole.withColumn("all", F.lit(None).cast("string")), ["all"], 64).collect()  # a null key is a group
    least = np.minimum.reduce([distinct.unpack(b)[1] for b in as_dict(whole).values()])
    assert len(total) == 1 and np.array_equal(distinct.unpack(bytes(total[0]["registers"]))[1], least)


def test_few_members_are_kept_as_they_are_and_estimate_the_same(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 20).otherwise(F.col("id")).cast("string").alias("v"))
    got = {r["k"]: bytes(r["registers"]) for r in distinct.sketch(df, ["k"], "v", 64).collect()}
    assert len(got[0]) == 1 + 8 * 10 and len(got[1]) == 1 + 4 * 64  # ten members, a hundred
    few, many = distinct.unpack(got[0])[0], distinct.unpack(got[1])[1]
    both = distinct.merge(distinct.sketch(df.withColumn("k", F.lit(1)), ["k"], "v", 64), ["k"], 64).first()["registers"]
    assert np.array_equal(distinct.unpack(bytes(both))[1], np.minimum(distinct.registers_of(few, 64), many))
    c = distinct.counts(distinct.sketch(df, ["k"], "v", 64).filter("k = 0"), 64).first()
    assert c["estimate"] == pytest.approx(63 / distinct.registers_of(few, 64).sum(dtype=np.float64))


def test_nulls_empty_and_parameters(spark):
    df = spark.createDataFrame([("a", None), (None, "x")], "k string, v string")
    assert [r["k"] for r in distinct.sketch(df, ["k"], "v", 8).collect()] == [None]  # a null key is a group, a null identifier is nothing
    assert distinct.sketch(df.limit(0), ["k"], "v", 8).count() == 0
    with pytest.raises(ValueError):
        distinct.sketch(df, ["k"], "v", 2)


def test_many_keys_of_many_values(spark):
    keys = [f"k{i}" for i in range(8)]
    df = spark.range(5000).select(*((F.col("id") * (i + 1)).alias(k) for i, k in enumerate(keys)), F.lit("x").alias("v"))
    got = distinct.sketch(df, keys, "v", 4)
    assert got.count() == 5000 and got.filter("k1 <> 2 * k0 or k7 <> 8 * k0").count() == 0


def test_more_groups_than_a_task_holds_open(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 9000).alias("k"), F.lit("x").alias("v"))
    assert distinct.sketch(df, ["k"], "v", 4).count() == 9000


def test_exponentials_are_exponential():
    x = distinct.exponentials(np.arange(2000), 50)
    assert abs(x.mean() - 1) < 0.02 and abs(x.var() - 1) < 0.05
