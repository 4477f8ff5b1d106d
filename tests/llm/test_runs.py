import random

import pytest
from pyspark.sql import functions as F

from tidelot.llm import runs


def best_cost(events, mismatch, penalty):
    """Optimal segmentation by trying every start of the last run."""
    best = [0.0]
    for t in range(1, len(events) + 1):
        options = []
        for s in range(t):
            part = events[s:t]
            off = sum(len(part) - max(sum(e[f] == v for e in part) for v in {e[f] for e in part}) for f in range(len(part[0])))
            options.append(best[s] + mismatch * off + penalty)
        best.append(min(options))
    return best[-1]


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("mismatch", [0.4, 1.0, 3.0])
def test_segmenter_is_optimal(mismatch, weighted):
    rng = random.Random(4)
    for _ in range(60):
        events = [(rng.choice("aaab"), rng.choice([None, None, "x"])) for _ in range(rng.randint(1, 18))]
        dp, done = runs.Segmenter(mismatch, 1.0), []
        for i, e in enumerate(events):
            k = 1
            while weighted and i + k < len(events) and events[i + k] == e:
                k += 1
            if not weighted or not i or events[i - 1] != e:
                dp.push(i, i + k - 1, k, e)
            done += dp.settled()
        done += dp.finish()
        assert sum(r[2] for r in done) == len(events)
        assert [r[0] for r in done] == sorted(r[0] for r in done)
        assert sum(r[3] for r in done) + len(done) == pytest.approx(best_cost(events, mismatch, 1.0))


def brute_runs(data, gap):
    out, by = [], {}
    for k, t, q, v in data:
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, q, v))
    for k, ev in by.items():
        ev.sort(key=lambda x: (x[0], x[1]))
        run = [ev[0]]
        for a, b in zip(ev, ev[1:], strict=False):
            if a[2] == b[2] and b[0] - a[0] <= gap:
                run.append(b)
            else:
                out.append((k, run[0][0], run[-1][0], len(run)))
                run = [b]
        out.append((k, run[0][0], run[-1][0], len(run)))
    return sorted(out)


@pytest.mark.parametrize("held", [3, 1 << 18])
@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_exact_runs_wherever_tasks_are_cut(spark, monkeypatch, parts, held):
    monkeypatch.setattr(runs, "HELD", held)
    rng = random.Random(6)
    data, q = [], 0
    for k in range(25):
        for _ in range(rng.randint(0, 40)):
            q += 1
            data.append((f"k{k}", rng.randint(0, 300), q, rng.choice([None, "a", "a", "a", "b"])))
    data += [("steady", t, 10_000 + t, "s") for t in range(0, 400, 2)]  # one run over many shards
    data += [(None, 1, 1, "a"), ("k1", None, 2, "a")]
    df = spark.createDataFrame(data, "k string, t bigint, q bigint, v string").withColumn("n_events", F.lit("clash"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = runs.collapse_runs(df, ["k"], "t", "q", ["v"], max_gap_us=12).collect()
        near = runs.collapse_runs(df, ["k"], "t", "q", ["v"], max_gap_us=12, mismatch=1.0, penalty=1.5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["k"], r["start_us"], r["end_us"], r["n_events"]) for r in got) == brute_runs(data, 12)
    by, want = {}, 0.0
    for k, t, q, v in sorted((x for x in data if x[0] is not None and x[1] is not None), key=lambda x: x[:3]):
        if k in by and t - by[k][-1][0] > 12:
            want += best_cost([(e[1],) for e in by.pop(k)], 1.0, 1.5)
        by.setdefault(k, []).append((t, v))
    want += sum(best_cost([(e[1],) for e in s], 1.0, 1.5) for s in by.values())
    assert sum(r["cost"] + 1.5 for r in near) == pytest.approx(want)


def test_short_deviation_is_absorbed(spark):
    data = [("k", i, i, "b" if i == 5 else "a") for i in range(12)]
    df = spark.createDataFrame(data, "k string, t bigint, q bigint, v string")
    near = runs.collapse_runs(df, ["k"], "t", "q", ["v"], 100, mismatch=1.0, penalty=1.5).collect()
    assert [(r["n_events"], r["cost"], r["v"]) for r in near] == [(12, 1.0, "a")]
    assert runs.collapse_runs(df, ["k"], "t", "q", ["v"], 100).count() == 3


def test_ties_repeats_and_empty(spark):
    data = [("k", 1, 1, "a"), ("k", 1, 2, "b"), ("k", 1, 2, "b"), ("k", 1, 3, "b")]
    df = spark.createDataFrame(data, "k string, t bigint, q bigint, v string")
    assert sorted(r["n_events"] for r in runs.collapse_runs(df, ["k"], "t", "q", ["v"], 10).collect()) == [1, 3]
    assert runs.collapse_runs(df.limit(0), ["k"], "t", "q", ["v"], 10).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(df, ["k"], "t", "q", ["v"], 10, penalty=0)
