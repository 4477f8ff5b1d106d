"""Operators against brute force: each random entity is a case of its own, all run in one plan."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelot.functions import numbers
from tidelot.operators import alerts, grid, intervals, lateness, messages, metrics, occupancy, redelivery, scans, sessions, upserts, validation
from tidelot.operators.store import VersionedTable


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- intervals ------------------------------------------------------------------------------------


def random_intervals(seed):
    rng = random.Random(seed)
    out = []
    for k in range(40):
        for _ in range(rng.randint(0, 12)):
            s = rng.randint(-60, 200)
            out.append((f"k{k}", s, s + rng.choice([-5, 0, 1, 3, 10, 25, 90])))
    out += out[::7]
    out += [(None, 0, 5), ("k1", None, 5), ("k1", 5, None)]
    return out


def brute_periods(data):
    by = defaultdict(list)
    for k, s, e in data:
        if k is not None and s is not None and e is not None and e > s:
            by[k].append((s, e))
    out = []
    for k, spans in by.items():
        spans.sort()
        s, e = spans[0]
        for a, b in spans[1:]:
            if a <= e:
                e = max(e, b)
            else:
                out.append((k, s, e))
                s, e = a, b
        out.append((k, s, e))
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 50, 100_000])
def test_periods_and_gaps(spark, shard):
    data = random_intervals(shard)
    df = spark.createDataFrame(data, "lot string, a bigint, b bigint").withColumn("s", F.lit("clash")).withColumn("k", F.lit(1))
    p = intervals.merge_intervals(df, "lot", F.col("a"), F.col("b"), shard)
    want = brute_periods(data)
    assert rows_of(p, "lot", "s", "e") == want
    gaps = sorted((k, e, s2) for (k, _, e), (k2, s2, _) in zip(want, want[1:], strict=False) if k == k2)
    assert rows_of(intervals.interval_gaps(p, "lot", None, shard), "lot", "s", "e") == gaps
    assert rows_of(intervals.interval_gaps(p, "lot", 20, shard), "lot", "s", "e") == [g for g in gaps if g[2] - g[1] <= 20]


def test_long_interval_covers_inner_ones(spark):
    data = [("a", 3, 1000), ("a", 50, 60), ("a", 995, 1010), ("a", 1010, 1020)]
    df = spark.createDataFrame(data, "k string, a bigint, b bigint")
    assert rows_of(intervals.merge_intervals(df, "k", F.col("a"), F.col("b"), 10), "k", "s", "e") == [("a", 3, 1020)]


def test_an_end_far_in_the_future_is_one_span(spark):
    far = 10**15
    df = spark.createDataFrame([("a", 5, far), ("a", 12, 13), ("a", far - 3, far + 2), ("a", far + 9, far + 10), ("b", 1, 2)], "k string, a bigint, b bigint")
    p = intervals.merge_intervals(df, "k", F.col("a"), F.col("b"), 10)
    assert rows_of(p, "k", "s", "e") == [("a", 5, far + 2), ("a", far + 9, far + 10), ("b", 1, 2)]


def test_intervals_empty(spark):
    df = spark.createDataFrame([], "k string, a bigint, b bigint")
    p = intervals.merge_intervals(df, "k", F.col("a"), F.col("b"))
    assert p.count() == 0 and intervals.interval_gaps(p, "k").count() == 0


def test_latest_version_is_defined_for_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", None, "q"), (None, 9, "n")], "id string, v int, p string")
    assert rows_of(intervals.latest_version(df, "id", "v", ["p"]), "id", "p") == [("a", "z")]


# --- sessions -------------------------------------------------------------------------------------


def brute_sessions(data, gap):
    by = defaultdict(list)
    for k, t in data:
        if k is not None and t is not None:
            by[k].append(t)
    out = []
    for k, ts in by.items():
        ts.sort()
        s = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last > gap:
                out.append((k, s, last, n))
                s, n = t, 0
            last = t
            n += 1
        out.append((k, s, last, n))
    return sorted(out)


def random_events(seed, keys=30, most=25, span=400):
    rng = random.Random(seed)
    data = [(f"k{k}", rng.randint(-span, span)) for k in range(keys) for _ in range(rng.randint(0, most))]
    return data + data[::9] + [(None, 1), ("k0", None)]


def test_sessions_in_one_pass_and_in_batches(spark, tmp_path):
    data, gap = random_events(1), 20
    df = lambda rows: spark.createDataFrame(rows, "k string, ts bigint").withColumn("n", F.lit("clash"))
    want = brute_sessions(data, gap)
    assert rows_of(sessions.sessionize(df(data), ["k"], "ts", gap), "k", "s", "e", "n") == want
    t = sessions.SessionTable(spark, str(tmp_path / "t"), ["k"], gap, part_us=50)
    random.Random(2).shuffle(data)
    for i in range(0, 4):
        part = data[i::4]
        cells = sessions.session_cells(df(part), ["k"], "ts", gap)
        assert t.apply(cells, i)
        assert not t.apply(cells, i)
    assert rows_of(t.sessions(), "k", "s", "e", "n") == want


def test_session_batch_touches_only_days_in_reach(spark, tmp_path):
    t = sessions.SessionTable(spark, str(tmp_path / "t"), ["k"], 5, part_us=100)
    spans = lambda *x: spark.createDataFrame([("a", s, e, 1) for s, e in x], "k string, s bigint, e bigint, n bigint")
    t.apply(spans((10, 20), (150, 160), (950, 960)), 0)
    before = t.table.state()["parts"]
    t.apply(spans((155, 170)), 1)
    after = t.table.state()["parts"]
    assert {k for k in before if before[k]["path"] != after[k]["path"]} == {"1"}
    assert rows_of(t.sessions(), "s", "e", "n") == [(10, 20, 1), (150, 170, 2), (950, 960, 1)]


def test_sessions_of_withdrawn_events_are_made_anew(spark, tmp_path):
    t = sessions.SessionTable(spark, str(tmp_path / "t"), ["k"], 5, part_us=100)
    spans = lambda *x: spark.createDataFrame(list(x), "k string, s bigint, e bigint, n bigint")
    t.apply(spans(("a", 10, 20, 3), ("a", 150, 160, 2), ("b", 12, 13, 2)), 0)
    t.apply(spans(("b", 16, 16, 1)), 1, again=spans(("a", 10, 10, 1), ("a", 20, 20, 1), ("a", 150, 160, 2)))
    assert rows_of(t.sessions(), "k", "s", "e", "n") == [("a", 10, 10, 1), ("a", 20, 20, 1), ("a", 150, 160, 2), ("b", 12, 16, 3)]


def test_sessions_empty(spark, tmp_path):
    t = sessions.SessionTable(spark, str(tmp_path / "t"), ["k"], 5)
    assert t.apply(spark.createDataFrame([], "k string, s bigint, e bigint, n bigint"), 0)
    assert t.sessions().count() == 0


# --- grid -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("within", [100, None])
def test_grid(spark, within):
    data = [(k, t, f"v{t % 7}" if t % 5 else None) for k, t in random_events(3, span=250) if k is not None and t is not None]
    df = spark.createDataFrame([*data, (None, 3, "x"), ("k1", None, "x")], "k string, t bigint, v string").withColumn("_cells", F.lit(0))
    g = grid.to_grid(df, ["k"], "t", F.col("v"), cell_us=10, shard_us=50, within_us=within)
    want, by = [], defaultdict(lambda: defaultdict(list))
    for k, t, v in data:
        by[k, t // within if within else 0][t // 10].append((t, v))
    for (k, _), cells in by.items():
        last = None
        for c in range(min(cells), max(cells) + 1):
            if c in cells:
                last = (c, max(cells[c], key=lambda x: (x[0], x[1] is not None, x[1] or ""))[1])
            want.append((k, c * 10, len(cells.get(c, [])), last[1], last[0] * 10))
    got = sorted(((r["k"], r["cell_us"], r["n"], r["value"], r["carried_from_us"]) for r in g.collect()), key=str)
    assert got == sorted(want, key=str)


def test_grid_empty_and_bad_widths(spark):
    df = spark.createDataFrame([], "k string, t bigint, v string")
    assert grid.to_grid(df, ["k"], "t", F.col("v"), 10, 50, 100).count() == 0
    with pytest.raises(ValueError):
        grid.to_grid(df, ["k"], "t", F.col("v"), 10, 55)


# --- lateness -------------------------------------------------------------------------------------


def test_lateness_and_statistics(spark):
    rng = random.Random(5)
    data = []
    for k in range(12):
        for n in range(rng.randint(0, 60)):
            arrival = n * 3 + rng.randint(0, 2)
            data.append((f"k{k}", arrival - rng.choice([0, 0, 1, 30, 80, -20]), arrival // 2, n, rng.randint(0, 5)))
    df = spark.createDataFrame([*data, (None, 1, 1, 1, 1), ("k1", None, 1, 999, 1)], "k string, t bigint, a bigint, q bigint, v int").withColumn("_shard", F.lit(9))
    heard = lateness.heard_before(df, "k", "t", "a", "q", shard_us=7)
    state = lateness.multiset(lateness.classify(heard, "t", 10, 15), ["k", "window_start_us"], F.col("v"))
    half = [lateness.multiset(lateness.classify(heard, "t", 10, 15).filter(F.col("q") % 2 == i), ["k", "window_start_us"], F.col("v")) for i in (0, 1)]
    by = defaultdict(list)
    for k in {x[0] for x in data}:
        top = None
        for _, t, a, q, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[3])):
            w = t // 10 * 10
            late = top is not None and top >= w + 10
            by[k, w].append((v, late, top is not None and top > w + 25))
            top = t if top is None else max(top, t)
    want = sorted((k, w, sum(not r for *_, r in x), sum(r for *_, r in x), sum(i for _, i, _ in x)) for (k, w), x in by.items())
    for s in (state, lateness.merge_states(["k", "window_start_us"], *half)):
        assert rows_of(lateness.period_counts(s, ["k", "window_start_us"]), "k", "window_start_us", "n_accepted", "n_rejected", "n_late") == want
    stats = []
    for (k, w), x in by.items():
        vs = sorted(v for v, _, r in x if not r)
        if vs:
            stats.append((k, w, len(vs), len(set(vs)), vs[0], vs[-1], vs[(len(vs) - 1) // 2]))
    assert rows_of(lateness.period_statistics(state, ["k", "window_start_us"]), "k", "window_start_us", "n", "n_distinct", "least", "greatest", "median") == sorted(stats)


def judged_at_once(data, window, cutoff):
    """Multisets by definition: rows (entity, ts, arrival, seq, counted, value) in order of arrival."""
    out = defaultdict(lambda: [0, 0, 0])
    for k in {x[0] for x in data}:
        top = None
        for _, t, _, _, counted, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[3])):
            w = t // window * window
            if counted:
                out[k, w, v][0 if top is None or top < w + window else 2 if top > w + window + cutoff else 1] += 1
            top = t if top is None else max(top, t)
    return [(*key, *n) for key, n in out.items()]


LATE = "entity string, ts bigint, arrival bigint, seq bigint, counted boolean, value bigint"
STATE = ("entity", "window_start_us", "value", "n_on_time", "n_corrected", "n_rejected")


def late_rows(seed, n=400):
    rng = random.Random(seed)
    return [(f"k{rng.randint(0, 4)}", a - rng.choice([0, 0, 1, 9, 30, 80, -20]), a, i, rng.random() < 0.8, rng.choice([None, 1, 2, 3])) for i in range(n) for a in [rng.randint(0, 600)]]


def test_lateness_table_in_any_order_of_batches_equals_one_pass(spark, tmp_path):
    data = late_rows(3)
    t = lateness.LatenessTable(spark, str(tmp_path / "t"), 10, 15, shard_us=20, part_us=100)
    df = lambda rows: spark.createDataFrame(rows, LATE)
    stored, withdrawn = [], data[5::40]
    for i in range(4):  # batches overlap in arrival; the third withdraws rows of the first two
        new = data[i::4]
        gone = [x for x in withdrawn if x in stored] if i == 2 else []
        kept = [x for x in stored if x not in gone]
        assert t.apply(df(new), i, df(gone) if gone else None, lambda since, kept=kept: df([x for x in kept if x[2] >= since]))
        assert not t.apply(df(new), i)
        stored = kept + new
        assert sorted((tuple(r[c] for c in STATE) for r in t.state().collect()), key=repr) == sorted(judged_at_once(stored, 10, 15), key=repr)


def test_a_late_batch_replaces_only_the_days_it_corrects(spark, tmp_path):
    t = lateness.LatenessTable(spark, str(tmp_path / "t"), 10, 1000, shard_us=50, part_us=100)
    df = lambda *rows: spark.createDataFrame(list(rows), LATE)
    t.apply(df(("a", 5, 5, 1, True, 1), ("a", 150, 150, 2, True, 1), ("a", 255, 255, 3, True, 1)), 0)
    before = t.table.state()["parts"]
    t.apply(df(("a", 151, 300, 4, True, 7)), 1, kept=lambda since: df(("a", 255, 255, 3, True, 1)).filter(F.col("arrival") >= since))
    after = t.table.state()["parts"]
    assert {p for p in before if p.startswith("counts") and before[p]["path"] != after[p]["path"]} == {"counts:1"}
    assert rows_of(t.state().filter("n_corrected > 0"), "window_start_us", "value") == [(150, 7)]
    assert t.apply(df(), 2) and t.state().count() == 4


def test_rows_without_a_partition_are_refused_and_young_folders_stay(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "a int")
    with pytest.raises(Exception, match="no partition"):
        t.write(spark.createDataFrame([(1,), (None,)], "a int"), F.col("a"))
    other = t.write(spark.createDataFrame([(1,)], "a int"))[""]  # what another writer is about to publish
    t.vacuum(t.state())
    assert spark.read.parquet(other).count() == 1
    t.vacuum(t.state(), age_s=-1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(other)


# --- redelivery -----------------------------------------------------------------------------------


SPELLINGS = [lambda h: h, str.upper, lambda h: "{" + h + "}", lambda h: f" {h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]} ", lambda h: "0x" + h.lstrip("0"), lambda h: "urn:uuid:" + h]


def deliveries(spark, seed=7):
    rng = random.Random(seed)
    out = []
    for off in range(300):
        n = rng.randint(0, 120)
        eid = rng.choice(SPELLINGS)(f"{n:032x}") if n else rng.choice([None, "", "  "])
        out.append((eid, n, rng.randint(0, 50), off % 3, off, rng.choice([*range(6), None]), f"p{off}"))
    df = spark.createDataFrame(out, "event_id string, n int, ts int, kafka_partition int, kafka_offset bigint, batch_no bigint, body string")
    return out, df.select("event_id", F.timestamp_micros(F.col("ts").cast("bigint")).alias("ingest_ts"), "kafka_partition", "kafka_offset", "batch_no", "body", F.lit(1).alias("_own"))


def test_first_delivery(spark):
    out, df = deliveries(spark)
    by = defaultdict(list)
    for eid, n, ts, p, o, b, body in out:
        by[n or ("none", o)].append((ts, o, p, body))
    want = sorted((min(x)[2], min(x)[1], min(x)[3]) for x in by.values())
    assert rows_of(messages.first_delivered(df, ["body"]), "kafka_partition", "kafka_offset", "body") == want


@pytest.mark.parametrize("increments", [1, 4])
def test_message_store(spark, tmp_path, increments):
    out, df = deliveries(spark, 8)
    store = redelivery.MessageStore(spark, str(tmp_path / "s"), {"body": "string"})
    redelivery.replay(store, df, "batch_no", increments)
    by = defaultdict(list)
    for eid, n, ts, p, o, b, body in out:
        by[n or ("none", o)].append((ts, o, p, body))
    kept = sorted((min(x)[2], min(x)[1], min(x)[3]) for x in by.values())
    assert rows_of(store.messages(), "kafka_partition", "kafka_offset", "body") == kept
    surplus = sorted((p, o) for x in by.values() for _, o, p, _ in sorted(x)[1:])
    assert rows_of(store.surplus(), "kafka_partition", "kafka_offset") == surplus
    assert not store.apply(df, 0)  # a batch that was committed


def test_message_store_rewrites_only_what_changes(spark, tmp_path):
    store = redelivery.MessageStore(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(list(x), "event_id string, t bigint, kafka_partition int, kafka_offset bigint").withColumn("ingest_ts", F.timestamp_micros("t"))
    store.apply(rows(("1", 10, 0, 1)), 0)
    store.apply(rows(("2", 20, 0, 2)), 1)
    before = store.table.state()["parts"]
    store.apply(rows(("0x1", 5, 0, 3), ("2", 30, 0, 4)), 2)
    after = store.table.state()["parts"]
    assert before["messages:0"]["path"] != after["messages:0"]["path"] and before["messages:1"]["path"] == after["messages:1"]["path"]
    assert rows_of(store.added(2), "kafka_offset") == [(3,)] and rows_of(store.removed(2), "kafka_offset") == [(1,)]
    assert rows_of(store.kept(2, 0), "kafka_offset") == [(2,)] and store.kept(2, 21).count() == 0
    assert rows_of(store.messages(), "kafka_offset") == [(2,), (3,)]
    assert rows_of(store.surplus(), "kafka_offset") == [(1,), (4,)]


def test_message_store_survives_a_batch_that_died(spark, tmp_path, monkeypatch):
    store = redelivery.MessageStore(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(list(x), "event_id string, t bigint, kafka_partition int, kafka_offset bigint").withColumn("ingest_ts", F.timestamp_micros("t"))
    store.apply(rows(("1", 10, 0, 1)), 0)
    batch = rows(("2", 20, 0, 2), ("1", 5, 0, 3), ("2", 30, 0, 4))
    with monkeypatch.context() as m:
        m.setattr(store.table, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.apply(batch, 1)
    assert rows_of(store.messages(), "kafka_offset") == [(1,)]
    assert store.apply(batch, 1)
    assert rows_of(store.messages(), "kafka_offset") == [(2,), (3,)]
    assert rows_of(store.surplus(), "kafka_offset") == [(1,), (4,)]


def test_message_store_empty(spark, tmp_path):
    _, df = deliveries(spark)
    store = redelivery.MessageStore(spark, str(tmp_path / "s"))
    redelivery.replay(store, df.limit(0), "batch_no", 3)
    assert store.messages().count() == 0 and store.surplus().count() == 0


def test_commit_conflict(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "a int")
    base = t.state()
    put = {"x": {"path": t.write(spark.range(1).selectExpr("cast(id as int) a"))[""], "stats": {}}}
    t.commit(base, put)
    with pytest.raises(RuntimeError):
        t.commit(base, put)
    assert t.read().count() == 1


# --- scans, upserts, alerts, metrics ----------------------------------------------------------------


def test_scan_equals_plain_windows(spark):
    rng = random.Random(11)
    data = [(f"k{k}", q, rng.choice([None, *range(9)])) for k in range(8) for q in range(rng.randint(1, 30))]
    df = spark.createDataFrame(data, "k string, q int, v int").withColumn("shard", F.expr("q div 4"))
    got = scans.scan(df, ["k"], "shard", ["q"], sums={"s": "v"}, tops={"t": "v"}, lags={"l": "v"}, leads={"f": "v"})
    want = []
    for k in {x[0] for x in data}:
        vs = [v for kk, _, v in data if kk == k]
        for i, _ in enumerate(vs):
            known = [v for v in vs[: i + 1] if v is not None]
            before = [v for v in vs[:i] if v is not None]
            want.append((k, i, sum(known) if known else 0, max(before) if before else None, vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None))
    have = [(r["k"], r["q"], r["s"] or 0, r["t"], r["l"], r["f"]) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_closed_is_final(spark):
    df = spark.createDataFrame([("a", 1, True, 5), ("a", 1, False, 9), ("a", 2, False, 1), ("a", 2, False, 3), (None, 1, True, 1)], "lot_id string, window_start int, closed boolean, at int")
    assert rows_of(upserts.closed_is_final(df, [F.col("at")]), "window_start", "at") == [(1, 5), (2, 3)]
    stored = df.filter("at = 5")
    assert rows_of(upserts.insert_missing(stored, df.filter("window_start = 2"), ["lot_id", "window_start"], [F.col("at")]), "window_start", "at") == [(1, 5), (2, 3)]


def test_hysteresis(spark):
    rng, data, want = random.Random(11), [], []
    for k in range(60):
        level, up = rng.randint(60, 100), False
        for q in range(rng.randint(0, 40)):
            level = min(100, max(60, level + rng.randint(-7, 7)))
            data.append((f"k{k}", q, level / 100, q // 5))
            if (level >= 90) != up and not 85 < level < 90:
                up = not up
                want.append((f"k{k}", q, "RAISED" if up else "CLEARED"))
    df = spark.createDataFrame(data, "k string, q int, f double, shard int")
    got = alerts.hysteresis(df, "k", "q", ["q"], "f", shard="shard")
    assert len(want) > 20 and rows_of(got, "k", "q", "state") == sorted(want)
    pairs = rows_of(alerts.pair_edges(got, "k", "q", ["q"]).fillna(-1), "k", "raised_at", "cleared_at")
    nxt = {(k, q): next((q2 for k2, q2, s2 in sorted(want) if k2 == k and q2 > q), -1) for k, q, s in want if s == "RAISED"}
    assert pairs == sorted((k, q, e) for (k, q), e in nxt.items())
    with pytest.raises(ValueError):
        alerts.hysteresis(df, "k", "q", ["q"], "f", 0.8, 0.9)


def test_latches_are_restored_from_their_log(spark):
    log = spark.createDataFrame([("a", "a|FULL_LOT|1", "RAISED", 1), ("b", "b|FULL_LOT|1", "RAISED", 1), ("b", "b|FULL_LOT|1", "CLEARED", 2), (None, "x", "RAISED", 3)], "lot_id string, alert_id string, state string, q int")
    latched = alerts.restore(log, "lot_id", ["q"])
    assert rows_of(latched, "lot_id", "alert_id") == [("a", "a|FULL_LOT|1")]
    df = spark.createDataFrame([(lot, 10_000_000 + i, n, 200) for lot in "ab" for i, n in enumerate((182, 181, 100, 190))], "lot_id string, at_us bigint, current_occupied int, capacity int")
    edges = alerts.hysteresis(df.withColumn("f", F.col("current_occupied") / F.col("capacity")), "lot_id", "at_us", ["at_us"], "f", keep=("current_occupied", "capacity"), latched=latched)
    got = rows_of(alerts.full_lot_alerts(edges, ["at_us"], latched), "lot_id", "at_us", "alert_id", "state", "message")
    raised = lambda k, i, n, pct: (k, 10_000_000 + i, f"{k}|FULL_LOT|10", "RAISED", f"Lot {k} full: {pct}% ({n}/200 slots)")
    cleared = lambda k, name: (k, 10_000_002, name, "CLEARED", f"Lot {k} has space again: 50% (100/200 slots)")
    assert got == [cleared("a", "a|FULL_LOT|1"), raised("a", 3, 190, 95), raised("b", 0, 182, 91), cleared("b", "b|FULL_LOT|10"), raised("b", 3, 190, 95)]


def test_sensor_alerts(spark):
    s = spark.createDataFrame([("L", "S1", True, 5_999_999, 150_000_000), ("L", "S1", False, 5_999_999, 200_000_000)], "lot_id string, sensor_id string, silent boolean, last_seen bigint, at bigint")
    assert rows_of(alerts.sensor_alerts(s), "alert_id", "state", "message") == [("L|S1|5", "CLEARED", "Sensor S1 reporting again"), ("L|S1|5", "RAISED", "Sensor S1 silent for 2 min")]


def test_load_row(spark):
    x = spark.createDataFrame([("a", t, min(t, 5) * 100, max(0, t - 2) * 100) for t in range(8)] + [("b", t, t * 100, t * 10) for t in range(5)], "k string, at_s int, produced int, consumed int")
    cols = ("k", "delivered", "produced_per_s", "sustained_per_s", "peak_backlog", "end_backlog", "drain_s", "saturated")
    assert rows_of(metrics.load_row(x, "k", 100, 2.5), *cols) == [("a", 500, 100.0, 500 / 7, 200, 200, 2, False), ("b", 400, 100.0, 10.0, 360, 360, None, True)]


def test_subscriptions_are_limited_and_changes_coalesced(spark):
    deltas = spark.createDataFrame([("L1", "s", 1, 1, "FREE"), ("L1", "s", 5, 2, "OCCUPIED"), ("L2", "s", 1, 3, "FREE"), ("L3", "s", 1, 4, "FREE")], "lot_id string, slot_id string, ts bigint, seq bigint, status string")
    subs = spark.createDataFrame([("c", "L1"), ("c", "L1"), ("c", "L2"), ("c", "L3"), ("d", None)], "client string, lot_id string")
    assert rows_of(occupancy.subscribed(deltas, subs, 2), "client", "lot_id", "ts", "status") == [("c", "L1", 5, "OCCUPIED"), ("c", "L2", 1, "FREE")]


def test_rounded_ratio_is_exact(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    rng = random.Random(3)
    rows = [(rng.randint(0, 10**12), rng.randint(1, 3 * 10**8)) for _ in range(300)] + [(1, 8), (3, 8), (5, 8), (1, 16), (0, 7), (45, 1000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = [r[0] for r in df.select(numbers.rounded_ratio(F.col("a"), F.col("b"), 2)).collect()]
    want = [float((Decimal(a) / Decimal(b)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for a, b in rows]
    assert got == want


def test_lifecycle(spark):
    m = spark.createDataFrame(
        [("a", "RAISED", 1, 1, "r"), ("a", "CLEARED", 5, 2, "c"), ("a", "RAISED", 7, 3, "r2"), ("b", "CLEARED", 4, 1, "x"), ("b", "RAISED", 9, 2, "y"), ("c", "RAISED", 2, 1, "z"), (None, "RAISED", 1, 1, "n")],
        "alert_id string, state string, at int, seq int, message string",
    )
    got = sorted(alerts.lifecycle(m).collect())
    assert [tuple(r) for r in got] == [("a", "cleared", 1, 5, "c"), ("b", "cleared", 4, 4, "x"), ("c", "active", 2, None, "z")]


def test_quantile_and_rates(spark):
    b = metrics.bucket_counts(spark.createDataFrame([("a", x / 10) for x in range(1, 101)], "k string, v double"), ["k"], "v", [1.0, 5.0, 20.0])
    assert metrics.histogram_quantile(b, ["k"], 0.5).first()["value"] == pytest.approx(5.0)
    s = spark.createDataFrame([("a", 0, 5), ("a", 1_000_000, 9), ("a", 2_000_000, 2)], "k string, at bigint, v int")
    assert [r["rate"] for r in metrics.rates(s, "k", "at", "v").orderBy("at").collect()] == [None, 4.0, 0.0]
    assert metrics.increases(s, "k", "at", "v").first()["increase"] == 6


def test_valid_is_no_error(spark):
    words = [None, "", "occupied ", "FREE", "Broken", "HEARTBEAT", "\toccupancy"]
    rows = [(e, k, st, tok, ok) for e in (None, "", "1") for k in words for st in words for tok in (None, "t") for ok in (True, False)]
    df = spark.createDataFrame(rows, "event_id string, event_type string, status string, vehicle_token string, ok boolean")
    ts = F.when(F.col("ok"), F.timestamp_micros(F.lit(0)))
    df = df.select("*", ts.alias("event_ts"), ts.alias("ingest_ts"), *(F.lit("x").alias(c) for c in ("sensor_id", "lot_id", "slot_id")))
    got = df.select(validation.is_valid().alias("a"), validation.event_error().isNull().alias("b"))
    assert got.filter("a <> b").count() == 0 and 0 < got.filter("a").count() < len(rows)


def test_regression_guard_and_late_correction(spark):
    t = 300_000_000 * 5_000_000
    row = lambda i, slot, sec, status: (f"{i:04x}", "occupancy ", f"S{slot}", "L", slot, status, "ab" if status.strip().lower() == "occupied" else None, t + sec * 1_000_000, t, 0, i)
    data = [row(1, "a", 0, "FREE"), row(2, "a", 100, "Occupied"), row(3, "a", 100, "FREE"), row(4, "a", 50, "FREE"), row(5, "b", 200, " free")]
    df = spark.createDataFrame(data, "event_id string, event_type string, sensor_id string, lot_id string, slot_id string, status string, vehicle_token string, t bigint, a bigint, kafka_partition int, kafka_offset bigint")
    j = occupancy.judge(df.select("*", F.timestamp_micros("t").alias("event_ts"), F.timestamp_micros("a").alias("ingest_ts")))
    assert rows_of(j.reports, "seq", "regressed") == [(1, False), (2, False), (3, True), (4, True), (5, False)]
    assert rows_of(occupancy.time_weighted(j), "area_us", "covered_us") == [(100_000_000, 200_000_000)]
