"""The batch-wise processor: golden timeline, restart, and agreement with the set-based plan."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidelot.functions.timing import SECOND_US as S
from tidelot.operators import occupancy as o
from tidelot.operators.sessions import SessionTable
from tidelot.streaming import processor as pr
from tidelot.streaming import progress, sinks

T = 300 * 5_000_000 * S  # a window border
P = o.Params()

#: arrival, second after the border, slot, status (None: heartbeat), token, identifier
GOLDEN = [
    (1, 0, "A-001", "FREE", None, "a1"), (2, 0, "A-002", "FREE", None, "a2"), (3, 5, "A-004", "FREE", None, "a3"), (4, 60, "A-001", "OCCUPIED", "A", "a4"),
    (5, 120, "A-002", "OCCUPIED", "B", "a5"), (6, 120, "A-002", "OCCUPIED", "B", "a5"), (7, 180, "A-001", "FREE", None, "a7"), (8, 330, "A-003", "FREE", None, "a8"),
    (9, 400, "A-003", "OCCUPIED", "C", "a9"), (10, 250, "A-004", "OCCUPIED", "D", "a10"), (12, 800, "A-009", None, None, "a12"), (13, 30, "A-002", "FREE", None, "a13"),
    (14, 1100, "A-009", None, None, "a14"),
]


COLUMNS = "event_id string, event_type string, sensor_id string, lot_id string, slot_id string, status string, vehicle_token string, t bigint, a bigint, kafka_partition int, kafka_offset bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).select("*", F.timestamp_micros("t").alias("event_ts"), F.timestamp_micros("a").alias("ingest_ts")).drop("t", "a")


def table(spark):
    return frame(spark, [(f"0000{int(eid[1:]):04x}", "OCCUPANCY" if status else "HEARTBEAT", "S-" + slot, "LOT-01", slot, status, token, T + sec * S, T + seq * S, 0, seq) for seq, sec, slot, status, token, eid in GOLDEN])


def beat(spark, *rows):
    return frame(spark, [(f"{seq:04x}", "HEARTBEAT", sensor, "L", sensor, None, None, T + sec * S, T, 0, seq) for sensor, sec, seq in rows])


EXPECTED = {0: (350, 0, 2, 3, 1), 300: (800, None, None, 1, 0), 600: (900, 3, 3, 0, 0)}


def check(start, area, low, high, entries, exits):
    want = EXPECTED[(start - T) // S]
    assert (area // S, entries, exits) == (want[0], *want[3:])
    if want[1] is not None:
        assert (low, high) == want[1:3]


@pytest.mark.parametrize("cuts", [[], [6, 12], [1, 5, 9, 10]])
def test_golden_timeline_in_batches(spark, tmp_path, cuts):
    t, rows = pr.OccupancyTable(spark, str(tmp_path / "t"), P), table(spark)
    closed, late = [], []
    for i, (a, z) in enumerate(zip([0, *cuts], [*cuts, 99], strict=True)):
        assert t.apply(rows.filter((F.col("kafka_offset") > a) & (F.col("kafka_offset") <= z)), i)
        closed += t.output("results", i).filter("closed").collect()
        late += t.output("late", i).collect()
    assert [(r["window_start"] - T) // S for r in sorted(closed)] == [0, 300, 600]
    for r in closed:
        check(r["window_start"], r["area_us"], r["min_occupied"], r["max_occupied"], r["entries"], r["exits"])
    assert [r["seq"] for r in late] == [13]
    assert not t.apply(rows, 0)


def test_random_batches_equal_the_set(spark, tmp_path):
    import random

    rng, rows, clock = random.Random(8), [], {"L1": 0, "L2": 0}
    for seq in range(260):
        lot = rng.choice(["L1", "L1", "L2"])
        clock[lot] += rng.choice([0, 5, 20, 60, 200])
        sec = clock[lot] - rng.choice([0, 0, 0, 30, 150, 400, 1200])
        kind = rng.choice(["OCCUPANCY"] * 3 + ["HEARTBEAT"])
        status = rng.choice(["OCCUPIED", "FREE"]) if kind == "OCCUPANCY" else None
        slot = f"s{rng.randint(0, 4)}"
        rows.append((f"{rng.choice([seq, seq, seq, max(0, seq - 2)]):04x}", kind, "S" + slot, lot, slot, status, f"{rng.randint(1, 30):x}" if status == "OCCUPIED" else None, T + sec * S, T + seq * S, 0, seq))
    everything = frame(spark, rows)
    t = pr.OccupancyTable(spark, str(tmp_path / "t"), P)
    got = {}
    for i, (a, z) in enumerate([(0, 90), (90, 91), (91, 200), (200, 300)]):
        t.apply(everything.filter((F.col("kafka_offset") >= a) & (F.col("kafka_offset") < z)), i)
        got |= {(r["lot_id"], r["window_start"]): r for r in t.results(i).collect()}
    want = {(r["lot_id"], r["window_start"]): r for r in o.window_results(o.judge(everything)).collect()}
    same = ("avg_occupied", "min_occupied", "max_occupied", "entries", "exits", "unique_vehicles_est", "closed", "latest_arrival_us")
    assert len(want) > 20 and set(want) <= set(got)
    for key, w in want.items():
        assert [got[key][c] for c in same] == [w[c] for c in same], key


def test_golden_timeline_as_a_set(spark):
    j = o.judge(table(spark))
    rows = o.window_results(j).filter("closed").collect()
    assert sorted((r["window_start"] - T) // S for r in rows) == [0, 300, 600]
    for r in rows:
        check(r["window_start"], round(r["avg_occupied"] * 300) * S, r["min_occupied"], r["max_occupied"], r["entries"], r["exits"])
    assert [r["seq"] for r in j.late.collect()] == [13]


def test_parameters():
    with pytest.raises(ValueError):
        o.Params(dedupe_ttl=100 * S)
    with pytest.raises(ValueError):
        o.Params(raise_at=0.8, clear_at=0.9)


def test_silence_is_signalled_once_and_ends(spark, tmp_path):
    t = pr.OccupancyTable(spark, str(tmp_path / "t"), replace(P, offline_after=90 * S))
    signals = lambda i: [(r["sensor_id"], r["silent"]) for r in t.output("signals", i).collect()]
    t.apply(beat(spark, ("1", 0, 1), ("2", 0, 2), ("2", 100, 3)), 0)
    assert signals(0) == [("1", True)]
    t.apply(beat(spark, ("2", 105, 4)), 1)
    assert not signals(1)
    t.apply(beat(spark, ("1", 110, 5)), 2)
    assert signals(2) == [("1", False)]


def test_identifiers_are_forgotten_after_their_time(spark, tmp_path):
    t = pr.OccupancyTable(spark, str(tmp_path / "t"), P)
    report = lambda sec, seq, i: frame(spark, [(i, "OCCUPANCY", "x", "L", "x", "FREE", None, T + sec * S, T, 0, seq)])
    t.apply(report(0, 1, "01"), 0)
    t.apply(report(301, 2, "02"), 1)
    assert [r["ts"] for r in t.table.read(kind="ids").collect()] == [T + 301 * S]


def test_restored_slots_count(spark, tmp_path):
    t = pr.OccupancyTable(spark, str(tmp_path / "t"), P)
    t.restore(spark.createDataFrame([("L", T, T, 1)], pr.STATE["lots"]), spark.createDataFrame([("L", "x", T, "OCCUPIED")], pr.STATE["slots"]))
    t.apply(frame(spark, [("01", "OCCUPANCY", "x", "L", "x", "FREE", None, T + 100 * S, T, 0, 1)]), 0)
    assert [(r["area_us"], r["exits"], r["occupied"]) for r in t.output("results", 0).collect()] == [(100 * S, 1, 0)]
    with pytest.raises(ValueError):
        t.restore(spark.createDataFrame([], pr.STATE["lots"]), spark.createDataFrame([], pr.STATE["slots"]))


def test_empty_batch_keeps_the_state(spark, tmp_path):
    t = pr.OccupancyTable(spark, str(tmp_path / "t"), P)
    t.apply(table(spark), 0)
    before = t.table.read(kind="slots").count()
    assert t.apply(table(spark).limit(0), 1) and t.table.read(kind="slots").count() == before and t.output("results", 1).count() == 0


def test_stream_restarts_and_agrees_with_the_set(spark, tmp_path):
    src, ck, side = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "side")
    all_rows = table(spark)
    parts = [all_rows.filter("kafka_offset <= 6"), all_rows.filter("kafka_offset > 6 and kafka_offset <= 12"), all_rows.filter("kafka_offset > 12")]
    windows = sinks.window_table(spark, str(tmp_path / "windows"))
    for part in parts:  # each run starts from the checkpoint of the run before
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(all_rows.schema).parquet(src)
        state = pr.OccupancyTable(spark, str(tmp_path / "state"), P)
        q = stream.writeStream.foreachBatch(pr.fold_occupancy(state, sinks.split_outputs(windows, side))).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = windows.read().filter("closed").collect()
    assert len(got) == 3
    for r in got:
        check(r["window_start"], r["area_us"], r["min_occupied"], r["max_occupied"], r["entries"], r["exits"])
    assert [r["seq"] for r in spark.read.parquet(side + "/late").collect()] == [13]


def test_progress_is_a_table(spark, tmp_path):
    import time

    seen = progress.ProgressLog()
    spark.streams.addListener(seen)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            if seen.ended:
                break
            time.sleep(0.1)
        rows = seen.frame(spark).filter("query = 'counted'").agg(F.sum("rows")).first()
    finally:
        spark.streams.removeListener(seen)
    assert rows[0] == 5 and seen.started == seen.ended == 1


def test_replayed_batch_changes_nothing(spark, tmp_path):
    w = sinks.window_table(spark, str(tmp_path / "w"))
    row = lambda area, closed: ("L", T, area, 300, 0, 1, 0, 0, None, closed, None)
    df = lambda *rows: spark.createDataFrame(list(rows), sinks.WINDOW_SCHEMA)
    assert w.apply(df(row(1, False)), 0) and w.apply(df(row(2, True)), 1)
    assert not w.apply(df(row(9, True)), 1)
    assert w.apply(df(row(3, False)), 2)  # open never replaces closed
    assert [r["area_us"] for r in w.read().collect()] == [2]
    assert w.apply(df(row(4, True)), 3)
    assert [r["area_us"] for r in w.read().collect()] == [4]


def test_fold_sessions(spark, tmp_path):
    t = SessionTable(spark, str(tmp_path / "s"), ["k"], 10)
    f = sinks.fold_sessions(t, ["k"], "ts")
    rows = lambda *ts: spark.createDataFrame([("a", x) for x in ts], "k string, ts bigint")
    f(rows(0, 5, 40), 0)
    f(rows(0, 5, 40), 0)
    f(rows(15, 22, 30), 1)  # bridges both
    assert [(r["s"], r["e"], r["n"]) for r in t.sessions().collect()] == [(0, 40, 6)]


def test_notifier_failure_is_isolated(spark):
    got = []

    def broken(page):
        raise OSError

    sinks.notify([broken, got.extend])(spark.range(3), 0)
    assert [r["id"] for r in got] == [0, 1, 2]
