"""Records, files, generators and functions."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tidelot.functions import demand, numbers, partitioning
from tidelot.sources import generate, logs, records, reports, snapshots

GOOD = '{"event_id":"e1","event_type":"OCCUPANCY","sensor_id":"S","lot_id":"L","slot_id":"A","status":"OCCUPIED","vehicle_token":"t","event_ts":"2026-01-01T10:00:00.000Z","ingest_ts":"2026-01-01T10:00:01+05:30"}'
BAD = [
    (GOOD[:40], "malformed JSON"), ("not json at all", "malformed JSON"), ("", "malformed JSON"), (GOOD.replace('"lot_id"', '"lot"'), "missing field"), (GOOD[:-1] + ',"x":1}', "surplus field"),
    (GOOD.replace("OCCUPIED", "BROKEN"), "unknown status"), (GOOD.replace("00.000Z", "00"), "timestamp missing or without zone"), (GOOD.replace('"t"', "null"), "occupied without token"),
    (GOOD.replace("OCCUPIED", "FREE"), "free with token"), (GOOD.replace('"e1"', '""'), "event_id missing"), (GOOD.replace("OCCUPANCY", "HEARTBEAT"), "heartbeat with status or token"),
]


def log(spark, values):
    return spark.createDataFrame([(bytearray(v.encode()), 0, i) for i, v in enumerate(values)], "value binary, partition int, offset bigint")


def test_strict_parser_and_dead_letters(spark):
    x = records.parse_strict(log(spark, [GOOD, *(b for b, _ in BAD)])).cache()
    assert [r["error"] for r in x.orderBy("offset").collect()] == [None, *(e for _, e in BAD)]
    dead = records.dead_letters(x, F.lit(None).cast("timestamp")).orderBy("source_offset").collect()
    assert bytes.fromhex(dead[1]["original_hex"]) == b"not json at all" and len(dead) == len(BAD)


def test_lenient_parser(spark):
    assert records.parse_slot_reports(log(spark, [GOOD, *(b for b, _ in BAD)])).count() == 5  # token and surplus fields do not matter


def test_encode_round_trip(spark):
    e = records.parse_strict(log(spark, [GOOD])).select(*records.EVENT.fieldNames(), F.lit(0).alias("kafka_partition"), F.lit(0).cast("bigint").alias("kafka_offset"))
    again = records.parse_strict(records.encode_events(e)).select("error", *records.EVENT.fieldNames())
    assert again.drop("error").collect() == e.drop("kafka_partition", "kafka_offset").collect() and again.first()["error"] is None


def test_compacted_topic(spark):
    df = spark.createDataFrame([("a", "1", 0, 0), ("a", "2", 0, 5), ("b", "1", 0, 1), ("b", None, 0, 2)], "key string, value string, partition int, offset bigint")
    assert sorted((r["key"], r["value"]) for r in records.compacted(df).collect()) == [("a", "2"), ("b", "1")]
    assert [(r["key"], r["value"]) for r in records.compacted(df, tombstones=True).collect()] == [("a", "2")]


def test_file_log_bounds_and_kafka_gate(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, ["a", "b", "c"]).withColumns({"key": F.lit(None).cast("binary"), "timestamp": F.current_timestamp()}).write.parquet(path)
    assert logs.read_log(spark, path, {0: 1}, {0: 2}).count() == 1
    if not logs.kafka_available(spark):
        with pytest.raises(RuntimeError):
            logs.read_topic(spark, "localhost:1", "t")
    states = spark.createDataFrame([("x", 0, 2), ("y", 0, 5)], "key string, partition int, resume_offset bigint")
    assert logs.resume_offsets(states).first()["resume"] == 2
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("z", 0)], "key string, offset bigint")
    assert logs.not_applied(rows, states, "key").count() == 2


def test_snapshots_replay(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("SystemCodeNumber,Capacity,Occupancy,LastUpdated\nA,10,2,2016-10-04 08:00:00\nA,10,5,2016-10-04 08:30:00\nA,10,4,2016-10-04 09:00:00\nA,10,x,2016-10-04 09:30:00\n")
    s = snapshots.read_snapshots(spark, str(f), "Asia/Kolkata")
    assert s.count() == 3
    assert s.orderBy("ts").first()["ts"] == 1475548200_000000
    assert sorted(r["status"] for r in snapshots.replay(s).collect()) == ["FREE", "OCCUPIED", "OCCUPIED", "OCCUPIED"]


def test_murmur2_vectors_and_balance(spark):
    keys = ["21", "foobar", "a-little-bit-long-string"]
    want = [x & 0xFFFFFFFF for x in (-973932308, -790332482, -985981536)]
    assert partitioning.murmur2_many([k.encode() for k in keys]).tolist() == want
    df = spark.createDataFrame([*((k,) for k in keys), (None,)], "k string")
    assert [r[0] for r in df.select(partitioning.murmur2("k")).collect()] == [*want, None]
    ids = partitioning.balanced_ids(12, 6)
    places = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "k string").select(partitioning.partition_of("k", 6)).collect()]
    assert sorted(places) == sorted([*range(6)] * 2)


def test_demand(spark):
    df = spark.createDataFrame([("office", False, 9.5), ("office", False, 6.5), ("mall", True, 24.0), ("nowhere", True, 1.0)], "p string, w boolean, h double")
    got = {(r["p"], r["h"]): r["target"] for r in demand.target(df, "p", "w", "h").collect()}
    assert got["office", 9.5] == pytest.approx(0.92) and got["office", 6.5] == pytest.approx(0.125) and got["mall", 24.0] == pytest.approx(0.03) and got["nowhere", 1.0] is None


def test_generated_events_and_faults(spark):
    lots = spark.createDataFrame([("L1", "mall", 20)], "lot_id string, personality string, capacity int")
    e = generate.synthetic_events(spark, lots, 1_453_000_000_000_000, 60)
    assert e.filter("event_ts is null").count() == 0 and e.groupBy("slot_id").count().count() == 20
    load = generate.load(spark, 1000, streaming=False, seconds=2)
    assert load.count() == 2000 and load.filter("event_type = 'OCCUPANCY'").count() == 600
    encoded = records.encode_events(load.withColumns({"kafka_partition": F.lit(0), "kafka_offset": F.monotonically_increasing_id()})).withColumn("sensor_id", F.lit("S"))
    x = records.parse_strict(generate.with_faults(encoded, 10, 5, 5)).cache()
    n = {r["fault"]: r["count"] for r in x.groupBy("fault").count().collect()}
    assert 120 < n["late"] < 280 and 50 < n["duplicate"] < 160 and 50 < n["malformed"] < 160
    assert x.filter("fault = 'malformed' and error is null").count() == 0 and x.filter("coalesce(fault, '') <> 'malformed' and error is not null").count() == 0
    delay = x.filter("fault = 'late'").agg(F.min("delay_s"), F.max("delay_s")).first()
    assert delay[0] >= 15 and delay[1] <= 600
    ids = spark.range(1).select(generate.slot_ids(F.lit(21)).alias("s")).first()["s"]
    assert (ids[0], ids[19], ids[20]) == ("A-001", "A-020", "B-021")


def test_texts_and_labels(spark):
    df = spark.createDataFrame([(42.0, 950.0, 91.0), (420.0, 97066.0, 75.0), (11100.0, 0.0, None)], "s double, r double, p double")
    got = [tuple(r) for r in df.select(numbers.duration_text("s"), numbers.rate_text("r"), numbers.fill_label(F.col("p")), numbers.percent_text("p")).collect()]
    assert got == [("42 s", "950 /s", "Full", "91%"), ("7 min", "97.1k /s", "Filling", "75%"), ("3 h 05 min", "0 /s", "No data", None)]


def test_poisson_and_log_normal_draws(spark):
    x = spark.range(20_000).select(generate.draw(1, "id").alias("u"), generate.draw(2, "id").alias("v"))
    x = x.select(generate.poisson(F.col("u"), F.lit(0.7)).alias("few"), generate.poisson(F.col("u"), F.lit(40.0)).alias("many"), F.log(generate.log_normal(F.col("u"), F.col("v"), F.lit(100.0), F.lit(0.5))).alias("l"))
    r = x.agg(F.avg("few"), F.variance("few"), F.avg("many"), F.variance("many"), F.avg("l"), F.stddev("l")).first()
    assert [abs(a - b) < c for a, b, c in zip(r, (0.7, 0.7, 40, 40, 4.60517, 0.5), (0.02, 0.03, 0.2, 1.5, 0.02, 0.02), strict=True)] == [True] * 6
    assert spark.range(1).select(generate.poisson(F.lit(0.999), F.lit(0.0)).alias("n")).first()["n"] == 0


def test_visits_of_a_slot_do_not_overlap_and_stale_departures_are_void(spark):
    lots = spark.createDataFrame([("L", "mall", 3)], "lot_id string, personality string, capacity int")
    start = 1_454_284_800_000_000
    v = generate.visits(lots, start, 24 * 60, burst_every_s=3600, burst_s=1800, burst_factor=20.0)
    rows = sorted((r["slot"], r["arrives_us"], r["leaves_us"], r["cut_short"]) for r in v.collect())
    assert rows and any(r[3] for r in rows) and all(a[2] >= a[1] for a in rows)
    for a, b in zip(rows, rows[1:], strict=False):
        assert a[0] != b[0] or a[2] <= b[1]
    e = generate.visit_events(v, start, until_us=start + 180_000_000)
    n = {r["event_type"]: r["count"] for r in e.groupBy("event_type").count().collect()}
    assert n["OCCUPANCY"] == 2 * len(rows) and n["HEARTBEAT"] == 3 * len({r[0] for r in rows})


def test_release_order(spark):
    log = spark.createDataFrame([(0, 1, 10, 5.0), (0, 2, 11, 0.0), (0, 3, 12, 0.0)], "partition int, offset bigint, t bigint, delay_s double").withColumn("event_ts", F.timestamp_seconds("t"))
    assert [r["offset"] for r in generate.in_order_of_release(log).collect()] == [2, 3, 1]


def test_sensors_fall_silent_from_an_instant_on(spark):
    e = spark.createDataFrame([("L1", "s", 1), ("L1", "s", 9), ("L2", "s", 9), ("L2", "t", 9), (None, None, 9)], "lot_id string, sensor_id string, t bigint").withColumn("event_ts", F.timestamp_micros("t"))
    left = lambda specs, after=0: generate.without_sensors(e, specs, after).count()
    assert (left([]), left(["s"]), left(["L1:s"]), left(["L1:s"], 5), left(["L9:s", "t"])) == (5, 2, 3, 4, 4)


def test_reports_and_senders(spark, tmp_path):
    log = spark.createDataFrame([("late", 0), (None, 0), (None, 1)], "fault string, partition int")
    r = reports.run_summary(log)
    assert r.first().asDict() == {"messages": 3, "by_fault": {"late": 1, "none": 2}, "by_partition": {"0": 2, "1": 1}}
    reports.write_json(r, str(tmp_path / "j"))
    reports.write_csv(log, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).first()["messages"] == 3 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    said, posted = [], []
    reports.console_sender(said.append)([{"state": "RAISED", "kind": "FULL_LOT", "lot_id": "L", "message": "m"}])

    @contextlib.contextmanager
    def opened(req, timeout):
        posted.append((req.full_url, req.data, timeout))
        yield

    reports.webhook_sender("http://x/y", 2, opened)([{"a": 1}])
    assert said == ["RAISED FULL_LOT L: m"] and posted == [("http://x/y", b'[{"a": 1}]', 2)]


def test_scratch_on_a_cluster_must_be_shared(spark, monkeypatch):
    from tidelot import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session(), "x")
