"""Queries over the log itself and over generators: depth, lag, rates, quantiles, dead letters, replay, partitioning, faults."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelot.functions import demand, partitioning
from tidelot.functions.timing import HOUR_US, SECOND_US, cell_of, local_hour, local_weekday
from tidelot.operators import metrics, validation
from tidelot.operators.messages import canonical_id, canonical_word
from tidelot.plans.reads import stored_windows
from tidelot.plans.stream_core import VALID_SQL
from tidelot.session import scratch_dir, table
from tidelot.sources import generate, logs, records, snapshots

#: A report that took longer than this to arrive counts as late in log statistics.
LATE_US = 15 * SECOND_US
LATENCY_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0, 3600.0]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parking_events")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), "batch_no", F.unix_micros("ingest_ts").alias("at"))


def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    """Messages, invalid ones, surplus copies of valid ones, and valid ones that arrived late."""
    e = _events(spark, d).withColumn("bad", validation.event_error().isNotNull())
    late = F.unix_micros("ingest_ts") - F.unix_micros("event_ts") > LATE_US
    # Copies per identifier: one row each after partial aggregation.
    per = e.groupBy(canonical_id("event_id").alias("id"), "bad").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"))
    ok = ~F.col("bad")
    return per.agg(
        F.sum("n").alias("messages"), F.sum(F.when(~ok, F.col("n")).otherwise(0)).alias("invalid"), F.sum(F.when(ok, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(ok, F.col("late")).otherwise(0)).alias("late"),
    )


def partition_depth(spark: SparkSession, d: str) -> DataFrame:
    return metrics.offset_ranges(_log(spark, d))


def silent_sensors(spark: SparkSession, d: str) -> DataFrame:
    """Sensors whose last heartbeat lies more than an hour before the newest one of all."""
    h = validation.valid_events(_events(spark, d)).filter(canonical_word("event_type") == "HEARTBEAT")
    last = h.groupBy("lot_id", "sensor_id").agg(F.max(F.unix_micros("event_ts")).alias("last"))
    newest = last.agg(F.max("last")).scalar()
    return last.filter(newest - F.col("last") > HOUR_US)


def lag_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Lag of two groups, one of which committed all batches up to number 20 and one nothing in partition 0."""
    log = _log(spark, d)
    early = log.filter("batch_no <= 20").groupBy("partition").agg((F.max("offset") + 1).alias("committed")).withColumn("group", F.lit("processor"))
    some = early.withColumns({"group": F.lit("sink"), "committed": F.when(F.col("partition") != 0, F.col("committed"))})
    return metrics.lag(early.unionByName(some), metrics.offset_ranges(log))


def rate_from_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Rows per second by partition between hourly polls of the end offset."""
    polls = _log(spark, d).groupBy("partition", (cell_of("at", HOUR_US) * HOUR_US).alias("at")).agg(F.max("offset").alias("end_offset"))
    return metrics.rates(polls, "partition", "at", "end_offset")


def counter_increase(spark: SparkSession, d: str) -> DataFrame:
    """Increase of a per-partition counter of the stored batch numbers, which starts again with each thousand of offsets."""
    polls = _log(spark, d).groupBy("partition", "at").agg(F.max(F.pmod("offset", F.lit(1000))).alias("counter"))
    return metrics.increases(polls, "partition", "at", "counter")


def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    """p95 of arrival delay by partition, from fixed buckets; clocks that run ahead count as no delay."""
    e = _events(spark, d).select(F.col("kafka_partition").alias("partition"), F.greatest(F.lit(0.0), (F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1e6).alias("delay"), "event_ts").filter("event_ts is not null")
    return metrics.histogram_quantile(metrics.bucket_counts(e, ["partition"], "delay", LATENCY_BOUNDS), ["partition"], 0.95)


def rebalance_detect(spark: SparkSession, d: str) -> DataFrame:
    """Changes between batches of which partitions are busy (70 rows and more); a batch with fewer than four counts as rebalancing."""
    busy = _log(spark, d).groupBy("batch_no", "partition").agg(F.count_if(F.col("offset").isNotNull()).alias("n"))
    b = busy.groupBy("batch_no").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("n") >= 70, F.col("partition")))), ",").alias("signature"), F.count_if(F.col("n") >= 70).alias("n"))
    b = b.withColumns({"state": F.when(F.col("n") < 4, "rebalancing").otherwise("stable"), "group": F.lit("raw")})
    return metrics.layout_changes(b, "group", "batch_no", "state", "signature")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumns({"event_type": canonical_word("event_type"), "status": canonical_word("status")})
    return records.encode_events(e)


def dlq_validate(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters by reason after encoding every event as JSON, cutting each row with offset 7 of 50 short and parsing all again."""
    log = _encoded(spark, d)
    cut = F.pmod("offset", F.lit(50)) == 7
    log = log.withColumn("value", F.when(cut, F.substring("value", 1, 25)).otherwise(F.col("value")))
    dead = records.dead_letters(records.parse_strict(log), F.lit(None).cast("timestamp"))
    return dead.groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def fault_counts(spark: SparkSession, d: str) -> DataFrame:
    """What injection did: rows by fault, and how many of those made malformed the strict parser rejects."""
    log = _encoded(spark, d).withColumn("sensor_id", F.lit("S"))
    x = records.parse_strict(generate.with_faults(log, 10, 5, 5).drop("sensor_id"))
    rejected = F.count_if(F.col("error").isNotNull())
    return x.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.when(F.first("fault") == "malformed", rejected).alias("n_rejected"))


#: A Monday, from which visits are generated.
VISITS_FROM = 1454284800_000_000


def visits_generated(spark: SparkSession, d: str) -> DataFrame:
    """A day of generated visits with a burst in every third hour: arrivals by lot and hour."""
    v = _visits(spark, d)
    return v.groupBy("lot_id", F.floor((F.col("arrives_us") - VISITS_FROM) / 3.6e9).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if("cut_short").alias("n_cut_short"))


def _visits(spark: SparkSession, d: str) -> DataFrame:
    lots = table(spark, d, "lot_metadata").select("lot_id", "personality", "capacity")
    return generate.visits(lots, VISITS_FROM, 24 * 60, seed=5, burst_every_s=3 * 3600, burst_s=3600, burst_factor=2.0)


def load_test_row(spark: SparkSession, d: str) -> DataFrame:
    """What a load test would report by partition, if each hour's arrivals were consumed an hour later."""
    hour = cell_of("at", HOUR_US)
    per = _log(spark, d).filter("at is not null").groupBy("partition", hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    produced = per.select("partition", "h", F.col("n").alias("p"), F.lit(0).alias("c"))
    consumed = per.select("partition", (F.col("h") + 1).alias("h"), F.lit(0).alias("p"), F.col("n").alias("c"))
    both = produced.unionByName(consumed).groupBy("partition", "h").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    w = Window.partitionBy("partition").orderBy("h")  # a row per hour
    samples = both.select("partition", (F.col("h") * 3600).alias("at_s"), F.sum("p").over(w).alias("produced"), F.sum("c").over(w).alias("consumed"))
    return metrics.load_row(samples, "partition", 1.0, 2.0)


def lag_with_owner(spark: SparkSession, d: str) -> DataFrame:
    """The lag of two groups with the members that own their partitions; the sink's partition 0 has none."""
    lags = lag_by_group(spark, d)
    owners = lags.select("group", "partition", F.concat_ws("-", "group", F.pmod("partition", F.lit(2)).cast("string")).alias("owner")).filter("not (`group` = 'sink' and partition = 0)")
    return metrics.with_owner(lags, owners)


def delay_by_lot(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of arrival delay summed by lot over its sensors' worst, where known."""
    e = _events(spark, d).filter("lot_id is not null and sensor_id is not null")
    delay = F.floor((F.unix_micros("ingest_ts") - F.unix_micros("event_ts")) / 1e6).cast("double")
    worst = e.groupBy("lot_id", "sensor_id").agg(F.max(F.coalesce(delay, F.lit(float("-inf")))).alias("w"))
    return metrics.sum_by(worst.withColumn("w", F.when(F.col("w") == float("-inf"), float("nan")).otherwise(F.col("w"))), ["lot_id"], "w")


def lots_up(spark: SparkSession, d: str) -> DataFrame:
    """Lots heard within an hour of the log's newest row."""
    return metrics.up(_events(spark, d).filter("lot_id is not null").select("lot_id", F.unix_micros("ingest_ts").alias("at")), "lot_id", "at", HOUR_US)


def reports_by_local_hour(spark: SparkSession, d: str, zone: str = "Asia/Kolkata") -> DataFrame:
    e = validation.valid_events(_events(spark, d)).select(F.unix_micros("event_ts").alias("ts"))
    return e.groupBy(local_weekday("ts", zone).alias("weekday"), local_hour("ts", zone).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


DROPPED = ["LOT-08:S-B-017", "S-A-002"]


def dropped_sensors(spark: SparkSession, d: str) -> DataFrame:
    """Rows left by lot when one sensor of a lot and one name in all lots fall silent."""
    x = generate.without_sensors(_events(spark, d).filter("lot_id is not null"), DROPPED)
    return x.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n"))


def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """What each partition of a log kept as files still has to be read of, between a common end and where its lots have been applied to: every lot up to its row of the middle batch."""
    log = _events(spark, d).filter("lot_id is not null and kafka_partition is not null and kafka_offset is not null")
    middle = log.agg(F.floor((F.min("batch_no") + F.max("batch_no")) / 2).alias("b")).select("b").scalar()
    states = log.filter(F.col("batch_no") <= middle).groupBy("lot_id").agg((F.max("kafka_offset") + 1).alias("resume_offset"), F.first("kafka_partition").alias("partition"))
    path = scratch_dir(spark, "log")
    _encoded(spark, d).withColumn("timestamp", F.lit(None).cast("timestamp")).select("key", "value", "partition", "offset", "timestamp").write.parquet(path)
    start = {r["partition"]: r["resume"] for r in logs.resume_offsets(states).collect()}  # a row per partition
    tail = logs.read_log(spark, path, start=start).filter("key is not null").withColumn("lot_id", F.col("key").cast("string"))
    return logs.not_applied(tail, states, "lot_id").groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first"))


def newest_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The newest three rows of each partition by arrival."""
    e = _events(spark, d).filter("ingest_ts is not null").select("kafka_partition", "kafka_offset", F.unix_micros("ingest_ts").alias("at_us"))
    return metrics.newest_n(e, ["kafka_partition"], [F.col("at_us").desc(), F.col("kafka_offset").desc()], 3)


def lenient_slot_events(spark: SparkSession, d: str) -> DataFrame:
    x = records.parse_slot_reports(_encoded(spark, d))
    return x.groupBy("lot_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("event_ts")).alias("newest"))


def compacted_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Lot metadata read back from a compacted topic that holds an outdated and a current version of each lot."""
    m = table(spark, d, "lot_metadata").select("lot_id", "capacity")
    value = lambda cap: F.to_json(F.struct("lot_id", cap.alias("capacity"))).cast("binary")
    version = lambda cap, n: m.select(F.col("lot_id").alias("key"), value(cap).alias("value"), F.lit(0).alias("partition"), F.lit(n).alias("offset"))
    log = version(F.lit(1), 0).unionByName(version(F.col("capacity"), 1)).unionByName(version(F.col("capacity"), 2).withColumn("value", F.lit(None).cast("binary")))
    x = records.compacted(log)
    return x.select(F.from_json(F.col("value").cast("string"), "lot_id string, capacity int").alias("m")).select("m.*")


def _hourly_snapshots(spark: SparkSession, d: str) -> DataFrame:
    w = stored_windows(spark, d).filter("max_occupied is not null")
    w = w.groupBy("lot_id", (cell_of("window_start", HOUR_US) * HOUR_US).alias("ts")).agg(F.max("max_occupied").alias("occupied"))
    return w


def replay_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals and departures that turn each lot's hourly peak into the next."""
    return snapshots.replay(_hourly_snapshots(spark, d))


def demand_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Target share of every lot at each half hour of a weekday and a weekend day."""
    lots = table(spark, d, "lot_metadata").select("lot_id", "personality")
    x = lots.withColumn("half", F.explode(F.sequence(F.lit(0), F.lit(48)))).withColumn("weekend", F.explode(F.array(F.lit(False), F.lit(True))))
    x = demand.target(x.withColumn("hour", F.col("half") / 2.0), "personality", "weekend", "hour")
    return x.select("lot_id", "half", "weekend", F.floor(F.col("target") * 1e6 + 0.5).alias("target_millionths"))


def partition_murmur2(spark: SparkSession, d: str) -> DataFrame:
    """Each lot's partition by the key hash of Kafka's producers."""
    return table(spark, d, "lot_metadata").select("lot_id", partitioning.partition_of("lot_id", 6).alias("partition"))


def partition_skew(spark: SparkSession, d: str) -> DataFrame:
    """Rows and lots by partition as stored."""
    return _events(spark, d).groupBy(F.col("kafka_partition").alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lot_id").alias("n_lots"))


_BUCKETS = ", ".join(f"count_if(delay <= {b}) as b{i}" for i, b in enumerate(LATENCY_BOUNDS))
_PAIRS = ", ".join(f"struct_pack(le := cast({b} as double), n := b{i})" for i, b in enumerate(LATENCY_BOUNDS))
_CURVES = ", ".join(
    f"('{p}', {str(w).lower()}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for (p, w), c in demand.CURVES.items() for a, b in zip(c, c[1:], strict=False)
)
_STAYS = ", ".join(f"('{k}', {m}::double, {s}::double, {m * math.exp(s**2 / 2)!r}::double)" for k, (m, s) in demand.STAYS.items())
_MD5 = "(('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0::double)"
_DRAW = _MD5.format("{} kafka_partition || ':' || kafka_offset")
_LOG = "log as (select kafka_partition as p, kafka_offset as o, batch_no, epoch_us(ingest_ts) as t from parking_events), ends as (select p, min(o) as low, max(o) + 1 as high, count(*) as n from log group by p)"

ORACLES = {
    "topic_stats": f"""with {VALID_SQL}, per as (select k, reason is not null as bad, count(*) as n, count_if(epoch_us(ingest_ts) - epoch_us(event_ts) > 15000000) as late from reasons group by all)
select cast(sum(n) as bigint) as messages, cast(sum(n) filter (where bad) as bigint) as invalid, cast(sum(n - 1) filter (where not bad) as bigint) as duplicates, cast(sum(late) filter (where not bad) as bigint) as late from per""",
    "partition_depth": f"with {_LOG} select p as partition, low, high, n, high - low as depth from ends",
    "silent_sensors": f"""with {VALID_SQL}, h as (select lot_id, sensor_id, max(epoch_us(event_ts)) as last from reasons where reason is null and kind = 'HEARTBEAT' group by all)
select * from h where (select max(last) from h) - last > 3600000000""",
    "lag_by_group": f"""with {_LOG}, c as (select p, max(o) + 1 as committed from log where batch_no <= 20 group by p),
g as (select 'processor' as grp, p, committed from c union all select 'sink', p, case when p <> 0 then committed end from c)
select grp as "group", p as partition, greatest(0, high - coalesce(committed, low)) as lag from g join ends using (p)""",
    "rate_from_offsets": f"""with {_LOG}, x as (select p as partition, t - t % 3600000000 as at_us, max(o) as end_offset from log group by all)
select partition, at_us as "at", end_offset, case when end_offset < lag(end_offset) over w then 0.0
    else (end_offset - lag(end_offset) over w) / ((at_us - lag(at_us) over w) / 1e6) end as rate from x window w as (partition by partition order by at_us)""",
    "counter_increase": f"""with {_LOG}, x as (select p as partition, t, max(o % 1000) as c from log group by all), y as (select *, lag(c) over (partition by partition order by t) as b from x)
select partition, cast(sum(case when b is null then 0 when c < b then c else c - b end) as bigint) as increase from y group by all""",
    "histogram_quantile": f"""with e as (select kafka_partition as partition, greatest(0.0, (epoch_us(ingest_ts) - epoch_us(event_ts)) / 1e6) as delay from parking_events where event_ts is not null and ingest_ts is not null),
b as (select partition, {_BUCKETS}, count(*) as b{len(LATENCY_BOUNDS)} from e group by partition),
u as (select partition, unnest([{_PAIRS}, struct_pack(le := cast('inf' as double), n := b{len(LATENCY_BOUNDS)})]) as p from b),
c as (select partition, p.le as le, p.n as n, coalesce(lag(p.n) over w, 0) as below, coalesce(lag(p.le) over w, 0.0) as lo, max(p.n) over (partition by partition) as total from u window w as (partition by partition order by p.le))
select partition, case when le = 'inf'::double then lo else lo + (le - lo) * (total * 0.95::double - below) / (n - below) end as value from c where n >= total * 0.95::double and below < total * 0.95::double""",
    "rebalance_detect": f"""with {_LOG}, busy as (select batch_no, p, count(o) as n from log group by all),
b as (select batch_no, coalesce(string_agg(p, ',' order by p) filter (where n >= 70), '') as signature, case when count_if(n >= 70) < 4 then 'rebalancing' else 'stable' end as state from busy group by batch_no),
x as (select *, lag(state) over (order by batch_no) as was, lag(signature) over (order by batch_no) as prior from b)
select 'raw' as "group", batch_no, case when state = 'rebalancing' and was <> 'rebalancing' then 'rebalance started' when was = 'rebalancing' and state <> 'rebalancing' then 'rebalance finished' else 'assignment changed' end as description
from x where was is not null and (was <> state or signature is distinct from prior)""",
    "dlq_validate": f"""with {VALID_SQL}, x as (select case when kafka_offset % 50 = 7 then 'malformed JSON' else reason end as reason from reasons)
select reason, count(*) as n from x where reason is not null group by reason""",
    "fault_counts": f"""with x as (select *, {_DRAW.format("'3:' ||")} as u0, {_DRAW.format("'4:' ||")} as u1, {_DRAW.format("'5:' ||")} as u2 from parking_events)
select case when u0 < 0.1 then 'late' else 'none' end as fault, count(*) as n, cast(null as bigint) as n_rejected from x group by all
union all select 'duplicate', count(*), null from x where u1 < 0.05 union all select 'malformed', count(*), count(*) from x where u2 < 0.05""",
    "visits_generated": f"""with recursive s(personality, weekend, h0, v0, h1, v1) as (values {_CURVES}), k(personality, median, sigma, mean) as (values {_STAYS}),
m as (select lot_id, personality, capacity, unnest(range(1440)) as minute from lot_metadata where lot_id is not null and capacity is not null),
t as (select m.*, case when minute * 60 % 10800 < 3600 then 2.0::double else 1.0 end * capacity * (v0 + (v1 - v0) * (minute / 60.0::double - h0) / (h1 - h0)) * 60 / mean as lam, median, sigma
  from m join s on m.personality = s.personality and not weekend and minute / 60.0::double >= h0 and minute / 60.0::double < h1 join k on k.personality = m.personality),
u as (select *, {_MD5.format("'5:' || lot_id || ':' || minute || ':n'")} as u from t),
q as (select lot_id, minute, capacity, median, sigma, lam, u, 0 as n, exp(-lam) as p, exp(-lam) as c from u
  union all select lot_id, minute, capacity, median, sigma, lam, u, n + 1, p * lam / (n + 1), c + p * lam / (n + 1) from q where c <= u and n < 200),
c as (select lot_id, minute, capacity, median, sigma, max(n) as n from q group by all having max(n) > 0),
e as (select *, unnest(range(1, n + 1)) as k from c),
d as (select *, {_MD5.format("'5:' || lot_id || ':' || minute || ':' || k || ':slot'")} as ds, {_MD5.format("'5:' || lot_id || ':' || minute || ':' || k || ':at'")} as da,
  {_MD5.format("'5:' || lot_id || ':' || minute || ':' || k || ':u'")} as du, {_MD5.format("'5:' || lot_id || ':' || minute || ':' || k || ':v'")} as dv from e),
v as (select lot_id, cast(floor(ds * capacity) as int) as slot, {VISITS_FROM} + minute * 60000000 + cast(floor(da * 60) as bigint) * 1000000 as a, minute || '-' || k as visit,
  cast(floor(greatest(60.0::double, median * exp(sigma * sqrt(-2 * ln(1 - du)) * cos(2 * pi() * dv)))) as bigint) as stay from d),
w as (select *, lead(a) over (partition by lot_id, slot order by a, visit) as nxt from v)
select lot_id, cast((a - {VISITS_FROM}) // 3600000000 as bigint) as hour, count(*) as n, count_if(coalesce(nxt <= a + stay * 1000000, false)) as n_cut_short from w group by all""",
    "load_test_row": """with p as (select kafka_partition as partition, epoch_us(ingest_ts) // 3600000000 as h, count(*) as n from parking_events where ingest_ts is not null group by all),
t as (select partition, min(h) as lo, max(h) as hi, sum(n) as total, arg_max(n, h) as last from p group by partition)
select partition, cast(total as bigint) as delivered, total / ((hi - lo) * 3600) as produced_per_s, total / ((hi + 1 - lo) * 3600) as sustained_per_s, (select max(n) from p where p.partition = t.partition) as peak_backlog,
  last as end_backlog, cast(3600 as bigint) as drain_s, last > 2.0 as saturated from t""",
    "lag_with_owner": f"""with {_LOG}, c as (select p, max(o) + 1 as committed from log where batch_no <= 20 group by p),
g as (select 'processor' as grp, p, committed from c union all select 'sink', p, case when p <> 0 then committed end from c)
select grp as "group", p as partition, greatest(0, high - coalesce(committed, low)) as lag, case when grp <> 'sink' or p <> 0 then grp || '-' || (p % 2) end as owner from g join ends using (p)""",
    "delay_by_lot": """with w as (select lot_id, sensor_id, max(floor((epoch_us(ingest_ts) - epoch_us(event_ts)) / 1e6)) as w from parking_events where lot_id is not null and sensor_id is not null group by all)
select lot_id, sum(w) as total, count(w) as n from w group by lot_id""",
    "lots_up": """with l as (select lot_id, max(epoch_us(ingest_ts)) as last from parking_events where lot_id is not null and ingest_ts is not null group by lot_id)
select lot_id, (select max(last) from l) - last <= 3600000000 as up from l""",
    "reports_by_local_hour": f"""with {VALID_SQL}, t as (select epoch_us(event_ts) + 19800000000 as t from reasons where reason is null)
select cast((t // 86400000000 + 3) % 7 as int) as weekday, cast(t // 3600000000 % 24 as int) as hour, count(*) as n from t group by all""",
    "dropped_sensors": """select lot_id, count(*) as n from parking_events where lot_id is not null
  and not coalesce((sensor_id = 'S-B-017' and lot_id = 'LOT-08') or sensor_id = 'S-A-002', false) group by lot_id""",
    "log_tail": """with l as (select lot_id, kafka_partition as p, kafka_offset as o, batch_no from parking_events where lot_id is not null and kafka_partition is not null and kafka_offset is not null),
s as (select lot_id, max(o) + 1 as resume from l where batch_no <= (select floor((min(batch_no) + max(batch_no)) / 2) from l) group by lot_id)
select p as partition, count(*) as n, min(o) as first from l left join s using (lot_id) where resume is null or o >= resume group by p""",
    "newest_arrivals": """select kafka_partition, kafka_offset, epoch_us(ingest_ts) as at_us from parking_events where ingest_ts is not null
qualify row_number() over (partition by kafka_partition order by ingest_ts desc, kafka_offset desc) <= 3""",
    "lenient_slot_events": f"""with {VALID_SQL} select lot_id, st as status, count(*) as n, max(epoch_us(event_ts) // 1000 * 1000) as newest from reasons
where kind = 'OCCUPANCY' and st in ('OCCUPIED', 'FREE') and lot_id is not null and slot_id is not null and event_ts is not null group by all""",
    "compacted_metadata": "select lot_id, capacity from lot_metadata",
    "replay_deltas": """with w as (select *, row_number() over (partition by lot_id, window_start order by closed desc, emitted_at desc nulls last, capacity desc, avg_occupied desc nulls last, avg_occupancy_pct desc nulls last,
      min_occupied desc nulls last, max_occupied desc nulls last) as rn from lot_occupancy_5min where lot_id is not null and window_start is not null),
h as (select lot_id, epoch_us(window_start) // 3600000000 * 3600000000 as ts, max(max_occupied) as occupied from w where rn = 1 and max_occupied is not null group by all),
l as (select *, lag(occupied) over (partition by lot_id order by ts) as was, lag(ts) over (partition by lot_id order by ts) as since from h),
x as (select *, abs(occupied - was) as n, unnest(range(1, abs(occupied - was) + 1)) as i from l where was is not null and was <> occupied)
select lot_id, since + (ts - since) * i // (n + 1) as ts, case when occupied > was then 'OCCUPIED' else 'FREE' end as status from x""",
    "demand_interpolate": f"""with s(personality, weekend, h0, v0, h1, v1) as (values {_CURVES}),
x as (select lot_id, personality, half, half / 2.0::double as hour from lot_metadata, (select unnest(range(49)) as half))
select lot_id, cast(half as int) as half, weekend, cast(floor((v0 + (v1 - v0) * (hour - h0) / (h1 - h0)) * 1e6 + 0.5) as bigint) as target_millionths
from x join s using (personality) where hour >= h0 and (hour < h1 or (hour = 24 and h1 = 24))""",
    "partition_murmur2": """with b as (select lot_id, ascii(lot_id[1]) + 256 * ascii(lot_id[2]) + 65536 * ascii(lot_id[3]) + 16777216 * ascii(lot_id[4]) as w, ascii(lot_id[5]) + 256 * ascii(lot_id[6]) as tail from lot_metadata),
k1 as (select lot_id, tail, (cast(w as hugeint) * 1540483477) % 4294967296 as k from b),
k2 as (select lot_id, tail, (xor(cast(k as bigint), cast(k as bigint) >> 24)::hugeint * 1540483477) % 4294967296 as k from k1),
h1 as (select lot_id, tail, xor(cast((xor(2538058380::bigint, 6::bigint)::hugeint * 1540483477) % 4294967296 as bigint), cast(k as bigint)) as h from k2),
h2 as (select lot_id, cast((xor(h, tail::bigint)::hugeint * 1540483477) % 4294967296 as bigint) as h from h1),
h3 as (select lot_id, cast((xor(h, h >> 13)::hugeint * 1540483477) % 4294967296 as bigint) as h from h2)
select lot_id, cast((xor(h, h >> 15) & 2147483647) % 6 as int) as partition from h3""",
    "partition_skew": "select kafka_partition as partition, count(*) as n, count(distinct lot_id) as n_lots from parking_events group by all",
}

QUERIES = {
    f.__name__: f
    for f in (
        topic_stats, partition_depth, silent_sensors, lag_by_group, rate_from_offsets, counter_increase, histogram_quantile, rebalance_detect, dlq_validate, fault_counts, visits_generated, load_test_row, newest_arrivals, dropped_sensors, log_tail, lag_with_owner, delay_by_lot,
        lots_up, reports_by_local_hour, lenient_slot_events,
        compacted_metadata, replay_deltas, demand_interpolate, partition_murmur2, partition_skew,
    )
}
