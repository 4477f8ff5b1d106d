"""Queries over the event stream: validation, repeats, lateness, slot state and time-weighted windows."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelot.operators import alerts, metrics, validation
from tidelot.operators import occupancy as o
from tidelot.session import listing, table

P = o.Params()
#: Standard error of the sketch of 2^10 registers.
HLL_ERROR = 1.04 / 32


@lru_cache(4)
def _judged(spark: SparkSession, d: str, files: tuple) -> o.Judged:
    return o.judge(table(spark, d, "parking_events"), P)


def judged(spark: SparkSession, d: str) -> o.Judged:
    """The judged stream of a folder; its tables are written when first asked for and shared by a session's queries while the files stay as they are."""
    return _judged(spark, d, listing(spark, f"{d}/parking_events.parquet"))


def forget() -> None:
    """Drop the judged streams, so that the next query makes its own."""
    _judged.cache_clear()


def window_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = o.arrivals(table(spark, d, "parking_events"))
    n = rows.groupBy("lot_id", (F.col("ts") - F.pmod("ts", F.lit(P.window))).alias("window_start"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "OCCUPANCY").alias("n_occupancy"), F.max("arrival").alias("latest_arrival_us"))


def event_consistency(spark: SparkSession, d: str) -> DataFrame:
    return validation.error_counts(table(spark, d, "parking_events"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return o.first_reports(o.arrivals(table(spark, d, "parking_events"))).select("lot_id", "seq")


def watermark_trace(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).rows.select("lot_id", "seq", "ts", "watermark", "late")


def late_side_output(spark: SparkSession, d: str) -> DataFrame:
    x = judged(spark, d).late
    return x.select("lot_id", "seq", "slot_id", "ts", "window_start", "watermark", ((F.col("watermark") - F.col("ts")) / 1e6).alias("late_by_s"))


def regression_guard(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).reports.select("lot_id", "slot_id", "seq", "ts", "regressed")


def slot_transitions(spark: SparkSession, d: str) -> DataFrame:
    x = judged(spark, d).reports.filter("delta <> 0 or entry + exit > 0")
    return x.select("lot_id", "slot_id", "seq", "ts", "was", "status", F.col("delta").cast("bigint").alias("delta"), F.col("entry").cast("bigint").alias("entry"), F.col("exit").cast("bigint").alias("exit"))


def window_time_weighted(spark: SparkSession, d: str) -> DataFrame:
    x = o.time_weighted(judged(spark, d))
    return x.withColumn("avg_occupied", F.col("area_us") / F.col("covered_us"))


def window_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a lot in which nothing arrived, carried forward from the count before."""
    j = judged(spark, d)
    heard = j.accepted.select("lot_id", "window_start").distinct()
    return o.time_weighted(j).join(heard, ["lot_id", "window_start"], "left_anti")


def window_min_max(spark: SparkSession, d: str) -> DataFrame:
    return o.extremes(judged(spark, d))


def window_entries_exits(spark: SparkSession, d: str) -> DataFrame:
    return o.flows(judged(spark, d))


def window_unique_exact(spark: SparkSession, d: str) -> DataFrame:
    return o.vehicles(judged(spark, d), exact=True)


def window_unique_hll(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate beside the exact number: within five standard errors."""
    j = judged(spark, d)
    both = o.vehicles(j, exact=True).withColumnRenamed("vehicles", "exact_vehicles").join(o.vehicles(j), ["lot_id", "window_start"])
    within = F.abs(F.col("vehicles") - F.col("exact_vehicles")) <= 5 * HLL_ERROR * F.col("exact_vehicles") + 0.5
    return both.select("lot_id", "window_start", "exact_vehicles", within.alias("within"))


def hll_error_report(spark: SparkSession, d: str) -> DataFrame:
    """Windows by magnitude of their exact count, and whether the estimate's mean error there is within two standard errors."""
    j = judged(spark, d)
    both = o.vehicles(j, exact=True).withColumnRenamed("vehicles", "exact").join(o.vehicles(j), ["lot_id", "window_start"])
    err = F.abs(F.col("vehicles") - F.col("exact")) / F.col("exact")
    x = both.groupBy(F.floor(F.log10("exact")).alias("magnitude"))
    return x.agg(F.count(F.lit(1)).alias("n"), (F.avg(err) <= 2 * HLL_ERROR).alias("mean_error_fits"))


def window_results(spark: SparkSession, d: str) -> DataFrame:
    """The whole result per window; its estimate column is HLL's."""
    return o.window_results(judged(spark, d), table(spark, d, "lot_metadata").select("lot_id", "capacity"))


def window_results_closed(spark: SparkSession, d: str) -> DataFrame:
    x = window_results(spark, d).filter("closed")
    return x.select("lot_id", "window_start", "capacity", "avg_occupied", "avg_occupancy_pct", "min_occupied", "max_occupied", "entries", "exits", "latest_arrival_us")


def window_results_checked(spark: SparkSession, d: str) -> DataFrame:
    """The whole result with the estimate judged: within five standard errors of the exact number of tokens, and half a token for its rounding."""
    exact = o.vehicles(judged(spark, d), exact=True).withColumnRenamed("vehicles", "exact_vehicles")
    x = window_results(spark, d).join(exact, ["lot_id", "window_start"], "left").fillna(0, ["exact_vehicles"])
    within = F.abs(F.col("unique_vehicles_est") - F.col("exact_vehicles")) <= 5 * HLL_ERROR * F.col("exact_vehicles") + 0.5
    return x.withColumn("estimate_within", within).drop("unique_vehicles_est")


def sensor_offline(spark: SparkSession, d: str) -> DataFrame:
    return o.sensor_silences(judged(spark, d).accepted, P)


def sensor_alerts(spark: SparkSession, d: str) -> DataFrame:
    """A raise where a sensor had been silent for longer than the threshold, when it is noticed, and a clear when it is back."""
    x = o.sensor_silences(judged(spark, d).accepted, P)
    raised = x.select("lot_id", "sensor_id", F.lit(True).alias("silent"), "last_seen", (F.col("last_seen") + P.offline_after + 1).alias("at"))
    cleared = x.filter("back_at is not null").select("lot_id", "sensor_id", F.lit(False).alias("silent"), "last_seen", F.col("back_at").alias("at"))
    return alerts.sensor_alerts(raised.unionByName(cleared)).select("alert_id", "state", "at_us", "message")


def subscribed_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Newest slot changes for two clients, one that watches its five lots and one that asks for more than it may."""
    lots = table(spark, d, "lot_metadata").filter("lot_id is not null")
    few = lots.filter("personality = 'mall'").orderBy("lot_id").limit(5).select(F.lit("few").alias("client"), "lot_id")
    every = lots.select(F.lit("every").alias("client"), "lot_id")
    return o.subscribed(judged(spark, d).changes, few.unionByName(every))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by what became of them: processed, dlq, duplicate or late."""
    e = table(spark, d, "parking_events")
    valid = validation.valid_events(e).filter("kafka_offset is not null").agg(F.count(F.lit(1)).alias("n"))
    j = judged(spark, d)
    kept = j.rows.groupBy(F.when(F.col("late"), "late").otherwise("processed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    n_kept = j.rows.agg(F.count(F.lit(1))).scalar()
    duplicate = valid.select(F.lit("duplicate").alias("outcome"), (F.col("n") - n_kept).alias("n"))
    dead = e.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dlq").alias("outcome"), (F.col("n") - valid.select("n").scalar()).alias("n"))
    return kept.unionByName(duplicate).unionByName(dead)


def true_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the log less those of every outcome but the dead letters, which are still to be written."""
    log = table(spark, d, "parking_events").select(F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))
    return metrics.backlog(metrics.offset_ranges(log), outcomes(spark, d).filter("outcome <> 'dlq'"))


def delay_sample(spark: SparkSession, d: str) -> DataFrame:
    """Delay from event to arrival of one accepted row in eight, by bucket."""
    x = judged(spark, d).accepted.filter(F.pmod("seq", F.lit(8)) == 0)
    x = x.select(F.lit(0).alias("all"), (F.greatest(F.lit(0), F.col("arrival") - F.col("ts")) / 1e6).alias("delay"))
    return metrics.bucket_counts(x, ["all"], "delay", [0.1, 1.0, 10.0, 60.0, 600.0]).select("le", "n")


def truth_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows in event time, lateness and repeats put aside."""
    return o.truth(table(spark, d, "parking_events"))


_CANON = "upper(trim({}, ' \t\r\n'))"
VALID_SQL = f"""
checked as (select *, {_CANON.format('event_type')} as kind, {_CANON.format('status')} as st,
  nullif(ltrim(translate(lower(event_id), ' {{}}-', ''), '0'), '') as k from parking_events),
reasons as (select *, case
    when coalesce(event_id, '') = '' then 'event_id missing' when coalesce(sensor_id, '') = '' then 'sensor_id missing'
    when coalesce(lot_id, '') = '' then 'lot_id missing' when coalesce(slot_id, '') = '' then 'slot_id missing'
    when kind is null or kind not in ('OCCUPANCY', 'HEARTBEAT') then 'unknown event_type'
    when st not in ('OCCUPIED', 'FREE') then 'unknown status'
    when event_ts is null or ingest_ts is null then 'timestamp missing or without zone'
    when kind = 'OCCUPANCY' and st is null then 'occupancy without status'
    when kind = 'HEARTBEAT' and (st is not null or vehicle_token is not null) then 'heartbeat with status or token'
    when st = 'OCCUPIED' and vehicle_token is null then 'occupied without token'
    when st = 'FREE' and vehicle_token is not null then 'free with token' end as reason from checked),
arrivals as (select lot_id, slot_id, sensor_id, kind, st, lower(vehicle_token) as token, k, epoch_us(event_ts) as ts, epoch_us(ingest_ts) as arrival,
    kafka_offset as seq from reasons where reason is null and kafka_offset is not null),
firsts as (select * from (select *, row_number() over (partition by lot_id, k order by seq) as rn from arrivals) where rn = 1 or kind <> 'OCCUPANCY')"""
JUDGED_SQL = f"""{VALID_SQL},
heard as (select *, ts - ts % 300000000 as window_start,
    max(ts) over (partition by lot_id order by seq rows between unbounded preceding and 1 preceding) - 60000000 as watermark from firsts),
judged as (select *, coalesce(kind = 'OCCUPANCY' and window_start + 420000000 < watermark, false) as late from heard),
reports as (select *, coalesce(ts <= max(ts) over (partition by lot_id, slot_id order by seq rows between unbounded preceding and 1 preceding), false) as regressed
  from judged where kind = 'OCCUPANCY' and not late),
lagged as (select *, lag(st) over (partition by lot_id, slot_id order by ts, seq) as was from reports where not regressed),
changes as (select *, cast(case when st = 'OCCUPIED' and was is distinct from 'OCCUPIED' then 1 when st = 'FREE' and was = 'OCCUPIED' then -1 else 0 end as bigint) as delta,
    cast(case when st = 'OCCUPIED' and was = 'FREE' then 1 else 0 end as bigint) as entry, cast(case when st = 'FREE' and was = 'OCCUPIED' then 1 else 0 end as bigint) as exit from lagged)"""
TIMELINE_SQL = f"""{JUDGED_SQL},
began as (select lot_id, arg_min(ts, seq) as began from judged where not late group by lot_id),
points as (select lot_id, ts, seq, delta from changes where delta <> 0
  union all select j.lot_id, j.ts, j.seq, 0 from judged j join began using (lot_id) where not j.late and j.ts >= began
    and (j.lot_id, j.seq) not in (select (lot_id, seq) from reports where regressed)),
line as (select lot_id, ts, lead(ts) over w as until, sum(delta) over (w rows unbounded preceding) as occupied from points window w as (partition by lot_id order by ts, seq)),
parts as (select lot_id, ts, until, occupied, unnest(range(ts - ts % 300000000, until, 300000000)) as window_start from line where until > ts),
clipped as (select *, greatest(ts, window_start) as a, least(until, window_start + 300000000) as b from parts),
weighted as (select lot_id, window_start, cast(sum(occupied * (b - a)) as bigint) as area_us, cast(sum(b - a) as bigint) as covered_us from clipped group by all)"""
EXTREMES_SQL = """
steps as (select j.lot_id, j.seq, j.ts, coalesce(c.delta, 0) as delta from judged j left join changes c using (lot_id, seq) where not j.late),
cursors as (select *, max(ts) over (w rows unbounded preceding) as cursor, sum(delta) over (w rows unbounded preceding) as occupied from steps window w as (partition by lot_id order by seq)),
nexts as (select *, lead(cursor) over (partition by lot_id order by seq) as nxt from cursors),
seen as (select lot_id, occupied, unnest(range(cursor - cursor % 300000000, nxt, 300000000)) as window_start from nexts where nxt > cursor
  union all select lot_id, occupied, ts - ts % 300000000 from nexts where delta <> 0 and ts >= cursor),
extremes as (select lot_id, window_start, cast(min(occupied) as bigint) as min_occupied, cast(max(occupied) as bigint) as max_occupied from seen group by all)"""
TRUTH_SQL = f"""{VALID_SQL},
true_reports as (select *, lag(st) over (partition by lot_id, slot_id order by ts, seq) as was from firsts where kind = 'OCCUPANCY'),
moves as (select *, case when st = 'OCCUPIED' and was is distinct from 'OCCUPIED' then 1 when st = 'FREE' and was = 'OCCUPIED' then -1 else 0 end as delta from true_reports),
true_line as (select lot_id, ts, lead(ts) over w as until, sum(delta) over (w rows unbounded preceding) as occupied from moves window w as (partition by lot_id order by ts, seq)),
true_parts as (select lot_id, ts, until, occupied, unnest(range(ts - ts % 300000000, until, 300000000)) as window_start from true_line where until > ts),
areas as (select lot_id, window_start, sum(occupied * (least(until, window_start + 300000000) - greatest(ts, window_start))) as area, sum(least(until, window_start + 300000000) - greatest(ts, window_start)) as covered from true_parts group by all),
own as (select lot_id, ts - ts % 300000000 as window_start, count_if(was is not null and delta > 0) as entries, count_if(delta < 0) as exits, count(distinct token) filter (where st = 'OCCUPIED') as vehicles from moves group by all),
truth as (select lot_id, window_start, cast(coalesce(area, 0) as bigint) as area_us, cast(coalesce(covered, 0) as bigint) as covered_us, coalesce(entries, 0) as entries, coalesce(exits, 0) as exits, coalesce(vehicles, 0) as vehicles
  from areas full join own using (lot_id, window_start))"""
RESULTS_SQL = f"""{TIMELINE_SQL}, {EXTREMES_SQL},
flows as (select lot_id, window_start, cast(sum(entry) as bigint) as entries, cast(sum(exit) as bigint) as exits from changes group by all),
fresh as (select lot_id, window_start, max(arrival) as latest_arrival_us, count(distinct token) filter (where st = 'OCCUPIED') as vehicles from reports group by all),
tops as (select lot_id, max(ts) as top from judged where not late group by all),
slots as (select lot_id, count(distinct slot_id) as n, cast(sum(delta) as bigint) as occupied from changes group by all),
x as (select w.*, cast(greatest(m.capacity, s.n, 1) as int) as capacity, coalesce(min_occupied, occupied) as min_occupied, coalesce(max_occupied, occupied) as max_occupied,
    coalesce(entries, 0) as entries, coalesce(exits, 0) as exits, latest_arrival_us, vehicles, coalesce(occupied, 0) as occupied, window_start + 420000000 < top - 60000000 as closed
  from weighted w left join extremes using (lot_id, window_start) left join flows using (lot_id, window_start) left join fresh using (lot_id, window_start)
    join tops using (lot_id) left join slots s using (lot_id) left join lot_metadata m using (lot_id)),
y as (select *, area_us * 1000 // covered_us as q, 2 * (area_us * 1000 % covered_us) as t, area_us * 10000 // (covered_us * capacity) as q2, 2 * (area_us * 10000 % (covered_us * capacity)) as t2 from x),
r as (select *, (q + case when t > covered_us or (t = covered_us and q % 2 = 1) then 1 else 0 end) / 1000 as avg_occupied,
    (q2 + case when t2 > covered_us * capacity or (t2 = covered_us * capacity and q2 % 2 = 1) then 1 else 0 end) / 100 as avg_occupancy_pct from y)"""

ORACLES = {
    "window_tumbling_counts": f"""with {VALID_SQL} select lot_id, ts - ts % 300000000 as window_start, count(*) as n, count_if(kind = 'OCCUPANCY') as n_occupancy,
  max(arrival) as latest_arrival_us from arrivals group by all""",
    "event_consistency": f"with {VALID_SQL} select coalesce(reason, 'valid') as reason, count(*) as n from reasons group by all",
    "dedupe_first": f"with {VALID_SQL} select lot_id, seq from firsts",
    "watermark_trace": f"with {JUDGED_SQL} select lot_id, seq, ts, watermark, late from judged",
    "late_side_output": f"with {JUDGED_SQL} select lot_id, seq, slot_id, ts, window_start, watermark, (watermark - ts) / 1e6 as late_by_s from judged where late",
    "regression_guard": f"with {JUDGED_SQL} select lot_id, slot_id, seq, ts, regressed from reports",
    "slot_transitions": f"with {JUDGED_SQL} select lot_id, slot_id, seq, ts, was, st as status, delta, entry, exit from changes where delta <> 0 or entry + exit > 0",
    "window_time_weighted": f"with {TIMELINE_SQL} select *, area_us / covered_us as avg_occupied from weighted",
    "window_gap_fill": f"""with {TIMELINE_SQL} select * from weighted where (lot_id, window_start) not in (select (lot_id, window_start) from judged where not late)""",
    "window_min_max": f"with {JUDGED_SQL}, {EXTREMES_SQL} select * from extremes",
    "window_entries_exits": f"""with {JUDGED_SQL} select lot_id, window_start, cast(sum(entry) as bigint) as entries, cast(sum(exit) as bigint) as exits from changes
  group by all having sum(entry) > 0 or sum(exit) > 0""",
    "window_unique_exact": f"with {JUDGED_SQL} select lot_id, window_start, count(distinct token) as vehicles from reports where st = 'OCCUPIED' and token is not null group by all",
    "window_unique_hll": f"with {JUDGED_SQL} select lot_id, window_start, count(distinct token) as exact_vehicles, true as within from reports where st = 'OCCUPIED' and token is not null group by all",
    "hll_error_report": f"""with {JUDGED_SQL}, e as (select count(distinct token) as n from reports where st = 'OCCUPIED' and token is not null group by lot_id, window_start)
select cast(floor(log10(n)) as bigint) as magnitude, count(*) as n, true as mean_error_fits from e group by all""",
    "window_results_closed": f"""with {RESULTS_SQL} select lot_id, window_start, capacity, avg_occupied, avg_occupancy_pct, min_occupied, max_occupied, entries, exits, latest_arrival_us from r where closed""",
    "window_results_checked": f"""with {RESULTS_SQL} select lot_id, window_start, window_start + 300000000 as window_end, capacity, avg_occupied, avg_occupancy_pct, min_occupied, max_occupied, entries, exits,
  closed, case when not closed then occupied end as current_occupied, latest_arrival_us, lot_id || '|' || strftime(make_timestamp(window_start), '%Y-%m-%dT%H:%M:%S+00:00') as window_key, coalesce(vehicles, 0) as exact_vehicles, true as estimate_within from r""",
    "sensor_offline": f"""with {JUDGED_SQL},
s as (select distinct lot_id, sensor_id, ts from judged where not late),
n as (select *, lead(ts) over (partition by lot_id, sensor_id order by ts) as back_at, max(ts) over (partition by lot_id) as ended from s)
select lot_id, sensor_id, ts as last_seen, back_at from n where coalesce(back_at, ended) - ts > 120000000""",
    "sensor_alerts": f"""with {JUDGED_SQL},
s as (select distinct lot_id, sensor_id, ts from judged where not late),
n as (select *, lead(ts) over (partition by lot_id, sensor_id order by ts) as back_at, max(ts) over (partition by lot_id) as ended from s),
g as (select *, lot_id || '|' || sensor_id || '|' || (ts // 1000000) as alert_id from n where coalesce(back_at, ended) - ts > 120000000)
select alert_id, 'RAISED' as state, ts + 120000001 as at_us, 'Sensor ' || sensor_id || ' silent for 2 min' as message from g
union all select alert_id, 'CLEARED', back_at, 'Sensor ' || sensor_id || ' reporting again' from g where back_at is not null""",
    "subscribed_deltas": f"""with {JUDGED_SQL},
few as (select 'few' as client, lot_id from lot_metadata where personality = 'mall' order by lot_id limit 5),
every as (select 'every' as client, lot_id from lot_metadata order by lot_id limit 5),
n as (select *, row_number() over (partition by lot_id, slot_id order by ts desc, seq desc) as newest from changes)
select client, lot_id, slot_id, ts, st as status from n join (select * from few union all select * from every) using (lot_id) where newest = 1""",
    "outcomes": f"""with {JUDGED_SQL} select case when late then 'late' else 'processed' end as outcome, count(*) as n from judged group by all
union all select 'duplicate', (select count(*) from arrivals) - (select count(*) from judged) union all select 'dlq', (select count(*) from parking_events) - (select count(*) from arrivals)""",
    "true_backlog": f"with {JUDGED_SQL} select count(*) as produced, (select count(*) from arrivals) as consumed, count(*) - (select count(*) from arrivals) as backlog from parking_events where kafka_offset is not null",
    "delay_sample": f"""with {JUDGED_SQL}, x as (select greatest(0, arrival - ts) / 1e6 as delay from judged where not late and seq % 8 = 0)
select le, (select count(*) from x where delay <= le) as n from (values (0.1::double), (1.0), (10.0), (60.0), (600.0), ('inf'::double)) v(le)""",
    "truth_windows": f"""with {TRUTH_SQL} select * from truth""",
}

QUERIES = {
    f.__name__: f
    for f in (
        window_tumbling_counts, event_consistency, dedupe_first, watermark_trace, late_side_output, regression_guard, slot_transitions, window_time_weighted, window_gap_fill,
        window_min_max, window_entries_exits, window_unique_exact, window_unique_hll, hll_error_report, window_results, window_results_closed, window_results_checked, sensor_offline, sensor_alerts,
        subscribed_deltas, outcomes, true_backlog, delay_sample, truth_windows,
    )
}
