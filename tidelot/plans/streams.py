"""Queries over event intervals, sessions, grids, redeliveries and lateness (problems 1, 3, 4, 5 and 6)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelot.functions.timing import DAY_US, HOUR_US, MINUTE_US, SECOND_US
from tidelot.operators import grid, intervals, lateness, messages, redelivery, sessions
from tidelot.session import Staging, materialise, scratch_dir, table

#: Batches that a finished log is replayed in where an operator works batch by batch.
INCREMENTS = 3


def alert_periods(spark: SparkSession, d: str) -> DataFrame:
    """Maximal spans under alert per lot, from the latest version of each alert."""
    last = intervals.latest_version(table(spark, d, "alerts"), "alert_id", "updated_at", ["lot_id", "raised_at", "cleared_at"])
    return intervals.merge_intervals(last, "lot_id", F.unix_micros("raised_at"), F.unix_micros("cleared_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    periods = materialise(alert_periods(spark, d), "alert-periods")
    gaps = intervals.interval_gaps(periods, "lot_id", max_gap_us=72 * HOUR_US)
    kind = lambda df, k: df.select("lot_id", F.lit(k).alias("span_kind"), F.col("s").alias("start_us"), F.col("e").alias("end_us"))
    return kind(periods, "period").unionByName(kind(gaps, "gap"))


def message_batches(spark: SparkSession, d: str, payload: dict[str, str]) -> Iterator[tuple[redelivery.MessageStore, int]]:
    """Deliveries folded batch by batch into a message store, which is given after each batch with the batch's number."""
    events = table(spark, d, "parking_events")
    words = {c: messages.canonical_word(c) for c in ("event_type", "status") if c in payload}
    store = redelivery.new_store(spark, payload)
    for i, rows in enumerate(redelivery.ranges_of(events, "batch_no", INCREMENTS)):
        store.apply(rows.withColumns(words), i)
        yield store, i


def session_table(spark: SparkSession, d: str, gap_us: int = 60 * MINUTE_US) -> sessions.SessionTable:
    """Bouts of use per lot and slot: each batch of deliveries brings messages, whose local sessions are folded into the table."""
    keys = ["lot_id", "slot_id"]
    out = sessions.SessionTable(spark, scratch_dir(spark, "session-table"), keys, gap_us)

    def spans(m: DataFrame) -> DataFrame:
        m = m.filter("event_type = 'OCCUPANCY' and status in ('OCCUPIED', 'FREE')").withColumn("ts", F.unix_micros("event_ts"))
        return sessions.session_cells(m, keys, "ts", gap_us)

    for store, i in message_batches(spark, d, {"lot_id": "string", "slot_id": "string", "event_type": "string", "status": "string", "event_ts": "timestamp"}):
        if store.moved(i):  # an earlier delivery took a message's place: the slots of both are made anew
            with Staging(spark, "withdrawn") as staging:
                slots = staging.write(store.removed(i).select(*keys).union(store.added(i).select(*keys)).na.drop().distinct(), "slots")
                again = staging.write(spans(store.messages().join(slots, keys, "left_semi")), "again")
                out.apply(spans(store.added(i).join(slots, keys, "left_anti")), i, again)
        else:
            out.apply(spans(store.added(i)), i)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = session_table(spark, d).sessions()
    return s.select("lot_id", "slot_id", F.col("s").alias("start_us"), F.col("e").alias("end_us"))


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions with duration and number of reports."""
    s = session_table(spark, d).sessions()
    return s.select("lot_id", "slot_id", F.col("s").alias("start_us"), F.col("e").alias("end_us"), (F.col("e") - F.col("s")).alias("duration_us"), F.col("n").alias("n_events"))


def sensor_grid(spark: SparkSession, d: str) -> DataFrame:
    m = messages.messages(table(spark, d, "parking_events"), ["lot_id", "sensor_id", "event_ts", "status"])
    m = m.withColumn("ts", F.unix_micros("event_ts"))
    return grid.to_grid(m, ["lot_id", "sensor_id"], "ts", F.col("status"), cell_us=15 * MINUTE_US, shard_us=6 * HOUR_US, within_us=DAY_US)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sensor_grid(spark, d).filter("n = 0").select("lot_id", "sensor_id", "cell_us")


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    """The whole series: readings per cell, the last status known and where it was carried from."""
    g = sensor_grid(spark, d)
    return g.select("lot_id", "sensor_id", "cell_us", F.col("n").alias("n_readings"), F.col("value").alias("status"), "carried_from_us")


def message_store(spark: SparkSession, d: str) -> redelivery.MessageStore:
    store = redelivery.new_store(spark)
    redelivery.replay(store, table(spark, d, "parking_events"), "batch_no", INCREMENTS)
    return store


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return message_store(spark, d).surplus()


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries that are kept."""
    return message_store(spark, d).messages().select("kafka_partition", "kafka_offset")


WINDOW_US, CUTOFF_US = 5 * MINUTE_US, 180 * SECOND_US


def lateness_state(spark: SparkSession, d: str) -> DataFrame:
    """Multisets of arrival delay (whole seconds) per lot and five-minute window, of OCCUPANCY messages, as batch after batch of deliveries leaves them."""
    out = lateness.LatenessTable(spark, scratch_dir(spark, "lateness-table"), WINDOW_US, CUTOFF_US)

    def rows(m: DataFrame) -> DataFrame:
        arrival, ts = F.unix_micros("ingest_ts"), F.unix_micros("event_ts")
        counted = F.coalesce(F.col("event_type") == "OCCUPANCY", F.lit(False))
        return m.select(F.col("lot_id").alias("entity"), ts.alias("ts"), arrival.alias("arrival"), F.col("kafka_offset").alias("seq"), counted.alias("counted"), F.floor((arrival - ts) / SECOND_US).alias("value"))

    for store, i in message_batches(spark, d, {"lot_id": "string", "event_type": "string", "event_ts": "timestamp"}):
        out.apply(rows(store.added(i)), i, rows(store.removed(i)) if store.moved(i) else None, lambda since, store=store, i=i: rows(store.kept(i, since)))
    return out.state().withColumnRenamed("entity", "lot_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    counts = lateness.period_counts(lateness_state(spark, d), ["lot_id", "window_start_us"])
    return counts.filter("n_late > 0").select("lot_id", "window_start_us", "n_accepted", "n_rejected")


def p6_window_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Exact statistics of arrival delay per window, late reports included up to the cut-off."""
    s = lateness.period_statistics(lateness_state(spark, d), ["lot_id", "window_start_us"])
    return s.select("lot_id", "window_start_us", "n", "n_distinct", "least", "greatest", "median")


#: SQL shared by the oracles: canonical identifiers, then the first delivery of each.
MESSAGES_SQL = """
keyed as (
  select *, nullif(ltrim(translate(lower(event_id), ' {}-', ''), '0'), '') as k,
    upper(trim(event_type, ' \t\r\n')) as kind, upper(trim(status, ' \t\r\n')) as st
  from parking_events where ingest_ts is not null and kafka_offset is not null and kafka_partition is not null),
numbered as (
  select *, row_number() over (partition by k order by ingest_ts, kafka_offset, kafka_partition) as rn from keyed),
messages as (select *, epoch_us(event_ts) as ts from numbered where k is null or rn = 1)"""

_P3 = f"""with {MESSAGES_SQL},
m as (select lot_id, slot_id, ts, kafka_offset as o from messages
  where kind = 'OCCUPANCY' and st in ('OCCUPIED', 'FREE') and lot_id is not null and slot_id is not null and ts is not null),
f as (select *, case when ts - lag(ts) over (partition by lot_id, slot_id order by ts, o) <= 3600000000 then 0 else 1 end as fresh from m),
g as (select *, sum(fresh) over (partition by lot_id, slot_id order by ts, o rows unbounded preceding) as island from f),
s as (select lot_id, slot_id, min(ts) as start_us, max(ts) as end_us, count(*) as n_events from g group by lot_id, slot_id, island)
select """

_P4 = f"""with {MESSAGES_SQL},
c as (select lot_id, sensor_id, ts // 900000000 as c, count(*) as n, arg_max(st, (ts, st)) as unused,
    max(struct_pack(ts := ts, st := coalesce(st, ''))) as l
  from messages where lot_id is not null and sensor_id is not null and ts is not null group by all),
n as (select *, c // 96 as dy, lead(c) over (partition by lot_id, sensor_id, c // 96 order by c) as nxt from c),
x as (select lot_id, sensor_id, c, n, nullif(l.st, '') as v, unnest(range(c, coalesce(nxt, c + 1))) as cell from n)
select """

_P5 = f"""with {MESSAGES_SQL} select kafka_partition, kafka_offset from """

_P6 = f"""with {MESSAGES_SQL},
h as (select *, epoch_us(ingest_ts) as arrival,
    max(ts) over (partition by lot_id order by ingest_ts, kafka_offset rows between unbounded preceding and 1 preceding) as heard
  from messages where lot_id is not null and ts is not null),
w as (select *, ts - ts % 300000000 as window_start_us from h where kind = 'OCCUPANCY'),
j as (select *, coalesce(heard >= window_start_us + 300000000, false) as late,
    coalesce(heard > window_start_us + 480000000, false) as rejected from w)
"""

ORACLES = {
    "p1_found": """with v as (select *, row_number() over (partition by alert_id order by updated_at desc, lot_id desc nulls last,
    raised_at desc nulls last, cleared_at desc nulls last) as rn from alerts where alert_id is not null and updated_at is not null),
i as (select lot_id, epoch_us(raised_at) as s, max(epoch_us(cleared_at)) as e from v where rn = 1 and lot_id is not null and cleared_at > raised_at group by all),
r as (select *, max(e) over (partition by lot_id order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by lot_id order by s, e rows unbounded preceding) as island from r),
p as (select lot_id, min(s) as start_us, max(e) as end_us from g group by lot_id, island),
n as (select *, lead(start_us) over (partition by lot_id order by start_us) as nxt from p)
select lot_id, 'period' as span_kind, start_us, end_us from p
union all select lot_id, 'gap', end_us, nxt from n where nxt - end_us <= 259200000000""",
    "p3_found": _P3 + "lot_id, slot_id, start_us, end_us from s",
    "p3_sessions": _P3 + "lot_id, slot_id, start_us, end_us, end_us - start_us as duration_us, n_events from s",
    "p4_found": _P4 + "lot_id, sensor_id, cell * 900000000 as cell_us from x where cell > c",
    "p4_series": _P4 + """lot_id, sensor_id, cell * 900000000 as cell_us, case when cell = c then n else 0 end as n_readings,
  v as status, c * 900000000 as carried_from_us from x""",
    "p5_found": _P5 + "numbered where k is not null and rn > 1",
    "p5_messages": _P5 + "messages",
    "p6_found": _P6 + """select lot_id, window_start_us, count_if(not rejected) as n_accepted, count_if(rejected) as n_rejected
from j group by all having bool_or(late)""",
    "p6_window_statistics": _P6 + """select lot_id, window_start_us, count(*) as n, count(distinct v) as n_distinct, min(v) as least, max(v) as greatest,
  list_sort(list(v))[(count(*) + 1) // 2] as median
from (select *, cast(floor((arrival - ts) / 1000000.0) as bigint) as v from j where not rejected) group by all""",
}

QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_sessions, p4_found, p4_series, p5_found, p5_messages, p6_found, p6_window_statistics)}
