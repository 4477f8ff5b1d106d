"""Read queries over stored windows, alerts and lot metadata: the answers a console or an API asks for.

The tables are logs of emissions; the reads work on what keyed upserts leave of them. Relative
times are taken from the newest stored window, or from `as_of`, never from the wall clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelot.functions import numbers as num
from tidelot.functions.timing import DAY_US, HOUR_US, MINUTE_US, cell_of
from tidelot.operators import alerts as al
from tidelot.operators import occupancy, upserts
from tidelot.operators.intervals import latest_version
from tidelot.plans.stream_core import JUDGED_SQL, TIMELINE_SQL, TRUTH_SQL, VALID_SQL, judged
from tidelot.session import broadcast_if_small, materialise, table

WINDOW_US = 5 * MINUTE_US


def stored_windows(spark: SparkSession, d: str) -> DataFrame:
    """One row per lot and window start: the last emission, where a closed one is never replaced by an open one."""
    w = table(spark, d, "lot_occupancy_5min")
    w = w.withColumns({"window_start": F.unix_micros("window_start"), "emitted_at": F.unix_micros("emitted_at")}).drop("window_end", "latest_ingest_ts")
    return upserts.closed_is_final(w, [F.col("emitted_at")])


def stored_alerts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "alerts")
    micros = {c: F.unix_micros(c) for c in ("raised_at", "cleared_at", "updated_at")}
    return latest_version(a.withColumns(micros), "alert_id", "updated_at", ["kind", "lot_id", "sensor_id", "status", "raised_at", "cleared_at", "message", "occupancy_pct"])


def _lots(spark: SparkSession, d: str) -> DataFrame:
    return upserts.keep_one(table(spark, d, "lot_metadata").drop("slot_ids"), ["lot_id"], [F.col("capacity")])


def upsert_closed_final(spark: SparkSession, d: str) -> DataFrame:
    return stored_windows(spark, d).select("lot_id", "window_start", "closed", "emitted_at", "avg_occupied", "entries", "exits")


def batch_collapse(spark: SparkSession, d: str) -> DataFrame:
    """What each emission hour, as one batch, would write: one row per key, the last, never open over closed."""
    w = table(spark, d, "lot_occupancy_5min").withColumns({"window_start": F.unix_micros("window_start"), "emitted_at": F.unix_micros("emitted_at")})
    w = w.withColumn("batch", cell_of("emitted_at", HOUR_US)).select("batch", "lot_id", "window_start", "closed", "emitted_at", "avg_occupied")
    return upserts.keep_one(w, ["batch", "lot_id", "window_start"], [F.col("closed"), F.col("emitted_at")])


def versions_per_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows that were written more than once: how often, how many different rows, and how often closed."""
    w = table(spark, d, "lot_occupancy_5min").filter("lot_id is not null and window_start is not null").withColumn("window_start", F.unix_micros("window_start"))
    per = w.groupBy(*w.columns).agg(F.count(F.lit(1)).alias("copies"))
    x = per.groupBy("lot_id", "window_start").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_different"), F.sum(F.when(F.col("closed"), F.col("copies")).otherwise(0)).alias("n_closed"))
    return x.filter("n > 1")


def latest_windows(windows: DataFrame) -> DataFrame:
    """(`lot_id`, `as_of`, `occupied`): newest window of each lot; the live count, else the rounded average."""
    count = F.coalesce(F.col("current_occupied"), F.bround("avg_occupied").cast("int"))
    x = windows.groupBy("lot_id").agg(F.max(F.struct("window_start", count.alias("occupied"))).alias("m"))
    return x.select("lot_id", F.col("m.window_start").alias("as_of"), F.col("m.occupied").alias("occupied"))


def latest_per_lot(spark: SparkSession, d: str) -> DataFrame:
    """Every lot with its newest window, if it has one."""
    return _lots(spark, d).join(latest_windows(stored_windows(spark, d)), "lot_id", "left").select("lot_id", "name", "personality", "capacity", "columns", "latitude", "longitude", "as_of", "occupied").orderBy("lot_id")


def latest_per_lot_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The same as a lateral join in SQL."""
    stored_windows(spark, d).createOrReplaceTempView("tidelot_windows")
    _lots(spark, d).createOrReplaceTempView("tidelot_lots")
    return spark.sql("""select m.lot_id, m.capacity, w.window_start as as_of, coalesce(w.current_occupied, cast(bround(w.avg_occupied) as int)) as occupied
      from tidelot_lots m left join lateral (select window_start, current_occupied, avg_occupied from tidelot_windows t where t.lot_id = m.lot_id
        order by window_start desc limit 1) w""")


def sparkline_topn(spark: SparkSession, d: str, points: int = 24) -> DataFrame:
    """The newest `points` occupancies of each lot within two days of the newest window, oldest first, as one text of hundredths."""
    w = stored_windows(spark, d)
    recent = w.filter(F.col("window_start") > w.agg(F.max("window_start")).scalar() - 2 * DAY_US)
    # At most two days of windows per lot reach the ordered list.
    lists = recent.groupBy("lot_id").agg(F.sort_array(F.collect_list(F.struct("window_start", num.hundredths("avg_occupancy_pct").alias("v"))), asc=False).alias("l"))
    newest = F.reverse(F.slice("l", 1, points))
    return lists.select("lot_id", F.array_join(F.transform(newest, lambda x: x["v"].cast("string")), ",").alias("spark"))


def sparkline_heights(spark: SparkSession, d: str) -> DataFrame:
    """The same points as heights of a line chart, where there are two or more."""
    x = sparkline_topn(spark, d).select("lot_id", F.split("spark", ",").cast("array<bigint>").alias("v")).filter(F.size("v") > 1)
    return x.select("lot_id", F.array_join(num.line_heights(F.col("v")).cast("array<string>"), ",").alias("heights"))


def stats_24h(windows: DataFrame) -> DataFrame:
    """Per lot, over the 24 hours up to its newest window: flows, occupied seconds and the newest closed estimate."""
    last = windows.groupBy("lot_id").agg(F.max("window_start").alias("last"), F.max_by("unique_vehicles_est", F.when(F.col("closed"), F.col("window_start"))).alias("unique_now"))
    x = windows.join(last, "lot_id").filter(F.col("window_start") > F.col("last") - DAY_US).groupBy("lot_id")
    return x.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("exits"), F.lit(0)).alias("exits"),
        (F.sum(num.thousandths("avg_occupied")) * (WINDOW_US // 1_000_000)).alias("occupied_milliseconds"), F.first("unique_now").alias("unique_now"),
    )


def lot_stats_24h(spark: SparkSession, d: str) -> DataFrame:
    return stats_24h(stored_windows(spark, d))


def dwell_littles_law(spark: SparkSession, d: str) -> DataFrame:
    """Mean stay in tenths of a minute: occupied time over entries, null without either."""
    x = stats_24h(stored_windows(spark, d))
    minutes = F.col("occupied_milliseconds") / F.col("entries") / 60_000
    return x.select("lot_id", F.when((F.col("entries") > 0) & (F.col("occupied_milliseconds") > 0), F.floor(minutes * 10 + 0.5)).alias("dwell_tenths"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    x = latest_per_lot(spark, d)
    return x.withColumn("occupancy_permille", num.permille("occupied", "capacity"))


def rank_lots(spark: SparkSession, d: str) -> DataFrame:
    """Lots by occupancy, unknown as empty, with their rank (ties share none: lot_id decides)."""
    x = _summaries(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("occupancy_permille", F.lit(0)).desc(), "lot_id")))  # a row per lot
    return x.select("rank", "lot_id", "occupied", "capacity", "occupancy_permille")


def system_totals(spark: SparkSession, d: str) -> DataFrame:
    x = _summaries(spark, d).agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("total_capacity"), F.coalesce(F.sum("occupied"), F.lit(0)).alias("total_occupied"))
    return x.withColumn("occupancy_permille", F.coalesce(num.permille("total_occupied", "total_capacity"), F.lit(0)))


def lot_labels(spark: SparkSession, d: str) -> DataFrame:
    x = _summaries(spark, d)
    return x.select("lot_id", num.fill_label(F.col("occupancy_permille") / 10).alias("label"), (F.col("capacity") - F.col("occupied")).alias("free"))


def hourly(windows: DataFrame) -> DataFrame:
    """Closed windows by hour: averages are means of window averages."""
    x = windows.filter("closed").groupBy("lot_id", (cell_of("window_start", HOUR_US) * HOUR_US).alias("bucket"))
    return x.agg(
        F.sum(num.thousandths("avg_occupied")).alias("sum_avg_thousandths"), F.sum(num.hundredths("avg_occupancy_pct")).alias("sum_pct_hundredths"), F.min("min_occupied").alias("min_occupied"),
        F.max("max_occupied").alias("max_occupied"), F.sum("entries").alias("entries"), F.sum("exits").alias("exits"), F.count(F.lit(1)).alias("windows"),
    )


def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return hourly(stored_windows(spark, d)).withColumn("avg_occupied", F.col("sum_avg_thousandths") / F.col("windows") / 1000)


def history(windows: DataFrame, lot_id: str, start: int | None = None, end: int | None = None, resolution: str = "5m", limit: int = 500) -> DataFrame:
    """A lot's series in [start, end), oldest first, the oldest `limit` points; by default the day (week for '1h') up to its newest window."""
    if resolution not in ("5m", "1h"):
        raise ValueError("resolution must be '5m' or '1h'")
    if not 1 <= limit <= 2000:
        raise ValueError("limit must be within 1 and 2000")
    x = windows.filter(F.col("lot_id") == lot_id)
    until = F.lit(end) if end is not None else x.agg(F.max("window_start") + WINDOW_US).scalar()
    x = hourly(x).withColumnRenamed("bucket", "window_start") if resolution == "1h" else x
    since = F.lit(start) if start is not None else until - (DAY_US if resolution == "5m" else 7 * DAY_US)
    return x.filter((F.col("window_start") >= since) & (F.col("window_start") < until)).orderBy("window_start").limit(limit)


def history_page(spark: SparkSession, d: str, lot_id: str = "LOT-07") -> DataFrame:
    x = history(stored_windows(spark, d), lot_id)
    return x.select("lot_id", "window_start", "avg_occupied", "min_occupied", "max_occupied", "entries", "exits", "closed")


def history_hourly(spark: SparkSession, d: str, lot_id: str = "LOT-07") -> DataFrame:
    x = history(stored_windows(spark, d), lot_id, resolution="1h")
    return x.select("lot_id", "window_start", "min_occupied", "max_occupied", "entries", "exits", "windows", F.lit(None).cast("double").alias("unique_vehicles_est"), F.lit(True).alias("closed"))


def alerts_where(alerts: DataFrame, kind: str | None = None, status: str | None = None, lot_id: str | None = None) -> DataFrame:
    for name, value in (("kind", kind), ("status", status), ("lot_id", lot_id)):
        if value is not None:
            alerts = alerts.filter(F.col(name) == value)
    return alerts


def alerts_page(spark: SparkSession, d: str, kind: str | None = "FULL_LOT", status: str | None = None, lot_id: str | None = None, limit: int = 50, offset: int = 20, as_of: datetime | None = None) -> DataFrame:
    """A page of alerts, newest raise first, each with the number of all that match and its duration up to `as_of`."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be within 1 and 200 and offset not negative")
    a = stored_alerts(spark, d)
    now = a.agg(F.max("updated_at")).scalar() if as_of is None else F.unix_micros(F.lit(as_of))
    hits = alerts_where(a, kind, status, lot_id)
    total = hits.agg(F.count(F.lit(1))).scalar()
    page = hits.orderBy(F.col("raised_at").desc_nulls_last(), "alert_id").offset(offset).limit(limit)
    seconds = F.greatest(F.lit(0.0), (F.coalesce(F.col("cleared_at"), now) - F.col("raised_at")) / 1e6)
    return page.select("alert_id", "kind", "lot_id", "status", "raised_at", "cleared_at", seconds.alias("duration_s"), total.alias("total"))


def alert_texts(spark: SparkSession, d: str) -> DataFrame:
    """How long cleared alerts lasted and how full their lot was, as texts."""
    a = stored_alerts(spark, d).filter("raised_at is not null and cleared_at >= raised_at")
    return a.select("alert_id", num.duration_text((F.col("cleared_at") - F.col("raised_at")) / 1e6).alias("lasted"), num.percent_text(F.floor(F.col("occupancy_pct") + 0.5)).alias("full"))


def active_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts_where(stored_alerts(spark, d), status="active").agg(F.count(F.lit(1)).alias("n"))


def full_since(spark: SparkSession, d: str) -> DataFrame:
    x = alerts_where(stored_alerts(spark, d), kind="FULL_LOT", status="active").filter("lot_id is not null")
    return x.groupBy("lot_id").agg(F.max("raised_at").alias("full_since"))


def alert_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Alert rows rebuilt from the log of versions read as raise and clear messages."""
    a = table(spark, d, "alerts")
    state = F.when(F.col("cleared_at").isNull(), "RAISED").otherwise("CLEARED")
    m = a.select("alert_id", state.alias("state"), F.unix_micros(F.coalesce("cleared_at", "raised_at")).alias("at"), F.struct(F.unix_micros("updated_at").alias("u"), F.coalesce(F.unix_micros("cleared_at"), F.lit(0)).alias("c")).alias("seq"), "message")
    return al.lifecycle(m.filter("seq.u is not null")).select("alert_id", "status", "raised_at", "cleared_at")


def alert_hysteresis(spark: SparkSession, d: str, raise_at: float = 0.05, clear_at: float = 0.03) -> DataFrame:
    """Raises and clears of a latch over the live counts of open windows, thresholds set for these tables' sparse lots."""
    w = table(spark, d, "lot_occupancy_5min").filter("not closed and current_occupied is not null and capacity > 0")
    x = w.select("lot_id", F.unix_micros("emitted_at").alias("at_us"), F.unix_micros("window_start").alias("ws"), (F.col("current_occupied") / F.col("capacity")).alias("fraction"))
    x = x.groupBy("lot_id", "at_us", "ws").agg(F.max("fraction").alias("fraction")).withColumn("shard", cell_of("at_us", DAY_US))
    return al.hysteresis(x, "lot_id", "at_us", ["at_us", "ws"], "fraction", raise_at, clear_at, "shard")


def slot_state(spark: SparkSession, d: str) -> DataFrame:
    """(`lot_id`, `slot_id`, `ts`, `status`): what each slot said last."""
    x = judged(spark, d).changes.groupBy("lot_id", "slot_id").agg(F.max(F.struct("ts", "seq", "status")).alias("m"))
    return x.select("lot_id", "slot_id", F.col("m.ts").alias("ts"), F.col("m.status").alias("status"))


def slot_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every declared slot of every lot in its order, with its state if known."""
    lots = table(spark, d, "lot_metadata").select("lot_id", F.posexplode("slot_ids").alias("position", "slot_id"))
    return lots.join(slot_state(spark, d), ["lot_id", "slot_id"], "left").select("lot_id", "position", "slot_id", F.coalesce("status", F.lit("UNKNOWN")).alias("state"), "ts")


def live_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Occupied slots by live state where a lot has any, else by its newest stored window."""
    live = slot_state(spark, d).groupBy("lot_id").agg(F.count_if(F.col("status") == "OCCUPIED").alias("live"))
    x = latest_per_lot(spark, d).join(live, "lot_id", "left")
    return x.select("lot_id", F.coalesce("live", F.col("occupied").cast("bigint")).alias("occupied"), F.col("live").isNotNull().alias("is_live"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    """One row per lot with everything a dashboard shows of it; `rank` is by live occupancy, unknown as empty."""
    x = _summaries(spark, d).join(live_overlay(spark, d).select("lot_id", F.col("occupied").alias("live_occupied"), "is_live"), "lot_id", "left")
    x = x.withColumn("live_permille", num.permille("live_occupied", "capacity"))
    x = x.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("live_permille", F.lit(0)).desc(), "lot_id")))  # a row per lot
    x = x.join(sparkline_topn(spark, d), "lot_id", "left").join(full_since(spark, d), "lot_id", "left")
    return x.select("rank", "lot_id", "capacity", "as_of", "live_occupied", "live_permille", "is_live", "spark", "full_since")


def overview_totals(spark: SparkSession, d: str) -> DataFrame:
    """The overview's head: capacity and live count of all lots, their share, and how many alerts are active."""
    x = _summaries(spark, d).join(live_overlay(spark, d).select("lot_id", F.col("occupied").alias("live_occupied")), "lot_id", "left")
    x = x.agg(F.count(F.lit(1)).alias("lots"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("total_capacity"), F.coalesce(F.sum("live_occupied"), F.lit(0)).alias("total_occupied"))
    active = active_alerts(spark, d).select("n").scalar()
    return x.select("*", F.coalesce(num.permille("total_occupied", "total_capacity"), F.lit(0)).alias("occupancy_permille"), active.alias("active_alerts"))


def lot_detail(spark: SparkSession, d: str, lot_id: str = "LOT-07") -> DataFrame:
    """A lot's metadata, flows and stay; the filter reaches every scan."""
    only = lambda x: x.filter(F.col("lot_id") == lot_id)
    w = only(stored_windows(spark, d))
    x = only(_lots(spark, d)).join(latest_windows(w), "lot_id", "left").join(stats_24h(w), "lot_id", "left")
    x = x.join(broadcast_if_small(only(full_since(spark, d))), "lot_id", "left")
    minutes = F.col("occupied_milliseconds") / F.col("entries") / 60_000
    dwell = F.when((F.col("entries") > 0) & (F.col("occupied_milliseconds") > 0), F.floor(minutes * 10 + 0.5))
    return x.select("lot_id", "capacity", "as_of", "occupied", num.permille("occupied", "capacity").alias("occupancy_permille"), "entries", "exits", dwell.alias("dwell_tenths"), "full_since")


def truth_compare(spark: SparkSession, d: str) -> DataFrame:
    """Closed results of the pipeline against event-time truth per lot: compared, missing, and differing by field.

    Averages may differ by 0.05 slots, flows not at all. A lot's first window and those not closed at its end are left out.
    """
    true = occupancy.truth(table(spark, d, "parking_events")).filter(F.col("covered_us") == WINDOW_US)
    j = judged(spark, d)
    closed = occupancy.closed_at(j.params)
    mine = occupancy.window_updates(j, ("net", "flows")).filter("covered_us > 0").select("lot_id", "window_start", F.col("area_us").alias("a"), F.col("covered_us").alias("c"), F.col("entries").alias("e"), F.col("exits").alias("x"), closed.alias("closed"))
    both = true.join(j.lots.select("lot_id", "top"), "lot_id", "left").filter(closed).drop("top").join(mine.filter("closed"), ["lot_id", "window_start"], "left")
    here, n = F.col("a").isNotNull(), F.count(F.lit(1))
    return both.groupBy("lot_id").agg(
        F.count_if(here).alias("compared"), (n - F.count_if(here)).alias("missing"), F.count_if(here & (F.abs(F.col("a") / F.col("c") - F.col("area_us") / F.col("covered_us")) > 0.05)).alias("average_differs"),
        F.count_if(here & (F.col("e") != F.col("entries"))).alias("entries_differ"), F.count_if(here & (F.col("x") != F.col("exits"))).alias("exits_differ"),
    )


def full_lot_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of full lots at the usual thresholds, from the live counts of open windows; latches start as the first half of the log leaves them."""
    w = table(spark, d, "lot_occupancy_5min").filter("not closed and current_occupied is not null and capacity > 0 and lot_id is not null and emitted_at is not null")
    x = w.groupBy("lot_id", F.unix_micros("emitted_at").alias("at_us"), F.unix_micros("window_start").alias("ws")).agg(F.max(F.struct((F.col("current_occupied") / F.col("capacity")).alias("fraction"), "current_occupied", "capacity")).alias("m"))
    x = materialise(x.select("lot_id", "at_us", "ws", "m.*", cell_of("at_us", DAY_US).alias("shard")), "live-counts")
    middle = x.agg(F.floor((F.min("at_us") + F.max("at_us")) / 2).alias("middle")).select("middle").scalar()
    seq = ["at_us", "ws"]
    edges = lambda part, latched=None: al.hysteresis(part, "lot_id", "at_us", seq, "fraction", 0.90, 0.85, "shard", ("current_occupied", "capacity"), latched)
    first = materialise(al.full_lot_alerts(edges(x.filter(F.col("at_us") < middle)).withColumn("half", F.lit(1)), seq), "first-alerts")
    latched = materialise(al.restore(first, "lot_id", ["at_us"]), "latched")
    second = al.full_lot_alerts(edges(x.filter(F.col("at_us") >= middle), latched), seq, latched)
    return first.unionByName(second).select("alert_id", "state", "lot_id", "at_us", "message", "occupancy_pct")


def alert_restore(spark: SparkSession, d: str) -> DataFrame:
    """Latches of full lots that the log of alerts leaves raised: its newest version of each lot's newest alert is active."""
    a = stored_alerts(spark, d).filter("kind = 'FULL_LOT' and raised_at is not null")
    log = a.select("lot_id", "alert_id", "raised_at", F.when(F.col("status") == "active", "RAISED").otherwise("CLEARED").alias("state"))
    return al.restore(log, "lot_id", ["raised_at", "alert_id"])


_WINDOWS = """w as (select lot_id, epoch_us(window_start) as window_start, capacity, avg_occupied, avg_occupancy_pct, min_occupied, max_occupied, entries, exits,
    unique_vehicles_est, closed, current_occupied, epoch_us(emitted_at) as emitted_at,
    row_number() over (partition by lot_id, window_start order by closed desc, emitted_at desc nulls last, capacity desc, avg_occupied desc nulls last, avg_occupancy_pct desc nulls last,
      min_occupied desc nulls last, max_occupied desc nulls last, entries desc nulls last, exits desc nulls last, unique_vehicles_est desc nulls last, current_occupied desc nulls last) as rn
  from lot_occupancy_5min where lot_id is not null and window_start is not null),
windows as (select * from w where rn = 1)"""
_ALERTS = """v as (select *, row_number() over (partition by alert_id order by updated_at desc, kind desc nulls last, lot_id desc nulls last, sensor_id desc nulls last, status desc nulls last,
    raised_at desc nulls last, cleared_at desc nulls last, message desc nulls last, occupancy_pct desc nulls last) as rn from alerts where alert_id is not null and updated_at is not null),
last_alerts as (select alert_id, kind, lot_id, status, epoch_us(raised_at) as raised_at, epoch_us(cleared_at) as cleared_at, epoch_us(updated_at) as updated_at from v where rn = 1)"""
_LATEST = f"""{_WINDOWS},
newest as (select lot_id, window_start as as_of, coalesce(current_occupied, cast(round_even(avg_occupied, 0) as int)) as occupied
  from (select *, row_number() over (partition by lot_id order by window_start desc) as r from windows) where r = 1),
lots as (select m.lot_id, name, personality, capacity, columns, latitude, longitude, as_of, occupied,
    case when capacity > 0 then cast(floor(occupied * 1000 / capacity + 0.5) as bigint) end as permille from lot_metadata m left join newest using (lot_id))"""
_STATS = f"""{_WINDOWS},
l as (select lot_id, max(window_start) as last, arg_max(unique_vehicles_est, case when closed then window_start end) as unique_now from windows group by lot_id),
stats as (select lot_id, cast(coalesce(sum(entries), 0) as bigint) as entries, cast(coalesce(sum(exits), 0) as bigint) as exits,
    cast(sum(floor(avg_occupied * 1000 + 0.5)) * 300 as bigint) as occupied_milliseconds, any_value(unique_now) as unique_now
  from windows join l using (lot_id) where window_start > last - 86400000000 group by lot_id)"""
_HOURLY = f"""{_WINDOWS},
hourly as (select lot_id, window_start - window_start % 3600000000 as bucket, cast(sum(floor(avg_occupied * 1000 + 0.5)) as bigint) as sum_avg_thousandths,
    cast(sum(floor(avg_occupancy_pct * 100 + 0.5)) as bigint) as sum_pct_hundredths, min(min_occupied) as min_occupied, max(max_occupied) as max_occupied,
    cast(sum(entries) as bigint) as entries, cast(sum(exits) as bigint) as exits, count(*) as windows from windows where closed group by all)"""
_STATE = f"{JUDGED_SQL}, state as (select lot_id, slot_id, max(ts) as ts, arg_max(st, ts) as st from changes group by all)"

ORACLES = {
    "upsert_closed_final": f"with {_WINDOWS} select lot_id, window_start, closed, emitted_at, avg_occupied, entries, exits from windows",
    "batch_collapse": """with b as (select epoch_us(emitted_at) // 3600000000 as batch, lot_id, epoch_us(window_start) as window_start, closed, epoch_us(emitted_at) as emitted_at, avg_occupied
    from lot_occupancy_5min where lot_id is not null and window_start is not null and emitted_at is not null),
r as (select *, row_number() over (partition by batch, lot_id, window_start order by closed desc, emitted_at desc, avg_occupied desc nulls last) as rn from b)
select batch, lot_id, window_start, closed, emitted_at, avg_occupied from r where rn = 1""",
    "latest_per_lot": f"with {_LATEST} select lot_id, name, personality, capacity, columns, latitude, longitude, as_of, occupied from lots",
    "latest_per_lot_lateral": f"with {_LATEST} select lot_id, capacity, as_of, occupied from lots",
    "sparkline_topn": f"""with {_WINDOWS},
r as (select *, row_number() over (partition by lot_id order by window_start desc) as k from windows where window_start > (select max(window_start) from windows) - 172800000000)
select lot_id, string_agg(cast(cast(floor(avg_occupancy_pct * 100 + 0.5) as bigint) as varchar), ',' order by window_start) as spark from r where k <= 24 group by lot_id""",
    "sparkline_heights": f"""with {_WINDOWS},
r as (select *, row_number() over (partition by lot_id order by window_start desc) as k from windows where window_start > (select max(window_start) from windows) - 172800000000),
p as (select lot_id, window_start, cast(floor(avg_occupancy_pct * 100 + 0.5) as bigint) as v from r where k <= 24),
b as (select lot_id, greatest(max(v) - min(v), 1000) as span, greatest(0, min(v) + max(v) - greatest(max(v) - min(v), 1000)) as low, count(*) as n from p group by lot_id)
select lot_id, string_agg(cast(cast(floor(210 - least(2 * v - low, 2 * span) * 180 / (2 * span) + 0.5) as bigint) as varchar), ',' order by window_start) as heights from p join b using (lot_id) where n > 1 group by lot_id""",
    "lot_stats_24h": f"with {_STATS} select * from stats",
    "dwell_littles_law": f"""with {_STATS} select lot_id, case when entries > 0 and occupied_milliseconds > 0
  then cast(floor(occupied_milliseconds / entries / 60000 * 10 + 0.5) as bigint) end as dwell_tenths from stats""",
    "rank_lots": f"""with {_LATEST} select row_number() over (order by coalesce(permille, 0) desc, lot_id) as rank, lot_id, occupied, capacity, permille as occupancy_permille from lots""",
    "system_totals": f"""with {_LATEST} select cast(sum(capacity) as bigint) as total_capacity, cast(sum(coalesce(occupied, 0)) as bigint) as total_occupied,
  cast(floor(sum(coalesce(occupied, 0)) * 1000 / sum(capacity) + 0.5) as bigint) as occupancy_permille from lots""",
    "lot_labels": f"""with {_LATEST} select lot_id, case when permille is null then 'No data' when permille >= 900 then 'Full' when permille >= 750 then 'Filling' else 'Space' end as label,
  capacity - occupied as free from lots""",
    "hourly_rollup": f"with {_HOURLY} select *, sum_avg_thousandths / windows / 1000 as avg_occupied from hourly",
    "history_page": f"""with {_WINDOWS}, x as (select * from windows where lot_id = 'LOT-07')
select lot_id, window_start, avg_occupied, min_occupied, max_occupied, entries, exits, closed from x
where window_start >= (select max(window_start) from x) + 300000000 - 86400000000 order by window_start limit 500""",
    "history_hourly": f"""with {_HOURLY}, x as (select max(window_start) + 300000000 as t from windows where lot_id = 'LOT-07')
select lot_id, bucket as window_start, min_occupied, max_occupied, entries, exits, windows, cast(null as double) as unique_vehicles_est, true as closed
from hourly, x where lot_id = 'LOT-07' and bucket >= t - 604800000000 and bucket < t order by bucket limit 500""",
    "alerts_page": f"""with {_ALERTS}, h as (select * from last_alerts where kind = 'FULL_LOT')
select alert_id, kind, lot_id, status, raised_at, cleared_at, greatest(0, (coalesce(cleared_at, (select max(updated_at) from last_alerts)) - raised_at) / 1e6) as duration_s,
  (select count(*) from h) as total from h order by raised_at desc nulls last, alert_id limit 50 offset 20""",
    "active_alerts": f"with {_ALERTS} select count(*) as n from last_alerts where status = 'active'",
    "full_since": f"with {_ALERTS} select lot_id, max(raised_at) as full_since from last_alerts where kind = 'FULL_LOT' and status = 'active' and lot_id is not null group by lot_id",
    "alert_lifecycle": """with m as (select alert_id, cleared_at is not null as cleared, epoch_us(coalesce(cleared_at, raised_at)) as t,
    row_number() over (partition by alert_id order by updated_at, coalesce(epoch_us(cleared_at), 0)) as seq from alerts where alert_id is not null and updated_at is not null)
select alert_id, case when bool_or(cleared) then 'cleared' else 'active' end as status, arg_min(t, seq) as raised_at,
  arg_min(t, seq) filter (where cleared) as cleared_at from m group by alert_id""",
    "alert_hysteresis": """with x as (select lot_id, epoch_us(emitted_at) as at_us, epoch_us(window_start) as ws, max(current_occupied / capacity) as fraction from lot_occupancy_5min
    where not closed and current_occupied is not null and capacity > 0 and lot_id is not null and emitted_at is not null group by all),
s as (select lot_id, at_us, ws, case when fraction >= 0.05 then 'RAISED' when fraction <= 0.03 then 'CLEARED' end as state from x),
d as (select *, lag(state) over (partition by lot_id order by at_us, ws) as was from s where state is not null)
select lot_id, at_us, ws, state from d where state <> coalesce(was, 'CLEARED')""",
    "slot_snapshot": f"""with {_STATE}, s as (select lot_id, unnest(slot_ids) as slot_id, unnest(range(len(slot_ids))) as position from lot_metadata)
select s.lot_id, cast(position as int) as position, s.slot_id, coalesce(st, 'UNKNOWN') as state, ts from s left join state using (lot_id, slot_id)""",
    "live_overlay": f"""with {_LATEST}, {_STATE}, live as (select lot_id, count_if(st = 'OCCUPIED') as live from state group by lot_id)
select lot_id, coalesce(live, occupied) as occupied, live is not null as is_live from lots left join live using (lot_id)""",
    "overview": f"""with {_LATEST}, {_STATE}, {_ALERTS}, live as (select lot_id, count_if(st = 'OCCUPIED') as live from state group by lot_id),
r as (select *, row_number() over (partition by lot_id order by window_start desc) as k from windows where window_start > (select max(window_start) from windows) - 172800000000),
sp as (select lot_id, string_agg(cast(cast(floor(avg_occupancy_pct * 100 + 0.5) as bigint) as varchar), ',' order by window_start) as spark from r where k <= 24 group by lot_id),
fs as (select lot_id, max(raised_at) as full_since from last_alerts where kind = 'FULL_LOT' and status = 'active' and lot_id is not null group by lot_id),
x as (select lots.lot_id, capacity, as_of, coalesce(live, occupied) as live_occupied, live is not null as is_live, case when capacity > 0 then cast(floor(coalesce(live, occupied) * 1000 / capacity + 0.5) as bigint) end as live_permille from lots left join live using (lot_id))
select row_number() over (order by coalesce(live_permille, 0) desc, lot_id) as rank, lot_id, capacity, as_of, live_occupied, live_permille, is_live, spark, full_since from x left join sp using (lot_id) left join fs using (lot_id)""",
    "overview_totals": f"""with {_LATEST}, {_STATE}, {_ALERTS}, live as (select lot_id, count_if(st = 'OCCUPIED') as live from state group by lot_id),
t as (select count(*) as lots, cast(sum(capacity) as bigint) as total_capacity, cast(sum(coalesce(live, occupied)) as bigint) as total_occupied from lots left join live using (lot_id))
select *, cast(floor(total_occupied * 1000 / total_capacity + 0.5) as bigint) as occupancy_permille, (select count(*) from last_alerts where status = 'active') as active_alerts from t""",
    "truth_compare": f"""with {TIMELINE_SQL}, {TRUTH_SQL.removeprefix(VALID_SQL + ",")},
fl as (select lot_id, window_start, sum(entry) as e, sum(exit) as x from changes group by all), tops as (select lot_id, max(ts) as top from judged where not late group by all),
b as (select t.*, w.area_us as a, w.covered_us as c, coalesce(e, 0) as e, coalesce(x, 0) as x from truth t join tops using (lot_id) left join weighted w using (lot_id, window_start) left join fl using (lot_id, window_start)
  where t.covered_us = 300000000 and window_start + 420000000 < top - 60000000)
select lot_id, count(a) as compared, count(*) - count(a) as missing, count_if(abs(a / c - area_us / covered_us) > 0.05) as average_differs, count_if(a is not null and e <> entries) as entries_differ,
  count_if(a is not null and x <> exits) as exits_differ from b group by lot_id""",
    "full_lot_alerts": """with x as (select lot_id, epoch_us(emitted_at) as at_us, epoch_us(window_start) as ws, current_occupied, capacity, current_occupied / capacity as fraction,
    row_number() over (partition by lot_id, emitted_at, window_start order by current_occupied / capacity desc, current_occupied desc, capacity desc) as rn from lot_occupancy_5min
    where not closed and current_occupied is not null and capacity > 0 and lot_id is not null and emitted_at is not null),
s as (select *, case when fraction >= 0.9 then 'RAISED' when fraction <= 0.85 then 'CLEARED' end as state from x where rn = 1),
d as (select *, lag(state) over (partition by lot_id order by at_us, ws) as was from s where state is not null),
e as (select *, lag(at_us) over (partition by lot_id order by at_us, ws) as raised from d where state <> coalesce(was, 'CLEARED')),
p as (select *, current_occupied * 1000 // capacity as q, 2 * (current_occupied * 1000 % capacity) as t from e),
r as (select *, (q + case when t > capacity or (t = capacity and q % 2 = 1) then 1 else 0 end) / 10 as pct from p)
select lot_id || '|FULL_LOT|' || (case when state = 'RAISED' then at_us else raised end // 1000000) as alert_id, state, lot_id, at_us,
  'Lot ' || lot_id || case when state = 'RAISED' then ' full: ' else ' has space again: ' end || cast(round_even(pct, 0) as int) || '% (' || current_occupied || '/' || capacity || ' slots)' as message, pct as occupancy_pct from r""",
    "alert_restore": f"""with {_ALERTS}, n as (select *, row_number() over (partition by lot_id order by raised_at desc, alert_id desc) as k from last_alerts where kind = 'FULL_LOT' and raised_at is not null and lot_id is not null)
select lot_id, alert_id from n where k = 1 and status = 'active'""",
    "lot_detail": f"""with {_LATEST}, {_ALERTS}, {_STATS.removeprefix(_WINDOWS + ",")}
select lots.lot_id, capacity, as_of, occupied, permille as occupancy_permille, entries, exits,
  case when entries > 0 and occupied_milliseconds > 0 then cast(floor(occupied_milliseconds / entries / 60000 * 10 + 0.5) as bigint) end as dwell_tenths,
  (select max(raised_at) from last_alerts a where a.lot_id = 'LOT-07' and kind = 'FULL_LOT' and status = 'active') as full_since from lots left join stats using (lot_id) where lots.lot_id = 'LOT-07'""",
    "versions_per_window": """with c as (select * exclude (window_start), epoch_us(window_start) as window_start, count(*) as copies from lot_occupancy_5min where lot_id is not null and window_start is not null group by all)
select lot_id, window_start, cast(sum(copies) as bigint) as n, count(*) as n_different, cast(coalesce(sum(copies) filter (where closed), 0) as bigint) as n_closed from c group by lot_id, window_start having sum(copies) > 1""",
    "alert_texts": f"""with {_ALERTS.replace("epoch_us(updated_at) as updated_at from v", "epoch_us(updated_at) as updated_at, occupancy_pct from v")},
s as (select *, (cleared_at - raised_at) // 1000000 as s from last_alerts where raised_at is not null and cleared_at >= raised_at)
select alert_id, case when s < 60 then s || ' s' when s < 3600 then (s // 60) || ' min' else (s // 3600) || ' h ' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ' min' end as lasted,
  cast(floor(occupancy_pct + 0.5) as bigint) || '%' as full from s""",
}

QUERIES = {
    f.__name__: f
    for f in (
        upsert_closed_final, batch_collapse, latest_per_lot, latest_per_lot_lateral, sparkline_topn, sparkline_heights, lot_stats_24h, dwell_littles_law, rank_lots, system_totals, lot_labels, hourly_rollup,
        history_page, history_hourly, alerts_page, active_alerts, full_since, alert_lifecycle, alert_hysteresis, slot_snapshot, live_overlay, overview, overview_totals, lot_detail, truth_compare, full_lot_alerts, alert_restore, versions_per_window, alert_texts,
    )
}
