"""Occupancy of slots in event time: what arrival order accepts, what slots did, and windows of it.

The plan is set-based: judge rows in arrival order (duplicates, lateness, regressions), derive state
changes per slot, and integrate the number of occupied slots over tumbling windows. Orders of rows
are two-level scans (`scans.scan`), so no lot is one task. Areas need no scan of rows: a change of the
count adds its size times the rest of its window, and all of every later one, so windows are summed
after partial aggregation and a running sum goes over windows only, one per lot and five minutes.

Every step takes what earlier batches left (`Carry`), so the same plan does a finished log in one go
and a stream batch by batch (`streaming.processor`).

Input columns: lot_id, slot_id, sensor_id, event_type, status, vehicle_token, event_id, ts (event
time), arrival (ingest time), seq (arrival order, unique in a lot); times in microseconds.
Invalid events (`validation.event_error`) and rows without seq are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelot.functions.numbers import half_even, rounded_ratio, window_key
from tidelot.functions.timing import HOUR_US, MINUTE_US, SECOND_US, cell_of, floor_to
from tidelot.operators import scans
from tidelot.operators.messages import canonical_id, canonical_word
from tidelot.operators.validation import valid_events
from tidelot.session import Staging, materialise, spread


@dataclass(frozen=True)
class Params:
    """Durations in microseconds. Identifiers must be remembered as long as a report can be accepted."""

    window: int = 5 * MINUTE_US
    lateness: int = 60 * SECOND_US
    grace: int = 120 * SECOND_US
    dedupe_ttl: int = 300 * SECOND_US
    offline_after: int = 120 * SECOND_US
    raise_at: float = 0.90
    clear_at: float = 0.85
    #: Rows of arrival order, and event time, that one task scans of a lot.
    arrival_shard: int = 1 << 17
    time_shard: int = 6 * HOUR_US

    def __post_init__(self) -> None:
        if min(self.window, self.arrival_shard, self.time_shard) <= 0 or self.time_shard % self.window:
            raise ValueError("window and shards must be positive, time_shard a multiple of window")
        if self.dedupe_ttl < self.lateness + self.grace:
            raise ValueError("dedupe_ttl must be at least lateness + grace")
        if not 0 < self.clear_at < self.raise_at <= 1:
            raise ValueError(f"a latch at {self.raise_at} / {self.clear_at} can not work: it must be raised above where it is cleared, both within 0 and 1")


def arrivals(events: DataFrame) -> DataFrame:
    """The input columns of the valid events in a table of deliveries."""
    events = spread(events.select("event_id", "event_type", "sensor_id", "lot_id", "slot_id", "status", "vehicle_token", "event_ts", "ingest_ts", "kafka_offset"), "kafka_offset")
    return valid_events(events).select(
        "lot_id", "slot_id", "sensor_id", canonical_word("event_type").alias("event_type"), canonical_word("status").alias("status"),
        F.lower("vehicle_token").alias("vehicle_token"), canonical_id("event_id").alias("event_id"),
        F.unix_micros("event_ts").alias("ts"), F.unix_micros("ingest_ts").alias("arrival"), F.col("kafka_offset").alias("seq"),
    ).filter("seq is not null")


def first_reports(rows: DataFrame) -> DataFrame:
    """Drop repeated identifiers of occupancy reports within a lot, by arrival; heartbeats stay, as they change nothing when repeated."""
    own = F.when((F.col("event_type") != "OCCUPANCY") | F.col("event_id").isNull(), F.col("seq"))
    rest = [c for c in rows.columns if c not in ("lot_id", "event_id", "seq")]
    best = rows.withColumn("_own", own).groupBy("lot_id", "event_id", "_own").agg(F.min(F.struct("seq", *rest)).alias("m"))
    return best.select("lot_id", "event_id", "m.*").select(*rows.columns)


@dataclass(frozen=True)
class Carry:
    """What earlier batches left. `lots`: (`lot_id`, `top` highest event time, `began` start of coverage, `occupied`). `slots`: (`lot_id`, `slot_id`, `ts`, `status`), what each said last."""

    lots: DataFrame
    slots: DataFrame


def watermarked(rows: DataFrame, p: Params, carry: Carry | None = None) -> DataFrame:
    """Add `heard` (highest event time that arrived before), `watermark` (that less the lateness), `window_start` and `late`."""
    x = scans.scan(rows.withColumn("_shard", cell_of("seq", p.arrival_shard)), ["lot_id"], "_shard", ["seq"], tops={"heard": "ts"}).drop("_shard")
    if carry is not None:
        x = x.join(carry.lots.select("lot_id", "top"), "lot_id", "left").withColumn("heard", F.greatest("heard", "top")).drop("top")
    x = x.withColumns({"watermark": F.col("heard") - p.lateness, "window_start": floor_to("ts", p.window)})
    late = (F.col("event_type") == "OCCUPANCY") & (F.col("window_start") + p.window + p.grace < F.col("watermark"))
    return x.withColumn("late", F.coalesce(late, F.lit(False)))


def slot_steps(accepted: DataFrame, p: Params, carry: Carry | None = None) -> DataFrame:
    """Accepted occupancy reports with `regressed` (not newer than what the slot already said), `was` (what it said), `delta` (change of the lot's count), `entry` and `exit`.

    What a slot said is the report with its highest event time, of equal ones the first: a running maximum gives time and status in one scan.
    """
    said = F.struct("ts", (-F.col("seq")).alias("rank"), "status")
    x = accepted.filter("event_type = 'OCCUPANCY'").withColumns({"_shard": cell_of("seq", p.arrival_shard), "_said": said})
    x = scans.scan(x, ["lot_id", "slot_id"], "_shard", ["seq"], tops={"_held": "_said"}).drop("_shard", "_said")
    if carry is not None:
        before = carry.slots.select("lot_id", "slot_id", F.struct("ts", F.lit(0).cast("bigint").alias("rank"), "status").alias("_stored"))
        x = x.join(before, ["lot_id", "slot_id"], "left").withColumn("_held", F.greatest("_held", "_stored")).drop("_stored")
    x = x.withColumns({"regressed": F.coalesce(F.col("ts") <= F.col("_held.ts"), F.lit(False)), "was": F.col("_held.status")}).drop("_held")
    holds, now_in = ~F.col("regressed"), F.col("status") == "OCCUPIED"
    was_in, was_out = F.col("was") == "OCCUPIED", F.col("was") == "FREE"
    delta = F.when(holds & now_in & F.coalesce(~was_in, F.lit(True)), 1).when(holds & ~now_in & F.coalesce(was_in, F.lit(False)), -1).otherwise(0)
    flag = lambda c: F.coalesce(holds & c, F.lit(False)).cast("int")
    return x.withColumns({"delta": delta, "entry": flag(was_out & now_in), "exit": flag(was_in & ~now_in)})


class Judged:
    """A lot stream judged in arrival order. Members are made when first asked for; `rows` and `reports` are written tables."""

    def __init__(self, events: DataFrame, params: Params, carry: Carry | None = None, staging: Staging | None = None, known_ids: DataFrame | None = None):
        self.events, self.params, self.carry, self.known_ids = events, params, carry, known_ids
        self._keep = staging.write if staging is not None else materialise

    @cached_property
    def rows(self) -> DataFrame:
        """After removal of repeats, with watermark and late."""
        firsts = first_reports(arrivals(self.events))
        if self.known_ids is not None:
            firsts = firsts.join(self.known_ids.select("lot_id", "event_id", F.lit("OCCUPANCY").alias("event_type")), ["lot_id", "event_id", "event_type"], "left_anti").select(*firsts.columns)
        return self._keep(watermarked(self._keep(firsts, "first-reports"), self.params, self.carry), "watermarked")

    @cached_property
    def reports(self) -> DataFrame:
        """Accepted occupancy reports with the columns of `slot_steps`."""
        return self._keep(slot_steps(self.accepted, self.params, self.carry), "slot-steps")

    @property
    def changes(self) -> DataFrame:
        return self.reports.filter("not regressed")

    @property
    def accepted(self) -> DataFrame:
        return self.rows.filter("not late")

    @property
    def late(self) -> DataFrame:
        return self.rows.filter("late")

    @cached_property
    def lots(self) -> DataFrame:
        """A row per lot heard: `first` (coverage starts or goes on here), `since` (earliest instant that changes), `began` (earliest instant that is covered now), `begun` (what was covered before), `top`, `base` (count at `first`), `net` (change of it)."""
        x = self.accepted.groupBy("lot_id").agg(F.min_by("ts", "seq").alias("first"), F.max("ts").alias("top"))
        d = self.reports.filter("delta <> 0").groupBy("lot_id").agg(F.min("ts").alias("_delta"), F.sum("delta").alias("net"))
        x = x.join(d, "lot_id", "left")
        if self.carry is None:
            x = x.withColumns({"begun": F.lit(None).cast("bigint"), "base": F.lit(0).cast("bigint")})
        else:
            c = self.carry.lots.select("lot_id", F.col("top").alias("_top"), F.col("began").alias("begun"), F.col("occupied").alias("base"))
            x = x.join(c, "lot_id", "left").withColumns({"first": F.coalesce("_top", "first"), "top": F.greatest("top", "_top"), "base": F.coalesce("base", F.lit(0).cast("bigint"))})
        began = F.least(F.coalesce("begun", "first"), F.col("_delta"))
        return self._keep(x.select("lot_id", "first", F.least("first", "_delta").alias("since"), began.alias("began"), "begun", "top", "base", F.coalesce("net", F.lit(0)).alias("net")), "lots")


def judge(events: DataFrame, p: Params = Params()) -> Judged:  # noqa: B008
    return Judged(events, p)


def _split(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Cut [start, end) at window borders: adds `window_start`; empty spans vanish."""
    x = df.filter(F.col(end) > F.col(start))
    return x.withColumn("window_start", F.explode(F.sequence(floor_to(start, width), floor_to(f"{end} - 1", width), F.lit(width).cast("bigint"))))


def seen_counts(j: Judged) -> DataFrame:
    """(`lot_id`, `window_start`, `occupied`): counts as seen while rows arrived, not rewritten by late ones.

    The count only changes with a change; between two of them event time runs from where it was behind
    the first to where it is behind the second. One more span leads up to the lot's first change.
    """
    p = j.params
    d = j.reports.filter("delta <> 0").select("lot_id", "seq", "ts", "window_start", "delta", F.greatest("ts", "heard").alias("cursor"), cell_of("seq", p.arrival_shard).alias("_shard"))
    x = scans.scan(d, ["lot_id"], "_shard", ["seq"], sums={"occupied": "delta"}, leads={"until": "cursor"})
    x = x.join(j.lots.select("lot_id", "top", "base"), "lot_id").withColumns({"occupied": F.col("occupied") + F.col("base"), "until": F.coalesce("until", "top")})
    lead_up = d.groupBy("lot_id").agg(F.min("cursor").alias("_cursor"))
    lead_up = j.lots.join(lead_up, "lot_id", "left").select("lot_id", F.col("first").alias("cursor"), F.coalesce("_cursor", "top").alias("until"), F.col("base").alias("occupied"))
    spans = x.select("lot_id", "cursor", "until", "occupied").unionByName(lead_up)
    at_once = x.filter("ts >= cursor").select("lot_id", "window_start", "occupied")
    return _split(spans, "cursor", "until", p.window).select("lot_id", "window_start", "occupied").unionByName(at_once)


def extremes(j: Judged) -> DataFrame:
    """(`lot_id`, `window_start`, `min_occupied`, `max_occupied`) of `seen_counts`."""
    return seen_counts(j).groupBy("lot_id", "window_start").agg(F.min("occupied").alias("min_occupied"), F.max("occupied").alias("max_occupied"))


def window_updates(j: Judged, measures: tuple[str, ...] = ("net", "flows", "seen", "tokens", "fresh"), lg_k: int = 10) -> DataFrame:
    """What a batch adds to each window: (`lot_id`, `window_start`, `area_us`, `covered_us`) and, as asked for, entries, exits, least and greatest count, a sketch of tokens, latest arrival.

    One aggregation over the union of what reports, spans and coverage say of a window.
    """
    p, keys = j.params, ["lot_id", "window_start"]
    rest = F.col("window_start") + p.window - F.col("ts")
    fields = {
        "net": {"net": F.col("delta"), "own": F.col("delta") * rest}, "flows": {"entries": F.col("entry"), "exits": F.col("exit")},
        "tokens": {"token": F.when(F.col("status") == "OCCUPIED", F.col("vehicle_token"))}, "fresh": {"arrival": F.col("arrival")},
    }
    per_report = {n: c for m in measures if m in fields for n, c in fields[m].items()}
    parts = [j.reports.select(*keys, *(c.alias(n) for n, c in per_report.items()))]
    if "seen" in measures:
        parts.append(seen_counts(j))
    covered = j.lots.withColumn("window_start", F.explode(F.sequence(floor_to("since", p.window), floor_to("top", p.window), F.lit(p.window).cast("bigint"))))
    parts.append(covered.select(*keys))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    totals = {
        "net": [F.coalesce(F.sum("net"), F.lit(0)).alias("net"), F.coalesce(F.sum("own"), F.lit(0)).alias("own")], "seen": [F.min("occupied").alias("min_occupied"), F.max("occupied").alias("max_occupied")],
        "flows": [F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("exits"), F.lit(0)).alias("exits")],
        "tokens": [F.hll_sketch_agg("token", lg_k).alias("tokens")], "fresh": [F.max("arrival").alias("latest_arrival_us")],
    }
    x = rows.groupBy(*keys).agg(*(a for m in measures for a in totals[m])).join(j.lots.drop("net"), "lot_id")
    before = F.coalesce(F.sum("net").over(Window.partitionBy("lot_id").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per five minutes
    end = F.least(F.col("window_start") + p.window, F.col("top"))
    cut = F.col("window_start") + p.window - end  # the part of the window that is still to come
    length = lambda a, b: F.greatest(F.lit(0), F.least(b, F.col("window_start") + p.window) - F.greatest(a, F.col("window_start")))
    went_on = length(F.col("first"), F.col("top"))
    earlier = length(F.col("began"), F.coalesce("begun", "first"))
    area = F.col("own") - F.col("net") * cut + before * (end - F.col("window_start")) + F.col("base") * went_on
    return x.withColumns({"area_us": area, "covered_us": went_on + earlier}).drop("net", "own", "first", "since", "began", "begun", "base")


def time_weighted(j: Judged) -> DataFrame:
    """(`lot_id`, `window_start`, `area_us`, `covered_us`): occupied slots integrated over each window, gaps carried forward."""
    return window_updates(j, ("net",)).filter("covered_us > 0").select("lot_id", "window_start", "area_us", "covered_us")


def flows(j: Judged) -> DataFrame:
    """(`lot_id`, `window_start`, `entries`, `exits`) credited to the window of the event."""
    x = j.changes.groupBy("lot_id", "window_start").agg(F.sum("entry").alias("entries"), F.sum("exit").alias("exits"))
    return x.filter("entries > 0 or exits > 0")


def vehicles(j: Judged, exact: bool = False, lg_k: int = 10) -> DataFrame:
    """(`lot_id`, `window_start`, `vehicles`): different tokens among accepted OCCUPIED reports, regressed ones included."""
    x = j.reports.filter("status = 'OCCUPIED' and vehicle_token is not null").groupBy("lot_id", "window_start")
    if exact:
        return x.agg(F.count_distinct("vehicle_token").alias("vehicles"))
    return x.agg(F.hll_sketch_estimate(F.hll_sketch_agg("vehicle_token", lg_k)).cast("double").alias("vehicles"))


def closed_at(p: Params) -> Column:
    """Whether the window that starts at `window_start` is closed once `top` was heard."""
    return F.col("window_start") + p.window + p.grace < F.col("top") - p.lateness


def project_results(windows: DataFrame, p: Params, capacity: DataFrame | None, n_slots: DataFrame) -> DataFrame:
    """The columns of a window's result from its sums, `top`, the lot's `occupied` and `closed`.

    Capacity is never below the number of slots that reported (`n_slots`: `lot_id`, `n_slots`), nor below 1.
    A window that covers no time has the current count as average; one in which no count was seen has it as extremes.
    Averages are rounded to thousandths, shares to hundredths of a percent and estimates to tenths, halves to even.
    """
    out = windows.join(n_slots, "lot_id", "left")
    limit = F.greatest(F.col("n_slots"), F.lit(1))
    if capacity is not None:
        out = out.join(capacity.select("lot_id", F.col("capacity").alias("_capacity")), "lot_id", "left")
        limit = F.greatest(F.col("_capacity"), F.col("n_slots"), F.lit(1))
    covers = F.col("covered_us") > 0
    area, time = F.when(covers, F.col("area_us")).otherwise(F.col("occupied")), F.when(covers, F.col("covered_us")).otherwise(F.lit(1).cast("bigint"))
    avg, share = rounded_ratio(area, time, 3), rounded_ratio(100 * area, time * limit, 2)
    return out.select(
        "lot_id", "window_start", (F.col("window_start") + p.window).alias("window_end"), limit.cast("int").alias("capacity"), avg.alias("avg_occupied"), share.alias("avg_occupancy_pct"),
        F.coalesce("min_occupied", "occupied").alias("min_occupied"), F.coalesce("max_occupied", "occupied").alias("max_occupied"), "entries", "exits",
        half_even(F.hll_sketch_estimate("tokens").cast("double"), 1).alias("unique_vehicles_est"), "closed", F.when(~F.col("closed"), F.col("occupied")).alias("current_occupied"), "latest_arrival_us",
        window_key("lot_id", "window_start").alias("window_key"),
    )


def window_results(j: Judged, capacity: DataFrame | None = None) -> DataFrame:
    """The result of each window that covers time; `capacity` is (`lot_id`, `capacity`). `closed`: the final watermark is past end and grace."""
    slots = j.changes.groupBy("lot_id").agg(F.count_distinct("slot_id").alias("n_slots"))
    now = j.lots.select("lot_id", (F.col("base") + F.col("net")).alias("occupied"))
    x = window_updates(j).filter("covered_us > 0").join(now, "lot_id").withColumn("closed", closed_at(j.params))
    return project_results(x, j.params, capacity, slots)


def subscribed(deltas: DataFrame, subscriptions: DataFrame, most: int = 5) -> DataFrame:
    """The newest change of each slot of the lots a client subscribed to (`client`, `lot_id`; at most `most` lots each, the first by name).

    Changes of one slot between two pushes are one: (`client`, `lot_id`, `slot_id`, `ts`, `status`).
    """
    chosen = subscriptions.filter("client is not null and lot_id is not null").distinct()
    chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("client").orderBy("lot_id"))).filter(F.col("_n") <= most).drop("_n")
    newest = deltas.groupBy("lot_id", "slot_id").agg(F.max(F.struct("ts", "seq", "status")).alias("m")).select("lot_id", "slot_id", "m.ts", "m.status")
    return newest.join(chosen, "lot_id").select("client", "lot_id", "slot_id", "ts", "status")


def truth(events: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """Windows as they were in event time, whatever arrived when: (`lot_id`, `window_start`, `area_us`, `covered_us`, `entries`, `exits`, `vehicles`).

    Each valid report counts once, in order of event time; the count of a lot is integrated from its first report to its last event.
    A slot's first report sets its state and is no entry.
    """
    rows = materialise(first_reports(arrivals(events)).filter("event_type = 'OCCUPANCY'").withColumn("_shard", cell_of("ts", p.time_shard)), "true-reports")
    x = scans.scan(rows, ["lot_id", "slot_id"], "_shard", ["ts", "seq"], lags={"was": "status"}).withColumn("window_start", floor_to("ts", p.window))
    now_in, was_in = F.col("status") == "OCCUPIED", F.coalesce(F.col("was") == "OCCUPIED", F.lit(False))
    delta = now_in.cast("int") - was_in.cast("int")
    x = x.withColumn("delta", delta)
    rest = F.col("window_start") + p.window - F.col("ts")
    told = F.col("was").isNotNull()
    sums = x.select("lot_id", "window_start", "delta", (F.col("delta") * rest).alias("own"), (told & (F.col("delta") > 0)).cast("int").alias("entry"), (F.col("delta") < 0).cast("int").alias("exit"), F.when(now_in, F.col("vehicle_token")).alias("token"))
    lots = materialise(rows.groupBy("lot_id").agg(F.min("ts").alias("began"), F.max("ts").alias("top")), "true-lots")
    dense = lots.select("lot_id", F.explode(F.sequence(floor_to("began", p.window), floor_to("top", p.window), F.lit(p.window).cast("bigint"))).alias("window_start"))
    w = sums.unionByName(dense, allowMissingColumns=True).groupBy("lot_id", "window_start").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("delta", "net"), ("own", "own"), ("entry", "entries"), ("exit", "exits"))), F.count_distinct("token").alias("vehicles")
    )
    w = w.join(lots, "lot_id")
    before = F.coalesce(F.sum("net").over(Window.partitionBy("lot_id").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per five minutes
    end = F.least(F.col("window_start") + p.window, F.col("top"))
    area = F.col("own") - F.col("net") * (F.col("window_start") + p.window - end) + before * (end - F.col("window_start"))
    covered = F.greatest(F.lit(0), end - F.greatest("window_start", "began"))
    return w.select("lot_id", "window_start", area.alias("area_us"), covered.alias("covered_us"), "entries", "exits", "vehicles")


def sensor_silences(accepted: DataFrame, p: Params) -> DataFrame:
    """(`lot_id`, `sensor_id`, `last_seen`, `back_at`): silences longer than the threshold, in event time.

    `back_at` is null while the sensor is silent at the end of its lot's stream.
    """
    x = accepted.filter("sensor_id is not null").groupBy("lot_id", "sensor_id", "ts").agg(F.lit(1).alias("_one"))
    x = materialise(x.withColumn("_shard", cell_of("ts", p.time_shard)), "sensor-seen")
    x = scans.scan(x, ["lot_id", "sensor_id"], "_shard", ["ts"], leads={"back_at": "ts"})
    end = accepted.groupBy("lot_id").agg(F.max("ts").alias("_end"))
    gap = F.coalesce("back_at", "_end") - F.col("ts")
    return x.join(end, "lot_id").filter(gap > p.offline_after).select("lot_id", "sensor_id", F.col("ts").alias("last_seen"), "back_at")
