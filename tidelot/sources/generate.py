"""Generated events: occupancy that follows demand curves, a load of exact rate, and injected faults. All are functions of row numbers and seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelot.functions import demand

LATE_RANGE_S = (15, 600)
#: Kinds of malformed messages.
BREAKAGES = ("truncated", "renamed field", "unknown status", "time without zone", "token removed")


def slot_ids(n: Column) -> Column:
    """A-001 and on, 20 to a row of letters."""
    name = lambda i: F.format_string("%s-%03d", F.chr(F.lit(65) + F.floor(i / 20).cast("int")), i + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), name)


def draw(*parts: Column | str | int) -> Column:
    """A uniform number within [0, 1) that depends on `parts` only: the first 32 bits of an MD5 over their texts, so that every engine draws the same."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def poisson(u: Column, mean: Column) -> Column:
    """The Poisson number of mean `mean` at a uniform draw `u`, by its cumulative probabilities, searched up to twelve standard deviations and 15 above the mean: a draw has 32 bits, what lies beyond has none."""
    far = F.ceil(mean + 12 * F.sqrt(mean) + 15).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    step = lambda acc, i: F.when(acc["c"] > u, acc).otherwise(F.struct((acc["p"] * mean / i).alias("p"), (acc["c"] + acc["p"] * mean / i).alias("c"), i.alias("n")))
    return F.aggregate(F.sequence(F.lit(1), far), start, step, lambda acc: acc["n"])


def log_normal(u: Column, v: Column, median: Column, sigma: Column) -> Column:
    """A log-normal number from two uniform draws."""
    return median * F.exp(sigma * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v))


def in_burst(second: Column, every_s: int, length_s: int) -> Column:
    """Whether a second lies in a burst: the first `length_s` of each `every_s`; never where either is 0."""
    return (F.pmod(second, F.lit(every_s)) < length_s) if every_s > 0 and length_s > 0 else F.lit(False)


def visits(lots: DataFrame, start_us: int, minutes: int, seed: int = 1, burst_every_s: int = 0, burst_s: int = 0, burst_factor: float = 3.0, least_stay_s: float = 60) -> DataFrame:
    """Visits of slots: (`lot_id`, `slot`, `visit`, `arrives_us`, `leaves_us`, `cut_short`).

    Arrivals of a lot's minute are a Poisson number whose mean keeps the lot at its curve (capacity times
    demand over mean stay, more in bursts); each takes a drawn slot at a drawn instant and stays for a
    log-normal time. A slot's scheduled departure only counts while its visit is the current one: where
    the next visit comes first, the car before it left a second earlier and its own departure is void.
    `lots` has `lot_id`, `personality` and `capacity`.
    """
    m = lots.select("lot_id", "personality", "capacity").withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))))
    ts = F.lit(start_us) + F.col("minute").cast("bigint") * 60_000_000
    m = m.withColumns({"at": ts, "hour": F.pmod(ts, F.lit(86_400_000_000)) / 3.6e9, "weekend": F.weekday(F.timestamp_micros(ts)) >= 5})
    m = demand.target(m, "personality", "weekend", "hour").filter("target is not null")
    busy = F.when(in_burst(F.col("minute") * 60, burst_every_s, burst_s), burst_factor).otherwise(1.0)
    mean = F.col("capacity") * F.col("target") * 60 / demand.mean_stay(F.col("personality")) * busy
    m = m.withColumns({"_mean": mean, "_u": draw(seed, "lot_id", "minute", F.lit("n"))}).filter("_u >= exp(-_mean)")  # the others have no arrival
    m = m.repartition("lot_id", "minute").withColumn("n", poisson(F.col("_u"), F.col("_mean")))
    x = m.withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
    one = lambda what: draw(seed, "lot_id", "minute", "k", F.lit(what))
    stay = F.greatest(F.lit(float(least_stay_s)), log_normal(one("u"), one("v"), demand.median_stay(F.col("personality")), demand.sigma_stay(F.col("personality"))))
    x = x.select(
        "lot_id", F.floor(one("slot") * F.col("capacity")).cast("int").alias("slot"), (F.col("at") + F.floor(one("at") * 60) * 1_000_000).alias("arrives_us"), F.floor(stay).alias("stay_s"),
        F.concat_ws("-", "minute", "k").alias("visit"),
    )
    x = x.withColumn("next", F.lead("arrives_us").over(Window.partitionBy("lot_id", "slot").orderBy("arrives_us", "visit")))  # visits of one slot: few
    leaves = F.col("arrives_us") + F.col("stay_s") * 1_000_000
    void = F.coalesce(F.col("next") <= leaves, F.lit(False))
    left = F.when(void, F.greatest(F.col("arrives_us"), F.col("next") - 1_000_000)).otherwise(leaves)
    return x.select("lot_id", "slot", "visit", "arrives_us", left.alias("leaves_us"), void.alias("cut_short"))


def visit_events(v: DataFrame, start_us: int, every_us: int = 60_000_000, until_us: int | None = None) -> DataFrame:
    """Reports of visits, OCCUPIED at their arrival and FREE when they leave, and a heartbeat of every visited slot each `every_us` up to `until_us`."""
    sid = F.format_string("A-%03d", F.col("slot") + 1)
    event = lambda kind, status, ts, tok: v.select("lot_id", sid.alias("slot_id"), F.concat(F.lit("S-"), sid).alias("sensor_id"), F.lit(kind).alias("event_type"), F.lit(status).cast("string").alias("status"), tok.alias("vehicle_token"), F.timestamp_micros(ts).alias("event_ts"))
    none = F.lit(None).cast("string")
    out = event("OCCUPANCY", "OCCUPIED", F.col("arrives_us"), token(F.col("lot_id"), sid, F.col("visit"))).unionByName(event("OCCUPANCY", "FREE", F.col("leaves_us"), none).filter("event_ts is not null"))
    if until_us is None:
        return out
    beats = v.select("lot_id", "slot").distinct().withColumn("at", F.explode(F.sequence(F.lit(start_us), F.lit(until_us - 1), F.lit(every_us))))
    beats = beats.select("lot_id", sid.alias("slot_id"), F.concat(F.lit("S-"), sid).alias("sensor_id"), F.lit("HEARTBEAT").alias("event_type"), none.alias("status"), none.alias("vehicle_token"), F.timestamp_micros("at").alias("event_ts"))
    return out.unionByName(beats)


def in_order_of_release(log: DataFrame) -> DataFrame:
    """A log with `delay_s` (see `with_faults`) and `event_ts` in the order its rows are sent: event time plus delay, then position."""
    return log.withColumn("released_at", F.timestamp_micros(F.unix_micros("event_ts") + F.floor(F.col("delay_s") * 1e6).cast("bigint"))).orderBy("released_at", "partition", "offset")


def token(*parts: Column, salt: str = "tidelot") -> Column:
    """A salted vehicle token: 16 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), *parts), 256), 1, 16)


def synthetic_events(spark: SparkSession, lots: DataFrame, start_us: int, minutes: int, seed: int = 1) -> DataFrame:
    """A report per change of a slot, minute by minute: a slot is taken while its own draw is below its lot's demand.

    `lots` has `lot_id`, `personality` and `capacity`. Rows: lot_id, slot_id, sensor_id, event_type, status, vehicle_token, event_ts.
    """
    grid = lots.select("lot_id", "personality", F.explode(F.sequence(F.lit(1), "capacity")).alias("slot"))
    grid = grid.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(minutes))))
    ts = F.lit(start_us) + F.col("minute").cast("bigint") * 60_000_000
    hour = F.pmod(ts, F.lit(86_400_000_000)) / 3.6e9
    weekend = F.weekday(F.timestamp_micros(ts)) >= 5
    x = demand.target(grid.withColumns({"ts": ts, "hour": hour, "weekend": weekend}), "personality", "weekend", "hour")
    x = x.withColumn("taken", draw(seed, F.col("lot_id"), F.col("slot")) < F.col("target"))
    w = Window.partitionBy("lot_id", "slot").orderBy("minute")
    x = x.withColumn("was", F.lag("taken").over(w)).filter(F.col("was").isNull() | (F.col("was") != F.col("taken")))
    jitter = F.floor(draw(seed + 1, F.col("lot_id"), F.col("slot"), F.col("minute")) * 60e6)
    sid = F.format_string("A-%03d", F.col("slot"))
    return x.select(
        "lot_id", sid.alias("slot_id"), F.concat(F.lit("S-"), sid).alias("sensor_id"), F.lit("OCCUPANCY").alias("event_type"), F.when(F.col("taken"), "OCCUPIED").otherwise("FREE").alias("status"),
        F.when(F.col("taken"), token(F.col("lot_id"), sid, F.col("minute").cast("string"))).alias("vehicle_token"), F.timestamp_micros(F.col("ts") + jitter).alias("event_ts"),
    )


def load(spark: SparkSession, rate: int, lots: int = 12, slots: int = 200, streaming: bool = True, seconds: int = 1) -> DataFrame:
    """Events at an exact rate, 30 % reports and 70 % heartbeats: a stream, or `seconds` of it as a table."""
    if streaming:
        base = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("i"), F.col("timestamp").alias("event_ts"))
    else:
        base = spark.range(rate * seconds).select(F.col("id").alias("i"), F.timestamp_micros(F.lit(0) + F.floor(F.col("id") * 1_000_000 / rate)).alias("event_ts"))
    lot, slot = F.pmod("i", F.lit(lots)), F.pmod(F.floor(F.col("i") / lots), F.lit(slots)) + 1
    report = F.pmod("i", F.lit(10)) < 3
    taken = report & (F.pmod(F.floor(F.col("i") / (lots * slots)), F.lit(2)) == 0)
    sid = F.format_string("A-%03d", slot)
    return base.select(
        F.format_string("load-%d", F.col("i")).alias("event_id"), F.when(report, "OCCUPANCY").otherwise("HEARTBEAT").alias("event_type"), F.concat(F.lit("S-"), sid).alias("sensor_id"),
        F.format_string("LOT-%02d", lot + 1).alias("lot_id"), sid.alias("slot_id"), F.when(report, F.when(taken, "OCCUPIED").otherwise("FREE")).alias("status"),
        F.when(taken, token(F.col("i").cast("string"))).alias("vehicle_token"), "event_ts", F.col("event_ts").alias("ingest_ts"),
    )


def without_sensors(events: DataFrame, specs: list[str], after_us: int = 0) -> DataFrame:
    """Events of a log from which some sensors fall silent at `after_us`: each of `specs` is a sensor, or a lot and its sensor parted by a colon."""
    gone = F.lit(False)
    for spec in specs:
        lot, _, sensor = spec.rpartition(":")
        c = F.col("sensor_id") == sensor
        gone = gone | (c & (F.col("lot_id") == lot) if lot else c)
    return events.filter(~F.coalesce(gone & (F.unix_micros("event_ts") >= after_us), F.lit(False)))


def with_faults(log: DataFrame, late_pct: float = 0, duplicate_pct: float = 0, malformed_pct: float = 0, dropped_sensors: list[str] = (), seed: int = 3) -> DataFrame:
    """A log of encoded events (`key`, `value`, `partition`, `offset`, `sensor_id`) with faults; `fault` names what was done to a row.

    Dropped sensors fall silent, late rows arrive (`delay_s`) after 15 to 600 s, duplicates are the same bytes once more,
    malformed rows are surplus messages broken in one of five ways.
    """
    chance = lambda k: draw(seed + k, F.col("partition"), F.col("offset")) * 100
    kept = log.filter(~F.col("sensor_id").isin(list(dropped_sensors))) if dropped_sensors else log
    low, high = LATE_RANGE_S
    late = chance(0) < late_pct
    base = kept.select("*", F.when(late, low + draw(seed + 9, F.col("partition"), F.col("offset")) * (high - low)).otherwise(0.0).alias("delay_s"), F.when(late, "late").alias("fault"))
    twice = kept.filter(chance(1) < duplicate_pct).select("*", F.lit(0.0).alias("delay_s"), F.lit("duplicate").alias("fault"))
    kind = F.floor(draw(seed + 5, "partition", "offset") * len(BREAKAGES))
    text = F.col("value").cast("string")
    ways = [
        F.substring(text, 1, 40), F.replace(text, F.lit('"lot_id"'), F.lit('"lot"')), F.regexp_replace(text, '"status":("[A-Z]+"|null)', '"status":"BROKEN"'),
        F.regexp_replace(text, '("event_ts":"[^"Z+]+)(Z|[+-][0-9:]+)"', '$1"'), F.regexp_replace(F.regexp_replace(text, '"vehicle_token":"[^"]*"', '"vehicle_token":null'), '"status":("[A-Z]+"|null)', '"status":"OCCUPIED"'),
    ]
    bad = ways[-1]
    for i in range(len(ways) - 2, -1, -1):
        bad = F.when(kind == i, ways[i]).otherwise(bad)
    broken = kept.filter(chance(2) < malformed_pct).withColumn("value", bad.cast("binary")).select("*", F.lit(0.0).alias("delay_s"), F.lit("malformed").alias("fault"))
    return base.unionByName(twice).unionByName(broken)
