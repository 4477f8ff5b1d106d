"""Queries of the problems for training data (2, 7, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelot.functions.timing import DAY_US, MINUTE_US, cell_of
from tidelot.llm import distinct, mixing, runs, tokens, truncation
from tidelot.operators import messages
from tidelot.session import broadcast_if_small, materialise, spread, table


SETS = [(), ("day",), ("lot_id",), ("personality",), ("day", "lot_id"), ("day", "personality"), ("lot_id", "personality"), ("day", "lot_id", "personality")]
KEYS = ["day", "lot_id", "personality"]


def _tokens_seen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "parking_events").filter("vehicle_token is not null")
    return e.select("lot_id", "event_ts", messages.canonical_id("vehicle_token", 16).alias("token"))


def _by_day_and_lot(spark: SparkSession, d: str) -> DataFrame:
    return _tokens_seen(spark, d).select(F.date_from_unix_date(cell_of("unix_micros(event_ts)", DAY_US).cast("int")).cast("string").alias("day"), "lot_id", "token")


def _sets(base: DataFrame, kind: DataFrame, rest: list[str]) -> DataFrame:
    """`base` (`day`, `lot_id` and `rest`) once for each grouping set that has all its keys; a lot's personality may be unknown."""
    base = base.join(broadcast_if_small(kind), "lot_id", "left")
    named = lambda s: " and ".join([f"`{k}` is not null" for k in s if k != "personality"] + (["lot_id is not null"] if "personality" in s else [])) or "true"
    as_set = lambda s: F.when(F.expr(named(s)), F.struct(F.lit("+".join(s) or "all").alias("grouping"), *(F.col(k).alias(k) if k in s else F.lit(None).cast("string").alias(k) for k in KEYS)))
    return base.select(*rest, F.explode(F.array_compact(F.array(*map(as_set, SETS)))).alias("g")).select("g.*", *rest)


def _personalities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lot_metadata").filter("lot_id is not null").groupBy("lot_id").agg(F.min("personality").alias("personality"))


def p2_distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Different vehicle tokens per day, lot, personality and each combination, with 95 % bounds; `grouping` names the keys set.

    A row counts in every set whose keys it has: one without `event_ts` has no day, one without `lot_id`
    no lot and no personality. Lots without metadata have a null personality of their own.
    """
    base = materialise(distinct.sketch(_by_day_and_lot(spark, d), ["day", "lot_id"], "token"), "token-sketches")
    each = _sets(base, _personalities(spark, d), ["registers"])
    return distinct.counts(distinct.merge(each, ["grouping", *KEYS])).drop("registers")


def p2_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """Groups of each set, and how many of their exact counts lie within four standard errors of the estimate."""
    exact = _sets(_by_day_and_lot(spark, d).distinct(), _personalities(spark, d), ["token"]).groupBy("grouping", *KEYS).agg(F.count_distinct("token").alias("exact"))
    est = p2_distinct_tokens(spark, d)
    same = F.lit(True)
    for k in ("grouping", *KEYS):
        same = same & exact[k].eqNullSafe(est[k])
    both = est.join(exact, same, "left").select(est["grouping"], "estimate", "relative_error", "exact")
    holds = F.abs(F.col("estimate") - F.col("exact")) <= 4 * F.col("relative_error") * F.col("exact") + 0.5
    return both.groupBy("grouping").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(holds).alias("n_within"))


def p2_beside_windows(spark: SparkSession, d: str, k: int = 1024) -> DataFrame:
    """Each stored window's last estimate beside one made here from the deliveries of that window."""
    w = table(spark, d, "lot_occupancy_5min").filter("lot_id is not null and window_start is not null and emitted_at is not null")
    w = w.groupBy("lot_id", "window_start").agg(F.max(F.struct("closed", "emitted_at", "unique_vehicles_est"))["unique_vehicles_est"].alias("unique_vehicles_est"))
    w = materialise(w.select("lot_id", F.unix_micros("window_start").alias("window_start_us"), "unique_vehicles_est"), "stored-windows")
    start = F.unix_micros("event_ts")
    seen = _tokens_seen(spark, d).filter("lot_id is not null and event_ts is not null").select("lot_id", (start - F.pmod(start, F.lit(5 * MINUTE_US))).alias("window_start_us"), "token")
    seen = seen.join(broadcast_if_small(w.select("lot_id", "window_start_us")), ["lot_id", "window_start_us"], "left_semi")
    mine = distinct.counts(distinct.sketch(seen, ["lot_id", "window_start_us"], "token", k), k).drop("registers")
    both = w.join(mine, ["lot_id", "window_start_us"], "left").fillna(0.0, ["estimate", "ci_low", "ci_high"])
    plausible = F.col("unique_vehicles_est").between(F.col("ci_low") - 1, F.col("ci_high") + 1)
    return both.withColumn("within_bounds", plausible)


def sensor_runs(spark: SparkSession, d: str, mismatch: float = 3.0, penalty: float = 1.0) -> DataFrame:
    m = messages.messages(table(spark, d, "parking_events"), ["lot_id", "sensor_id", "slot_id", "event_type", "status", "event_ts"])
    m = m.filter("slot_id is not null and event_type is not null").withColumn("ts", F.unix_micros("event_ts"))
    return runs.collapse_runs(m, ["lot_id", "sensor_id"], "ts", "kafka_offset", ["slot_id", "event_type", "status"], 20 * MINUTE_US, mismatch, penalty)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two and more; a difference costs more than two borders, so that neighbours in a run agree in every field."""
    return sensor_runs(spark, d).filter("n_events >= 2").select("lot_id", "sensor_id", "start_us", "end_us", "n_events")


def p7_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """All runs when a short deviation (cheaper than two borders) is absorbed, with duration and what the run says."""
    r = sensor_runs(spark, d, mismatch=1.0, penalty=1.5)
    return r.withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def p7_near_cost(spark: SparkSession, d: str) -> DataFrame:
    """Least total cost of each sensor's segmentation (of several with that cost one is chosen), and its events."""
    r = sensor_runs(spark, d, mismatch=1.0, penalty=1.5).groupBy("lot_id", "sensor_id")
    return r.agg(F.sum(F.col("cost") + 1.5).alias("total_cost"), F.sum("n_events").alias("n_events"))


def _texts(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", *cols), "doc_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_texts(spark, d, "text"), "text", ["doc_id"])


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether decoding their ids gives the text back: all of them must."""
    ids = tokens.encode(_texts(spark, d, F.col("text").alias("original")), "original", ["doc_id", "original"])
    back = tokens.decode(ids, "ids", ["doc_id", "original"])
    same = F.col("text") == F.coalesce("original", F.lit(""))
    return back.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n_docs"))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether their tokens' byte offsets run through the text without hole or overlap and the characters reach its end: all must."""
    x = tokens.encode_with_offsets(_texts(spark, d, "text"), "text", ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    empty = F.size("ids") == 0
    joined = F.slice("byte_start", 2, F.greatest(F.size("ids") - 1, F.lit(0))) == F.slice("byte_end", 1, F.greatest(F.size("ids") - 1, F.lit(0)))
    ends = (F.get("byte_start", F.lit(0)) == 0) & (F.element_at("byte_end", -1) == F.octet_length(text)) & (F.element_at("char_end", -1) == F.char_length(text))
    covers = F.when(empty, text == "").otherwise(joined & ends)
    return x.groupBy(covers.alias("covers")).agg(F.count(F.lit(1)).alias("n_docs"))


def _sized(spark: SparkSession, d: str, targets: DataFrame) -> DataFrame:
    docs = spread(table(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", "source", "text"), "doc_id")
    docs = docs.join(broadcast_if_small(targets.select("source").distinct()), "source", "left_semi")
    return materialise(tokens.count_tokens(docs, "text", ["doc_id", "source"]), "document-sizes")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    return mixing.select_mix(_sized(spark, d, targets), targets)


def p9_mix_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents selected and how often each is used."""
    return _mix(spark, d)[0]


def p9_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return _mix(spark, d)[1].drop("tokens_wanted", "longest_doc")


def _kept(report: DataFrame) -> DataFrame:
    fits = F.abs(F.col("tokens_selected") - F.col("tokens_wanted")) <= F.col("longest_doc")
    return report.select("source", "max_repeats", (F.col("tokens_available") > 0).alias("has_records"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"), fits.alias("wanted_fits"))


def p9_rules_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether its cap is kept and its tokens are those wanted, up to one document."""
    return _kept(_mix(spark, d)[1])


def p9_whole_budget(spark: SparkSession, d: str) -> DataFrame:
    """The same for a mix as large as all sources together: small sources are used up to their caps and the others fill the rest."""
    targets = table(spark, d, "mix_targets")
    sized = _sized(spark, d, targets)
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    return _kept(mixing.select_mix(sized, targets, float(total))[1])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_incomplete(table(spark, d, "documents")).filter("incomplete").select("doc_id")


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are not blank and how many of them are incomplete, per source (null is one)."""
    found = truncation.find_incomplete(table(spark, d, "documents"))
    n = F.count(F.lit(1))
    cut = F.count_if("incomplete")
    return found.groupBy("source").agg(n.alias("n_docs"), cut.alias("n_incomplete"), (cut / n).alias("share"))


def p10_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each kind of evidence shows to be incomplete."""
    found = truncation.find_incomplete(table(spark, d, "documents")).filter("incomplete")
    return found.groupBy("evidence").agg(F.count(F.lit(1)).alias("n_docs"))
