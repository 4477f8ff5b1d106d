"""Statistics of a partitioned log and of metric samples: depth, lag, rates, counters, histogram quantiles, layout changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelot.functions.numbers import nan_to_null
from tidelot.functions.timing import HOUR_US, cell_of
from tidelot.operators import scans


def offset_ranges(log: DataFrame) -> DataFrame:
    """(`partition`, `low`, `high`, `depth`, `n`) of a log with `partition` and `offset`; `high` is the next offset to come."""
    x = log.groupBy("partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"), F.count(F.lit(1)).alias("n"))
    return x.withColumn("depth", F.col("high") - F.col("low"))


def lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """(`group`, `partition`, `lag`): what a group has still to read of each partition it lists; a null commit starts at the lowest offset."""
    x = committed.join(ends.select("partition", "low", "high"), "partition")
    return x.select("group", "partition", F.greatest(F.lit(0), F.col("high") - F.coalesce("committed", "low")).alias("lag"))


def with_owner(lags: DataFrame, owners: DataFrame) -> DataFrame:
    """Lags with the member of the group that owns the partition (`group`, `partition`, `owner`); null where none does."""
    return lags.join(owners.select("group", "partition", "owner"), ["group", "partition"], "left")


def sum_by(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """(`by`, `total`, `n`): the sum of a metric over all series of a group and how many series there are; values that are no numbers count as missing."""
    known = nan_to_null(F.col(value).cast("double"))
    return samples.groupBy(*by).agg(F.sum(known).alias("total"), F.count(known).alias("n"))


def up(samples: DataFrame, target: str, at_us: str, within_us: int) -> DataFrame:
    """(`target`, `up`): whether each target was heard within `within_us` of the newest sample of all."""
    last = samples.filter(F.col(at_us).isNotNull()).groupBy(target).agg(F.max(at_us).alias("last"))
    newest = last.agg(F.max("last")).scalar()
    return last.select(target, (newest - F.col("last") <= within_us).alias("up"))


def rates(samples: DataFrame, key: str, at_us: str, value: str) -> DataFrame:
    """Change per second of a growing value between successive samples of a key, never negative; null for the first."""
    w = Window.partitionBy(key).orderBy(at_us)  # samples of a poller: bounded by time over poll interval
    seconds = (F.col(at_us) - F.lag(at_us).over(w)) / 1e6
    change = (F.col(value) - F.lag(value).over(w)) / seconds
    return samples.withColumn("rate", F.when(change < 0, 0.0).otherwise(change))


def increases(samples: DataFrame, key: str, at_us: str, value: str, shard_us: int = HOUR_US) -> DataFrame:
    """(`key`, `increase`) of a counter that starts again at 0 when its process does; `at_us` is unique in a key. Scanned by time shards, however dense the samples."""
    x = samples.select(key, at_us, value).withColumn("_shard", cell_of(f"`{at_us}`", shard_us))
    x = scans.scan(x, [key], "_shard", [at_us], lags={"_before": value})
    before = F.col("_before")
    step = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return x.withColumn("_step", step).groupBy(key).agg(F.sum("_step").alias("increase"))


def backlog(ends: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row (`produced`, `consumed`, `backlog`): what was written to a log (`offset_ranges`), what left it by any outcome (`outcome`, `n`), and the rest."""
    produced = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("produced"))
    consumed = outcomes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("consumed"))
    return produced.crossJoin(F.broadcast(consumed)).withColumn("backlog", F.col("produced") - F.col("consumed"))  # a row each


def load_row(samples: DataFrame, by: str, offered: float, saturated_after_s: float) -> DataFrame:
    """What a load test reports per `by`, from samples (`by`, `at_s`, `produced`, `consumed`; totals so far).

    The hold ends when the last event was produced, the drain when all were consumed (null if never).
    Sustained is all that was produced over both, or what was consumed over the hold where the log did not drain.
    """
    first = samples.groupBy(by).agg(F.min("at_s").alias("begin"), F.max("produced").alias("total"))
    x = samples.join(first, by)
    x = x.groupBy(by).agg(
        F.first("begin").alias("begin"), F.first("total").alias("delivered"), F.min(F.when(F.col("produced") == F.col("total"), F.col("at_s"))).alias("held"),
        F.min(F.when((F.col("produced") == F.col("total")) & (F.col("consumed") == F.col("total")), F.col("at_s"))).alias("drained"), F.max(F.col("produced") - F.col("consumed")).alias("peak_backlog"),
        F.min_by(F.col("produced") - F.col("consumed"), F.when(F.col("produced") == F.col("total"), F.col("at_s"))).alias("end_backlog"),
        F.min_by("consumed", F.when(F.col("produced") == F.col("total"), F.col("at_s"))).alias("consumed_in_hold"),
    )
    hold = F.col("held") - F.col("begin")
    sustained = F.when(F.col("drained").isNotNull(), F.col("delivered") / (F.col("drained") - F.col("begin"))).otherwise(F.col("consumed_in_hold") / hold)
    return x.select(
        by, "delivered", (F.col("delivered") / hold).alias("produced_per_s"), sustained.alias("sustained_per_s"), "peak_backlog", "end_backlog", (F.col("drained") - F.col("held")).alias("drain_s"),
        (F.col("end_backlog") > saturated_after_s * offered).alias("saturated"),
    )


def bucket_counts(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(`by`, `le`, `n`): cumulative counts up to each bound; the last bound is infinity. Nulls are not observed."""
    edges = [*bounds, float("inf")]
    x = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(*(F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)))
    pairs = F.array(*(F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)))
    return x.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", "p.n")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(`by`, `value`): quantile by straight lines inside buckets; in the last bucket the highest finite bound; null when empty."""
    w = Window.partitionBy(*by).orderBy("le")
    x = buckets.withColumns({"below": F.coalesce(F.lag("n").over(w), F.lit(0)), "from": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("n").over(Window.partitionBy(*by))})
    rank = F.col("total") * q
    line = F.col("from") + (F.col("le") - F.col("from")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))
    hit = x.filter((F.col("n") >= rank) & (F.col("below") < rank)).select(*by, F.when(F.col("le") == float("inf"), F.col("from")).otherwise(line).alias("value"))
    return buckets.select(*by).distinct().join(hit, by, "left") if by else hit


def layout_changes(polls: DataFrame, group: str, at: str, state: str, signature: str) -> DataFrame:
    """Polls whose layout differs from the poll before, with what happened; the first poll of a group is its baseline."""
    w = Window.partitionBy(group).orderBy(at)
    was, now = F.lag(state).over(w), F.col(state)
    x = polls.withColumns({"_was": was, "_before": F.lag(signature).over(w)})
    x = x.filter(F.col("_was").isNotNull() & ((F.col("_was") != now) | ~F.col(signature).eqNullSafe(F.col("_before"))))
    what = F.when((now == "rebalancing") & (F.col("_was") != "rebalancing"), "rebalance started").when((F.col("_was") == "rebalancing") & (now != "rebalancing"), "rebalance finished").otherwise("assignment changed")
    return x.select(group, at, what.alias("description"))


def newest_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest `n` rows of each group; limited before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
