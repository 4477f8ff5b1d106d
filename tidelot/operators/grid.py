"""Irregular readings onto a regular grid.

Readings are reduced to one row per source and cell before any shuffle of rows, then to one row
per source and time shard that holds the shard's cells (at most shard / cell of them). The last
reading before a shard and the place of the next are propagated by a prefix scan over those
summaries; every shard, those without a reading included, then fills its own cells independently, so
one source with any number of readings or any length of silence is shared out.

Readings with a null key or time are left out. Of equal times in a cell the greatest value is the
cell's last one. A null value is a reading whose value is unknown. Empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelot.functions.timing import DAY_US, cell_of


def to_grid(
    df: DataFrame,
    keys: list[str],
    ts_us: str,
    value: Column,
    cell_us: int,
    shard_us: int = DAY_US,
    within_us: int | None = DAY_US,
) -> DataFrame:
    """(`keys`, `cell_us`, `n`, `value`, `carried_from_us`) for every cell between a source's first and last reading.

    `n` is 0 for a silent cell; its `value` is carried forward from the cell that starts at
    `carried_from_us`. `within_us` limits filling to the stretch between the first and last reading
    of one such period (a UTC day by default); None fills every silence, however long.
    """
    if shard_us % cell_us:
        raise ValueError("shard_us must be a multiple of cell_us")
    if within_us is not None and within_us % shard_us:
        raise ValueError("within_us must be a multiple of shard_us")
    per = shard_us // cell_us
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in [*keys, ts_us]))
    rows = rows.select(*keys, F.col(ts_us).alias("_ts"), value.cast("string").alias("_v"), cell_of(f"`{ts_us}`", cell_us).alias("c"))
    cells = rows.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_ts", "_v")).alias("_last"))
    cells = cells.withColumn("_shard", cell_of("c", per))
    shards = cells.groupBy(*keys, "_shard").agg(F.sort_array(F.collect_list(F.struct("c", "n", F.col("_last._v").alias("v")))).alias("_cells"))
    shards = shards.withColumns({"_first": F.expr("_cells[0].c"), "_lastc": F.element_at("_cells", -1)})
    scope = [*keys] if within_us is None else [*keys, "_period"]
    if within_us is not None:
        shards = shards.withColumn("_period", cell_of("_shard", within_us // shard_us))
    scan = Window.partitionBy(*scope).orderBy("_shard")
    # The prefix scan: what a shard takes over from before it, and whether and where the series goes on.
    shards = shards.withColumns({"_taken": F.lag("_lastc").over(scan), "_next": F.lead("_shard").over(scan)})
    # A stretch: cells from `a` up to `z` that show reading `c`. A shard's readings fill up to the next one or, if the series goes on, its end.
    own = F.expr(f"transform(_cells, (x, i) -> struct(x.c as c, x.n as n, x.v as v, x.c as a, coalesce(get(_cells, i + 1).c, if(_next is null, x.c + 1, (_shard + 1) * {per}L)) as z))")
    lead_in = F.expr(f"if(_taken is null, array(), array(struct(_taken.c as c, _taken.n as n, _taken.v as v, _shard * {per}L as a, _first as z)))")
    heard = shards.select(*keys, F.explode(F.concat(lead_in, own)).alias("x")).select(*keys, "x.*")
    # Shards without a reading are rows of their own and fill themselves wherever they are sent.
    mute = shards.filter(F.col("_next") > F.col("_shard") + 1).select(*keys, F.col("_lastc").alias("x"), F.explode(F.expr("sequence(_shard + 1, _next - 1)")).alias("_shard"))
    mute = mute.repartition(*keys, "_shard").select(*keys, "x.c", "x.n", "x.v", (F.col("_shard") * per).alias("a"), ((F.col("_shard") + 1) * per).alias("z"))
    filled = heard.unionByName(mute).filter("z > a").select(*keys, F.col("c").alias("_from"), "n", "v", F.explode(F.sequence("a", F.col("z") - 1)).alias("cell"))
    silent = F.col("cell") != F.col("_from")
    return filled.select(
        *keys,
        (F.col("cell") * cell_us).alias("cell_us"),
        F.when(silent, F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("n"),
        F.col("v").alias("value"),
        (F.col("_from") * cell_us).alias("carried_from_us"),
    )
