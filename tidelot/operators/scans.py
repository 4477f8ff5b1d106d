"""Ordered scans per entity that are shared out over shards of the order.

A window function over an entity puts all its rows into one task. Here rows are scanned inside
(entity, shard) and receive what earlier or later shards contribute from one summary row per
shard. The result equals the plain window function; a busy entity is as many tasks as it has shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan(
    df: DataFrame,
    keys: list[str],
    shard: str,
    order: list[str],
    sums: dict[str, str] | None = None,
    tops: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
) -> DataFrame:
    """Add columns, named by the dictionaries' keys, from their value columns.

    sums: running total up to and with the row. tops: greatest value before the row. lags and leads:
    value of the row before and after. `order` must be total within `keys`, and `shard` must not
    decrease along it. `df` is read twice: give a written table or a plan with a shared exchange.
    """
    sums, tops, lags, leads = sums or {}, tops or {}, lags or {}, leads or {}
    inside = Window.partitionBy(*keys, shard).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, shard).agg(
        *(F.sum(c).alias(f"s_{o}") for o, c in sums.items()),
        *(F.max(c).alias(f"t_{o}") for o, c in tops.items()),
        *(F.max(F.struct(*order, F.col(c).alias("_v")))["_v"].alias(f"l_{o}") for o, c in lags.items()),
        *(F.min(F.struct(*order, F.col(c).alias("_v")))["_v"].alias(f"f_{o}") for o, c in leads.items()),
        F.count(F.lit(1)).alias("_rows"),
    )
    over = Window.partitionBy(*keys).orderBy(shard)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col(shard).alias("_ks"),
        *(F.sum(f"s_{o}").over(earlier).alias(f"s_{o}") for o in sums),
        *(F.max(f"t_{o}").over(earlier).alias(f"t_{o}") for o in tops),
        *(F.lag(f"l_{o}").over(over).alias(f"l_{o}") for o in lags),
        *(F.lead(f"f_{o}").over(over).alias(f"f_{o}") for o in leads),
    )
    rn = F.row_number().over(inside)
    local = df.withColumns(
        {f"_s_{o}": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for o, c in sums.items()}
        | {f"_t_{o}": F.max(c).over(before) for o, c in tops.items()}
        | {f"_l_{o}": F.lag(c).over(inside) for o, c in lags.items()}
        | {f"_f_{o}": F.lead(c).over(inside) for o, c in leads.items()}
        | ({"_first": rn == 1} if lags else {})
        | ({"_last": F.lead(F.lit(1)).over(inside).isNull()} if leads else {})
    )
    on = [F.col(f"_k{i}") == F.col(k) for i, k in enumerate(keys)] + [F.col("_ks") == F.col(shard)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = local.join(carry, cond)
    out = (
        {o: F.coalesce(F.col(f"_s_{o}") + F.col(f"s_{o}"), f"_s_{o}", f"s_{o}") for o in sums}
        | {o: F.greatest(f"_t_{o}", f"t_{o}") for o in tops}
        | {o: F.when(F.col("_first"), F.col(f"l_{o}")).otherwise(F.col(f"_l_{o}")) for o in lags}
        | {o: F.when(F.col("_last"), F.col(f"f_{o}")).otherwise(F.col(f"_f_{o}")) for o in leads}
    )
    return both.select(*df.columns, *(c.alias(o) for o, c in out.items()))
