"""Exact quantiles of groups, without a task for a group's values.

Values are counted by ranges of magnitude first, which tells the range of each rank wanted; only the values of those
ranges are then counted one by one. Both counts are combined before their shuffle, so that neither a large group nor a
frequent value is a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_GREATEST = 1.7976931348623157e308  # of doubles


def magnitude(x: Column, each: int = 1024) -> Column:
    """The number of x's range, rising with x: `each` ranges to a factor of e, by sign; infinities and NaN are in the
    outermost ones."""
    size = F.floor(F.log(F.when(x != 0, F.least(F.abs(x), F.lit(_GREATEST)))) * each) + (1 << 24)  # above 0 for every double
    return F.when(x.isNotNull(), F.coalesce(F.when(x > 0, size).otherwise(-size), F.lit(0)))


def quantiles(df: DataFrame, x: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): for each group, of which there are few, such as columns or classes, the quantiles of x as an array, exact and
    linear between neighbouring values. Nulls are left out; a group of nulls has null quantiles, and without `by` so has an
    empty table. NaN is the greatest value."""
    group = F.struct(*(by or (F.lit(0),)))  # null keys are equal within a struct
    rows = df.select(group.alias("__g"), F.col(x).cast("double").alias("__x")).withColumn("__range", magnitude(F.col("__x")))
    sums = rows.groupBy("__g", "__range").agg(F.count("__x").alias("__n"))
    whole = Window.partitionBy("__g")
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumns({"__from": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__all": F.sum("__n").over(whole)})
    ranks = [s * (F.col("__all") - 1) for s in shares]
    wanted = F.array_distinct(F.array(*(f(r) for r in ranks for f in (F.floor, F.ceil))))
    ranked = placed.withColumn("__rank", F.explode(wanted)).filter("__rank >= __from and __rank < __from + __n")
    ranked = ranked.select("__g", "__range", "__from", "__rank")  # two rows for each share and group
    near = rows.filter("__x is not null").join(F.broadcast(ranked.select("__g", "__range").distinct()), ["__g", "__range"], "left_semi")
    counts = near.groupBy("__g", "__range", "__x").agg(F.count("*").alias("__n"))
    within = Window.partitionBy("__g", "__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    at = F.col("__rank") - F.col("__from") - F.col("__before")
    found = counts.join(F.broadcast(ranked), ["__g", "__range"]).filter((at >= 0) & (at < F.col("__n")))
    found = found.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__of"))
    totals = sums.groupBy("__g").agg(F.sum("__n").alias("__all"))
    if not by:
        totals = totals.groupBy().agg(F.coalesce(F.max("__all"), F.lit(0)).alias("__all")).select(group.alias("__g"), "__all")

    def between(r: Column) -> Column:
        a, b = (F.element_at("__of", f(r)) for f in (F.floor, F.ceil))
        return F.when(F.ceil(r) == F.floor(r), a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b)

    out = totals.join(F.broadcast(found), "__g", "left").withColumn("q", F.array(*map(between, ranks)))
    return out.select(*(F.col("__g")[b].alias(b) for b in by), "q")
