"""Row order within series, without a task for a whole series.

A window over one series puts it into one task, however long it is. Here rows are numbered in two levels, and windows
with bounded frames run over blocks of consecutive rows that also hold copies of the rows just outside.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES, TIME, ROW = "series_id", "ts", "row_id"


def numbered(df: DataFrame, series: str = SERIES, order: Sequence[str] = (TIME, ROW), days: int = 1, name: str = "rn") -> DataFrame:
    """df with each row's number in its series, from 0. Days of a series are numbered apart and then put in sequence; ties in
    all of `order` are numbered in any order, null times first."""
    day = F.coalesce(F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (86_400_000_000 * days)), F.lit(-(1 << 40))).alias("__day")
    rows = df.withColumn("__day", day)
    sizes = rows.groupBy(series, "__day").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(series).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(series).alias("__s"), F.col("__day").alias("__d"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    local = F.row_number().over(Window.partitionBy(series, "__day").orderBy(*order)) - 1
    rows = rows.withColumn("__local", local).join(first, F.col(series).eqNullSafe(F.col("__s")) & (F.col("__day") == F.col("__d")))
    return rows.withColumn(name, (F.col("__first") + F.col("__local")).cast("long")).drop("__day", "__n", "__s", "__d", "__first", "__local")


def dealt(df: DataFrame, before: int, after: int = 0, series: str = SERIES, order: Sequence[str] = (TIME, ROW), block: int = 8192) -> DataFrame:
    """df with rn and __block, a number of consecutive rows of a series, to which the `before` rows before and the `after` rows after
    it are copied; __own is false of those."""
    if before > block or after > block:
        raise ValueError(f"frames may reach {block} rows at most")
    rows = numbered(df, series, order) if "rn" not in df.columns else df
    own = F.expr(f"rn div {block}")
    place = F.array(
        F.struct(own.alias("block"), F.lit(True).alias("own")),
        F.struct(F.when(F.col("rn") % block >= block - before, own + 1).alias("block"), F.lit(False).alias("own")),
        F.struct(F.when((F.col("rn") % block < after) & (own > 0), own - 1).alias("block"), F.lit(False).alias("own")),
    )
    return rows.withColumn("__to", F.explode(F.filter(place, lambda p: p["block"].isNotNull()))).withColumns({"__block": F.col("__to.block"), "__own": F.col("__to.own")}).drop("__to")


def windowed(df: DataFrame, columns: Callable[[Window], Mapping[str, Column]], before: int, after: int = 0, series: str = SERIES, order: Sequence[str] = (TIME, ROW), block: int = 8192) -> DataFrame:
    """df with columns(w), where w is a window over a series in order, with rn, whose frames reach at most `before` rows
    back and `after` rows on. Rows at a block's ends are copied into its neighbours."""
    w = Window.partitionBy(series, "__block").orderBy("rn")
    return dealt(df, before, after, series, order, block).withColumns(dict(columns(w))).filter("__own").drop("__block", "__own")


def carried(df: DataFrame, value: str, series: str = SERIES, order: Sequence[str] = (TIME, ROW), block: int = 8192) -> DataFrame:
    """df with rn and the nearest non-null `value` on either side: prev_at, prev, next_at, next (row numbers and values),
    at any distance: within blocks, and over the table of the blocks' ends."""
    rows = numbered(df, series, order) if "rn" not in df.columns else df
    rows = rows.withColumn("__block", F.expr(f"rn div {block}"))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("rn").alias("at"), F.col(value).alias("x")))
    ends = rows.groupBy(series, "__block").agg(F.min(known).alias("__lo"), F.max(known).alias("__hi"))
    b, back = (Window.partitionBy(series).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("__block", F.desc("__block")))
    ends = ends.select(
        F.col(series).alias("__s"),
        F.col("__block").alias("__b"),
        F.last("__hi", True).over(b).alias("__before"),
        F.last("__lo", True).over(back).alias("__after"),
    )
    # a frame to the end of a partition is summed anew for each row, so what comes after is found in descending order
    w, down = (Window.partitionBy(series, "__block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("rn", F.desc("rn")))
    rows = rows.withColumns({"__p": F.last(known, True).over(w), "__q": F.last(known, True).over(down)})
    rows = rows.join(ends, F.col(series).eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    p, q = F.coalesce("__p", "__before"), F.coalesce("__q", "__after")
    return rows.withColumns({"prev_at": p["at"], "prev": p["x"], "next_at": q["at"], "next": q["x"]}).drop("__block", "__p", "__q", "__s", "__b", "__before", "__after")
