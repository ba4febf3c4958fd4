"""Data quality: integrity, outliers and their handling, validation by rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, windowed
from sunfold.operators.quantiles import quantiles
from sunfold.runtime import cut
from sunfold.schema import ERROR_MARKERS, MEASURES, PHYSICAL_RANGES, VALID_RANGES


def _long(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(carry, column, x): a row for each cell."""
    return df.select(*carry, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(carry), list(columns), "column", "x")


def null_markers(df: DataFrame, columns: Sequence[str] = MEASURES, markers: Sequence[float] = ERROR_MARKERS) -> DataFrame:
    """Error markers and NaN become null."""
    return df.withColumns({c: F.when(~(F.col(c).isin(*markers) | F.isnan(c)), F.col(c)) for c in columns})


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within bounds; null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def finite_or_zero(x: Column) -> Column:
    """x as float; null, NaN and infinities are 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).cast("float")


def null_ratios(df: DataFrame, columns: Sequence[str] = MEASURES, warn: float = 0.3) -> DataFrame:
    """(column, n, nulls, ratio, warning) in one pass."""
    cells = _long(df, columns)
    nulls = F.count_if(F.col("x").isNull())
    return cells.groupBy("column").agg(F.count("*").alias("n"), nulls.alias("nulls"), (nulls / F.count("*")).alias("ratio"), (nulls / F.count("*") > warn).alias("warning"))


def describe(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """(column, n, mean, std (sample), min, q25, median, q75, max), exact, nulls left out."""
    cells = _long(df, columns)
    out = cells.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.join(F.broadcast(quantiles(cells, "x", (0.25, 0.5, 0.75), ["column"])), "column")
    return out.select("column", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


def integrity_report(df: DataFrame, columns: Sequence[str] = MEASURES, ranges: Mapping[str, tuple[float, float]] = PHYSICAL_RANGES) -> DataFrame:
    """A row for each column: n, nulls, markers, out_of_range, mean, min, max."""
    cells = _long(df, columns)
    out = _outside("x", ranges)
    return cells.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if(_marked("x")).alias("markers"), F.count_if(out).alias("out_of_range"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))


def _marked(x: str) -> Column:
    return F.coalesce(F.col(x).isin(*ERROR_MARKERS), F.lit(False))


def _outside(x: str, ranges: Mapping[str, tuple[float, float]]) -> Column:
    """Outside the range of the row's column."""
    out = F.lit(False)
    for c, (lo, hi) in ranges.items():
        out = F.when(F.col("column") == c, (F.col(x) < lo) | (F.col(x) > hi)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def time_gaps(df: DataFrame, minutes: int = 15, series: str = SERIES) -> DataFrame:
    """(series, steps, irregular, shortest, longest, regular): steps between rows that are not `minutes` long; seconds."""
    step = lambda w: {"step": (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6}
    rows = windowed(df, step, 1)
    return rows.groupBy(series).agg(F.count("step").alias("steps"), F.count_if(F.col("step") != minutes * 60.0).alias("irregular"), F.min("step").alias("shortest"), F.max("step").alias("longest"), (F.min("step") == F.max("step")).alias("regular"))


def frequency(df: DataFrame, series: str = SERIES) -> DataFrame:
    """(series, seconds, share): the most frequent step between rows, to the millisecond; of ties the shortest."""
    step = lambda w: {"step": (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6}
    steps = windowed(df, step, 1).filter("step is not null").withColumn("step", F.round("step", 3))
    counts = steps.groupBy(series, "step").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("step", "n"), F.struct("n", -F.col("step")))
    return counts.groupBy(series).agg(best.alias("b"), F.sum("n").alias("all")).select(series, F.col("b.step").alias("seconds"), (F.col("b.n") / F.col("all")).alias("share"))


def physical_outliers(df: DataFrame, columns: Sequence[str] = MEASURES, ranges: Mapping[str, tuple[float, float]] = PHYSICAL_RANGES) -> DataFrame:
    """(column, outliers, markers, out_of_range): a marker counts as such, whatever the range."""
    cells = _long(df, columns)
    marked, outside = _marked("x"), _outside("x", ranges)
    return cells.groupBy("column").agg(F.count_if(marked | outside).alias("outliers"), F.count_if(marked).alias("markers"), F.count_if(outside & ~marked).alias("out_of_range"))


def bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """(column, low, high): quartiles and `threshold` (1.5) interquartile ranges, or mean and `threshold` (3) sample deviations. Without spread nothing is outside."""
    cells = _long(df, columns)
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        got = quantiles(cells, "x", (0.25, 0.75), ["column"])
        wide = (F.col("q")[1] - F.col("q")[0]) * k
        return got.select("column", (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))
    if method == "zscore":
        k = 3.0 if threshold is None else threshold
        got = cells.groupBy("column").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")))
        return got.select("column", (F.col("m") - F.col("s") * k).alias("low"), (F.col("m") + F.col("s") * k).alias("high"))
    raise ValueError(f"unknown method {method}")


def _flagged(df: DataFrame, columns: Sequence[str], method: str, threshold: float | None, carry: Sequence[str]) -> DataFrame:
    """Cells with low, high and out. The table of bounds has a row for each column, and is made once, whatever reads the cells."""
    cells = _long(df, columns, carry).join(F.broadcast(cut(bounds(df, columns, method, threshold))), "column")
    return cells.withColumn("out", F.coalesce((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.lit(False)))


def outlier_counts(df: DataFrame, columns: Sequence[str] = MEASURES, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """(column, low, high, outliers)."""
    return _flagged(df, columns, method, threshold, ()).groupBy("column", "low", "high").agg(F.count_if("out").alias("outliers"))


def extreme_rows(df: DataFrame, columns: Sequence[str] = MEASURES, k: int = 3, key: str = "row_id") -> DataFrame:
    """(column, side, place, key, x): the k least and the k greatest values of each column; ties by key.

    A first choice in each of 64 groups of rows leaves few rows for the second."""
    cells = _long(df, columns, (key,)).filter("x is not null")
    out = None
    for side, order in (("low", F.asc("x")), ("high", F.desc("x"))):
        some = cells.withColumn("g", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("column", "g").orderBy(order, key))).filter(F.col("r") <= k)
        best = some.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(order, key))).filter(F.col("place") <= k)
        best = best.select("column", F.lit(side).alias("side"), F.col("place").cast("long").alias("place"), key, "x")
        out = best if out is None else out.unionAll(best)
    return out


def handle_outliers(df: DataFrame, columns: Sequence[str], how: str = "clip", method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """df with the outliers of `columns` clipped to the bounds, removed (null), or replaced by the mean or median of the others."""
    if how not in ("clip", "remove", "replace_mean", "replace_median"):
        raise ValueError(f"unknown handling {how}")
    flagged = _flagged(df, columns, method, threshold, ()).withColumn("inner", F.when(~F.col("out"), F.col("x")))
    facts = flagged.groupBy("column", "low", "high").agg(F.avg("inner").alias("mean"))
    middle = quantiles(flagged, "inner", (0.5,), ["column"]).select("column", F.col("q")[0].alias("median")) if how == "replace_median" else None
    facts = facts.withColumn("median", F.lit(None).cast("double")) if middle is None else facts.join(F.broadcast(middle), "column")
    row = facts.groupBy().pivot("column", list(columns)).agg(*(F.first(x).alias(x) for x in ("low", "high", "mean", "median")))  # one row
    out = df.join(F.broadcast(row), F.lit(True))

    def handled(c: str) -> Column:
        x, lo, hi = F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high")
        outside = F.coalesce((x < lo) | (x > hi), F.lit(False))
        new = {"clip": F.when(x < lo, lo).otherwise(hi), "remove": F.lit(None), "replace_mean": F.col(f"{c}_mean"), "replace_median": F.col(f"{c}_median")}[how]
        return F.when(outside, new).otherwise(x)

    return out.select(*(handled(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def validate(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = VALID_RANGES) -> DataFrame:
    """(column, low, high, violations, least, greatest, passed) for each rule; nulls pass."""
    cells = _long(df, list(ranges))
    bad = _outside("x", ranges)
    low = F.lit(None).cast("double")
    high = low
    for c, (lo, hi) in ranges.items():
        low, high = F.when(F.col("column") == c, F.lit(lo)).otherwise(low), F.when(F.col("column") == c, F.lit(hi)).otherwise(high)
    got = cells.groupBy("column").agg(F.count_if(bad).alias("violations"), F.min(F.when(bad, F.col("x"))).alias("least"), F.max(F.when(bad, F.col("x"))).alias("greatest"))
    return got.select("column", low.alias("low"), high.alias("high"), "violations", "least", "greatest", (F.col("violations") == 0).alias("passed"))
