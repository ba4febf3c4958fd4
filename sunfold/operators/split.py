"""Splits by time, expanding-window folds, sliding windows and supervised sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, numbered, windowed


def _cuts(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Ends of train and validation: products in double, cut to whole rows, as floats give them."""
    return F.floor(n * F.lit(float(train))), F.floor(n * F.lit(float(train) + float(val)))


def split_temporal(df: DataFrame, train: float = 0.7, val: float = 0.2, gap_hours: float = 0, by: str | None = None, order: Sequence[str] = ("ts", "row_id")) -> DataFrame:
    """df with split: train, val or test by position in time, over all rows or within each `by`. With a gap, that many
    hours' worth of rows (by mean density) are left out before val and again before test."""
    rows = numbered(df.withColumn("__by", F.col(by) if by else F.lit("")), "__by", order, name="__rn")
    facts = df.groupBy((F.col(by) if by else F.lit("")).alias("__of")).agg(F.count("*").alias("__n"), F.min("ts").alias("__lo"), F.max("ts").alias("__hi"))
    rows = rows.join(F.broadcast(facts) if by is None else facts, F.col("__by").eqNullSafe(F.col("__of")))
    a, b = _cuts(F.col("__n"), train, val)
    i = F.col("__rn")
    if gap_hours:
        span = (F.unix_micros(F.col("__hi").cast("timestamp")) - F.unix_micros(F.col("__lo").cast("timestamp"))) / 1e6
        gap = F.coalesce(F.floor(F.try_divide(F.lit(gap_hours * 3600.0), span / F.col("__n"))), F.lit(0))
        split = F.when(i < a, "train").when((i >= a + gap) & (i < b), "val").when(i >= b + gap, "test")
    else:
        split = F.when(i < a, "train").when(i < b, "val").otherwise("test")
    return rows.withColumn("split", split).filter("split is not null").select(*df.columns, "split")


def split_statistics(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(split, column, n, mean, std, min, max)."""
    cells = split.select("split", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["split"], list(columns), "column", "x")
    return cells.groupBy("split", "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def split_ranges(split: DataFrame) -> DataFrame:
    """(split, n, share, first, last, hours)."""
    got = split.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    hours = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 3.6e9
    return got.select("split", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), "first", "last", hours.alias("hours"))


def validate_split(split: DataFrame, train: float = 0.7, tolerance: float = 0.05) -> DataFrame:
    """One row: empty (a split has no rows), overlap (a split starts before another ends), ratio_ok."""
    names = ("train", "val", "test")
    one = split.groupBy().pivot("split", list(names)).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    n = sum((F.coalesce(f"{s}_n", F.lit(0)) for s in names), F.lit(0))
    empty = F.lit(False)
    for s in names:
        empty = empty | F.coalesce(F.col(f"{s}_n") == 0, F.lit(True))
    overlap = F.coalesce(F.col("train_hi") >= F.col("val_lo"), F.lit(False)) | F.coalesce(F.col("val_hi") >= F.col("test_lo"), F.lit(False))
    return one.select(empty.alias("empty"), overlap.alias("overlap"), F.coalesce(F.abs(F.try_divide(F.coalesce("train_n", F.lit(0)), n) - train) <= tolerance, F.lit(False)).alias("ratio_ok"))


def fold_bounds(df: DataFrame, folds: Sequence[tuple[int, int, int]], time: str = "ts") -> DataFrame:
    """(fold, split, low, high, closed) from months of train, val and test for each fold, from the first time on. A row for each fold and split."""
    start = df.agg(F.min(time).alias("start"))
    rows = []
    for i, (a, b, c) in enumerate(folds):
        for s, lo, hi in (("train", 0, a), ("val", a, a + b), ("test", a + b, a + b + c)):
            rows.append(F.struct(F.lit(i).alias("fold"), F.lit(s).alias("split"), F.lit(lo).alias("a"), F.lit(hi).alias("b"), F.lit(i == len(folds) - 1 and s == "test").alias("closed")))
    out = start.select("start", F.explode(F.array(*rows)).alias("f")).select("start", "f.*")
    at = lambda m: F.expr(f"start + make_ym_interval(0, {m})")
    return out.select("fold", "split", at("a").alias("low"), at("b").alias("high"), "closed")


def walk_forward(df: DataFrame, folds: Sequence[tuple[int, int, int]], time: str = "ts") -> DataFrame:
    """df with fold and split, a row for each fold that it is in: half-open ranges, the last test closed. The bounds, a few rows, go to every task."""
    b = F.broadcast(fold_bounds(df, folds, time))
    t = df[time]
    return df.join(b, (t >= b["low"]) & ((t < b["high"]) | (b["closed"] & (t == b["high"])))).drop("low", "high", "closed")


def folds_overlap(folded: DataFrame, time: str = "ts") -> DataFrame:
    """(fold, ordered): within a fold train ends before val starts, and val before test."""
    one = folded.groupBy("fold").pivot("split", ["train", "val", "test"]).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    ordered = F.coalesce(F.col("train_hi") < F.col("val_lo"), F.lit(True)) & F.coalesce(F.col("val_hi") < F.col("test_lo"), F.lit(True))
    return one.select("fold", ordered.alias("ordered"))


def sliding_windows(df: DataFrame, size: int, stride: int = 1, columns: Sequence[str] = ("power",), series: str = SERIES) -> DataFrame:
    """(series, window, rows array of struct): runs of `size` rows that start at every `stride`-th row; none for a series that is shorter."""
    rows = windowed(df, lambda w: {"rows": F.collect_list(F.struct("rn", *columns)).over(w.rowsBetween(0, size - 1))}, 0, size - 1)
    return rows.filter((F.size("rows") == size) & (F.col("rn") % stride == 0)).select(series, F.expr(f"rn div {stride}").alias("window"), "rows")


def sequences(df: DataFrame, length: int = 24, features: Sequence[str] = ("power",), target: str = "power", horizon: int = 0, series: str = SERIES) -> DataFrame:
    """df's keys with x (array of `length` feature arrays, the last at the row) and y, the target `horizon` rows on."""
    def columns(w):
        vector = F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features))
        return {"x": F.collect_list(vector).over(w.rowsBetween(-(length - 1), 0)), "y": F.lead(target, horizon).over(w) if horizon else F.col(target)}

    rows = windowed(df, columns, length - 1, horizon)
    return rows.filter((F.size("x") == length) & F.col("y").isNotNull()).select(series, "ts", "row_id", "rn", "x", "y")


def merge_average(df: DataFrame, columns: Sequence[str], time: str = "ts") -> DataFrame:
    """(time, columns): the mean over all stations at each time."""
    return df.groupBy(time).agg(*(F.avg(c).alias(c) for c in columns))


def merge_concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
