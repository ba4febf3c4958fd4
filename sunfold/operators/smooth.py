"""Smoothing along a series: moving average, Gaussian filter, Savitzky-Golay."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, numbered, windowed


def moving_average(df: DataFrame, column: str, width: int = 5, out: str = "smooth") -> DataFrame:
    """The mean of the `width` rows around each; where fewer are there or one is null, the value itself."""
    back, on = width // 2, (width - 1) // 2

    def columns(w):
        frame = w.rowsBetween(-back, on)
        return {out: F.when(F.count(column).over(frame) == width, F.avg(column).over(frame)).otherwise(F.col(column))}

    return windowed(df, columns, back, on)


def _taps(df: DataFrame, column: str, reach: int, out: str, taps, reflect: bool) -> DataFrame:
    """Weighted sums of the rows within `reach`; beyond a series' ends values are mirrored (the end itself twice), or the sum is null."""
    rows = numbered(df)
    sizes = rows.groupBy(SERIES).agg(F.count("*").alias("__size")).withColumnRenamed(SERIES, "__s")
    rows = rows.join(sizes, F.col(SERIES).eqNullSafe(F.col("__s"))).drop("__s")

    def columns(w):
        near = F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(w.rowsBetween(-reach, reach))
        return {"__near": near}

    wide = windowed(rows, columns, reach, reach)
    n, i = F.col("__size"), F.col("rn")
    first = F.greatest(i - reach, F.lit(0))
    total = F.lit(0.0)
    for k, t in zip(range(-reach, reach + 1), taps, strict=True):
        at = F.pmod(i + k, 2 * n)
        mirrored = F.when(at >= n, 2 * n - 1 - at).otherwise(at)
        place = (mirrored if reflect else i + k) - first
        total = total + F.get("__near", place.cast("int")) * float(t)
    value = F.when((i >= reach) & (i < n - reach), total) if not reflect else total
    return wide.withColumn(out, F.when(F.isnan(value), F.lit(None)).otherwise(value)).drop("__near", "__size")


def gaussian(df: DataFrame, column: str, sigma: float = 1.0, truncate: float = 4.0, out: str = "smooth") -> DataFrame:
    """Gaussian filter; values are mirrored beyond the ends. A null within reach gives null; so do series shorter than the reach, beyond their mirror."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return _taps(df, column, reach, out, [x / sum(raw) for x in raw], True)


def savgol_taps(width: int, order: int, at: int = 0) -> np.ndarray:
    """Weights of a least-squares polynomial over `width` points, taken `at` points off the middle."""
    half = width // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return np.array([float(at) ** p for p in range(order + 1)]) @ np.linalg.pinv(a)


def savgol(df: DataFrame, column: str, width: int = 5, order: int = 2, out: str = "smooth") -> DataFrame:
    """Savitzky-Golay filter of odd width; near the ends the polynomial through the first or last `width` rows is taken.
    A null within reach gives null; series shorter than `width` are left as they are."""
    half = width // 2
    rows = numbered(df)
    sizes = rows.groupBy(SERIES).agg(F.count("*").alias("__size")).withColumnRenamed(SERIES, "__s")
    rows = rows.join(sizes, F.col(SERIES).eqNullSafe(F.col("__s"))).drop("__s")
    near = lambda w: {"__near": F.collect_list(F.struct("rn", F.col(column).cast("double").alias("x"))).over(w.rowsBetween(-(width - 1), width - 1))}
    wide = windowed(rows, near, width - 1, width - 1)
    i, n = F.col("rn"), F.col("__size")
    middle = F.least(F.greatest(i, F.lit(half)), n - 1 - half)
    first = F.col("__near")[0]["rn"]
    value = None
    for off in range(-half, half + 1):
        total = F.lit(0.0)
        for k, t in zip(range(-half, half + 1), savgol_taps(width, order, off), strict=True):
            total = total + F.get("__near", (middle + k - first).cast("int"))["x"] * float(t)
        value = F.when(i - middle == off, total) if value is None else value.when(i - middle == off, total)
    return wide.withColumn(out, F.when(n < width, F.col(column)).otherwise(value)).drop("__near", "__size")
