"""Scaling learnt on one frame and applied to others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunfold.operators.quantiles import quantiles

METHODS = ("minmax", "standard", "robust", "maxabs")


def fit(df: DataFrame, columns: Sequence[str], method: str = "minmax") -> dict[str, tuple[float, float]]:
    """For each column what to subtract and what to divide by; a row for each to the driver. Null and NaN are left out.

    minmax: minimum and range (None for a constant column). standard: mean, sample deviation. robust: median, interquartile
    range. maxabs: 0, greatest absolute value. A spread of 0 or none is 1, but for minmax."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    known = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    if method == "robust":
        cells = known.unpivot([], list(columns), "column", "x")
        got = {c: (q[1], None if q[0] is None else q[2] - q[0]) for c, q in quantiles(cells, "x", (0.25, 0.5, 0.75), ["column"]).collect()}
    else:
        aggs = []
        for c in columns:
            x = F.col(c)
            pair = {"minmax": (F.min(x), F.max(x) - F.min(x)), "standard": (F.avg(x), F.stddev_samp(x)), "maxabs": (F.lit(0.0), F.max(F.abs(x)))}[method]
            aggs.append(F.struct(*(v.alias(n) for v, n in zip(pair, ("a", "b"), strict=True))).alias(c))
        row = known.agg(*aggs).first()
        got = {c: (row[c]["a"], row[c]["b"]) for c in columns}
    none = None if method == "minmax" else 1.0
    return {c: (a, b or none) for c, (a, b) in ((c, got.get(c, (None, None))) for c in columns)}


def _each(df: DataFrame, params: Mapping[str, tuple], one) -> DataFrame:
    return df.withColumns({c: one(F.col(c).cast("double"), *p) for c, p in params.items()})


def apply(df: DataFrame, params: Mapping[str, tuple], method: str = "minmax", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """df scaled, without clipping; a constant column becomes the middle of the range."""

    def one(x: Column, a, b) -> Column:
        if method == "minmax":
            return F.when(x.isNotNull(), F.lit((low + high) / 2)) if b is None else (x - a) / b * (high - low) + low
        return x if a is None else (x - a) / b

    return _each(df, params, one)


def invert(df: DataFrame, params: Mapping[str, tuple], method: str = "minmax", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Undoes apply; a constant column gets its value back."""

    def one(x: Column, a, b) -> Column:
        if method == "minmax":
            return F.when(x.isNotNull(), F.lit(a)) if b is None else (x - low) / (high - low) * b + a
        return x if a is None else x * b + a

    return _each(df, params, one)
