"""Parameters that move with the errors of batches: thresholds of the weather indices, and weights of their fusion.

A step x -> min(hi, max(lo, x + a)) after another is a step of the same kind, so a long row of steps needs no task of its own: blocks
are put together to one step each, the steps of a series' blocks give where each block starts, and blocks then go through their rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, numbered

RATE = 0.005  # of a threshold's step
CI_LOW, CI_HIGH = (0.15, 0.25), (0.55, 0.65)  # where thresholds may be
WSI_LOW, WSI_HIGH = 1.75, 1.25  # those of the state index, as multiples of them


class Moved(NamedTuple):
    """A value that starts somewhere and moves by a step in each row, within bounds."""

    step: Column
    start: float
    low: float = float("-inf")
    high: float = float("inf")


def composed(first: tuple[float, float, float], then: tuple[float, float, float]) -> tuple[float, float, float]:
    """Two steps (a, lo, hi), one after the other, as one."""
    a, lo, hi = then
    return first[0] + a, min(hi, max(lo, first[1] + a)), min(hi, max(lo, first[2] + a))


def moved(df: DataFrame, values: Mapping[str, Moved], series: str = SERIES, order: Sequence[str] = ("ts", "row_id"), block: int = 8192) -> DataFrame:
    """df with rn and, for each name, the value after the row's step. Steps are taken in `order` within a series; a null step is 0."""
    names = list(values)
    low, high, start = (np.array([getattr(values[n], x) for n in names]) for x in ("low", "high", "start"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    own = numbered(df, series, order).select(F.col(series).alias("key"), "rn", F.expr(f"rn div {block}").alias("block"), *(F.coalesce(values[n].step.cast("double"), F.lit(0.0)).alias(f"a{i}") for i, n in enumerate(names)))
    steps = [f"a{i}" for i in range(len(names))]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        a, lo, hi = np.zeros(len(names)), np.full(len(names), -np.inf), np.full(len(names), np.inf)
        for x in pdf.sort_values("rn")[steps].to_numpy():
            a, lo, hi = a + x, np.clip(lo + x, low, high), np.clip(hi + x, low, high)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "a": [a.tolist()], "lo": [lo.tolist()], "hi": [hi.tolist()]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, out = pdf.sort_values("block"), start.astype(float), []
        for a, lo, hi in zip(pdf["a"], pdf["lo"], pdf["hi"], strict=True):
            out.append(x.tolist())
            x = np.minimum(np.asarray(hi), np.maximum(np.asarray(lo), x + np.asarray(a)))
        return pdf[["key", "block"]].assign(x=out)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        x, out = np.asarray(pdf["x"].iloc[0], float), np.empty((len(pdf), len(names)))
        for i, a in enumerate(pdf[steps].to_numpy()):
            x = out[i] = np.clip(x + a, low, high)
        return pd.DataFrame({"key": pdf["key"], "at": pdf["rn"], **{f"x{i}": out[:, i] for i in range(len(names))}})

    key = f"key {kinds[series]}"
    blocks = own.groupBy("key", "block").applyInPandas(whole, f"{key}, block long, a array<double>, lo array<double>, hi array<double>")
    begun = blocks.groupBy("key").applyInPandas(starts, f"{key}, block long, x array<double>").select(F.col("key").alias("k"), F.col("block").alias("b"), "x")
    met = own.join(begun, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).drop("k", "b")
    found = met.groupBy("key", "block").applyInPandas(go, ", ".join([key, "at long", *(f"x{i} double" for i in range(len(names)))])).select(F.col("key").alias("__k"), F.col("at").alias("__at"), *(F.col(f"x{i}").alias(f"__x{i}") for i in range(len(names))))
    back = numbered(df, series, order).join(found, F.col(series).eqNullSafe(F.col("__k")) & (F.col("rn") == F.col("__at")))
    return back.withColumns({n: F.col(f"__x{i}") for i, n in enumerate(names)}).drop("__k", "__at", *(f"__x{i}" for i in range(len(names))))


def batch_errors(errors: DataFrame, size: int = 100, series: str = SERIES, p: str = "prediction", t: str = "target", state: str = "weather") -> DataFrame:
    """(series, batch, sunny, cloudy, overcast, error): mean absolute errors of each state and of all rows, in batches of `size` rows in order;
    null where a batch has no row of a state."""
    off = F.abs(F.col(p) - F.col(t))
    rows = numbered(errors.filter(off.isNotNull()), series).withColumn("batch", F.expr(f"rn div {size}"))
    return rows.groupBy(series, "batch").agg(*(F.avg(F.when(F.col(state) == i, off)).alias(n) for i, n in enumerate(("sunny", "cloudy", "overcast"))), F.avg(off).alias("error"))


def _sign(a: str, b: str) -> Column:
    return F.signum(F.coalesce(F.col(a), F.lit(0.0)) - F.coalesce(F.col(b), F.lit(0.0)))


def adapted_thresholds(batches: DataFrame, series: str = SERIES, order: Sequence[str] = ("batch",), rate: float = RATE, low: float = 0.2, high: float = 0.6, **how) -> DataFrame:
    """batches with ci_low, ci_high, wsi_low and wsi_high after each batch.

    The lower threshold rises where errors of sunny rows exceed those of cloudy ones and falls where they are less, the upper one
    likewise for cloudy and overcast rows, by `rate`, within bounds; the state index follows. A state without an error has 0."""
    got = moved(batches, {"ci_low": Moved(rate * _sign("sunny", "cloudy"), low, *CI_LOW), "ci_high": Moved(rate * _sign("cloudy", "overcast"), high, *CI_HIGH)}, series, order, **how)
    return got.withColumns({"wsi_low": F.col("ci_low") * WSI_LOW, "wsi_high": F.col("ci_high") * WSI_HIGH}).drop("rn")


def adapted_fusion(batches: DataFrame, series: str = SERIES, order: Sequence[str] = ("batch",), rate: float = 0.01, at: float = 0.1, start: float = 0.3, **how) -> DataFrame:
    """batches with ci_weight and wsi_weight after each: the state index gains `rate` times the error of each batch that errs by more
    than `at`, up to 0.9."""
    step = F.when(F.col("error") > at, rate * F.col("error")).otherwise(0.0)
    got = moved(batches, {"wsi_weight": Moved(step, start, high=0.9)}, series, order, **how)
    return got.withColumn("ci_weight", 1 - F.col("wsi_weight")).drop("rn")
