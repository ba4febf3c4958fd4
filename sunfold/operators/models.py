"""A bank of one regression model for each weather state, their ensemble, and rules of training."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfold.sources.sinks import read_params, write_params


def flattened(sequences: DataFrame, x: str = "x", out: str = "features") -> DataFrame:
    """Sequences of feature arrays as one vector each."""
    return sequences.withColumn(out, array_to_vector(F.transform(F.flatten(x), lambda v: v.cast("double"))))


def vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The columns as one vector; nulls are 0."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df.fillna(0.0, list(columns)))


def train_bank(df: DataFrame, states: Sequence[int] = (0, 1, 2), kind: str = "linear", label: str = "y", state: str = "weather", before: Mapping[int, Sequence[Model]] | None = None, **how) -> dict[int, list[Model]]:
    """The models of each state that has rows, whose predictions add up. Each is trained by Spark on all rows of its state.

    before: a bank to go on from. A state's new model learns what its former ones leave, so that with a penalty it starts
    from them and moves only as far as the rows ask; a state without rows keeps its models."""
    make = {"linear": lambda: LinearRegression(labelCol=label, regParam=how.get("penalty", 1e-3), maxIter=how.get("rounds", 50)), "trees": lambda: GBTRegressor(labelCol=label, maxIter=how.get("rounds", 20), maxDepth=how.get("depth", 4), seed=42)}[kind]
    out = {s: list(m) for s, m in (before or {}).items()}
    for s in states:
        rows = df.filter((F.col(state) == s) & F.col(label).isNotNull())
        if not rows.isEmpty():
            rest = _summed(rows, out.get(s, []), "__known").withColumn(label, F.col(label) - F.col("__known")).drop("__known")
            out[s] = [*out.get(s, []), make().fit(rest)]
    return out


def _summed(df: DataFrame, parts: Sequence[Model], keep: str) -> DataFrame:
    """df with the sum of the models' predictions; 0 without models."""
    out, total = df, F.lit(0.0)
    for i, m in enumerate(parts):
        out = m.transform(out).withColumnRenamed("prediction", f"__part{i}")
        total = total + F.col(f"__part{i}")
    return out.withColumn(keep, total).drop(*(f"__part{i}" for i in range(len(parts))))


_CLASSES = {"LinearRegressionModel": LinearRegressionModel, "GBTRegressionModel": GBTRegressionModel}


def save_bank(spark: SparkSession, bank: Mapping[int, Sequence[Model]], folder: str) -> None:
    """The bank's models under folder, and a list of them as JSON."""
    for s, parts in bank.items():
        for i, m in enumerate(parts):
            m.write().overwrite().save(f"{folder}/state={s}/part={i}")
    write_params(spark, {str(s): [type(m).__name__ for m in parts] for s, parts in bank.items()}, f"{folder}/bank")


def load_bank(spark: SparkSession, folder: str) -> dict[int, list[Model]]:
    """A bank that save_bank saved."""
    return {int(s): [_CLASSES[c].load(f"{folder}/state={s}/part={i}") for i, c in enumerate(names)] for s, names in read_params(spark, f"{folder}/bank").items()}


def predict(df: DataFrame, bank: Mapping[int, Sequence[Model]], state: str = "weather", keep: str = "prediction") -> DataFrame:
    """Each row by the model of its state; the first model where a state has none. All models are expressions of one pass."""
    out, names = df, {}
    for s, parts in bank.items():
        names[s] = f"__p{s}"
        out = _summed(out, parts, names[s])
    choice = F.col(next(iter(names.values())))
    for s, c in names.items():
        choice = F.when(F.col(state) == s, F.col(c)).otherwise(choice)
    return out.withColumn(keep, choice).drop(*names.values())


def ensemble(df: DataFrame, bank: Mapping[int, Sequence[Model]], odds: Mapping[int, Column], keep: str = "prediction") -> DataFrame:
    """The sum of all models' predictions, weighed by the odds of their states."""
    out, total = df, F.lit(0.0)
    for s, parts in bank.items():
        out = _summed(out, parts, f"__p{s}")
        total = total + F.col(f"__p{s}") * odds[s]
    return out.withColumn(keep, total).drop(*(f"__p{s}" for s in bank))


class EarlyStopping:
    """Stops after `patience` scores that don't better the best by `delta`."""

    def __init__(self, patience: int = 10, delta: float = 1e-4, mode: str = "min"):
        self.patience, self.delta, self.sign = patience, delta, -1 if mode == "min" else 1
        self.best, self.waited = None, 0

    def stop(self, score: float) -> bool:
        score *= self.sign
        if self.best is None or score >= self.best + self.delta:
            self.best, self.waited = score, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


def best_epochs(history: DataFrame, by: Sequence[str] = ("weather",), loss: str = "loss") -> DataFrame:
    """(by, epoch, loss) of each class's least loss; of ties the first epoch."""
    return history.groupBy(*by).agg(F.min_by("epoch", F.struct(loss, "epoch")).alias("epoch"), F.min(loss).alias(loss))


def accepted(before: float, after: float, gain: float = 0.05) -> bool:
    """Whether a fine-tuned model stays: its error fell by at least that share."""
    return before > 0 and (before - after) / before >= gain


def balanced_weights(raw: Sequence[float]) -> list[float]:
    """Softmax, within 0.2 and 0.8, adding up to 1."""
    e = [math.exp(v - max(raw)) for v in raw]
    held = [min(0.8, max(0.2, v / sum(e))) for v in e]
    return [v / sum(held) for v in held]


def fusion_weights(errors: DataFrame, p: Sequence[str], t: str = "target", rounds: int = 50) -> list[float]:
    """Weights of several predictions of one target, within 0.2 and 0.8 before they are made to add up to 1, that lessen the
    mean squared error of their weighed sum: softmax weights by quasi-Newton steps.

    The error needs only the predictions' products, which are one aggregate over all rows; all steps work on that small table."""
    names = [*p, t]
    live = errors.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    row = live.agg(F.count("*"), *(F.avg(F.col(a) * F.col(b)) for a in names for b in names)).first()
    if not row[0]:
        return [1 / len(p)] * len(p)
    m = np.array(row[1:], float).reshape(len(names), len(names))
    g, c = m[:-1, :-1], m[:-1, -1]

    def loss(raw):
        e = np.exp(raw - raw.max())
        w = e / e.sum()
        dw = 2 * (g @ w - c)
        return w @ g @ w - 2 * c @ w, w * (dw - w @ dw)

    raw, inverse = np.zeros(len(p)), np.eye(len(p))
    value, grad = loss(raw)
    for _ in range(rounds):
        step, size = -inverse @ grad, 1.0
        if step @ grad >= 0 or not np.isfinite(step).all():
            step, inverse = -grad, np.eye(len(p))
        while size > 1e-8 and loss(raw + size * step)[0] > value + 1e-4 * size * (step @ grad):
            size /= 2
        new = raw + size * step
        new_value, new_grad = loss(new)
        s, y = new - raw, new_grad - grad
        if s @ y > 1e-12:
            left = np.eye(len(p)) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
        done = value - new_value < 1e-12
        raw, value, grad = new, new_value, new_grad
        if done:
            break
    return balanced_weights(raw.tolist())


def fine_tuned(bank: Mapping[int, Sequence[Model]], recent: DataFrame, check: DataFrame, gain: float = 0.05, label: str = "y", **how) -> tuple[dict[int, list[Model]], bool]:
    """The bank trained further on recent rows, and True, if that lowers the mean absolute error of the rows to check by the
    share `gain`; else the bank as it was, and False."""
    new = train_bank(recent, before=bank, label=label, **how)
    off = lambda b: predict(check, b).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0] or 0.0
    kept = accepted(off(bank), off(new), gain)
    return (new, True) if kept else ({s: list(m) for s, m in bank.items()}, False)


def mini_batches(df: DataFrame, size: int, seed: int = 42, order: Sequence[str] = ("series_id", "ts", "row_id")) -> DataFrame:
    """df with batch, from 0: rows in a pseudorandom order by hash, dealt into batches of about `size` rows."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(n)))
