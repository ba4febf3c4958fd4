"""Least squares that goes on from batch to batch: sums by class that forget at a rate, from which weights are solved.

The sums of a batch are one aggregate, summed within tasks first; those of two sets of rows add up. To the driver come the sums
alone, which the number of features bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sunfold.runtime import drop_path


def class_sums(df: DataFrame, features: str = "features", label: str = "y", state: str = "weather", weight: Column | None = None) -> dict[int, np.ndarray]:
    """For each class the sums of products of (1, features, label), a matrix, each row times its weight; rows with a null among them
    are left out."""
    values = vector_to_array(features) if df.schema[features].dataType.typeName() == "vectorudt" else F.col(features).cast("array<double>")
    row = F.concat(F.array(F.lit(1.0)), values, F.array(F.col(label).cast("double")))
    if weight is not None:
        row = F.transform(row, lambda v: v * F.sqrt(weight))
    rows = df.select(F.col(state).cast("int").alias("state"), row.alias("x")).filter("state is not null and not exists(x, v -> v is null or isnan(v))")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, own in b.groupby("state")["x"]:
                for at in range(0, len(own), 1024):
                    x = np.stack(own.iloc[at : at + 1024])
                    total[s] = total.get(s, 0) + x.T @ x
        for s, g in total.items():
            yield pd.DataFrame({"state": np.int32(s), "row": np.arange(len(g), dtype=np.int32), "values": g.tolist()})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": pdf["state"].iloc[:1], "row": pdf["row"].iloc[:1], "values": [np.stack(pdf["values"]).sum(0).tolist()]})

    schema = "state int, row int, values array<double>"
    found: dict[int, dict[int, list]] = {}
    for s, r, v in rows.mapInPandas(part, schema).groupBy("state", "row").applyInPandas(add, schema).collect():  # classes by features rows
        found.setdefault(s, {})[r] = v
    return {s: np.array([g[i] for i in range(len(g))]) for s, g in found.items()}


class RecursiveLeastSquares:
    """Linear weights for each class, from sums of all batches so far, each of which counts `forgetting` times as much as the one after it.

    penalty: of the mean square of weights but the intercept."""

    def __init__(self, forgetting: float = 1.0, penalty: float = 1e-3, sums: dict[int, np.ndarray] | None = None, updates: int = 0):
        if not 0 < forgetting <= 1:
            raise ValueError("forgetting is above 0 and at most 1")
        self.forgetting, self.penalty, self.sums, self.updates = forgetting, penalty, dict(sums or {}), updates

    def update(self, batch: DataFrame, features: str = "features", label: str = "y", state: str = "weather") -> None:
        """Learn from a batch. A class that it has no rows of is left as it is."""
        for s, g in class_sums(batch, features, label, state).items():
            self.sums[s] = g + self.forgetting * self.sums[s] if s in self.sums else g
        self.updates += 1

    def update_all(self, df: DataFrame, batch: str, batches: int, features: str = "features", label: str = "y", state: str = "weather") -> None:
        """What `batches` updates by the rows with batch 0, 1, ... come to, in one pass: a row counts by how many batches follow its own."""
        age = F.lit(batches - 1) - F.col(batch)
        new = class_sums(df.filter(F.col(batch).between(0, batches - 1)), features, label, state, F.pow(F.lit(float(self.forgetting)), age))
        # a class forgets in batches that have rows of it only; over many batches of all classes that is every one
        for s, g in new.items():
            self.sums[s] = g + self.forgetting**batches * self.sums[s] if s in self.sums else g
        self.updates += batches

    def merge(self, other: RecursiveLeastSquares) -> None:
        """Learn what another has learnt from other rows."""
        for s, g in other.sums.items():
            self.sums[s] = self.sums.get(s, 0) + g
        self.updates += other.updates

    def weights(self) -> dict[int, np.ndarray]:
        """The intercept and a weight for each feature, by class."""
        out = {}
        for s, g in sorted(self.sums.items()):
            a = g[:-1, :-1] + np.diag(np.r_[0.0, np.full(len(g) - 2, self.penalty * g[0, 0])])
            out[s] = np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0]
        return out

    def prediction(self, features: Column, state: str = "weather") -> Column:
        """What the class' weights make of an array of features; null for a class that has none."""
        out = F.lit(None).cast("double")
        for s, w in self.weights().items():
            terms = F.zip_with(features, F.array(*(F.lit(float(v)) for v in w[1:])), lambda a, b: a * b)
            out = F.when(F.col(state) == s, F.aggregate(terms, F.lit(float(w[0])), lambda t, v: t + v)).otherwise(out)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(s, i, row, self.updates, self.forgetting, self.penalty) for s, g in self.sums.items() for i, row in enumerate(g.tolist())]
        spark.createDataFrame(rows, "state int, row int, values array<double>, updates int, forgetting double, penalty double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RecursiveLeastSquares:
        rows = spark.read.parquet(path).orderBy("state", "row").collect()
        if not rows:
            return cls()
        sums = {s: np.array([r["values"] for r in rows if r["state"] == s]) for s in {r["state"] for r in rows}}
        return cls(rows[0]["forgetting"], rows[0]["penalty"], sums, rows[0]["updates"])


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
    done = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done if n.startswith("version="))


def latest(spark: SparkSession, folder: str, before: int | None = None) -> RecursiveLeastSquares | None:
    """The last model written under folder, before a batch's number if one is given."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    return RecursiveLeastSquares.load(spark, f"{folder}/version={found[-1]}") if found else None


def learn_stream(stream: DataFrame, folder: str, start: RecursiveLeastSquares | None = None, most: int = 100, keep: int = 3, **names) -> StreamingQuery:
    """Learns from each micro-batch of what is there now, `most` of them at most, and writes a model under folder after each.

    A batch's model comes from the last one before it, so that a batch that is done again after a failure gives the same model, and a
    query that is started again goes on where it ended. The checkpoint is under folder too; the last `keep` models stay."""

    def each(df: DataFrame, i: int) -> None:
        if i >= most:
            return
        spark = df.sparkSession
        model = latest(spark, folder, i) or start or RecursiveLeastSquares()
        model = RecursiveLeastSquares(model.forgetting, model.penalty, model.sums, model.updates)
        model.update(df, **names)
        model.save(spark, f"{folder}/version={i}")
        for old in _versions(spark, folder)[:-keep]:
            drop_path(spark, f"{folder}/version={old}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
