"""The jobs from station files to metrics: prepare, train, test, walk-forward."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.functions import weather
from sunfold.operators import adapt, embed, evaluate, graph, missing, models, modes, quality, recursive, scale, split
from sunfold.operators.ordered import numbered, windowed
from sunfold.runtime import cut
from sunfold.schema import MEASURES
from sunfold.sources import sinks


@dataclass
class Config:
    """Settings of the jobs, checked when made. Values in files may use other spellings (see ALIASES)."""

    train_ratio: float = 0.7
    val_ratio: float = 0.2
    test_ratio: float = 0.1
    scaler: str = "minmax"
    modes: int = 5
    mode_rounds: int = 100
    embedding: int = 30
    length: int = 24
    horizon: int = 1
    model: str = "linear"
    penalty: float = 0.01  # of a linear model's weights
    weight_every: int = 16  # rows between those where columns' weights are learnt; 0: equal weights
    projection: int = 0  # features that sequences are projected to; 0: not at all
    projection_rows: int = 5000  # at most, of train rows, that the projection is learnt from
    projection_alpha: float = 0.5
    gain: float = 0.05  # that online learning must bring
    updates: int = 100  # batches that it learns a fold's val rows in
    forgetting: float = 0.99  # how much a batch counts against the one after it
    pressure_base: float = 1040.0
    weights: tuple[float, float] = (0.7, 0.3)
    folds: Sequence[tuple[int, int, int]] = field(default=((12, 3, 3), (15, 3, 3), (18, 3, 3), (21, 3, 3)))
    limit: int = 6

    ALIASES = {"max_iter": "mode_rounds", "max_iterations": "mode_rounds", "n_modes": "modes", "sequence_length": "length", "embedding_dim": "embedding"}

    def __post_init__(self) -> None:
        if abs(self.train_ratio + self.val_ratio + self.test_ratio - 1) > 1e-6:
            raise ValueError("ratios must add up to 1")
        if self.scaler not in scale.METHODS:
            raise ValueError(f"unknown scaler {self.scaler}")
        if not (1 <= self.modes <= 20 and self.length >= 1 and self.horizon >= 0):
            raise ValueError("modes, length or horizon out of range")

    @classmethod
    def of(cls, values: Mapping) -> Config:
        """From nested settings: sections don't matter, unknown names are left out."""
        flat: dict = {}

        def walk(v: Mapping) -> None:
            for k, x in v.items():
                if isinstance(x, Mapping):
                    walk(x)
                else:
                    flat[cls.ALIASES.get(k, k)] = x

        walk(values)
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})

    @classmethod
    def load(cls, path: str, environment: Mapping[str, str] | None = None, prefix: str = "SUNFOLD_") -> Config:
        """From a JSON file, or YAML where a parser is installed, then from the environment: SUNFOLD_TRAIN_RATIO=0.6 sets
        train_ratio."""
        with open(path) as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                values = dict(yaml.safe_load(f) or {})
            else:
                values = dict(json.load(f))
        for k, v in (environment or {}).items():
            if k.startswith(prefix) and (name := k[len(prefix) :].lower()) in cls.__dataclass_fields__:
                values[name] = json.loads(v) if v[:1] in "0123456789.-[{tf" else v
        return cls.of(values)


def clean(df: DataFrame, config: Config) -> DataFrame:
    """Markers out, gaps of every measure filled within series."""
    out = quality.null_markers(df)
    for c in MEASURES:
        out = missing.fill(out, c, "linear", config.limit)
    return out.drop("rn")


def _learnt(rows: DataFrame, folder: str, config: Config) -> tuple[DataFrame, dict]:
    """Scaled and decomposed rows, written by split under folder and read back, and all that was learnt from train rows: the
    scaler, the columns' weights, the projection."""
    spark = rows.sparkSession
    params = scale.fit(rows.filter("split = 'train'"), MEASURES, config.scaler)
    scaled = scale.apply(rows, params, config.scaler)
    imfs = modes.vmd(scaled, "power", config.modes, ("series_id", "split"), rounds=config.mode_rounds)
    sinks.write_table(scaled.join(imfs, ["series_id", "split", "ts", "row_id"]), f"{folder}/features", ["split"])
    out = spark.read.parquet(f"{folder}/features")
    names, known = feature_columns(config), {"method": config.scaler, "columns": params, "config": asdict(config)}
    if config.weight_every:
        near = embed.local_weights(out.filter("split = 'train'"), names, every=config.weight_every)
        learnt = dict(embed.mean_weights(near, names).collect())  # a row for each column
        known["weights"] = [learnt.get(c, 1 / len(names)) * len(names) for c in names]
    if config.projection:
        r = embed.reconstruction(out.filter("split = 'train'"), names, known.get("weights"), max(config.embedding, len(names)))
        r = cut(r.select(F.xxhash64("series_id", "ts", "row_id").alias("id"), F.col("r").alias("v")).orderBy("id").limit(config.projection_rows))
        lap = graph.laplacian(graph.similarity(graph.knn_edges(r, key="id", vector="v"), mode="union"))
        found = graph.learn_projection(r, lap, config.projection, alpha=config.projection_alpha)
        known["projection"] = found.matrix.tolist()
        known["projection_history"] = {"changes": found.changes, "objectives": found.objectives, "stopped": found.stopped}
    return out, known


def prepare(df: DataFrame, folder: str, config: Config | None = None) -> DataFrame:
    """Cleaned, split, labelled, scaled and decomposed rows, written by split under folder and read back.

    Weather is judged by raw units; scaler, weights and projection learn from train rows only and are saved as parameters;
    modes are made for each series and split."""
    config = config or Config()
    spark = df.sparkSession
    rows = split.split_temporal(clean(df, config), config.train_ratio, config.val_ratio, by="series_id")
    rows = weather.classify(rows, tuple(config.weights), pressure_base=config.pressure_base).drop("rn", "ge", "ci", "wsi").withColumn("target", F.col("power"))
    sinks.write_table(rows, f"{folder}/labelled", ["split"])
    out, known = _learnt(spark.read.parquet(f"{folder}/labelled"), folder, config)
    sinks.write_params(spark, known, f"{folder}/params")
    return out


def feature_columns(config: Config) -> list[str]:
    return [*(f"imf{k + 1}" for k in range(config.modes)), *(c for c in MEASURES if c != "power")]


def samples(features: DataFrame, config: Config, known: Mapping | None = None) -> DataFrame:
    """One row for each sequence of `length` rows: their weighed and, where one was learnt, projected reconstructions as a
    vector, y the target `horizon` rows on from the last, and its weather."""
    from pyspark.ml.functions import array_to_vector

    known, names = known or {}, feature_columns(config)
    rows = features.withColumn("series_id", F.concat_ws("|", "series_id", "split"))
    rows = embed.reconstruction(rows, names, known.get("weights"), max(config.embedding, len(names)))
    if known.get("projection"):
        rows = graph.project(rows, "r", np.array(known["projection"])).drop("r").withColumnRenamed("projected", "r")

    def columns(w):
        y = F.lead("target", config.horizon).over(w) if config.horizon else F.col("target")
        return {"y": y, "x": F.collect_list("r").over(w.rowsBetween(-(config.length - 1), 0))}

    ahead = windowed(rows, columns, config.length - 1, max(1, config.horizon))
    return ahead.filter((F.size("x") == config.length) & F.col("y").isNotNull()).withColumn("features", array_to_vector(F.flatten("x"))).drop("x")


def train(features: DataFrame, config: Config | None = None, known: Mapping | None = None, folder: str | None = None) -> tuple[dict, DataFrame]:
    """Models for each weather state, saved under folder if there is one, and metrics on val rows by state and for all."""
    config = config or Config()
    x = samples(features, config, known)
    bank = models.train_bank(x.filter("split = 'train'"), kind=config.model, penalty=config.penalty)
    if folder:
        models.save_bank(features.sparkSession, bank, f"{folder}/models")
    return bank, test(features, bank, config, "val", known)


def predictions(features: DataFrame, bank: Mapping, config: Config, which: str = "test", known: Mapping | None = None) -> DataFrame:
    """One split's rows with target and prediction."""
    x = samples(features.filter(F.col("split") == which), config, known)
    return models.predict(x.withColumn("target", F.col("y")), bank)


def test(features: DataFrame, bank: Mapping, config: Config | None = None, which: str = "test", known: Mapping | None = None) -> DataFrame:
    """Metrics of one split's rows, by state and for all."""
    return evaluate.metrics_with_total(predictions(features, bank, config or Config(), which, known))


def _in_time(batches: DataFrame) -> DataFrame:
    return batches.withColumn("at", F.timestamp_seconds("batch"))


def _corrected(rows: DataFrame, learner: recursive.RecursiveLeastSquares) -> DataFrame:
    more = F.coalesce(learner.prediction(vector_to_array("features")), F.lit(0.0))
    return rows.withColumn("prediction", F.col("prediction") + more)


def _online(rows: DataFrame, config: Config, share: float = 0.8) -> tuple[recursive.RecursiveLeastSquares, bool]:
    """A learner of what predictions leave of y in each series' first rows, in batches over time, and whether it betters the rest, by
    the share `gain` of the mean absolute error."""
    placed = numbered(rows.drop("rn"))
    sizes = placed.groupBy(F.col("series_id").alias("__s")).agg(F.count("*").alias("__n"))
    placed = placed.join(sizes, F.col("series_id").eqNullSafe(F.col("__s")))
    at = F.col("rn") / (F.col("__n") * share)
    placed = placed.withColumns({"batch": F.floor(at * config.updates).cast("int"), "left": F.col("y") - F.col("prediction")})
    learner = recursive.RecursiveLeastSquares(config.forgetting, config.penalty)
    learner.update_all(placed, "batch", config.updates, label="left")
    check = placed.filter(F.col("batch") >= config.updates)
    off = lambda df: df.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] or 0.0
    return learner, models.accepted(off(check), off(_corrected(check, learner)), config.gain)


def walk_forward(df: DataFrame, folder: str, config: Config | None = None) -> DataFrame:
    """Metrics by fold and state over expanding windows, before and after models learn from the fold's val rows (online).

    Rows are cleaned and labelled once for all folds. Each fold learns its own scaler, modes, weights and projection; its
    models start from those of the fold before. What they leave is then learnt from the first four fifths of its val rows, batch by batch,
    and kept if it betters them on the last fifth, which it has not seen. Each fold also has the thresholds that its test rows' errors lead to."""
    config = config or Config()
    spark = df.sparkSession
    rows = weather.classify(clean(df, config), tuple(config.weights), pressure_base=config.pressure_base).drop("rn", "ge", "ci", "wsi")
    folded = split.walk_forward(rows.withColumn("target", F.col("power")), config.folds)
    sinks.write_table(folded, f"{folder}/folds", ["fold", "split"])
    parts = spark.read.parquet(f"{folder}/folds").groupBy("fold", "split").agg(F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"), F.count("*").alias("rows"))
    sinks.write_params(spark, {"folds": [r.asDict() for r in parts.orderBy("fold", "first").collect()]}, f"{folder}/fold_info")  # three rows a fold
    out, bank = None, {}
    for fold in range(len(config.folds)):
        part = spark.read.parquet(f"{folder}/folds").filter(F.col("fold") == fold).drop("fold")
        if part.filter("split = 'train'").isEmpty():
            continue
        features, known = _learnt(part, f"{folder}/fold={fold}", config)
        sinks.write_params(spark, known, f"{folder}/fold={fold}/params")
        x = samples(features, config, known)
        bank = models.train_bank(x.filter("split = 'train'"), kind=config.model, penalty=config.penalty, before=bank)
        if not bank:
            continue
        models.save_bank(spark, bank, f"{folder}/fold={fold}/models")
        learner, kept = _online(models.predict(x.filter("split = 'val'"), bank), config)
        learner.save(spark, f"{folder}/fold={fold}/online")
        found = models.predict(x.filter("split = 'test'").withColumn("target", F.col("y")), bank)
        sinks.write_table(adapt.adapted_thresholds(_in_time(adapt.batch_errors(found)), order=("at",)).drop("at"), f"{folder}/fold={fold}/thresholds", [])
        for name, rows in (("start", found), ("online", _corrected(found, learner) if kept else found)):
            got = evaluate.metrics_with_total(rows)
            got = got.withColumns({"fold": F.lit(fold), "models": F.lit(name)})
            out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no fold has rows to train on")
    return out
