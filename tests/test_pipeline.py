"""The jobs end to end on an invented plant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunfold.operators import evaluate, models
from sunfold.plans import pipeline
from sunfold.sources import files, sinks


@pytest.fixture(scope="module")
def plant(spark):
    df = files.synthetic(spark, 4, minutes=15)
    return df.withColumns({"series_id": F.lit("s"), "row_id": F.xxhash64("ts")})


def test_prepare_train_test(spark, plant, tmp_path):
    config = pipeline.Config(modes=3, mode_rounds=30, embedding=7, length=3, projection=5, projection_rows=200)
    features = pipeline.prepare(plant, str(tmp_path), config)
    assert features.count() == plant.count() and {"imf3", "weather", "target"} <= set(features.columns)
    known = sinks.read_params(spark, f"{tmp_path}/params")
    assert len(known["weights"]) == 7 and np.array(known["projection"]).shape == (7, 5)
    bank, got = pipeline.train(features, config, known, str(tmp_path))
    total = {r["weather"]: r for r in got.collect()}[None]
    assert bank and total["r2"] > 0.5
    again = models.load_bank(spark, f"{tmp_path}/models")  # a saved bank predicts as it did, without training
    one, two = (sorted(map(str, pipeline.test(features, b, config, "test", known).collect())) for b in (bank, again))
    assert one == two and one
    sinks.write_predictions(pipeline.predictions(features, again, config, "val", known), f"{tmp_path}/predictions")
    assert {"prediction", "target", "error", "weather"} <= set(spark.read.parquet(f"{tmp_path}/predictions").columns)
    files_ = sinks.checkpoints(spark, f"{tmp_path}/models")
    assert files_.count() > 3 and sinks.checkpoints(spark, f"{tmp_path}/models", 2).count() == 2 and sinks.changed_files(files_, files_).count() == 0


def test_bank_goes_on_from_another(spark):
    """A model that starts from another moves less from it than one that starts anew, and one that doesn't help is rolled back."""
    rows = [(0, float(i % 10), 2.0 * (i % 10) + 1) for i in range(200)]
    x = models.vectors(spark.createDataFrame(rows, "weather int, a double, y double"), ["a"])
    bank = models.train_bank(x)
    few = models.vectors(spark.createDataFrame([(0, 1.0, 5.0), (0, 2.0, 7.5)], "weather int, a double, y double"), ["a"])
    on = models.train_bank(few, before=bank, penalty=10.0)
    assert len(on[0]) == 2 and len(bank[0]) == 1
    off = lambda b: models.predict(x, b).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off(on) < off(models.train_bank(few, penalty=10.0))
    kept, changed = models.fine_tuned(bank, few, x)
    assert not changed and off(kept) == off(bank)
    kept, changed = models.fine_tuned(bank, few, few, penalty=1e-6)
    assert changed and off(kept) > off(bank)


def test_fusion_weights(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=500)
    df = spark.createDataFrame([(float(v + rng.normal(0, 0.1)), float(v + rng.normal(0, 0.3)), float(v)) for v in t], "a double, b double, t double")
    w = models.fusion_weights(df, ["a", "b"], "t")
    assert abs(sum(w) - 1) < 1e-9 and w[0] == max(w) and abs(w[0] - 0.8) < 0.02
    assert models.fusion_weights(df.limit(0), ["a", "b"], "t") == [0.5, 0.5]


def test_small_things(spark, plant, tmp_path):
    assert files.numeric_columns(plant)[:2] == ["irradiance", "power"] and files.power_column(plant.withColumnRenamed("power", "active_power"), "x") == "active_power"
    assert files.preview(plant, 3).count() == 3
    got = models.mini_batches(plant, 50).groupBy("batch").count().collect()
    assert sum(r["count"] for r in got) == plant.count() and max(r["count"] for r in got) < 100
    plant.select(F.col("ts").alias("timestamp"), "power", "irradiance", "temperature", "pressure", "humidity").coalesce(1).write.option("header", True).csv(str(tmp_path / "one.csv"))
    assert [f.rsplit("/", 1)[1] for f in files.station_files(spark, str(tmp_path))] == ["one.csv"]
    df, failed = files.read_stations(spark, [f"{tmp_path}/"])
    assert not failed and df.count() == plant.count()
    pred = plant.select("series_id", "ts", "row_id", F.col("power").alias("target"), (F.col("power") * 0.9).alias("prediction"))
    r = evaluate.rolling_errors(pred, window=20, percentiles=True).filter("rn = 60").first()
    e = [abs(x["target"] - x["prediction"]) for x in pred.orderBy("ts").limit(61).collect()][-20:]
    assert np.allclose([r["error_p5"], r["error_p95"]], np.percentile(e, [5, 95]))
    sinks.append_history(evaluate.metrics(pred), str(tmp_path / "h"), epoch=1)
    sinks.append_history(evaluate.metrics(pred), str(tmp_path / "h"), epoch=2)
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 2


def test_bootstrap_counts_equal_rows(spark):
    """Repeated rows are drawn on their own: an interval over 400 rows of two values is as narrow as it should be."""
    df = spark.createDataFrame([(0.0, 1.0)] * 200 + [(0.0, 3.0)] * 200, "target double, prediction double")
    low, high = evaluate.bootstrap_ci(df, rounds=1000).first()
    assert abs(low - 1.902) < 0.03 and abs(high - 2.098) < 0.03
    assert tuple(evaluate.bootstrap_ci(df.repartition(7), rounds=1000).first()) == (low, high)


def test_walk_forward(spark, plant, tmp_path):
    year = plant.withColumn("ts", F.expr("ts + make_dt_interval(int(pmod(row_id, 170)), 0, 0, 0)"))
    got = pipeline.walk_forward(year, str(tmp_path), pipeline.Config(folds=((2, 1, 1), (3, 1, 1)), modes=2, mode_rounds=10, embedding=6, length=2, weight_every=50))
    info = pipeline.sinks.read_params(spark, f"{tmp_path}/fold_info")["folds"]
    assert len(info) == 6 and all(r["rows"] > 0 and r["first"] <= r["last"] for r in info)
    assert spark.read.parquet(f"{tmp_path}/fold=0/thresholds").filter("ci_low between 0.15 and 0.25 and ci_high between 0.55 and 0.65").count() > 0
    assert {(r["fold"], r["models"]) for r in got.collect()} == {(f, m) for f in (0, 1) for m in ("start", "online")}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"vmd": {"max_iterations": 7}, "data": {"train_ratio": 0.6, "test_ratio": 0.2}}')
    c = pipeline.Config.load(str(tmp_path / "c.json"), {"SUNFOLD_SCALER": "robust"})
    assert (c.mode_rounds, c.train_ratio, c.scaler) == (7, 0.6, "robust")
    with pytest.raises(ValueError):
        pipeline.Config(train_ratio=0.9)
