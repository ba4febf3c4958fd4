"""What goes on from batch to batch: thresholds, fusion weights, least squares."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunfold.operators import adapt, recursive


def sequential(errors, low=0.2, high=0.6):
    """The rule, batch by batch."""
    out = []
    for sunny, cloudy, overcast in errors:
        sunny, cloudy, overcast = (v or 0.0 for v in (sunny, cloudy, overcast))
        low += 0.005 if sunny > cloudy else -0.005 if cloudy > sunny else 0
        high += 0.005 if cloudy > overcast else -0.005 if overcast > cloudy else 0
        low, high = min(0.25, max(0.15, low)), min(0.65, max(0.55, high))
        out.append((low, high, low * 1.75, high * 1.25))
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_thresholds_follow_the_sequential_rule(spark, block):
    """All nine orders of errors, bounds on either side, nulls, a null series, blocks that end within a run."""
    rng = np.random.default_rng(block)
    nine = [(float(a), 1.0, float(b)) for a, b in itertools.product((0, 1, 2), repeat=2)]
    series = {"nine": nine, "up": [(2.0, 1.0, 0.5)] * 30 + [(0.0, 1.0, 2.0)] * 60, None: [(None, float(x), None if x > 0 else 1.0) for x in rng.normal(size=40)]}
    rows = [(k, i, *e) for k, x in series.items() for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, batch long, sunny double, cloudy double, overcast double")
    timed = df.withColumn("at", F.timestamp_seconds("batch"))
    got = {}
    for r in adapt.adapted_thresholds(timed, order=("at",), block=block).collect():
        got.setdefault(r["series_id"], {})[r["batch"]] = (r["ci_low"], r["ci_high"], r["wsi_low"], r["wsi_high"])
    for k, x in series.items():
        assert [got[k][i] for i in range(len(x))] == [pytest.approx(v) for v in sequential(x)]
    assert min(v[0] for v in got["up"].values()) == pytest.approx(0.15) and max(v[0] for v in got["up"].values()) == pytest.approx(0.25)
    assert adapt.adapted_thresholds(timed.limit(0), order=("at",)).count() == 0


def test_steps_put_together_are_a_step():
    rng = np.random.default_rng(0)
    step = lambda x, s: min(s[2], max(s[1], x + s[0]))
    for _ in range(200):
        f, g = ((a, min(l, h), max(l, h)) for a, l, h in rng.normal(size=(2, 3)))
        for x in rng.normal(size=5):
            assert step(x, adapt.composed(f, g)) == pytest.approx(step(step(x, f), g))


def test_fusion_moves_towards_the_state_index(spark):
    df = spark.createDataFrame([("a", i, e) for i, e in enumerate([0.05, 0.2, None, 100.0, 0.3])], "series_id string, batch long, error double")
    rows = adapt.adapted_fusion(df.withColumn("at", F.timestamp_seconds("batch")), order=("at",)).orderBy("batch").collect()
    assert [r["wsi_weight"] for r in rows] == pytest.approx([0.3, 0.302, 0.302, 0.9, 0.9]) and rows[-1]["ci_weight"] == pytest.approx(0.1)


def made(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(np.arange(n) % 2, x @ [1, 2, 3], x @ [-1, 0, 4]) + 5 + 0.1 * rng.normal(size=n)
    rows = [(i, i % 2, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame([*rows, (n, 0, [1.0, 2.0, 3.0], None), (n + 1, None, [1.0, 2.0, 3.0], 4.0)], "i long, weather int, features array<double>, y double")


def test_recursive_fit_equals_a_batch_fit(spark):
    x, y, df = made(spark)
    model = recursive.RecursiveLeastSquares(penalty=0.0)
    for b in range(3):
        model.update(df.filter(f"i % 3 = {b}"))
    other = recursive.RecursiveLeastSquares(penalty=0.0)
    other.update(df)
    forgets = recursive.RecursiveLeastSquares(0.5, 0.0)
    for b in range(3):
        forgets.update(df.filter(f"i % 3 = {b}"))
    for s in (0, 1):
        own = np.c_[np.ones(150), x[s::2]]
        want = np.linalg.lstsq(own, y[s::2], rcond=None)[0]
        assert model.weights()[s] == pytest.approx(want, abs=1e-9) and other.weights()[s] == pytest.approx(want, abs=1e-9)
        root = np.sqrt(0.5 ** (2 - np.arange(300)[s::2] % 3))
        assert forgets.weights()[s] == pytest.approx(np.linalg.lstsq(own * root[:, None], y[s::2] * root, rcond=None)[0], abs=1e-9)
    off = df.filter("y is not null and weather is not null").select(F.max(F.abs(model.prediction(F.col("features")) - F.col("y")))).first()[0]
    assert off < 0.6
    assert df.filter("weather is null").select(model.prediction(F.col("features"))).first()[0] is None
    once = recursive.RecursiveLeastSquares(0.5, 0.0)
    once.update_all(df.withColumn("batch", F.col("i") % 3), "batch", 3)
    assert all(once.weights()[s] == pytest.approx(w, abs=1e-9) for s, w in forgets.weights().items()) and once.updates == 3
    merged = recursive.RecursiveLeastSquares(penalty=0.0)
    merged.merge(model)
    merged.merge(other)
    assert merged.weights()[0] == pytest.approx(model.weights()[0]) and merged.updates == 4
    with pytest.raises(ValueError):
        recursive.RecursiveLeastSquares(0.0)


def test_learning_from_a_stream_goes_on_after_a_restart(spark, tmp_path):
    _, _, df = made(spark)
    schema = "i long, weather int, features array<double>, y double"

    def feed(part):
        df.filter(f"i % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(folder, most=100):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        recursive.learn_stream(stream, str(tmp_path / folder), recursive.RecursiveLeastSquares(penalty=0.0), most).awaitTermination()
        return recursive.latest(spark, str(tmp_path / folder))

    feed(0)
    feed(1)
    assert run("a").updates == 2
    feed(2)
    feed(3)
    again, whole = run("a"), recursive.RecursiveLeastSquares(penalty=0.0)
    whole.update(df)
    assert again.updates == 4 and all(again.weights()[s] == pytest.approx(w, abs=1e-9) for s, w in whole.weights().items())
    assert run("b", most=2).updates == 2 and len(recursive._versions(spark, str(tmp_path / "a"))) == 3
