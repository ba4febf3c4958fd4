"""Operators on small frames: ties, nulls, ends of series, blocks, and numerical invariants."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunfold.operators import embed, evaluate, graph, missing, models, modes, ordered, quality, quantiles, scale, smooth, split
from sunfold.sources import files, sinks
from sunfold.streaming import monitor

T0 = dt.datetime(2024, 6, 1)


def frame(spark, values, series="a"):
    rows = [(series, i, T0 + dt.timedelta(minutes=15 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, row_id long, ts timestamp_ntz, power double")


def by_row(df, c):
    return [r[0] for r in df.orderBy("row_id").select(c).collect()]


def test_windows_over_blocks_equal_plain_windows(spark):
    x = np.random.default_rng(0).normal(size=500).round(3).tolist()
    df = frame(spark, x)
    got = ordered.windowed(df, lambda w: {"m": F.sum("power").over(w.rowsBetween(-5, 3))}, 5, 3, block=16)
    assert got.count() == 500
    want = [sum(x[max(0, i - 5) : i + 4]) for i in range(500)]
    assert np.allclose(by_row(got, "m"), want)


@pytest.mark.parametrize("limit", [1, 6])
def test_linear_fill_equals_pandas(spark, limit):
    rng = np.random.default_rng(limit)
    x = [None if rng.random() < 0.6 else float(rng.integers(100)) for _ in range(120)]
    got = by_row(missing.fill(frame(spark, x), "power", limit=limit), "power")
    s = pd.Series(x, dtype=float).interpolate(limit=limit).ffill().bfill()
    assert np.allclose(got, s)


def test_fill_of_nothing_known_stays_null(spark):
    assert by_row(missing.fill(frame(spark, [None, None]), "power"), "power") == [None, None]


@pytest.mark.parametrize("method", scale.METHODS)
def test_scale_round_trip(spark, method):
    df = frame(spark, [3.0, None, 5.0, 11.0]).withColumn("same", F.lit(2.0))
    p = scale.fit(df, ["power", "same"], method)
    back = scale.invert(scale.apply(df, p, method), p, method)
    assert by_row(back, "power")[::2] == pytest.approx([3.0, 5.0]) and by_row(back, "same") == pytest.approx([2.0] * 4)


def test_savgol_and_gaussian_keep_a_line(spark):
    line = [2.0 * i for i in range(20)]
    assert by_row(smooth.savgol(frame(spark, line), "power"), "smooth") == pytest.approx(line)
    assert by_row(smooth.gaussian(frame(spark, line), "power"), "smooth")[5:15] == pytest.approx(line[5:15])
    assert by_row(smooth.savgol(frame(spark, [1.0, 2.0]), "power"), "smooth") == [1.0, 2.0]


def test_split_boundaries_follow_float_products(spark):
    got = split.split_temporal(frame(spark, [0.0] * 1000)).groupBy("split").count().collect()
    assert dict(got) == {"train": 700, "val": 199, "test": 101}


def test_validate_split_of_empty_frame(spark):
    r = split.validate_split(split.split_temporal(frame(spark, []))).first()
    assert r["empty"] and not r["overlap"]


def test_sequences_of_short_series_are_none(spark):
    assert split.sequences(frame(spark, [1.0] * 5), 6).count() == 0
    assert split.sequences(frame(spark, [1.0] * 6), 6).count() == 1


def test_extremes_and_bounds_without_spread(spark):
    df = frame(spark, [5.0] * 4)
    assert quality.outlier_counts(df, ["power"], "zscore").first()["outliers"] == 0
    assert quality.extreme_rows(df, ["power"], 2).count() == 4
    with pytest.raises(ValueError):
        quality.handle_outliers(df, ["power"], "forest")


def test_modes_of_two_tones():
    t = np.arange(1000)
    x = np.sin(2 * np.pi * 0.01 * t) + 0.5 * np.sin(2 * np.pi * 0.1 * t)
    u, w = modes.decompose(x, 2)
    assert w == pytest.approx([0.01, 0.1], abs=2e-3)
    assert np.linalg.norm(x - u.sum(0)) / np.linalg.norm(x) < 0.05
    assert np.median(modes.instantaneous_frequency(np.sin(2 * np.pi * 0.05 * t))) == pytest.approx(0.05, abs=1e-3)


def test_weights_gradient_and_constraints():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(20, 3)), np.array([0.3, 0.5, 0.2])
    y = x[:, 0] + 0.1 * rng.normal(size=20)
    _, g = embed.neighbourhood_loss(x, y, w, 0.01)
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        num = (embed.neighbourhood_loss(x, y, w + e, 0.01)[0] - embed.neighbourhood_loss(x, y, w - e, 0.01)[0]) / 2e-6
        assert g[i] == pytest.approx(num, abs=1e-5)
    learnt = embed.learn_weights(x, y)
    assert learnt.sum() == pytest.approx(1) and learnt.min() >= 0 and learnt.argmax() == 0


def test_laplacian_rows_and_eigenvectors(spark):
    edges = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    g = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "src long, dst long, w double")
    lap = graph.laplacian(g)
    m = np.zeros((4, 4))
    for a, b, v in lap.collect():
        m[a, b] = v
    d = np.array([2, 3, 3, 2]) ** 0.5
    assert np.allclose(m @ d, 0) and np.allclose(m, m.T)
    found = graph.smallest_eigenvectors(lap, 1)
    f = {r["node"]: r["f"] for r in found.vectors.collect()}
    v = np.array([f[i][0] for i in range(4)])
    assert abs(v @ d) / np.linalg.norm(d) == pytest.approx(1, abs=1e-6) and found.values == pytest.approx([0], abs=1e-9)


def test_knn_is_exact(spark):
    x = np.random.default_rng(2).normal(size=(60, 5)).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph.knn_edges(df, 3, block=20).collect():
        got.setdefault(r["src"], []).append((r["d2"], r["dst"]))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert all(sorted(j for _, j in got[i]) == sorted(np.argsort(d[i])[:3].tolist()) for i in range(60))


def test_projection_error_is_zero_for_full_rank(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.5, -1.0],)], "v array<double>")
    assert graph.reconstruction_error(df, "v", np.array([[1.0, 0.3], [0.2, 1.0]])).first()[0] == pytest.approx(0, abs=1e-12)


def test_t_test_of_known_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 7)], "d double")
    r = evaluate.t_test(df).first()
    d = np.array([1, 2, 3, 4, 7.0])
    assert r["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / 5**0.5)) and r["cohens_d"] == pytest.approx(d.mean() / d.std())
    assert evaluate._t_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    w = evaluate.wilcoxon(spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (0.0,)], "d double")).first()
    assert (w["n"], w["w"]) == (3, 1.5)


def test_early_stopping_series():
    stop = models.EarlyStopping(5, 1e-4)
    series = [0.1, 0.09, 0.085, 0.084, 0.0839, 0.0838, 0.0838, 0.0838]
    assert [stop.stop(v) for v in series] == [False] * 8
    assert models.accepted(1.0, 0.95) and not models.accepted(1.0, 0.96)
    assert sum(models.balanced_weights([3.0, 0.0])) == pytest.approx(1)
    assert embed.allocation(30, 9) == [4, 4, 4, 3, 3, 3, 3, 3, 3]


def test_station_files(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("timestamp,Power  (MW),Global horizontal irradiance (W/m2),T,Pre,Hum\n2024-06-01 00:00:00,0.5,100,20,1000,130\n2024-06-01 00:15:00,x,200,21,1001,50\n")
    (tmp_path / "s2.csv").write_text("time,P,I,T,Atmospheric pressure (kPa),Hum\n2024-06-01 00:00:00,900,300,22,100.5,40\n")
    (tmp_path / "s3.csv").write_text("a,b\n1,2\n")
    df, failed = files.read_stations(spark, [str(tmp_path / f"s{i}.csv") for i in (1, 2, 3)])
    rows = {(r["station"], r["ts"].minute): r for r in df.collect()}
    assert rows["s1", 0]["power"] == 500 and rows["s1", 15]["power"] is None and rows["s1", 0]["humidity"] == 100
    assert rows["s2", 0]["pressure"] == 1005 and len(failed) == 1
    mean, _ = files.read_stations(spark, [str(tmp_path / f"s{i}.csv") for i in (1, 2)], merge="average")
    assert {r["ts"].minute: r["power"] for r in mean.collect()}[0] == 700
    with pytest.raises(ValueError):
        files.read_station(spark, "x.doc")


def test_synthetic_plant_and_reports(spark, tmp_path):
    df = files.synthetic(spark, 1)
    assert df.count() == 289 and df.filter("power < 0 or irradiance < 0").count() == 0
    got = evaluate.metric_grades(evaluate.metrics(df.select(F.col("power").alias("target"), (F.col("power") + 1).alias("prediction"))))
    assert "rmse" in sinks.markdown_report(got) and "<table>" in sinks.html_report(got)
    sinks.write_params(spark, {"a": [1.0, 2.0]}, str(tmp_path / "p"))
    assert sinks.read_params(spark, str(tmp_path / "p")) == {"a": [1.0, 2.0]}


def test_error_monitor_stream(spark, tmp_path):
    for i in range(4):
        rows = [("a", 1.0, 0.0), ("a", 2.0, 0.5), ("b", 0.0, 0.0)]
        spark.createDataFrame(rows, "series_id string, prediction double, target double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, prediction double, target double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.error_monitor(stream).writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("levels").filter("series_id = 'a'").orderBy("n").collect()
    assert [r["n"] for r in rows] == [2, 4, 6, 8] and rows[0]["mean"] == pytest.approx(1.25)
    assert rows[0]["level"] == 0 and rows[2]["level"] == 2 and math.isclose(rows[3]["std"], np.std([1, 1.5] * 4, ddof=1))


def test_training_log_lines(spark):
    lines = spark.createDataFrame([("Epoch 3/10 Loss: 0.25", "f"), ("nothing", "f")], "value string, file string")
    assert [tuple(r) for r in monitor.parsed_log(lines).collect()] == [("f", 3, 0.25)]


def test_rows_before_any_magnitude(spark):
    """Negative, zero, tiny and huge values, against sorting all rows."""
    values = [-1e300, -3.5, -3.5, -1e-310, 0.0, 0.0, 0.0, 5e-324, 2.0, 2.0000001, 1e308]
    counts = spark.createDataFrame([(v,) for v in values], "x double").groupBy("x").count().withColumnRenamed("count", "n")
    got = {r.x: r.before for r in evaluate.with_rows_before(counts, "x").collect()}
    assert got == {v: sum(w < v for w in values) for v in values}
    assert evaluate.with_rows_before(counts.limit(0), "x").collect() == []


def test_error_figures_of_few_rows(spark):
    """One row, nulls and equal errors."""
    kind = "weather int, prediction double, target double"
    one = spark.createDataFrame([(0, 3.0, 1.0), (None, None, 1.0)], kind)
    assert [(r.error, r.n, r.first_p, r.first_z) for r in evaluate.error_qq(one).collect()] == [(2.0, 1, 0.5, 0.0)]
    assert evaluate.error_density(one).collect() == []
    same = spark.createDataFrame([(0, 1.0 + i, 1.0) for i in (0, 1, 2, 3, 100)], kind)
    assert [tuple(r)[:2] + (r.outside,) for r in evaluate.error_band(same, width=1.5).collect()] == [(0, 5, 1)]
    total = evaluate.error_density(same, points=4000).agg({"density": "sum"}).first()[0] * 100 / 3999
    assert 0.3 < total <= 1


def test_quantiles_equal_numpy(spark):
    """Ties, both signs, all magnitudes, null keys and values, against numpy; groups of nulls, one row, no rows."""
    rng = np.random.default_rng(3)
    groups = {"a": (rng.normal(size=301) * 10.0 ** rng.integers(-9, 9, 301)).tolist(), None: rng.integers(-3, 3, 80).astype(float).tolist(), "b": [7.5], "c": [None, None]}
    df = spark.createDataFrame([(g, v) for g, xs in groups.items() for v in [*xs, None]], "g string, x double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in quantiles.quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == set(groups) and got["c"] == [None] * 5
    for g in ("a", None, "b"):
        assert got[g] == pytest.approx(np.quantile(groups[g], shares).tolist(), rel=1e-12)
    everything = [v for xs in groups.values() for v in xs if v is not None]
    assert quantiles.quantiles(df, "x", (0.5,)).first().q == pytest.approx([np.median(everything)])
    assert quantiles.quantiles(df.limit(0), "x", (0.5,)).first().q == [None]
    assert quantiles.quantiles(df.limit(0), "x", (0.5,), ["g"]).collect() == []
    ends = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, float("inf"))], "x double")
    assert quantiles.quantiles(ends, "x", (0.0, 0.5, 1.0)).first().q == [float("-inf"), 1.0, float("inf")]


def test_robust_scale_of_nulls(spark):
    df = frame(spark, [1.0, 2.0, 4.0, 8.0, float("nan")]).withColumn("none", F.lit(None).cast("double"))
    assert scale.fit(df, ["power", "none"], "robust") == {"power": (3.0, 3.25), "none": (None, 1.0)}
    assert scale.fit(df.limit(0), ["power"], "robust") == {"power": (None, 1.0)}


def test_weights_of_many_neighbourhoods_are_those_of_each():
    rng = np.random.default_rng(6)
    x = rng.exponential(size=(200, 24, 3)) * [1, 5, 20]
    y = rng.normal(size=(200, 24)) + x[:, :, 0]
    y[3], x[4] = 1.0, 0.0  # nothing to learn
    for rounds in (1, 3, 20):
        many = embed.learn_many_weights(x, y, rounds=rounds)
        each = np.array([embed.learn_weights(a, b, rounds=rounds) for a, b in zip(x, y, strict=True)])
        assert np.quantile(np.abs(many - each).max(1), 0.98) < 1e-6 and np.abs(many.mean(0) - each.mean(0)).max() < 1e-3


def test_models_are_trained_on_rows_that_are_made_once(spark, small):
    """Every state's training and the predictions read the classified rows, not the tables."""
    from sunfold.plans import queries

    rows, bank = queries._modelled(spark, small)
    assert rows.inputFiles() == [] and len(bank) == 3 and {"weather", "y", "features"} == set(rows.columns)


def test_local_weights_of_blocks_are_those_of_each_row(spark):
    """Blocks of 50 rows, a null key, missing labels and features: each row's weights from the last rows, a series' first rows from as many as there are."""
    rng = np.random.default_rng(8)
    series = {k: [None if rng.random() < 0.1 else float(v) for v in rng.exponential(size=n) * 9] for k, n in (("a", 150), (None, 100), ("b", 2))}
    rows = [(k, i, T0 + dt.timedelta(minutes=i), v, float(i % 7), None if i % 5 else float(i % 3)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, row_id long, ts timestamp_ntz, power double, u double, v double")
    got = {(r["series_id"], r["row_id"]): (r["rn"], r["weights"]) for r in embed.local_weights(df, ["u", "v"], length=24, rounds=10, block=50).collect()}
    assert len(got) == len(rows)
    off = []
    for k, p in series.items():
        y = np.array([np.nan if b is None and a is None else a if b is None else b for a, b in zip(p, [*p[1:], None], strict=True)])
        x = np.array([[i % 7, 0 if i % 5 else i % 3] for i in range(len(p))], float)
        for i in range(len(p)):
            low = max(0, i - 23)
            want = [0.5, 0.5] if i < 2 else embed.learn_weights(x[low : i + 1], y[low : i + 1], rounds=10)
            off.append(np.abs(np.array(got[k, i][1]) - want).max())
            assert got[k, i][0] == i
    assert np.quantile(off, 0.97) < 1e-6


def test_weights_that_add_up_are_learnt_at_every_row(spark, small, monkeypatch):
    from sunfold.plans import queries

    seen, means = [], embed.mean_weights
    monkeypatch.setattr(embed, "mean_weights", lambda weights, names: seen.append(weights) or means(weights, names))
    queries.queries()["nca_weights_add_up"](spark, small)
    assert seen[0].count() == spark.read.parquet(f"{small}/events.parquet").count()
