"""Fourier transforms and mode decomposition in blocks, against numpy and against one task for a series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunfold.operators import fourier, modes

T0 = dt.datetime(2024, 6, 1)


def frame(spark, series):
    rows = [(k, i, T0 + dt.timedelta(minutes=15 * i), None if v is None else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, row_id long, ts timestamp_ntz, power double")


def test_shapes_of_lengths():
    assert fourier.shape_of(600, 64) == (600, 24) and fourier.shape_of(1, 8) == (1, 1)
    m, a = fourier.shape_of(997, 64)  # a prime
    assert (m, a) == (2048, 32)
    for n in (2, 3, 1000, 70_080, 999_983):
        m, a = fourier.shape_of(n, 4096)
        assert m % a == 0 and a <= m // a <= 4096 and (m == n or m >= 2 * n - 1)
    with pytest.raises(ValueError):
        fourier.shape_of(997, 16)


def test_transforms_equal_numpy(spark):
    """Lengths with factors, primes, one value; a null key; two channels; there and back."""
    rng = np.random.default_rng(0)
    series = {"a": rng.normal(size=600), "b": rng.normal(size=997), "c": rng.normal(size=1), None: rng.normal(size=2)}
    rows = [(k, len(x), i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "s string, n long, at long, x double")
    v = fourier.shaped(df.select("s", "n", "at", fourier.vector([F.col("x"), F.col("x") * 2]).alias("v")), 64).select("s", "n", "m", "a", "at", "v")

    def of(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["s"], {})[r["at"]] = (r["v"][0] + 1j * r["v"][2], r["v"][1] + 1j * r["v"][3])
        return {k: np.array([x[i] for i in range(len(x))]) for k, x in out.items()}

    half = of(fourier.transform(v, ["s"], half=True, block=64))
    whole = fourier.transform(v, ["s"], block=64)
    back = of(fourier.transform(whole, ["s"], inverse=True, block=64))
    for k, x in series.items():
        want = np.fft.rfft(x)
        assert half[k].shape == (len(want), 2) and np.abs(half[k] - np.stack([want, 2 * want], 1)).max() < 1e-11
        assert np.abs(back[k] - np.stack([x, 2 * x], 1)).max() < 1e-13
    assert fourier.transform(v.limit(0), ["s"], block=64).count() == 0


def test_modes_in_blocks_equal_modes_in_one_task(spark):
    """Sixteen blocks a series, more rounds than are replayed, a prime length, nulls, a null key; a short series beside them."""
    rng, t = np.random.default_rng(1), np.arange(1024)
    tones = np.sin(2 * np.pi * 0.05 * t) + 0.5 * np.sin(2 * np.pi * 0.2 * t) + 0.1 * rng.normal(size=1024)
    series = {"a": tones.tolist(), None: [None, *rng.normal(size=330).tolist()], "s": rng.normal(size=20).tolist()}
    df = frame(spark, series)
    how = {"modes": 3, "rounds": 15, "longest": 100, "block": 64}
    got = {}
    for r in modes.vmd(df, **how).collect():
        got.setdefault(r["series_id"], {})[r["row_id"]] = [r["imf1"], r["imf2"], r["imf3"]]
    centres = {(r["series_id"], r["mode"]): r["frequency"] for r in modes.centre_frequencies(df, **how).collect()}
    for k, x in series.items():
        u, w = modes.decompose(np.array([v or 0.0 for v in x]), 3, rounds=15)
        assert np.abs(np.array([got[k][i] for i in range(len(x))]).T - u).max() < 1e-9
        assert [centres[k, i] for i in (1, 2, 3)] == pytest.approx(w.tolist(), abs=1e-9)
    assert modes.vmd(df.limit(0), modes=2).count() == 0


def test_even_series_keep_their_highest_frequency():
    """A series that turns with every row is all in the last bin."""
    x = np.where(np.arange(64) % 2, -1.0, 1.0)
    u, w = modes.decompose(x, 2)
    assert w[-1] == pytest.approx(0.5) and np.linalg.norm(x - u.sum(0)) < 0.1 * np.linalg.norm(x)


def test_rounds_on_moments_equal_rounds_on_the_spectrum():
    """Hundreds of rounds, which no series of less than a band's width or with one tone upsets; a narrow and a wide filter, a quick multiplier."""
    rng, t = np.random.default_rng(3), np.arange(4000)
    for x, k, how in ((rng.exponential(size=4001), 4, {}), (np.sin(2 * np.pi * 0.05 * t), 2, {}), (rng.normal(size=5), 3, {}), (rng.normal(size=900), 3, {"alpha": 30.0}), (rng.exponential(size=900), 5, {"tau": 1.0})):
        how = {"alpha": 2000.0, "tau": 0.1} | how
        f, power, bands = np.arange(len(x) // 2 + 1) / len(x), np.abs(np.fft.rfft(x)) ** 2, modes._bands(how["alpha"])
        some, found = modes.moments(power, f, bands)
        whole = np.zeros((bands, found.shape[1]))
        whole[some] = found
        past, centres = modes.Rounds(*modes.nodes(whole, bands), k, **how).settle(1e-6, 500)
        want, last = modes.Rounds(power, f, k, **how).settle(1e-6, 500)
        assert len(past) == len(want) and np.abs(np.array(past) - want).max() < 1e-10 and np.abs(centres - last).max() < 1e-10


def test_long_series_take_few_jobs(spark):
    """However many rounds they need."""
    df = frame(spark, {"a": np.random.default_rng(4).exponential(size=500)})
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rounds", "")
    assert modes.centre_frequencies(df, modes=3, longest=100, tol=0.0, rounds=300).count() == 3
    jobs = len(seen.getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 60


def test_modes_cover_rows_that_share_a_number(spark, tmp_path):
    """Copied rows with one event_id, and a null series: the query counts each row once."""
    from sunfold.plans import queries

    rows = [(i % 40, T0 + dt.timedelta(minutes=i), 1, k, 5.0 + i % 7, '{"k": 1}') for k in ("a", None) for i in range(80)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["series_id"]: (r["n"], r["total"]) for r in queries.queries()["vmd_modes_cover"](spark, str(tmp_path)).collect()}
    assert got == {k: (80, sum(5.0 + i % 7 for i in range(80))) for k in ("a", None)}
    assert queries.queries()["vmd_diagnostics"](spark, str(tmp_path)).filter("relative_error < 1").count() == 2


def test_modes_cover_series_of_nothing(spark, tmp_path):
    """A series without any value, one of zeros, one of a single row: nothing is left of them."""
    from sunfold.plans import queries

    rows = [(i, T0 + dt.timedelta(minutes=i), 1, k, v, '{"k": 1}') for k, v, n in (("none", None, 9), ("zeros", 0.0, 9), ("one", 5.0, 1)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in queries.queries()["vmd_modes_cover"](spark, str(tmp_path)).select("series_id", "n", "total", "near").collect()}
    assert got == {("none", 9, None, True), ("zeros", 9, 0.0, True), ("one", 1, 5.0, True)}
    assert {r["series_id"]: r["max_corr"] for r in queries.queries()["vmd_diagnostics"](spark, str(tmp_path)).collect()} == {"none": 0.0, "zeros": 0.0, "one": 0.0}


def test_lengths_with_factors_plan_no_chirps(spark):
    """A plan on the driver has the transforms that its series need, beside a prime length those by chirps too."""
    x = np.random.default_rng(7).exponential(size=997).tolist()
    for series, steps in (({"a": x[:960], "s": x[:20]}, 2), ({"a": x[:960], "b": x}, 8)):
        df = modes.vmd(frame(spark, series), modes=2, rounds=5, longest=100, block=64)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == steps
        got = {(r["series_id"], r["row_id"]): [r["imf1"], r["imf2"]] for r in df.collect()}
        for k, v in series.items():
            u, _ = modes.decompose(np.array(v), 2, rounds=5)
            assert np.abs(np.array([got[k, i] for i in range(len(v))]).T - u).max() < 1e-9
