"""Errors of weather states against those of a baseline state."""

import datetime as dt

import pytest

from sunfold.operators import evaluate

SCHEMA = "ts timestamp, row_id long, weather int, prediction double, target double"


def table(spark, errors):
    """errors: for each state a list, in order of time; None is a row without a prediction. Rows come in reverse."""
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=7 * i + s), 10 * i + s, s, None if e is None else 5.0 + e, 5.0) for s, x in errors.items() for i, e in enumerate(x)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


@pytest.mark.parametrize("test", ["paired_t", "wilcoxon"])
def test_a_shift_is_significant_and_noise_is_not(spark, test):
    base = [1.0 + 0.01 * (i * 37 % 50) for i in range(200)]
    worse = [-(e + 0.5 + 0.002 * (i % 7)) for i, e in enumerate(base)]
    same = [e + (0.03 if i % 2 else -0.03) for i, e in enumerate(base)]
    got = {r["weather"]: r for r in evaluate.significance_against(table(spark, {0: base, 1: worse, 2: same}), test=test, digits=9).collect()}
    assert set(got) == {1, 2} and all(r["unpaired"] == 0 and r["n"] == 200 for r in got.values())
    assert got[1]["significant"] and got[1]["p_value"] < 1e-6 and got[1]["mae"] > got[1]["baseline_mae"] + 0.5
    assert not got[2]["significant"] and got[2]["p_value"] > 0.9


def test_lengths_gaps_and_missing_states(spark):
    uneven = table(spark, {0: [1.0, None, 2.0, 4.0], 1: [2.0, 2.5]})
    (r,) = evaluate.significance_against(uneven).collect()
    assert (r["weather"], r["n"], r["unpaired"], r["mae"], r["baseline_mae"]) == (1, 2, 1, 2.25, 1.5)
    (r,) = evaluate.significance_against(table(spark, {0: [1.0, 2.0], 1: [1.0, 2.0]})).collect()
    assert r["t"] is None and r["p_value"] is None and not r["significant"]
    for alone in ({0: [1.0, 2.0]}, {1: [1.0, 2.0]}, {}):
        assert evaluate.significance_against(table(spark, alone)).collect() == []
    with pytest.raises(ValueError):
        evaluate.significance_against(uneven, test="sign")
