"""Every query of the core against its SQL on the smallest tables."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from sunfold.plans import queries as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"nca_weights"}  # covered by unit tests of its parts


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def rows(values, order):
    return sorted((tuple(0.0 if v == 0 else v for v in (r[i] for i in order)) for r in values), key=repr)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in SLOW])
def test_query(spark, duck, small, name):
    df = registry.queries()[name](spark, small)
    names = sorted(df.columns)
    got = rows(df.collect(), [df.columns.index(n) for n in names])
    if name not in registry.oracle_sql():
        assert got
        return
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    assert got == rows(want.fetchall(), [want.columns.index(n) for n in names])


def test_levels_of_means_just_on_a_threshold(spark, tmp_path):
    """Errors whose mean over any hundred rows is 3.4 or 3.6 but for rounding."""
    rng, rows = np.random.default_rng(5), []
    for series in range(8):
        p = rng.integers(6000, 8000, 100)
        p += (68 + series % 2 * 4) * 100 - p.sum() // 100
        p[0] -= p.sum() % 100
        rows += [(13 * i + 6 + 13_000 * series, dt.datetime(2024, 6, 1) + dt.timedelta(seconds=i), 1, str(series), float(p[i % 100]) / 100, '{"k": 1}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("adaptation_triggers", "rolling_error_stats"):
        df = registry.queries()[name](spark, str(tmp_path))
        names = [r[0] for r in c.execute(f"DESCRIBE {registry.oracle_sql()[name]}").fetchall()]
        assert rows_of(df, names) == sorted(map(tuple, c.execute(registry.oracle_sql()[name]).fetchall()), key=repr)


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
