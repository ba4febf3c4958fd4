"""Eigenvectors and projections against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunfold.operators import graph


def dense(lap):
    rows = lap.collect()
    at = {k: i for i, k in enumerate(sorted({r["src"] for r in rows}))}
    m = np.zeros((len(at), len(at)))
    for r in rows:
        m[at[r["src"]], at[r["dst"]]] = r["l"]
    return m, at


def test_eigenvectors_equal_a_dense_solution(spark, small):
    """The graph of neighbours of a whole table: values, residuals, orthonormal vectors, and a projection learnt on them."""
    x = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    lap = graph.cut(graph.laplacian(graph.similarity(graph.knn_edges(x, key="id", vector="v"), mode="union")))
    m, at = dense(lap)
    want = np.linalg.eigvalsh(m)[:3]
    found = graph.smallest_eigenvectors(lap, 3)
    assert found.values == pytest.approx(want, abs=1e-6) and found.residuals.max() <= 1e-5
    f = np.zeros((len(at), 3))
    for r in found.vectors.collect():
        f[at[r["node"]]] = r["f"]
    assert np.abs(f.T @ f - np.eye(3)).max() < 1e-8 and np.abs(m @ f - f * found.values).max() < 1e-5


def test_eigenvectors_of_parts_and_few_nodes(spark):
    """A graph in three parts has three zeros; there are no more vectors than nodes; none of no graph."""
    edges = [(0, 1), (1, 2), (0, 2), (10, 11), (20, 21), (21, 22)]
    g = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "src long, dst long, w double")
    lap = graph.laplacian(g)
    found = graph.smallest_eigenvectors(lap, 4, more=0)
    assert found.values == pytest.approx(np.linalg.eigvalsh(dense(lap)[0])[:4], abs=1e-6)
    assert len(graph.smallest_eigenvectors(lap, 50).values) == 8
    assert graph.smallest_eigenvectors(lap.limit(0), 3).vectors.count() == 0
    with pytest.raises(RuntimeError):
        graph.smallest_eigenvectors(lap, 4, tol=0.0, rounds=0, more=0)


def test_rules_that_stop_a_projection():
    why = lambda c, o=(): graph.stop_reason(c, o or [1.0 / (i + 1) for i in range(len(c))], 1e-5)
    assert why([1.0, 1e-6]) == "converged" and why([1.0, 1.0]) == ""
    assert why([1.0] * 6, [1.0] * 6) == "objective stands still" and why([1.0] * 5, [1.0] * 5) == ""
    assert why([1.0, 5e-5, 5e-5, 5e-5]) == "small changes" and why([5e-5, 5e-5, 5e-5]) == ""
    assert why([1.0] * 20 + [4e-4]) == "converged slowly" and why([1.0] * 19 + [4e-4]) == ""


def test_projection_objective_falls(spark):
    """Against the objective of dense matrices."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    lap = graph.cut(graph.laplacian(graph.similarity(graph.knn_edges(rows, 5, key="id", vector="v"), mode="union")))
    p = graph.learn_projection(rows, lap, 2, alpha=0.5, beta=0.01)
    m, _ = dense(lap)
    f = np.linalg.eigh(m)[1][:, :2]
    first = np.trace(f.T @ m @ f)
    assert p.matrix.shape == (4, 2) and np.abs(p.matrix).sum() > 0 and p.stopped
    assert p.objectives[0] < first + 0.5 * 2 and p.values == pytest.approx(np.linalg.eigvalsh(m)[:2], abs=1e-6)
    assert p.objectives[-1] <= p.objectives[0]


@pytest.mark.parametrize(("block", "pivots"), [(None, None), (16, 9), (7, 40)])
def test_neighbours_equal_brute_force(spark, block, pivots):
    """Copies, ties, a crowd in one place that fills several blocks, a null vector, fewer rows than neighbours."""
    rng = np.random.default_rng(block or 1)
    x = np.r_[rng.normal(size=(120, 2)).round(1), rng.normal(size=(60, 2)) * 0.01 + 30, np.zeros((50, 2))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph.knn_edges(df, 4, block=block, pivots=pivots).collect():
        got.setdefault(r["src"], []).append((r["place"], r["d2"], r["dst"]))
    d = graph._distances(x, x)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = [(p + 1, d[i, j], j) for p, j in enumerate(np.argsort(d[i], kind="stable")[:4])]
        assert sorted(got[i]) == want
    assert set(got) == set(range(len(x)))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert graph.knn_edges(few, 4, block=block, pivots=pivots).count() == 6
    assert graph.knn_edges(few.limit(0), 4).count() == 0


def test_neighbours_of_structured_vectors_meet_few_others(spark):
    """The share of pairs that must meet falls as rows grow, where vectors have few dimensions."""
    rng = np.random.default_rng(2)
    share = []
    for n in (400, 6400):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.random(size=(n, 2)))], "vec_id long, embedding array<double>")
        share.append(graph.cells(df, 5).share)
    assert share[1] < 0.5 * share[0]


def test_ring_of_suppliers_whose_keys_leave_gaps(spark, tmp_path):
    """Values that lie close together at the low end, of suppliers whose keys are not one run."""
    from sunfold.plans import queries

    n, s = 1000, 10
    spark.range(n).select((F.col("id") % 100 + F.expr("id div 100") * 1_000_000 + 1).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries.queries()["ring_eigenvalues"](spark, str(tmp_path)).sort("place").collect()
    k = np.arange(n)
    want = np.sort(1 - sum(np.cos(2 * np.pi * k * o / n) for o in (1, s, s * s)) / 3)[:5]
    assert [r["value"] for r in got] == pytest.approx(want.tolist(), abs=2e-6) and all(r["orthonormal"] for r in got)


def test_eigenvectors_near_the_bulk_take_few_products(spark, small):
    """Vectors without structure, whose second and third values lie close to all others: products must not go by the hundred."""
    x = spark.read.parquet(f"{small}/embeddings.parquet")
    found = graph.smallest_eigenvectors(graph.laplacian(graph.similarity(graph.knn_edges(x), mode="union")), 3)
    assert found.residuals.max() <= 1e-5 and found.products <= 60


def test_projection_makes_its_graph_once(spark):
    """Making the Laplacian may be most of the work: each of its rows is made once only, for eigenvectors and projection."""
    edges = [(i, (i + o) % 30) for i in range(30) for o in (1, 4)]
    g = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "src long, dst long, w double")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    lap = graph.cut(graph.laplacian(g))
    rows = spark.createDataFrame([(i, [float(np.sin(i * j)) for j in range(1, 5)]) for i in range(30)], "id long, v array<double>")
    graph.learn_projection(rows, lap.mapInPandas(counted, lap.schema), 2, alpha=0.5, beta=0.01)
    assert made.value == lap.count()


def test_neighbours_among_large_groups_of_copies(spark):
    """Copies count as neighbours by id, are compared once for each point, and may be more than a task compares; keys are strings."""
    rng = np.random.default_rng(8)
    x = np.r_[np.zeros((300, 3)), np.repeat(rng.normal(size=(4, 3)), 3, axis=0), rng.normal(size=(40, 3))]
    names = [f"n{i:04}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame(list(zip(names, x.tolist(), strict=True)), "vec_id string, embedding array<double>")
    got = {}
    for r in graph.knn_edges(df, 5, block=16).collect():
        got.setdefault(r["src"], []).append((r["place"], r["dst"]))
    d = graph._distances(x, x)
    np.fill_diagonal(d, np.inf)
    for i, name in enumerate(names):
        assert sorted(got[name]) == [(p + 1, b) for p, (_, b) in enumerate(sorted(zip(d[i], names, strict=True))[:5])]
