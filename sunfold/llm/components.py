"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.runtime import cut, shuffle_partitions, shuffles_dropped

_ROWS = 5000  # edges that a task gets at least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge; root is the smallest node that can be reached.

    Loops and edges with a null end are ignored; repeated edges and either direction count once; no edges give no
    rows. Each round is two aggregations and joins over the edges, which grow in no round, and is cut through the
    shared folder. Its tasks are as many as the edges need, not one for each shuffle partition. A node with many edges
    meets them in aggregates that combine before the shuffle, and in joins whose large keys Spark splits.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
    before = None
    for _ in range(rounds):
        with shuffles_dropped(now.sparkSession):
            state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state
        tasks = min(shuffle_partitions(now.sparkSession), -(-state[0] // _ROWS))
        now = now.coalesce(tasks)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").coalesce(tasks)
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b").unionAll(root.select(F.col("m").alias("a"), "b"))
        now = cut(small.coalesce(tasks).distinct().coalesce(tasks))
    raise RuntimeError(f"no fixed point after {rounds} rounds")
