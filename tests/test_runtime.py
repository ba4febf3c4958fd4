"""What cutting lineage and rounds over small tables leave on disk and ask of Spark."""

import os

from pyspark.sql import functions as F

from sunfold.llm.components import connected_components
from sunfold.runtime import _CLEANUP, cut


def _shuffle_files(spark):
    """Of the driver's block manager, which is the only one in local mode."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    before, conf = _shuffle_files(spark), spark.conf.get(_CLEANUP)
    got = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert got.agg(F.sum("count")).first()[0] == 1000
    mine = {f for f in _shuffle_files(spark) - before if f.endswith(".data")}
    assert len(mine) <= 1  # of the sum above, not of the cut frame
    assert spark.conf.get(_CLEANUP) == conf


def test_components_of_few_edges_take_few_tasks(spark):
    parts, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.range(1, 120).select((F.col("id") - 1).alias("a"), F.col("id").alias("b")).filter("b % 60 <> 0")
        got = connected_components(chain)
        assert {tuple(r) for r in got.collect()} == {(i, i // 60 * 60) for i in range(120)}
        assert got.rdd.getNumPartitions() <= 1 + 40  # the edges' one task, and the distinct roots' own exchange
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
