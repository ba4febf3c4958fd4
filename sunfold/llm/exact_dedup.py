"""Exact deduplication as a stateful stream.

A streaming aggregation keeps, for each digest of a normalised text, the row that stays, with its identifier and
the place of its content (file and row), and the number of rows so far. The state has no watermark, so no entry
ever expires, and lives in RocksDB on the executors' disks, with its changes in the checkpoint folder: a lost
executor's share is loaded elsewhere. Rows with equal digests are combined before the shuffle, so a text that fills
a third of the table is no hot key. The texts never enter the state. Where a digest was met again, the full bytes of
all its rows are compared, again by combining: they are equal just if the least and the greatest text are the same.
Should texts of a digest differ, they are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfold.runtime import cut, scratch_path, shuffle_partitions

_STREAM = "spark.sql.streaming.stateStore."
#: Settings of the stream: state in RocksDB, changes in the checkpoint folder, no disk space taken in advance by each of its many small stores.
_STORE = {_STREAM + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _STREAM + "rocksdb.changelogCheckpointing.enabled": "true", _STREAM + "rocksdb.allowFAllocate": "false"}
#: Digests met more than once that may be sent to every task, where their rows are looked up.
MOST_SENT = 500_000
#: A group of so many rows meets its keeper in several places, since one would be hot.
LARGE = 256


def normalised(text: Column) -> Column:
    """The text without white space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _facts(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    plain = normalised(docs[text])
    origin = docs.metadataColumn("_metadata")  # the reader's, even if the table has a column of that name
    place = F.struct(origin["file_path"].alias("file"), origin["row_index"].alias("row"))
    return docs.select(docs[key].alias("key"), F.char_length(F.coalesce(docs[text], F.lit(""))).alias("length"), digest(plain).alias("digest"), place.alias("place"), plain.alias("plain"))


def _rank() -> Column:
    """Greatest for the row that stays: most code points, then smallest key, then a place."""
    return F.struct("length", F.expr("~key").alias("order"), "key", "place")


def stream_states(stream: DataFrame, folder: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Run the stream over all that is there now; (digest, best, n) for each digest of it and of earlier runs with the same folder.

    best has the length, key and place (file, row) of the row that stays. A batch that is run again overwrites what it wrote."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        state = _facts(stream, key, text, digest).groupBy("digest").agg(F.max(_rank()).alias("best"), F.count("*").alias("n"))
        write = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        write.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/states/batch={i}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    states = spark.read.schema("digest string, best struct<length int, order bigint, key bigint, place struct<file string, row bigint>>, n bigint, batch bigint").parquet(f"{folder}/states")
    return states.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")


def exact_duplicates(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For every row of the Parquet table at path: key, keep_id, group_size, kept, text_sha256, and keep_file and keep_row,
    where the text that stays is found.

    Texts are equal when their characters other than white space are; a null text is empty, and empty texts are
    equal. Of equal texts the one with most code points stays, then the smallest key; a null key comes last. Of
    repeated rows one is kept. The key is a bigint. Other columns are not read. An empty table gives an empty result.
    `folder` holds the stream's state; a later call with the same folder and more files continues it.
    """
    folder = folder or scratch_path(spark, "exact-dedup")
    docs = spark.read.parquet(path)
    path = path.rstrip("/")
    just = f"{path[:-1]}[{path[-1]}]"  # a pattern for just this path: a stream reads a pattern's files, but not a plain file
    states = stream_states(spark.readStream.schema(docs.schema).parquet(just), folder, key, text, digest)
    facts = _facts(docs, key, text, digest)
    again = cut(states.filter("n > 1").select("digest"))
    hits = facts.join(F.broadcast(again) if again.count() <= MOST_SENT else again, "digest", "left_semi")
    differ = cut(hits.groupBy("digest").agg(F.min("plain").alias("least"), F.max("plain").alias("most")).filter("least <> most").select("digest"))

    salts = shuffle_partitions(spark)

    def named(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        kept = F.col("best.place") == F.col("place")
        large = cut(groups.filter(F.col("n") >= LARGE).select("digest").distinct())
        if 0 < large.count() <= MOST_SENT:
            to = F.when(F.col("__large"), F.pmod(F.xxhash64("place"), F.lit(salts))).otherwise(0)
            sent = F.broadcast(large.withColumn("__large", F.lit(True)))
            rows = rows.join(sent, "digest", "left").withColumn("__to", to).drop("__large")
            last = F.when(F.col("__large"), salts - 1).otherwise(0).cast("long")
            groups = groups.join(sent, "digest", "left").withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__large")
            on = [*on, "__to"]
        return rows.join(groups, on).select(F.col("key").alias(key), F.col("best.key").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), F.col("best.place.file").alias("keep_file"), F.col("best.place.row").alias("keep_row"))

    rows = facts.withColumn("sha", sha256(F.col("plain")))
    light = rows.drop("plain")
    if differ.isEmpty():
        return named(light, states, ["digest"])
    apart = rows.join(differ, "digest", "left_semi")
    groups = apart.groupBy("digest", "plain").agg(F.max(_rank()).alias("best"), F.count("*").alias("n"))
    same = light.join(differ, "digest", "left_anti")
    return named(same, states, ["digest"]).unionAll(named(apart, groups, ["digest", "plain"]))
