"""Station frames made from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measurements: a series for each event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("series_id"),
        F.col("event_id").alias("row_id"),
        "ts",
        F.col("value").alias("power"),
        (F.col("value") * 4).alias("irradiance"),
        ((F.col("user_id") * 7) % 50 - 5).cast("double").alias("temperature"),
        (F.col("event_id") % 60 + 980).cast("double").alias("pressure"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("humidity"),
    )


def pv_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pv with error markers and gaps in power."""
    i = F.col("row_id")
    gone = F.when(i % 97 == 0, F.lit(-999.0)).when((i % 11).isin(3, 4, 5) | i.between(200, 280), F.lit(None)).otherwise(F.col("power"))
    return pv(spark, sf_dir).withColumn("power", gone)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pv with a target, a prediction and a weather state."""
    i = F.col("row_id")
    return pv(spark, sf_dir).withColumns({"target": F.col("power"), "prediction": F.col("power") * 0.95 + (i % 13 - 6), "weather": (i % 3).cast("int")})


PV = """pv AS (SELECT event_type AS series_id, event_id AS row_id, ts, value AS power, value * 4 AS irradiance,
 CAST((user_id * 7) % 50 - 5 AS DOUBLE) AS temperature, CAST(event_id % 60 + 980 AS DOUBLE) AS pressure,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS humidity FROM events)"""
PV_DIRTY = PV + """, pv_dirty AS (SELECT * REPLACE (CASE WHEN row_id % 97 = 0 THEN -999.0::DOUBLE
 WHEN row_id % 11 IN (3, 4, 5) OR row_id BETWEEN 200 AND 280 THEN NULL ELSE power END AS power) FROM pv)"""
PRED = PV + """, pred AS (SELECT *, power AS target, power * 0.95::DOUBLE + (row_id % 13 - 6) AS prediction, CAST(row_id % 3 AS INTEGER) AS weather FROM pv)"""
