"""The session that jobs of this package start with, unless they bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sunfold", **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC times, checkpoints that go with what they hold, and whatever else `conf` sets (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
