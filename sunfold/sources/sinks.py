"""Tables, JSON and reports that jobs leave behind."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, in folders by the columns `by`, which readers prune."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_splits(split: DataFrame, folder: str, formats: Sequence[str] = ("parquet",)) -> None:
    """A split frame in each format, in folders by split, and the splits' ranges as JSON."""
    from sunfold.operators.split import split_ranges

    for f in formats:
        out = split.write.mode("overwrite").partitionBy("split")
        (out.option("header", True).csv if f == "csv" else out.parquet)(f"{folder}/{f}")
    write_json(split_ranges(split), f"{folder}/split_info")


def write_json(df: DataFrame, path: str) -> None:
    """A small report as one JSON file in a folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_params(spark: SparkSession, params: Mapping, path: str) -> None:
    """Learnt parameters as one JSON line, through Spark, so that any store will do."""
    spark.range(1).select(F.lit(json.dumps(params)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    """Parameters that write_params wrote."""
    return json.loads(spark.read.text(path).first()[0])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A report that write_json wrote, such as split or fold ranges."""
    return spark.read.json(path)


def write_merged(df: DataFrame, folder: str) -> None:
    """A merged frame as Parquet, and (station, rows, first, last) of its stations as JSON."""
    df.write.mode("overwrite").parquet(f"{folder}/data")
    write_json(df.groupBy("station").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")), f"{folder}/metadata")


def write_predictions(df: DataFrame, path: str, p: str = "prediction", t: str = "target") -> None:
    """Keys, predictions, targets and errors, in folders by weather where there is one."""
    keys = [c for c in ("series_id", "ts", "row_id", "fold", "weather") if c in df.columns]
    out = df.select(*keys, F.col(p).alias("prediction"), F.col(t).alias("target"), (F.col(p) - F.col(t)).alias("error"))
    write_table(out, path, [c for c in ("weather",) if c in keys])


def append_history(got: DataFrame, path: str, **when) -> None:
    """Rows of metrics added to a CSV history, with the columns that say when (such as epoch)."""
    got.select(*(F.lit(v).alias(k) for k, v in when.items()), *got.columns).coalesce(1).write.mode("append").option("header", True).csv(path)


def checkpoints(spark: SparkSession, folder: str, latest: int | None = None) -> DataFrame:
    """(path, bytes, modified, sha256) of the saved files under folder, the latest first, at most `latest` of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    out = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")).orderBy(F.desc("modified"), "path")
    return out if latest is None else out.limit(latest)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files that were added, removed or changed between two lists of checkpoints."""
    both = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def metrics_json(got: DataFrame) -> DataFrame:
    """Rows of metrics as JSON texts."""
    return got.select(F.to_json(F.struct(*got.columns)).alias("value"))


def markdown_report(got: DataFrame, title: str = "Results") -> str:
    """A table of metrics as Markdown; `got` has a row for each class, fold or run, all of which the driver writes."""
    rows = got.collect()
    head = got.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows:
        lines.append("| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


def html_report(got: DataFrame, title: str = "Results") -> str:
    """The same as HTML, with grades' names as classes."""
    from html import escape

    cells = lambda r, t: "".join(f"<{t}{f' class={v}' if v in ('good', 'normal', 'bad') else ''}>{escape(f'{v:.4g}' if isinstance(v, float) else str(v))}</{t}>" for v in r)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in got.collect())
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{cells(got.columns, 'th')}</tr>{body}</table></body></html>"
