"""Streams: error monitoring with state, online learning, log tailing, regular grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sunfold.sources.logs import growing_lines


def error_monitor(stream: DataFrame, key: str = "series_id", p: str = "prediction", t: str = "target", window: int = 100, recent: int = 20, mean_at: float = 0.1, std_at: float = 0.15, trend_at: float = 0.05, late_at: float = 0.08) -> DataFrame:
    """(key, n, mean, std, trend, level) for each key and micro-batch that has rows of it.

    State, for each key: the last `window` absolute errors and four counters, whatever the stream's length."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, means, counts = (list(x) for x in state.get) if state.exists else ([], [], [0, 0, 0])
        for b in batches:
            errors += (b[p] - b[t]).abs().dropna().tolist()
        errors = errors[-window:]
        if not errors:
            state.update((errors, means, counts))
            return
        mean, std = float(np.mean(errors)), float(np.std(errors, ddof=1)) if len(errors) > 1 else 0.0
        trend = 0.0
        if len(errors) > recent:
            old = float(np.mean(errors[:-recent]))
            trend = (float(np.mean(errors[-recent:])) - old) / (old + 1e-10)
        hits = (mean > mean_at, std > std_at, abs(trend) > trend_at)
        counts = [c + 1 if h else 0 for c, h in zip(counts, hits, strict=True)]
        means = [*means, mean][-5:]
        late = len(means) == 5 and sum(m > late_at for m in means) >= 4
        level = 4 if late else 3 if counts[2] >= 2 else 2 if counts[1] >= 2 else 1 if counts[0] >= 3 else 0
        state.update((errors, means, counts))
        yield pd.DataFrame({key: [k[0]], "n": [len(errors)], "mean": [mean], "std": [std], "trend": [trend], "level": [level]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n long, mean double, std double, trend double, level int", "errors array<double>, means array<double>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def online_learner(stream: DataFrame, learn: Callable[[DataFrame, int], None], checkpoint: str, most: int | None = None) -> StreamingQuery:
    """Calls learn(batch, number) on each micro-batch over what is there now; with `most`, on the first so many."""

    def each(df: DataFrame, i: int) -> None:
        if most is None or i < most:
            learn(df, i)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (file, epoch, loss) from lines of experiment logs as they grow; each line is read once, when it has ended."""
    return parsed_log(growing_lines(spark, folder))


def parsed_log(lines: DataFrame) -> DataFrame:
    """(file, epoch, loss) of the lines (value, file) that state them."""
    epoch = F.regexp_extract("value", r"(?i)epoch\D{0,3}(\d+)", 1)
    loss = F.regexp_extract("value", r"(?i)loss\D{0,3}([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1)
    return lines.filter((epoch != "") & (loss != "")).select("file", epoch.cast("int").alias("epoch"), loss.cast("double").alias("loss"))


def regular_grid(stream: DataFrame, minutes: int = 15, late: str = "1 hour", columns: tuple[str, ...] = ("power",), series: str = "series_id") -> DataFrame:
    """(series, ts, means) on a grid of `minutes`; rows later than `late` are left out."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = timed.groupBy(series, F.window("ts", f"{minutes} minutes")).agg(*(F.avg(c).alias(c) for c in columns))
    return got.select(series, F.col("window.start").alias("ts"), *columns)
