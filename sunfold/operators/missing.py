"""Missing values: interpolation and fills with a limit for each gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, carried


def fill(df: DataFrame, column: str, method: str = "linear", limit: int = 6, rest: bool = True, series: str = SERIES) -> DataFrame:
    """df with rn and the gaps of `column` filled within each series, by position.

    linear: on the line between the neighbours, for the first `limit` rows of a gap; behind the last value, that value.
    forward, backward: the neighbour's value, for `limit` rows. With `rest`, what is left takes the value before it as
    filled, or else the value after it; without, it stays null."""
    rows = carried(df, column, series)
    i, p, a, q, b = F.col("rn"), F.col("prev_at"), F.col("prev"), F.col("next_at"), F.col("next")
    ahead, behind = i - p, q - i
    if method == "linear":
        line = lambda k: F.when(q.isNull(), a).otherwise(a + (b - a) * k / (q - p))
        near, far = F.when(ahead <= limit, line(ahead)), line(F.lit(limit))
    elif method == "forward":
        near = F.when(ahead <= limit, a)
        far = a
    elif method == "backward":
        near = F.when(behind <= limit, b)
        # rows before the filled end of a gap take the value in front of it
        far = a
    else:
        raise ValueError(f"unknown method {method}")
    value = F.coalesce(F.col(column), near)
    if rest:
        value = F.coalesce(value, F.when(p.isNotNull(), far), b)
    return rows.withColumn(column, value).drop("prev_at", "prev", "next_at", "next")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every one of the columns."""
    return df.na.drop("any", subset=list(columns))
