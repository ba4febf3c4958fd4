"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

A line's ratio is the share of its host's pages that contain it. The ratios of a host's lines add up to its mean
number of distinct lines a page, so that at most that mean over `ratio` lines of a host can exceed the ratio: the
lists of lines to drop stay short whatever the number of pages. They are found in two passes: counts by host and
line hash, combined before the shuffle, name the candidates (collisions can only add some), and counts of the
candidates' texts decide. A third pass drops the lines; no text of a page is shuffled while the lists are small
enough to send to every task, which is checked, and pages are dealt out by salted host where they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunfold.runtime import cut, shuffle_partitions

#: Entries of all hosts' lists that may be sent to every task.
MOST_SENT = 200_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _with_lists(docs: DataFrame, lists: DataFrame, entries: int) -> DataFrame:
    """docs joined, on __host, to the row of `lists` of its host; docs of hosts without one have nulls."""
    if entries <= MOST_SENT:
        return docs.join(F.broadcast(lists), F.col("__host").eqNullSafe(F.col("__of")), "left").drop("__of")
    salts = shuffle_partitions(docs.sparkSession)
    salted = docs.withColumn("__salt", F.pmod(F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith("map"))), F.lit(salts)))
    spread = lists.withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = F.col("__host").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__to"))
    return salted.join(spread, both, "left").drop("__of", "__salt", "__to")


def drop_boilerplate_lines(docs: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 5, dropped: str = "lines_dropped", keep_copies: bool = False) -> DataFrame:
    """docs with `text` freed of the lines that more than `ratio` and at least `min_pages` of their host's pages
    contain, and the number of lines dropped (long).

    Lines end at \\n and are compared without spaces at their ends; lines without other characters are never
    dropped and count for nothing. On a small site a line of one or two pages exceeds any ratio, so that a line counts as
    repeated from `min_pages` on. A page with nothing else becomes a text without words. keep_copies: it keeps its text
    instead, for it is a copy among many, which another step is to judge. A null text stays null; a null host is a host. Repeated rows
    are pages of their own. A column of docs named like `dropped` is replaced; others are carried, whatever their
    names. An empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c != dropped or c == text]
    pages = docs.select(F.struct(*(docs[f"`{c}`"] for c in columns)).alias("__row"), (F.col(host) if isinstance(host, str) else host).cast("string").alias("__host"), F.col(text).alias("__text"))
    light = pages.select("__host", F.array_distinct(F.transform(_lines("__text"), lambda x: F.trim(x))).alias("__lines"))
    totals = light.groupBy(F.col("__host").alias("__of")).agg(F.count("*").alias("__pages"))
    hashed = light.select("__host", F.explode("__lines").alias("__line")).filter("__line <> ''").groupBy("__host", F.xxhash64("__line").alias("__hash")).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_pages)
    frequent = F.col("__n") > F.lit(float(ratio)) * F.col("__pages")
    same = F.col("__host").eqNullSafe(F.col("__of"))
    candidates = cut(hashed.join(totals, same).filter(frequent).select("__of", "__hash", "__pages"))
    lists = candidates.groupBy("__of", "__pages").agg(F.collect_set("__hash").alias("__hashes"))
    found = _with_lists(light, lists, candidates.count()).filter("__hashes is not null")
    found = found.select("__host", "__pages", F.explode(F.filter("__lines", lambda x: F.array_contains(F.col("__hashes"), F.xxhash64(x)))).alias("__line"))
    exact = found.filter("__line <> ''").groupBy("__host", "__pages", "__line").agg(F.count("*").alias("__n")).filter((F.col("__n") >= min_pages) & frequent)
    exact = cut(exact.select(F.col("__host").alias("__of"), "__line"))
    bad = exact.groupBy("__of").agg(F.collect_set("__line").alias("__bad"))
    out = _with_lists(pages, bad, exact.count()).withColumn("__all", _lines("__text"))
    kept = F.filter("__all", lambda x: ~F.array_contains(F.col("__bad"), F.trim(x)))
    out = out.withColumn("__kept", F.when(F.col("__bad").isNotNull(), kept))
    changed = F.col("__kept").isNotNull()
    if keep_copies:
        changed &= F.exists("__kept", lambda x: F.trim(x) != "")
    new = F.when(changed, F.array_join("__kept", "\n")).otherwise(F.col("__text"))
    number = F.when(changed, F.size("__all") - F.size("__kept")).otherwise(F.lit(0)).cast("long")
    return out.select(*((new if c == text else F.col(f"__row.`{c}`")).alias(c) for c in columns), number.alias(dropped))


#: DuckDB SQL with the rows of op7.
SQL = """
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
uses AS (SELECT source, line, count(*) AS n FROM
  (SELECT source, unnest(list_distinct([trim(x, ' ') for x in lines])) AS line FROM pages) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT u.source, list(u.line) AS bad FROM uses u JOIN totals t ON u.source IS NOT DISTINCT FROM t.source
  WHERE u.n >= 5 AND u.n > 0.05::DOUBLE * t.pages GROUP BY u.source),
cleaned AS (SELECT p.*, CASE WHEN b.bad IS NULL THEN NULL ELSE [x for x in lines if NOT list_contains(b.bad, trim(x, ' '))] END AS kept
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source),
judged AS (SELECT *, kept IS NOT NULL AS changed FROM cleaned)
SELECT doc_id, source, CASE WHEN changed THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  CASE WHEN changed THEN len(lines) - len(kept) ELSE 0 END::BIGINT AS lines_dropped FROM judged
"""
