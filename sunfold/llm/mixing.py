"""Mixing sources to target weights, in DataFrame operations only.

The words of each source form one stream, cut into blocks of fixed length. The mix is a list of slots in shards of
fixed size: each shard draws multinomial source counts, the draws are brought to the sources' exact quotas (slots
drawn beyond a quota go, in order, to the sources left short), a source's slots are numbered through all shards,
and a pseudorandom permutation of the source's block numbers, one for each pass over the source, says which block
a slot takes. Slots and blocks then meet in a join by source and block number.

Positions in the streams and slot numbers are prefix sums in two levels, over hashed buckets of rows and over the
table of bucket sums, so that a source of any share of the rows is spread over all tasks. The table of sources is
on the driver: it is a setting like the weights, and more than `max_sources` of them raise ValueError.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfold.runtime import cut, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 24


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """share * sum(sizes) split by weight, no part above most * its size; what is cut off goes to the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if level * weight[i] >= most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else level * weight[i]
        left -= sum(out[i] for i in full)
        open_ = open_ - full if full else set()
    return out


def _permuted(x: Column, n: Column, key: Sequence[Column], back: bool = False) -> Column:
    """x's place in a pseudorandom permutation of 0..n-1: rounds that swap x with a mirrored place, or don't, by a hash
    that both places share. back: the inverse."""

    def step(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *key), n) + n - v, n)
        return F.when(F.xxhash64(F.lit(2), r, F.greatest(v, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(v)

    order = [F.lit(r) for r in (range(_ROUNDS)[::-1] if back else range(_ROUNDS))]
    return F.aggregate(F.array(*order), x.cast("long"), step)


def _of(values: Sequence, at: Column, kind: str = "bigint") -> Column:
    return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), at + 1)


def _prefix(df: DataFrame, by: Sequence[str], group: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before, within `by`, in two levels: groups by number, then rows by order."""
    sums = df.groupBy(*by, group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, group, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*by, group]).withColumn(name, F.col("__base") + F.col("__before")).drop("__base", "__before")


class Mix:
    """A mix of docs. `taken()` says how much of each document it takes; `documents()` has the texts.

    A null or empty text has no words and is never taken; a null source is a source, the last in order. Repeated
    rows are documents of their own. Keys may be null or repeat. An empty table gives an empty mix. Other columns
    of docs are carried by `documents()`, whatever their names. Equal inputs give equal mixes, in whatever order
    and partitions their rows come.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_slots: int = 1024, seed: int = 42, max_sources: int = 10_000):
        self.docs, self.text, self.block, self.shard, self.seed = docs, text, block_words, shard_slots, seed
        spark = docs.sparkSession
        self.parts = shuffle_partitions(spark)
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        self.rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(key, text).alias("order"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
        self.rows = self.rows.withColumn("bucket", F.pmod("order", F.lit(4 * self.parts)))
        light = cut(self.rows.drop("row"))
        found = light.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sources, self.sizes = [r.source for r in found], [r["size"] for r in found]
        self.targets = targets(self.sizes, weights, share, most)
        self.light = light
        self.blocks = [-(-n // block_words) for n in self.sizes]
        self._quotas(spark)

    def _numbered(self, df: DataFrame) -> DataFrame:
        """df with its source's number."""
        names = {s: i for i, s in enumerate(self.sources) if s is not None}
        known = F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("source")) if names else F.lit(None)
        return df.withColumn("k", F.coalesce(F.when(F.col("source").isNotNull(), known), F.lit(len(self.sources) - 1)).cast("int"))

    def _spans(self, rows: DataFrame) -> DataFrame:
        """Each row's first word in its source's stream: start."""
        return _prefix(self._numbered(rows), ["k"], "bucket", [F.col("order"), F.col("size")], "size", "start")

    def _quotas(self, spark) -> None:
        """Slots for each source, and the words that its last slot leaves out, so that it takes its target to the word."""
        goal = [round(t) for t in self.targets]
        turn = [g // n if n else 0 for g, n in zip(goal, self.sizes, strict=True)]
        self.slots, self.trim = [0] * len(goal), [0] * len(goal)
        if not any(goal):
            return
        k = F.col("id").cast("int")
        n = F.greatest(_of(self.blocks, k), F.lit(1))
        short = spark.range(len(goal)).select("id", _permuted(n - 1, n, self._key(k, _of(turn, k)), back=True).alias("at")).collect()
        for i, at in short:
            words, block = goal[i] - turn[i] * self.sizes[i], self.block
            less = self.blocks[i] * block - self.sizes[i]  # that the source's last block falls short
            some = -(-words // block)
            if some > at:  # the short block is among them
                some = max(at + 1, -(-(words + less) // block))
            got = some * block - less * (some > at)
            self.slots[i], self.trim[i] = turn[i] * self.blocks[i] + some, max(0, got - words)

    def _key(self, k: Column, turn: Column) -> list[Column]:
        return [F.lit(self.seed), k, turn]

    def draws(self) -> DataFrame:
        """The mix: (shard, slot, k, turn, block, leave): leave is how many words of the block's end are left out."""
        spark, total = self.docs.sparkSession, sum(self.slots)
        upto = [sum(self.slots[: i + 1]) for i in range(len(self.slots))]
        u = F.xxhash64(F.lit(self.seed), F.lit("slot"), "slot").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        drawn = spark.range(0, total, 1, self.parts).select(F.col("id").alias("slot"), F.expr(f"id div {self.shard}").alias("shard"))
        drawn = drawn.withColumn("u", (u * total).cast("long"))
        drawn = drawn.withColumn("k", F.size(F.filter(F.array(*map(F.lit, upto or [0])).cast("array<bigint>"), lambda c: c <= F.col("u")))).drop("u")
        counts = drawn.groupBy("shard", "k").agg(F.count("*").alias("n")).withColumn("range", F.expr("shard div 1024"))
        counts = cut(counts)
        offset = _prefix(counts, ["k"], "range", [F.col("shard")], "n", "first").select("shard", "k", "first")
        got = dict(counts.groupBy("k").agg(F.sum("n")).collect())
        got = [got.get(i, 0) for i in range(len(self.slots))]
        over = [max(0, g - q) for g, q in zip(got, self.slots, strict=True)]
        short = [max(0, q - g) for g, q in zip(got, self.slots, strict=True)]
        over_at = [sum(over[:i]) for i in range(len(over))]
        short_to = [sum(short[: i + 1]) for i in range(len(short))]
        drawn = drawn.repartition(self.parts, "shard", "k")  # slots are light but cost hashing, so they stay on as many tasks
        rank = F.col("first") + F.row_number().over(Window.partitionBy("shard", "k").orderBy("slot")) - 1
        out = drawn.join(offset, ["shard", "k"]).select("slot", "shard", "k", rank.alias("rank"))
        extra = _of(over_at, F.col("k")) + F.col("rank") - _of(self.slots, F.col("k"))
        other = F.size(F.filter(F.array(*map(F.lit, short_to)).cast("array<bigint>"), lambda c: c <= extra))
        moved = F.col("rank") >= _of(self.slots, F.col("k"))
        out = out.withColumn("to", F.when(moved, other).otherwise(F.col("k")))
        base = [g - (t - s) for g, t, s in zip(got, short_to, short, strict=True)]
        out = out.select("shard", "slot", F.col("to").alias("k"), F.when(moved, extra + _of(base, F.col("to"))).otherwise(F.col("rank")).alias("rank"))
        n, k = _of(self.blocks, F.col("k")), F.col("k")
        turn = F.expr("rank div n")
        last = F.col("rank") == _of(self.slots, k) - 1
        out = out.withColumn("n", n).withColumn("turn", turn)
        return out.select("shard", "slot", "k", "turn", _permuted(F.col("rank") % F.col("n"), F.col("n"), self._key(k, F.col("turn"))).alias("block"), F.when(last, _of(self.trim, k)).otherwise(F.lit(0)).alias("leave"))

    def _pieces(self, spans: DataFrame) -> DataFrame:
        """(k, start, turn, at, n): for each document and pass the runs of its words that the mix takes, by blocks."""
        b = self.block
        cutted = spans.filter("size > 0").select("k", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        lo = F.greatest(F.col("start"), F.col("block") * b)
        used = self.draws().select("k", "turn", "block", "leave")
        joined = cutted.join(used, ["k", "block"])
        end = F.least(F.col("block") * b + b, _of(self.sizes, F.col("k"))) - F.col("leave")
        return joined.select("k", "start", "turn", (lo - F.col("start")).alias("at"), (F.least(F.col("start") + F.col("size"), end) - lo).alias("n")).filter("n > 0")

    def taken(self, key: str = "doc_id") -> DataFrame:
        """(key, size, source_size, target, taken) for every row of docs."""
        if not self.sources:
            return self.light.select(F.col("key").alias(key), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
        spans = cut(self._spans(self.light))
        sums = self._pieces(spans).groupBy("k", "start").agg(F.sum("n").alias("taken"))
        out = spans.join(sums, ["k", "start"], "left")
        taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
        return out.select(F.col("key").alias(key), "size", _of(self.sizes, F.col("k")).alias("source_size"), _of(self.targets, F.col("k"), "double").alias("target"), taken.alias("taken"))

    def documents(self) -> DataFrame:
        """The mixed documents, with the columns of docs: a row for each pass in which a document is taken. A document
        that is taken whole keeps its text; of others, the words taken with the white space between them."""
        if not any(self.slots):
            return self.docs.limit(0)
        spans = self._spans(self.rows)
        light = self._pieces(self._spans(self.light))
        runs = light.groupBy("k", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("runs"), F.sum("n").alias("taken"))
        words = F.regexp_extract_all(f"row.`{self.text}`", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
        part = F.rtrim(F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, r["at"].cast("int") + 1, r["n"].cast("int")))), ""))
        text = F.when(F.col("taken") == F.col("size"), F.col(f"row.`{self.text}`")).otherwise(part)
        out = spans.filter("size > 0").join(runs, ["k", "start"])
        return out.select(*((text if c == self.text else F.col(f"row.`{c}`")).alias(c) for c in self.docs.columns))
