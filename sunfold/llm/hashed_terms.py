"""Texts as sets of hashed terms, bounded samples of labelled texts, and the terms worth weights.

Terms are words (runs of letters and digits, any byte beyond ASCII counting as a letter, A-Z in lower case), the first
4 and 5 bytes of longer words, and coarse measures of a text's shape: repetition, capitals, symbols, separators, word
length, size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.llm.batches import frugal, slices
from sunfold.runtime import cut

BITS = 22
_BYTES = 1 << 20  # of text whose terms are made at once; a byte takes some 50 meanwhile
_BASE = np.uint64(0x100000001B3)
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b
_KIND = np.zeros(256, np.uint8)  # 1 capitals, 2 symbols, 3 lines' ends
_KIND[[b for b in range(65, 91)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_KIND[10] = 3


def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((h ^ h >> np.uint64(31)) >> np.uint64(64 - BITS)).astype(np.int64)


def hashed_terms(texts: Sequence[str | None], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of every distinct term of each text, sorted. only: a flag for each term; others are left out."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    fold = _FOLD[data]
    inside = fold > 0
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, size = edge[::2], edge[1::2] - edge[::2]
    doc = np.searchsorted(ends, start, "right")
    n = len(texts)
    found_doc, found = [doc, doc[size > 4], doc[size > 5]], []
    h = np.empty(0, np.uint64)
    if len(start):
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()) - 1, _BASE)])
            part = fold[inside].astype(np.uint64) * power[at]
            h = np.add.reduceat(part, first) ^ size.astype(np.uint64) << np.uint64(56)
            found.append(_bucket(h))
            for k in (4, 5):
                cut = np.add.reduceat(np.where(at < k, part, np.uint64(0)), first)[size > k]
                found.append(_bucket(cut ^ np.uint64(k << 48)))
    else:
        found = [np.empty(0, np.int64)] * 3
    # shape
    words = np.bincount(doc, minlength=n)
    repeated = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    letters = np.bincount(doc, size, minlength=n)
    kind, starts = _KIND[data], ends - np.array([len(r) + 1 for r in raw])
    capitals, symbols, lines = (np.add.reduceat((kind == i).astype(np.int64), starts) if n else np.empty(0) for i in (1, 2, 3))
    bars = np.add.reduceat(np.r_[data[1:] == 32, False] & (data == 124), starts) if n else np.empty(0)
    some = np.maximum(words, 1)
    shape = np.stack([repeated / some, capitals / np.maximum(letters, 1), symbols / some, bars / some, lines / some, letters / some / 16, np.log2(some) / 16], 1)
    level = np.minimum(11, (12 * np.sqrt(shape)).astype(np.int64))
    found.append(_bucket((np.arange(shape.shape[1]) * 16 + level + (1 << 40)).ravel().astype(np.uint64)))
    found_doc.append(np.repeat(np.arange(n), shape.shape[1]))
    doc, term = np.concatenate(found_doc), np.concatenate(found)
    if only is not None:
        keep = only[term]
        doc, term = doc[keep], term[keep]
    both = np.unique(doc << BITS | term)
    return both >> BITS, both & (1 << BITS) - 1


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, key: str, text: str, most: int) -> DataFrame:
    """(text, grade int, at bigint) of at most `most` labelled documents, those of least hash `at`, so that it is a sample.

    Rows with a null key, label or grade are left out, a key with several labels has the greatest grade, and one with
    several texts the least of them. Light rows are chosen first; they are few, `most` at most, and go to every task that
    reads texts. The sample is read once and kept in the shared folder."""
    rows = labels.select(F.col(key).alias("__key"), grade.cast("int").alias("grade")).filter("__key is not null and grade is not null")
    rows = rows.groupBy("__key").agg(F.max("grade").alias("grade")).withColumn("at", F.xxhash64("__key")).orderBy("at", "__key").limit(most)
    found = docs.select(F.col(key).alias("__of"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(rows), F.col("__of") == F.col("__key"))
    return cut(found.groupBy("__key", "grade", "at").agg(F.min("text").alias("text")).select("text", "grade", "at"))


def telling_terms(sample: DataFrame, grades: int, least: int = 4, floor: float = 12.0, share: float | None = None) -> np.ndarray:
    """The terms, in at least `least` of the sample's texts, that tell by themselves whether a grade is reached, by a
    chi-squared of `floor` or more, and, with `share`, all that this share of a grade's texts have, whatever they tell by
    themselves; sorted. Their number is bounded by the sample's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, _BYTES, 500):
                doc, term = hashed_terms(part[0].to_pylist())
                both, n = np.unique(term * grades + np.asarray(part[1])[doc], return_counts=True)
                yield pa.record_batch([pa.array(both // grades), pa.array(both % grades), pa.array(n)], ["term", "grade", "n"])

    totals = [0] * grades
    for g, n in sample.groupBy("grade").count().collect():
        totals[g] = n
    every = sum(totals)
    by = sample.select("text", "grade").mapInArrow(frugal(count), "term bigint, grade bigint, n bigint").groupBy("term").agg(*(F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(grades)), F.sum("n").alias("n"))
    keep = F.lit(False)
    for j in range(1, grades):
        upper = float(sum(totals[j:]))
        if 0 < upper < every:
            a = sum((F.col(f"n{g}") for g in range(j, grades)), F.lit(0.0))
            expected = F.col("n") * (upper / every)
            keep |= (a - expected) ** 2 / (expected * (1 - upper / every)) >= floor
    if share is not None:
        for g, n in enumerate(totals):
            keep |= F.col(f"n{g}") >= max(float(least), share * n)
    kept = by.filter((F.col("n") >= least) & keep).select("term").toArrow()
    return np.sort(kept["term"].to_numpy()) if kept.num_rows else np.empty(0, np.int64)


def numbered(terms: np.ndarray) -> np.ndarray:
    """For each term its place in `terms` plus 1, or 0."""
    out = np.zeros(1 << BITS, np.int32)
    out[terms] = np.arange(1, len(terms) + 1)
    return out


def rows_of(texts: Sequence[str | None], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, first feature of each text): the places of each text's terms, each text led by feature 0, which all have."""
    doc, term = hashed_terms(texts, place > 0)
    doc, x = np.r_[np.arange(len(texts)), doc], np.r_[np.zeros(len(texts), np.int64), place[term]]
    order = np.lexsort((x, doc))
    return x[order], np.searchsorted(doc[order], np.arange(len(texts)))


def design(sample: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sample as features, first feature of each row, and grades, in the order of `at`; bounded by the sample's and the terms' numbers."""
    place = numbered(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, _BYTES, 500):
                x, first = rows_of(part[0].to_pylist(), place)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(x)].astype(np.int32)), pa.array(x.astype(np.int32)))
                yield pa.record_batch([lists, part[1], part[2]], ["x", "grade", "at"])

    got = sample.select("text", "grade", "at").mapInArrow(run, "x array<int>, grade int, at bigint").toArrow()
    lists = got["x"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    start, x = np.cumsum(sizes) - sizes, pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(got["at"].to_numpy(), kind="stable")  # whatever order tasks returned them in
    n = sizes[order]
    first = np.cumsum(n) - n
    return x[np.repeat(start[order] - first, n) + np.arange(len(x))], first, got["grade"].to_numpy()[order].astype(np.int64)


def batches_of(x: np.ndarray, first: np.ndarray, y: np.ndarray, size: int, rounds: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Minibatches of shuffled rows, over and over."""
    rng, ends = np.random.default_rng(seed), np.r_[first[1:], len(x)]
    for _ in range(rounds):
        order = rng.permutation(len(first))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            n = ends[rows] - first[rows]
            start = np.cumsum(n) - n
            yield x[np.repeat(first[rows] - start, n) + np.arange(int(n.sum()))], start, y[rows]


def scored(docs: DataFrame, text: str, terms: np.ndarray, carry: Sequence, schema: str, names: Sequence[str], score) -> DataFrame:
    """The carried columns of docs and the columns that score(features, first) gives for each whole text."""
    place = numbered(terms)
    short = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, _BYTES, 256):
                columns = score(*rows_of(part[0].to_pylist(), place))
                yield pa.record_batch([*part.columns[1:], *map(pa.array, columns)], [*short, *names])

    plain = docs.select(F.col(text).alias("text"), *(c.alias(s) for c, s in zip(carry, short, strict=True)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:])
    return plain.mapInArrow(frugal(run), f"{kinds}, {schema}" if kinds else schema)
