"""Document fingerprints of closed syncmers.

A k-mer is a closed syncmer if the least of its s-mers, by hash, is its first or its last. Whether it is one depends
on nothing but the k-mer, so an edit disturbs no anchor that it does not touch. A fingerprint is all of a text's anchors,
repeats included, in text order with their positions, so it grows with the text. An anchor that two fingerprints have
counts only if it is in order with the others, so that common words in other places are no likeness.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.runtime import shuffle_partitions

K, S = 8, 3
_ODD = 0x9E3779B97F4A7C15


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n code points."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(points) - n + 1), np.uint64)
        for i in range(n):
            out = out * np.uint64(_ODD) + points[i : i + len(out)]
        return _mix(out)


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of a text's closed syncmers. A short text without one is itself one anchor; an empty one has none."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    whole_text = lambda: ((_hashes(points, len(points)) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64))
    if len(points) < k:
        return whole_text()
    inner, w = _hashes(points, s), k - s + 1
    least, size = inner, 1  # the least of each w s-mers, by doubling
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(inner) - w + 1], least[w - size :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[w - 1 :] == least))
    if not len(at):  # any k - s k-mers in a row have one, so that only a text of fewer than 2 k - s code points comes here
        return whole_text()
    with np.errstate(over="ignore"):
        whole = _mix(inner[at] * np.uint64(_ODD) + inner[at + w - 1])
        for i in range(s, w - 1, s):
            whole = _mix(whole ^ inner[at + i])
        whole = _mix(whole ^ inner[at + (w - 1) // 2])
    return (whole >> np.uint64(32)).astype(np.uint32), at


def fingerprint(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all anchors of the whole text, in text order."""
    h, at = anchors(text, k, s)
    return h, at.astype(np.uint32)


def encoded(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: base64 of its hashes, four bytes each, little endian, then of the steps from each position to the next, a
    byte each, as neighbouring anchors are at most k - s apart."""
    steps = np.diff(print_[1].astype(np.int64), prepend=0)
    return base64.b64encode(print_[0].astype("<u4").tobytes() + steps.astype(np.uint8).tobytes()).decode()


def decoded(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    n = len(raw) // 5
    return np.frombuffer(raw[: 4 * n], "<u4"), np.cumsum(np.frombuffer(raw[4 * n :], np.uint8), dtype=np.uint32)


def _in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, exactly.

    By the longest rising run over the places where elements match, a microsecond each, or, where repeats make these too many, by one
    bit for each element of b, which takes len(a) * len(b) / 1e10 seconds. What both begin or end with costs nothing, nor do elements that
    only one has. So prose is cheap, and the worst case is long texts of very few letters that differ from the start."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    head = int(other[0]) if len(other) else n
    a, b, n = a[head:], b[head:], n - head
    other = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(other[0]) if len(other) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    p, q = np.sort(a), np.sort(b)
    x, y = (v[other[np.minimum(np.searchsorted(other, v), len(other) - 1)] == v].tolist() if len(other) else [] for v, other in ((a, q), (b, p)))
    left, right = Counter(x), Counter(y)
    if sum(n * right[v] for v, n in left.items()) * 4096 < len(x) * (len(y) + 65536):
        places = defaultdict(list)
        for i in range(len(y) - 1, -1, -1):
            places[y[i]].append(i)
        ends: list[int] = []
        for v in x:
            for j in places[v]:
                i = bisect_left(ends, j)
                ends[i : i + 1] = [j]
        return head + tail + len(ends)
    z = np.array(y)
    masks = {v: int.from_bytes(np.packbits(z == v, bitorder="little").tobytes(), "little") for v in left}
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & masks[v]
        row = (row + hit | row - hit) & full
    return head + tail + len(y) - row.bit_count()


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    v = np.sort(values)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return v[start], np.diff(np.r_[start, len(v)])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of anchors, of those either text has, that both have in the same order; 0 to 1. Two empty texts are alike.

    Exact for whole texts; an anchor that a text repeats counts each time."""
    m, n = len(a[0]), len(b[0])
    if not m or not n:
        return float(m == n)
    (x, p), (y, q) = (_counted(print_[0]) for print_ in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    return _in_order(a[0], b[0]) / (m + n - int(np.minimum(p[i], q[j]).sum()))


def _in_descending_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, own, key, text) with the rows dealt into blocks by ranges of keys. A block also has, with own false, the
    row after its last one: the first of the next block, or for the last block the first of all."""
    n = 4 * shuffle_partitions(docs.sparkSession)
    shares = [i / n for i in range(1, n)]
    bounds = docs.select(F.percentile_approx(key, F.array(*map(F.lit, shares)), 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    block = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b < F.coalesce(key, F.lit(-(1 << 63))))) if bounds else F.lit(0)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), block.alias("block"))
    heads = {b: (top, has) for b, top, has in rows.groupBy("block").agg(F.max("key"), F.count("*")).collect()}  # a row for each block
    order = sorted(heads, reverse=True)
    before = dict(zip(order[1:], order, strict=False)) | ({order[0]: order[-1]} if order else {})
    into = F.lit(None).cast("int")
    for b, above in before.items():
        into = F.when((F.col("block") == b) & F.col("key").eqNullSafe(F.lit(heads[b][0])), F.lit(above)).otherwise(into) if len(before) <= 64 else into
    if len(before) > 64:
        tops = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(heads[b][0]).cast("bigint").alias("top"), F.lit(above).alias("above")) for b, above in before.items()))
        into = F.get(F.filter(tops, lambda t: (t["b"] == F.col("block")) & t["top"].eqNullSafe(F.col("key"))), F.lit(0))["above"]
    copies = F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("own")), F.struct(into.alias("block"), F.lit(False).alias("own")))
    return rows.select("key", "text", F.explode(F.filter(copies, lambda c: c["block"].isNotNull())).alias("to")).select("to.block", "to.own", "key", "text")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """For each row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points (rounded down) replaced by as many of the first of the next
    document, or all it has; the next document is the one with the next smaller key, after the last the first. Nulls
    count as empty texts; a null key is the smallest. Rows with equal keys follow each other by their texts. One row
    alone is its own next. The key is of an integer type. Other columns are not read; an empty table gives an empty
    result.

    Texts are shuffled once, into blocks of near keys, each with a copy of the row that follows it, and each block is
    read in order, so every fingerprint of a text is made once and no task holds more than two texts at a time.
    """
    if not 0 < s <= k or k - s > 255:
        raise ValueError("k exceeds s by 255 at most")
    blocks = _in_descending_order(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    ordered = blocks.repartition(4 * shuffle_partitions(docs.sparkSession), "block").sortWithinPartitions("block", F.desc("own"), F.desc_nulls_last("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, print_ = None, None, None
        out: list[tuple] = []

        def close(next_text: str, next_print: tuple) -> None:
            n = len(held[1])
            edited = held[1][: n - n // 2] + next_text[: n // 2]
            changed = fingerprint(edited, k, s)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((held[0], n, digest, encoded(print_), encoded(changed), likeness(print_, changed), likeness(print_, next_print)))

        def flush() -> pa.RecordBatch:
            done = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return done

        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        first = True
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for b, own, i, t in zip(*(part[c].to_pylist() for c in ("block", "own", "key", "text")), strict=True):
                    if b != block:
                        block, first = b, True
                    now = fingerprint(t, k, s)
                    if not first:
                        close(t, now)
                    held, print_, first = ((i, t), now, False) if own else (None, None, True)
                if out:
                    yield flush()

    out = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, out).withColumn(key, F.col(key).cast(kind))
