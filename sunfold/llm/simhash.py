"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a point between them that lies within half of r of each. So
every distinct fingerprint emits the points of a ball of half the radius, the points are shuffled, and equal points
betray the pairs. For an odd r one of the two has to reach a step further. At r = 3 the two fingerprints of a pair
then differ in parity, so only those with an odd number of bits emit the sphere of radius 2, and of it only the
points that flip two bits of the same half: of any three bits, two lie in one half. That is 65 points for every
fingerprint and 992 more for odd ones, where full balls of radius 2 would be 2081 for each.

Within one point's bucket, those that came from balls of radius 1 are at most 2 apart, and at most 3 from those
that came from further out, so a star around one of the former has only true links and keeps what is connected
together: its size is linear in the bucket's. Distinct fingerprints around a point are bounded by geometry, so no
bucket grows with the copies of a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.llm.batches import each_row, frugal
from sunfold.llm.components import connected_components
from sunfold.runtime import cut, shuffle_partitions, shuffles_dropped

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, repeats included; of all words where there are fewer; none without words."""
    w = (text or "").encode().lower().split()
    if len(w) >= words:
        runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
        return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(w) - words + 1)
    return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)


def _mixed(h: np.ndarray, longs: int) -> np.ndarray:
    """So many 64-bit words for each hash; the first is the hash itself, each other a bijection of it."""
    out = np.empty((len(h), longs), np.uint64)
    out[:, 0] = h
    with np.errstate(over="ignore"):
        for i in range(1, longs):
            z = h + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            out[:, i] = z ^ z >> np.uint64(31)
    return out


def simhashes(hashes: list[np.ndarray], longs: int = 1) -> np.ndarray:
    """For each array of hashes the bits that are set in over half of them, as uint64 [n, longs]; zero for none.

    Counts eight bits at a time in the bytes of a word, in runs of 255 hashes that cannot overflow one."""
    out = np.zeros((len(hashes), longs), np.uint64)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    sizes = np.array([len(hashes[i]) for i in full])
    ends = np.cumsum(sizes)
    runs = [np.arange(e - s, e, 255) for s, e in zip(sizes, ends, strict=True)]
    first = np.cumsum([0, *map(len, runs[:-1])])
    starts, h = np.concatenate(runs), _mixed(np.concatenate([hashes[i] for i in full]), longs)
    bits = np.empty((len(full), longs, 8, 8), np.uint8)
    for i in range(8):
        lanes = np.add.reduceat(h >> np.uint64(i) & _LANES, starts, axis=0).view(np.uint8).reshape(len(starts), longs, 8)
        counts = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        bits[:, :, :, i] = 2 * counts > sizes[:, None, None]
    out[full] = np.packbits(bits.reshape(len(full), -1), axis=1, bitorder="little").view("<u8").reshape(len(full), longs)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, longs: int = 1) -> DataFrame:
    """(key, fingerprint array of bigint) for every row: SimHash over all word shingles of the whole text.

    Nulls count as empty; an empty text has fingerprint zero. Repeated rows each get theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = simhashes([shingle_hashes(t, words) for t in part[1].to_pylist()], longs).view(np.int64)
                yield pa.record_batch([part[0], pa.array(list(out), pa.list_(pa.int64()))], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint array<bigint>")


def ball_masks() -> tuple[np.ndarray, int]:
    """What to flip for radius 3: first nothing and each bit (every fingerprint), then pairs within a half (odd ones); and how many are of the first kind."""
    near = [0, *(1 << i for i in range(64))]
    far = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return np.array(near + far, np.uint64), len(near)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """From rows sorted by their first column: the rows whose key another row shares, as (start of each run, keys, each other column)."""
    held: list[np.ndarray] | None = None

    def shared(columns):
        k = columns[0]
        if len(k) < 2:
            return None
        same = k[1:] == k[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        columns = [c[keep] for c in columns]
        k = columns[0]
        return (np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), *columns) if len(k) else None

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        if found := shared([c[:last] for c in held]):
            yield found
        held = [c[last:] for c in held]
    if held is not None and (found := shared(held)):
        yield found


def _forest(edges: np.ndarray) -> np.ndarray:
    """Stars that connect the same nodes as the edges do, with as few edges as that takes."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in edges.tolist():
        p, q = top(a), top(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    return np.array([(top(x), x) for x in up if top(x) != x], np.int64).reshape(-1, 2)


def links_within_three(prints: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b) over distinct 64-bit fingerprints, connecting just what the links of 3 bits or fewer connect. Each task reduces its links to a forest."""
    masks, near = ball_masks()
    parts = shuffle_partitions(prints.sparkSession)

    def emit(batches):
        for batch in batches:
            x = batch[0].to_numpy().view(np.uint64)
            odd = x[np.bitwise_count(x) % 2 == 1]
            for rows, lo, hi in ((x, 0, near), (odd, near, len(masks))):
                for at in range(0, len(rows), 512):
                    points = (rows[at : at + 512, None] ^ masks[None, lo:hi]).ravel().view(np.int64)
                    which = np.tile(np.arange(lo, hi, dtype=np.int16), len(points) // (hi - lo))
                    yield pa.record_batch([pa.array(points), pa.array(which)], ["point", "flipped"])

    def meet(batches):
        held = np.empty((0, 2), np.int64)
        for start, key, which in _runs(batches):
            node = (key.view(np.uint64) ^ masks[which]).view(np.int64)
            none = np.iinfo(np.int64).max
            hub = np.minimum.reduceat(np.where(which < near, node, none), start)
            hub = np.repeat(hub, np.diff(np.r_[start, len(key)]))
            has = np.logical_or.reduceat(which < near, start)
            keep = np.repeat(has, np.diff(np.r_[start, len(key)])) & (hub != node)
            if keep.any():
                held = np.unique(np.concatenate([held, np.stack([hub[keep], node[keep]], 1)]), axis=0)
                if len(held) > 200_000:
                    held = _forest(held)
        if len(held):
            held = _forest(held)
            yield pa.record_batch([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])

    points = prints.select(fingerprint).distinct().repartition(parts).mapInArrow(emit, "point bigint, flipped smallint")
    met = points.repartition(parts, "point").sortWithinPartitions("point").mapInArrow(meet, "a bigint, b bigint")
    return met.distinct()


def near_duplicate_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fingerprint bigint, component_id): fingerprints of at most 3 differing bits are linked, and component_id is the smallest key that links can reach.

    One row per document. Nulls and empty texts have fingerprint zero, which links like any other. Documents with
    equal fingerprints are one node of the graph, however many they are. Rows without a key have a fingerprint, and
    the smallest key of their component, or null if it has none. Repeated rows stay. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, key, text, words).select(key, F.col("fingerprint")[0].alias("fingerprint")))
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    roots = connected_components(links_within_three(prints))
    whole = classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component_id")


_BITS = 1 << 24  # of the bitmap that keeps texts without a candidate from the shuffle
_HUB = 512  # members of a star that one group of rows verifies
_CLASSES = 1 << 18  # of shingles, whose counts say which shingles are frequent
_BLOCK = 4096  # members of a bucket that a task compares with as many others


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parity(shingles: np.ndarray) -> bytes:
    """One bit for each of at least 2 n places: whether an odd number of the set's n shingles falls there."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length() if len(shingles) else 0)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _short_parity(shingles: np.ndarray) -> list[int]:
    """A parity over 256 places, as four numbers."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _folded(parity: bytes, size: int) -> int:
    """A parity of so many bytes, which is the set's own parity over fewer places."""
    n, v = len(parity), int.from_bytes(parity, "little")
    while n > size:
        n //= 2
        v = v >> 8 * n ^ v & (1 << 8 * n) - 1
    return v


def _frequencies(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """For each of `_CLASSES` classes of shingles, by their last bits, how many shingles of different texts fall there, over all texts.

    A frequent shingle's class stands out from the others by its count. Copies of a text in one task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = np.zeros(_CLASSES, np.int64), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                new = []
                for t in batch[0].slice(i, 256).to_pylist():
                    name = xxhash.xxh3_64_intdigest(t or "")
                    if name not in known:
                        known.add(name)
                        new.append(_shingle_set(t, words))
                if new:
                    n += np.bincount(_class_of(np.concatenate(new)), minlength=_CLASSES)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(n[at])], ["class", "n"])

    with shuffles_dropped(docs.sparkSession):
        rows = docs.select(text).mapInArrow(frugal(run), "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_CLASSES, np.int64)
    out[rows["class"].to_numpy()] = rows["n"].to_numpy()
    return out


def _class_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(_CLASSES - 1)).astype(np.int64)


def _may_be_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets whose first common shingle stands at these places can be alike; a place is size << 32 | position."""
    m, n = a >> 32, b >> 32
    return np.minimum(m - (a & 0xFFFFFFFF), n - (b & 0xFFFFFFFF)) + 1e-6 >= similarity / (1 + similarity) * (m + n)


def _not_apart(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose parities allow that similarity: sets differ in at least as many shingles as their
    parities in bits, so no pair that is alike goes. A parity has a thirtieth of a set's bytes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, p, q = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                size = min(len(p[i]), len(q[i]))
                apart = (_folded(p[i], size) ^ _folded(q[i], size)).bit_count()
                keep.append((m[i] + n[i] - apart) / 2 + 1e-6 >= similarity / (1 + similarity) * (m[i] + n[i]))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch[0].filter(mask), batch[1].filter(mask)], ["a", "b"])

    one, other = (sets.select(F.col("digest").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    near = (F.col("size_a") >= similarity * F.col("size_b") - 1e-6) & (F.col("size_b") >= similarity * F.col("size_a") - 1e-6)
    both = pairs.join(one, "a").join(other, "b").filter(near).select("a", "b", "size_a", "size_b", "parity_a", "parity_b")
    return both.mapInArrow(frugal(check), "a bigint, b bigint")


def _alike(docs: DataFrame, pairs: DataFrame, sets: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose shingle sets have that Jaccard similarity, exactly.

    What the parities leave is verified on whole sets; a set is sent once for each pair that it is the second of, and once
    for each `_HUB` pairs that it is the first of, so that a set with many partners is no hot key."""
    parts = shuffle_partitions(docs.sparkSession)
    pairs, sets = cut(_not_apart(pairs, sets, similarity)), sets.select("digest", "node")
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / _HUB).alias("shares"))
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    need = dealt.select(F.col("b").alias("digest"), F.col("a").alias("hub"), "share").unionAll(dealt.select(F.col("a").alias("digest"), F.col("a").alias("hub"), "share").distinct())
    at = F.pmod(F.xxhash64("node"), F.lit(_BITS))
    with shuffles_dropped(docs.sparkSession):
        marks = need.select("digest").distinct().join(sets, "digest").groupBy(F.floor(at / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 32).cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(_BITS // 32, np.int64)
    bitmap[marks["word"].to_numpy()] = marks["bits"].to_numpy()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                wanted = bitmap[part[0].to_numpy() >> 5] >> (part[0].to_numpy() & 31) & 1
                found = [_shingle_set(t, words) for t in part[1].filter(pa.array(wanted == 1)).to_pylist()]
                yield pa.record_batch([pa.array(map(_digest, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["digest", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            out = []
            for hub, share, d, raw in each_row(batch):
                x = np.frombuffer(raw, np.uint64)
                if hub == d:
                    now, own = (hub, share), x
                elif (hub, share) == now:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if both / (len(own) + len(x) - both) >= similarity:
                        out.append((hub, d))
            yield pa.record_batch([pa.array([v[i] for v in out], pa.int64()) for i in range(2)], ["a", "b"])

    found = docs.select(F.pmod(F.xxhash64(key), F.lit(_BITS)).alias("at"), text).mapInArrow(frugal(made), "digest bigint, shingles binary").dropDuplicates(["digest"])
    met = need.join(found, "digest").select("hub", "share", "digest", "shingles").repartition(parts, "hub", "share").sortWithinPartitions("hub", "share", F.col("hub") != F.col("digest"))
    return met.mapInArrow(frugal(check), "a bigint, b bigint")


def near_duplicate_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, block: int = _BLOCK, most: int = 8) -> DataFrame:
    """(key, cluster) for each distinct key: documents whose sets of word shingles have a Jaccard similarity of at least `similarity` are linked,
    and a cluster is what links connect, named by its smallest key. Exact: no pair is lost and none is added.

    Shingles have one order for all texts, rare ones first. Of two sets that are alike, each has a shingle in common with
    the other among its first n - ceil(similarity * n) + 1, so only these are shuffled. The first that a pair has in
    common also bounds their overlap by what follows it. Pairs that meet are verified, by their parities and then on the
    whole sets, in rounds: first the star around the smallest of each bucket and the chain of neighbours, then the other pairs
    of the bucket whose members are not connected yet, at most `most` for each member, 64 times as many in the next round and
    so on until a round leaves none. A pair left out is connected already.

    Texts are read again for each round, and only those that parities leave send their sets. How frequent a shingle is comes
    from counts of classes of shingles over all texts; it changes the work, not the result. Members of a bucket that are not
    connected cost a comparison for each pair, of two numbers each; a large bucket's are dealt to tasks in pairs of blocks. A
    null text counts as empty, and documents without words are alike. Rows without a key are not
    clustered. Rows that share a key are one document. Equal sets are one node, by a digest of 64 bits.
    """
    parts = shuffle_partitions(docs.sparkSession)
    docs = docs.filter(F.col(key).isNotNull()).select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    counts = _frequencies(docs, text, words)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's digest; for the first of equal ones in a task also size, parity and the shingles to send."""
        known: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for t in part[1].to_pylist():
                    x = _shingle_set(t, words)
                    n, d = len(x), _digest(x)
                    if d in known:
                        out.append((d, None, None, None, None))
                        continue
                    known.add(d)
                    first = x[np.argsort(counts[_class_of(x)], kind="stable")[: n - math.ceil(similarity * n - 1e-6) + 1]].view(np.int64)
                    out.append((d, n, _parity(x), first, _short_parity(x)))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
                yield pa.record_batch([part[0], *columns], ["node", "digest", "size", "parity", "first", "short"])

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2), np.int64)
        none = lambda n: pa.nulls(n, pa.int64())
        names = ["a", "b", "point", "place"]
        for _, point, digest, place in _runs(batches):
            once = np.r_[True, (point[1:] != point[:-1]) | (digest[1:] != digest[:-1])]
            point, digest, place = point[once], digest[once], place[once]
            start = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
            size = np.diff(np.r_[start, len(point)])
            inner = np.ones(len(point), bool)
            inner[start] = False
            own = np.flatnonzero(inner)
            two = np.concatenate([np.stack([x, own], 1) for x in (np.repeat(start, size)[own], own - 1)])
            two = two[_may_be_alike(place[two[:, 0]], place[two[:, 1]], similarity)]
            held = np.unique(np.concatenate([held, digest[two]]), axis=0)
            if len(held) > 500_000:
                yield pa.record_batch([pa.array(held[:, 0]), pa.array(held[:, 1]), none(len(held)), none(len(held))], names)
                held = held[:0]
            if (more := np.repeat(size > 3, size)).any():
                yield pa.record_batch([pa.array(digest[more]), none(int(more.sum())), pa.array(point[more]), pa.array(place[more])], names)
        yield pa.record_batch([pa.array(held[:, 0]), pa.array(held[:, 1]), none(len(held)), none(len(held))], names)

    def crossing(most: int):
        """A round over rows sorted by pair of blocks, each of which is named; within it by side. Of the pairs that differ in root only
        those go on that places and short parities allow: sets differ in at least as many shingles as their parities in bits. Each row
        sends at most so many pairs, to different roots first; a row of nulls says that some were left for a further round."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            n, left = 0, False
            for start, _, digest, place, root, side, *short in _runs(batches):
                bits, size = np.stack(short, 1).view(np.uint64), place >> 32
                for i, j in zip(start, np.r_[start[1:], len(root)], strict=True):
                    # within a block each row meets those behind it, else the rows of one side meet those of the other
                    middle = i + int(np.searchsorted(side[i:j], 1))
                    for at in range(i, j - 1 if middle == j else middle):
                        low = max(at + 1, middle) if middle < j else at + 1
                        b = np.flatnonzero((root[low:j] != root[at]) & _may_be_alike(place[at], place[low:j], similarity)) + low
                        both = size[at] + size[b]
                        b = b[(both - np.bitwise_count(bits[b] ^ bits[at]).sum(1, dtype=np.int64)) / 2 + 1e-6 >= similarity / (1 + similarity) * both]
                        if len(b) > most:
                            new = np.unique(root[b], return_index=True)[1]
                            b, left = b[np.r_[new, np.setdiff1d(np.arange(len(b)), new)][:most]], True
                        if len(b):
                            held.append(np.stack([np.minimum(digest[at], digest[b]), np.maximum(digest[at], digest[b])], 1))
                            n += len(b)
                        if n > 500_000:
                            pairs = np.unique(np.concatenate(held), axis=0)
                            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                            held, n = [], 0
            if held:
                pairs = np.unique(np.concatenate(held), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            if left:
                yield pa.record_batch([pa.nulls(1, pa.int64())] * 2, ["a", "b"])

        return run

    prints = cut(docs.mapInArrow(frugal(describe), f"node {kind}, digest bigint, size bigint, parity binary, first array<bigint>, short array<bigint>"))
    sets = prints.filter("parity is not null").select("node", "digest", "size", "parity").dropDuplicates(["digest"])
    points = prints.select("digest", "size", F.posexplode("first").alias("at", "point")).select("point", "digest", F.expr("shiftleft(size, 32) | at").alias("place"))
    met = cut(points.repartition(parts, "point").sortWithinPartitions("point", "digest").mapInArrow(frugal(first_round), "a bigint, b bigint, point bigint, place bigint"))
    links = _alike(docs, met.filter("b is not null").select("a", "b").distinct(), sets, key, text, words, similarity)
    # a key whose rows differ in text has several digests, which count as linked
    several = prints.groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).filter("a <> z")
    links = links.unionAll(prints.join(several, "node").select("a", F.col("digest").alias("b")))
    found = cut(connected_components(links).withColumnsRenamed({"node": "a"}))
    short = prints.filter("short is not null").select("digest", "short").dropDuplicates(["digest"])
    while True:
        rest = cut(met.filter("b is null").join(found, "a", "left").select("point", F.col("a").alias("digest"), "place", F.coalesce("root", "a").alias("root")))
        mixed = rest.groupBy("point").agg(F.ceil(F.count("*") / block).alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("point", "blocks")
        own = F.pmod(F.xxhash64("digest"), F.col("blocks"))
        each = rest.join(mixed, "point").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        pair = F.xxhash64("point", F.least("own", "other"), F.greatest("own", "other")).alias("pair")
        dealt = each.join(short, "digest").select(pair, "digest", "place", "root", F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("bigint").alias("side"), *(F.col("short")[i].alias(f"short{i}") for i in range(4)))
        crossed = cut(dealt.repartition(parts, "pair").sortWithinPartitions("pair", "side").mapInArrow(frugal(crossing(most)), "a bigint, b bigint").distinct())
        if not crossed.head(1):
            break
        links = _alike(docs, crossed.filter("a is not null"), sets, key, text, words, similarity).unionAll(found.select("a", F.col("root").alias("b")))
        found = cut(connected_components(links).withColumnsRenamed({"node": "a"}))
        if not crossed.filter("a is null").head(1):
            break
        most *= 64
    rooted = cut(prints.select("node", "digest").join(found, prints["digest"] == found["a"], "left").select("node", F.coalesce("root", "digest").alias("root")).distinct())
    least = rooted.groupBy("root").agg(F.min("node").alias("cluster"))
    return rooted.join(least, "root").select(F.col("node").alias(key), "cluster")


def one_of_each_cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without near-duplicates: of each cluster the document with the smallest key stays, once. Rows without a key stay.

    A cluster is what two kinds of links connect: SimHash fingerprints within 3 bits, found by ball hashing (`near_duplicate_components`),
    and sets of shingles that are alike (`near_duplicate_clusters`), which fingerprints may miss."""
    keyed = docs.filter(F.col(key).isNotNull())
    prints = near_duplicate_components(keyed, key, text).select(F.col(key).alias("__key"), "component_id").distinct()
    clusters = near_duplicate_clusters(docs, key, text, **how).select(F.col(key).alias("__key"), "cluster")
    both = cut(clusters.join(prints, "__key"))
    roots = connected_components(both.select(F.col("cluster").alias("a"), F.col("component_id").alias("b")))
    # a document is its own cluster's root unless links lead to a smaller key; roots are the smallest keys that can be reached
    first = both.join(roots, both["cluster"] == roots["node"], "left").select("__key", F.coalesce("root", "cluster").alias("least"))
    keep = first.groupBy("__key").agg(F.min("least").alias("least")).filter("__key = least").select(F.col("__key").alias(key))
    once = docs.join(keep, key, "left_semi").dropDuplicates([key])
    return once.select([f"`{c}`" for c in docs.columns]).unionAll(docs.filter(F.col(key).isNull()))
