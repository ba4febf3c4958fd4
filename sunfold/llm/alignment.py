"""Alignment of two tokenizers over the same bytes, and how often each pair of their tokens overlaps in the whole corpus.

The ends of a text's tokens under either tokenizer, united, cut it into elementary intervals. The owner of an interval is
the token with the first end that is not before it, so a search of the ends gives both owners, and as no token ends within
an interval, each interval is one overlap of two tokens: a link. Ends that both share close a group.

Corpus-wide counts come back to the documents through blocks: a task packs its texts' results and names each pair of a
block once, with its count. A pair's counts are summed over blocks, the highest of each id of the second
tokenizer is kept in a table of at most its vocabulary, and every block gets its own pairs back. So no pair, however
frequent, has more rows than there are blocks, and no task holds more than one block's pairs and one slice of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunfold.llm.batches import each_row, slices
from sunfold.llm.bpe_trie import loaded
from sunfold.llm.packed import pack, unpack
from sunfold.runtime import cut, shuffle_partitions

_SLICE = 1 << 20  # bytes of text that are aligned at once
_BITS = 20  # of an id within a packed pair
_PAIRS, _TEXTS = 0, 1


class PieceBytes:
    """A SentencePiece model with the bytes that each piece stands for: a marker is a space, <0xHH> a byte."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        size = self.model.vocab_size()
        name = self.model.id_to_piece
        self.table = pa.array([bytes([int(name(i)[1:-1], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(size)], pa.binary())
        self.sizes = np.array([len(s.as_py()) for s in self.table], np.int64)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> PieceBytes:
    """The model, kept by a Python worker from task to task."""
    return PieceBytes(model)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, owner in a, owner in b, whether both end there) of the elementary intervals of two rising lists of ends."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # of two rising runs, which a stable sort merges
    ends = ends[np.r_[np.ones(min(1, len(ends)), bool), ends[1:] != ends[:-1]]]  # their union
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, ends_a[a] == ends_b[b]


@lru_cache(maxsize=2)
def _numerals(size: int) -> pa.Array:
    """The decimal ids below size followed by a comma, then by a bar, then by a semicolon."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.binary())


def _bytes(x: pa.Array) -> tuple[bytes, np.ndarray]:
    """A binary array's bytes, and where each value begins, with the end of the last."""
    at = np.frombuffer(x.buffers()[1], np.int32)[: len(x) + 1].astype(np.int64)
    return (x.buffers()[2].to_pybytes() if x.buffers()[2] and at[-1] else b""), at


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs: np.ndarray, size: int) -> list[bytes]:
    """For each document its groups as `a1,a2|b1;a3|b2,b3`. group_a, group_b: the group of each token, numbered through all
    documents; docs: the number of groups before each document, with the number of all; ids are below size."""
    last_a, last_b = (np.r_[g[1:] != g[:-1], np.ones(min(1, len(g)), bool)] for g in (group_a, group_b))
    code = np.empty(len(a) + len(b), np.int64)  # in order of groups, a's tokens first
    code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + size * last_a
    code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * size * last_b
    data, at = _bytes(_numerals(size).take(pa.array(code)))
    begin = at[np.searchsorted(group_a, docs) + np.searchsorted(group_b, docs)]
    return [data[x : max(x, y - 1)] for x, y in zip(begin, begin[1:], strict=False)]


def _aligned(texts: list[str | None], bpe, pieces: PieceBytes, whole: bool) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """The columns of texts' results; and, sorted, the packed (text, pair) of their links, each once, with how many there are."""
    ids_a, at_a = bpe.encode(texts, " ")
    lists = pieces.model.encode([t or "" for t in texts], num_threads=1)
    n_b = np.fromiter(map(len, lists), np.int64, len(lists))
    ids_b, at_b = np.fromiter(chain.from_iterable(lists), np.int32, int(n_b.sum())), np.r_[0, np.cumsum(n_b)]
    (bytes_a, start_a), (bytes_b, start_b) = (_bytes(m.table.take(pa.array(x))) for m, x in ((bpe, ids_a), (pieces, ids_b)))
    keep = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        keep[i] = bool(t) and (s := (" " + t).encode()) == bytes_a[start_a[at_a[i]] : start_a[at_a[i + 1]]] and s == bytes_b[start_b[at_b[i]] : start_b[at_b[i + 1]]]
    n_a, n_b = np.diff(at_a) * keep, n_b * keep
    a, b = ids_a[np.repeat(keep, np.diff(at_a))], ids_b[np.repeat(keep, np.diff(at_b))]
    ends_a, ends_b = np.cumsum(bpe.sizes[a]), np.cumsum(pieces.sizes[b])
    ends, own_a, own_b, shared = intervals(ends_a, ends_b)
    doc = np.repeat(np.arange(len(texts)), n_a)[own_a]  # of each link
    n_links, n_groups = np.bincount(doc, minlength=len(texts)), np.bincount(doc[shared], minlength=len(texts))
    closed = ends[shared]
    said = group_texts(a, b, np.searchsorted(closed, ends_a), np.searchsorted(closed, ends_b), np.r_[0, np.cumsum(n_groups)], max(len(bpe.table), len(pieces.table)))
    shown = [s.decode() if whole else hashlib.sha256(s).hexdigest() if s else "" for s in said]
    links, times = np.unique((doc << 2 * _BITS) | (a[own_a].astype(np.int64) << _BITS) | b[own_b], return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": shown}, links, times


def align(docs: DataFrame, bpe_path: str, piece_path: str, text: str = "text", groups: str = "sha256", block_mb: int = 16) -> DataFrame:
    """docs with n_a and n_b (tokens of a space and the text by the byte-level model and by the SentencePiece model), n_groups, n_links,
    n_best (links whose pair is the most frequent one of its second id in the whole table, ties included), count_sum (how often
    the links' pairs occur in the whole table, added up), and a column of the groups.

    groups: "text" gives the groups as `a1,a2|b1;a3|b2,b3` (column groups), "sha256" their digest (groups_sha256), which is a
    twentieth as large. Strings of special tokens within texts are plain text. Null and empty texts, and texts that either model
    does not give back byte by byte, have no tokens: zeros and "". Repeated rows stay and count each time. Columns of
    docs named like results are replaced, all others are carried, whatever their names. An empty table gives an empty result.

    Every text is encoded once; the results, without texts, are cut through the shared folder."""
    if groups not in ("text", "sha256"):
        raise ValueError(f"groups is text or sha256, not {groups}")
    spark, whole, size = docs.sparkSession, groups == "text", block_mb << 20
    spec, model = open(bpe_path, encoding="utf-8").read(), open(piece_path, "rb").read()
    if max(len(loaded(spec, False).bytes_of), len(_pieces(model).table)) > 1 << _BITS:
        raise ValueError(f"a vocabulary has more than {1 << _BITS} ids")
    made = ["n_a", "n_b", "n_groups", "n_links", "groups" if whole else "groups_sha256", "n_best", "count_sum"]
    carried = [c for c in docs.columns if c not in made or c == text]
    plain = docs.select(*(docs[f"`{c}`"] for c in carried)).toDF(*(f"c{i}" for i in range(len(carried))))
    at = f"c{carried.index(text)}"
    keep = [i for i, c in enumerate(carried) if c not in made]  # a text column named like a result is replaced by it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = loaded(spec, False), _pieces(model)
        block, held, parts, links, times = TaskContext.get().partitionId() << 32, 0, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            pairs, where = np.unique(np.concatenate(links) & ((1 << 2 * _BITS) - 1), return_inverse=True)
            n = np.bincount(where, np.concatenate(times), len(pairs)).astype(np.int64)
            yield _row(block, _PAIRS, 0, pack(pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])))
            from_ = 0
            for i, (rows, x, t) in enumerate(zip(parts, links, times, strict=True)):
                place = where[from_ : from_ + len(x)].astype(np.int32)
                from_ += len(x)
                first = np.searchsorted(x >> 2 * _BITS, np.arange(rows.num_rows + 1)).astype(np.int32)
                which, many = (pa.ListArray.from_arrays(pa.array(first), pa.array(v)) for v in (place, t.astype(np.int32)))
                yield _row(block, _TEXTS, i, pack(pa.record_batch([*rows.columns, which, many], [*rows.schema.names, "which", "many"])))

        for batch in batches:
            for part in slices(batch, at, _SLICE, 1 << 15):
                found, x, t = _aligned(part[at].to_pylist(), bpe, pieces, whole)
                parts.append(pa.record_batch([*(part[f"c{i}"] for i in keep), *map(pa.array, found.values())], [*(f"c{i}" for i in keep), *found]))
                links.append(x)
                times.append(t)
                held += part[at].nbytes
                if held >= size:
                    yield from close()
                    block, held, parts, links, times = block + 1, 0, [], [], []
        if parts:
            yield from close()

    rows = cut(plain.mapInArrow(run, _ROW))

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in each_row(batch):
                x = unpack(payload)
                yield pa.record_batch([pa.array(np.full(x.num_rows, block)), x["pair"].combine_chunks(), x["n"].combine_chunks()], ["block", "pair", "n"])

    asked = rows.filter(F.col("kind") == _PAIRS).select("block", "payload").mapInArrow(pairs_of, "block long, pair long, n long")
    counted = asked.withColumn("count", F.sum("n").over(Window.partitionBy("pair")))
    second = F.col("pair").bitwiseAND(F.lit((1 << _BITS) - 1))
    best = counted.groupBy(second.alias("b")).agg(F.max("count").alias("most"))  # at most a row for each id of the vocabulary
    told = counted.join(F.broadcast(best), second == F.col("b"))
    answers = told.select("block", F.lit(_PAIRS).alias("kind"), F.col("pair").alias("seq"), F.lit(None).cast("binary").alias("payload"), "count", (F.col("count") == F.col("most")).alias("best"))
    texts = rows.filter(F.col("kind") == _TEXTS).withColumns({"count": F.lit(None).cast("long"), "best": F.lit(None).cast("boolean")})
    fields = [plain.schema.fields[i] for i in keep]
    schema = T.StructType([*fields, *(T.StructField(n, T.StringType() if n == "groups" else T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, bests, fresh = None, [], [], True
        for batch in batches:
            kinds, blocks = (np.asarray(batch[c]) for c in ("kind", "block"))
            edges = np.flatnonzero(np.r_[True, (np.diff(blocks) != 0) | (np.diff(kinds) != 0), True]) if len(blocks) else [0]
            for x, y in zip(edges, edges[1:], strict=False):
                if blocks[x] != now:
                    now, counts, bests, fresh = blocks[x], [], [], True
                if kinds[x] == _PAIRS:
                    counts.append(np.asarray(batch["count"].slice(x, y - x)))
                    bests.append(np.asarray(batch["best"].slice(x, y - x).cast(pa.int8())))
                    continue
                if fresh:  # all of the block's pairs are there, in their order
                    count, best, fresh = np.concatenate([np.empty(0, np.int64), *counts]), np.concatenate([np.empty(0, np.int8), *bests]), False
                for payload in batch["payload"].slice(x, y - x):
                    got = unpack(payload.as_py()).combine_chunks().to_batches()
                    for r in got:
                        which, many = (np.asarray(r[c].flatten()) for c in ("which", "many"))
                        doc = np.repeat(np.arange(r.num_rows), np.asarray(r["which"].value_lengths()))
                        sums = [np.zeros(r.num_rows, np.int64), np.zeros(r.num_rows, np.int64)]
                        np.add.at(sums[0], doc, many * best[which])
                        np.add.at(sums[1], doc, many * count[which])
                        yield pa.record_batch([*r.columns[:-2], *map(pa.array, sums)], [*r.schema.names[:-2], "n_best", "count_sum"])

    dealt = answers.unionByName(texts).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "kind", "seq")
    return dealt.mapInArrow(join, schema).toDF(*(carried[i] for i in keep), *made)


_ROW = "block long, kind int, seq long, payload binary"


def _row(block: int, kind: int, seq: int, payload: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([seq], pa.int64()), pa.array([payload], pa.binary())], ["block", "kind", "seq", "payload"])
