"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with the word behind it. Where no piece of the model holds a marker
behind another character, no merge crosses a chunk's end, so a chunk is segmented alike in every text. The
texts are packed into blocks; each block names its distinct chunks once, each distinct chunk is segmented once,
and its ids go back to the blocks, which join them by the chunks' positions in their texts. Three exchanges move
data: distinct chunks of a block by chunk, their ids by block, and the packed block by block. None has a key
that a word or a document could make hot, and no task holds more than a block and its share of the table.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunfold.llm.batches import each_row, frugal, slices
from sunfold.llm.packed import pack as _pack
from sunfold.llm.packed import unpack as _unpack
from sunfold.runtime import shuffle_partitions

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PIECES, _IDS = 0, 1
_KNOWN = 2_000_000  # segmented chunks that a task remembers before it forgets them


def check_model(model: bytes) -> None:
    """Raise ValueError unless chunks of this model's texts can be segmented one by one."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.vocab_size())) if re.search(f"[^{MARK}]{MARK}", p)]
    probe = "ﬁ ①  Ä\t x\n "
    if crossing or sp.decode(sp.encode(probe)) != probe or sp.encode("a b") != sp.encode("a") + sp.encode("b"):
        raise ValueError(f"pieces cross white space ({crossing[:3]}) or the model rewrites texts")


def chunks_of(text: str | None) -> list[str]:
    """The marked words of a text, in order; none for an empty text."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def _segment(sp, chunks: list[str]) -> list[list[int]]:
    """The ids of each chunk. The library itself puts the first marker before a text."""
    out = sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
    alone = sp.encode(" ", num_threads=1) if MARK in chunks else None
    if alone is not None:  # a text of one space has two markers; one marker alone is a piece of the vocabulary
        one = [sp.piece_to_id(MARK)]
        out = [one if c == MARK else ids for c, ids in zip(chunks, out, strict=True)]
    return out


def _strings(values: list[str]) -> bytes:
    return _pack(pa.record_batch([pa.array(values, pa.string())], ["c"]))


def _content(texts: pa.Array) -> bytes:
    """A string array's lengths and bytes."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1]
    return np.diff(at).tobytes() + (texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if texts.buffers()[2] else b"")


def _blocks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """Consecutive rows with about `size` bytes of text. A block's name is its partition's number with a digest of its texts and of
    those of the partition's blocks before it, so that both passes over the documents, and any task that is run again, give it the same
    name, and that blocks of one text over and over have different names, in one partition and in different ones."""
    rows, held, name = [], 0, xxhash.xxh3_128()
    task = TaskContext.get()
    part = task.partitionId() if task else 0  # in the union of both passes the packed texts come first, so numbers agree
    for batch in batches:
        for piece in slices(batch, text, size):
            rows.append(piece)
            name.update(_content(piece[text]))
            held += piece[text].nbytes
            if held >= size:
                yield f"{part}-{name.hexdigest()}", rows
                rows, held = [], 0
    if rows:
        yield f"{part}-{name.hexdigest()}", rows


def _parts_of(chunks: list[str], parts: int) -> np.ndarray:
    """The part of the table that segments each chunk."""
    return np.fromiter((zlib.crc32(c.encode()) % parts for c in chunks), np.int32, len(chunks))


def _texts(rows: list[pa.RecordBatch], text: str) -> Iterator[str | None]:
    for r in rows:
        for at in range(0, r.num_rows, 500):
            yield from r[text].slice(at, 500).to_pylist()


_ROW = "block string, kind int, seq int, payload binary"


def _rows(items: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    b, k, s, p = zip(*items, strict=True)
    return pa.record_batch([pa.array(b, pa.string()), pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(p, pa.binary())], ["block", "kind", "seq", "payload"])


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", block_mb: int = 24) -> DataFrame:
    """docs with two more columns: the ids of each whole text (array of int) and the text decoded from them.

    Nulls and empty texts have no ids and decode to "". Repeated rows stay, each with its ids. Columns of docs
    that are named like the two new ones are replaced; all others are carried, whatever their names. An empty
    table gives an empty result. No begin or end ids, no sampling.

    docs is read twice and must give the same rows in the same order and partitions each time, as a stored table does;
    cut anything else first, such as the result of a shuffle without a sort.
    """
    spark = docs.sparkSession
    model = open(model_path, "rb").read()  # on the driver; executors get the bytes
    check_model(model)
    parts, size = shuffle_partitions(spark), block_mb << 20
    docs = docs.drop(ids, decoded) if text not in (ids, decoded) else docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = f"c{docs.columns.index(text)}"
    plain = docs.toDF(*names)

    def pack(batches):
        for name, rows in _blocks(batches, at, size):
            for i, r in enumerate(rows):
                yield _rows([(name, _PIECES, i, _pack(r))])

    def ask(batches):
        for name, rows in _blocks(batches, at, size):
            chunks = list(dict.fromkeys(chain.from_iterable(map(chunks_of, _texts(rows, at)))))
            by = [[] for _ in range(parts)]
            for c, i in zip(chunks, _parts_of(chunks, parts).tolist(), strict=True):
                by[i].append(c)
            if items := [(name, _IDS, i, _strings(cs)) for i, cs in enumerate(by) if cs]:
                yield _rows(items)

    def segment(batches):
        from sentencepiece import SentencePieceProcessor

        sp, table = SentencePieceProcessor(model_proto=model), {}
        for batch in batches:
            for name, kind, part, payload in each_row(batch):
                chunks = _unpack(payload)["c"].to_pylist()
                if len(table) > _KNOWN:
                    table.clear()
                new = [c for c in chunks if c not in table]
                table.update((c, np.array(x, np.int32).tobytes()) for c, x in zip(new, _segment(sp, new), strict=True))
                got = [table[c] for c in chunks]
                yield _rows([(name, kind, part, _pack(pa.record_batch([pa.array(got, pa.binary())], ["c"])))])

    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def join(batches):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)

        def finish(pieces: list[bytes], answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            rows = [b for p in pieces for b in _unpack(p).to_batches(max_chunksize=200)]
            number = defaultdict(count().__next__)  # distinct chunks in order of first use
            uses = []
            for r in rows:
                words = [chunks_of(t) for t in r[at].to_pylist()]
                uses.append((np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int32), np.array([len(w) for w in words])))
            order = np.argsort(_parts_of(list(number), parts), kind="stable")
            number.clear()
            got = [_unpack(answers[i])["c"].combine_chunks() for i in sorted(answers)]
            flat = np.concatenate([np.frombuffer(g.buffers()[2], np.int32) for g in got]) if got else np.empty(0, np.int32)
            sizes = np.concatenate([np.diff(np.frombuffer(g.buffers()[1], np.int32)[: len(g) + 1]) // 4 for g in got]) if got else np.empty(0, np.int64)
            size_of, start_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            size_of[order], start_of[order] = sizes, np.cumsum(sizes) - sizes
            for r, (use, lengths) in zip(rows, uses, strict=True):
                n = size_of[use]
                ends = np.r_[0, np.cumsum(n)]
                values = flat[np.repeat(start_of[use] - ends[:-1], n) + np.arange(ends[-1])]
                at_doc = ends[np.r_[0, np.cumsum(lengths)]].astype(np.int32)
                back = sp.decode([values[a:b].tolist() for a, b in zip(at_doc, at_doc[1:], strict=False)])
                found = pa.ListArray.from_arrays(pa.array(at_doc), pa.array(values))
                yield pa.record_batch([*r.columns, found, pa.array(back, pa.string())], [*r.schema.names, "ids", "decoded"])

        now, pieces, answers = None, [], {}
        for batch in batches:
            for name, kind, seq, payload in each_row(batch):
                if name != now:
                    if pieces:
                        yield from finish(pieces, answers)
                    now, pieces, answers = name, [], {}
                if kind == _PIECES:
                    pieces.append(payload)
                else:
                    answers[seq] = payload
        if pieces:
            yield from finish(pieces, answers)

    asked = plain.mapInArrow(frugal(ask), _ROW).repartition(parts, "seq").mapInArrow(frugal(segment), _ROW)
    packed = plain.mapInArrow(frugal(pack), _ROW)
    out = packed.unionAll(asked).repartition(parts, "block").sortWithinPartitions("block", "kind", "seq").mapInArrow(frugal(join), schema)
    return out.toDF(*docs.columns, ids, decoded)


def digests(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """For each row its number of ids, and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    return encoded.select(
        key,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
