"""Collocations: phrases of two to four words that occur together more than their parts would.

Words that are frequent enough have dictionary ids; everywhere else pieces break, since a phrase is no more frequent than its words.
An n-gram is four ids of 32 bits, absent ones 0, in a key of 128 bits that is held as two numbers. Every word gives one key, of the
words from it on; sorted keys hold the shorter n-grams as runs of equal prefixes. A task radix-sorts the keys of a block of texts
and counts runs; these are range-partitioned and sorted by key, and runs of two, three and four ids are counted in passing. A run that
ends with its range may go on in the next, so its parts are added up; of all others only frequent ones leave the task.

Texts are read once: a task packs a block of them as numbers of the block's own words, and names each word of the block once,
with its count. Words are counted over blocks, and each block gets the ids of its words back. So a word or a phrase,
however frequent, has no more rows than there are blocks, and a task holds one block and its words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfold.llm.batches import each_row, slices
from sunfold.llm.packed import pack, unpack
from sunfold.runtime import cut, shuffle_partitions

_WORDS, _TEXTS = 0, 1
_SLICE = 1 << 20  # bytes of text that are numbered at once
_BATCH = 1 << 16  # runs that are handed on at once
_BUCKETS = 4096  # of words, that are given ids apart
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by keys of 64 bits, not negative, the first of which counts most: digits of 16 bits, the last first.
    Digits in which all rows agree are passed over."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> shift & 0xFFFF).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort, as the digits have 16 bits
    return order


def runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, and how many there are of each."""
    order = radix_order(hi, lo)
    hi, lo = hi[order], lo[order]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(hi)), bool), (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    return hi[start], lo[start], np.diff(np.r_[start, len(hi)])


def keys_of(ids: np.ndarray, longest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word that another follows: it and the words after it, `longest` at most, up to the first 0."""
    m = max(0, len(ids) - 1)
    ids = np.r_[ids, np.zeros(2, np.int64)]
    at = np.flatnonzero((ids[:m] != 0) & (ids[1 : m + 1] != 0))
    third = ids[at + 2] if longest > 2 else np.zeros(len(at), np.int64)
    fourth = np.where(third != 0, ids[at + 3] if longest > 3 else 0, 0)
    return ids[at] << 32 | ids[at + 1], third << 32 | fourth


def _prefixes(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams that sorted keys (hi, lo, n) begin with: those of at least `least`, and, however few, those of a
    partition's first and last key, which may have more elsewhere."""
    masks = [0, ~((1 << 32) - 1), -1][: longest - 1]  # what two, three and four ids keep of lo
    marks = [None, 32, 0]  # where lo has the last of them
    open_: list[tuple[int, int, int, bool] | None] = [None] * len(masks)  # of each length the run that may go on, and whether it is the partition's first

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], ["hi", "lo", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hi, whole, n = (np.asarray(batch[c]) for c in ("hi", "lo", "n"))
        out = []
        for i, mask in enumerate(masks):
            lo = whole & mask
            start = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            x, y, total = hi[start], lo[start], np.add.reduceat(n, start)
            edge = np.zeros(len(start), bool)
            if open_[i] is None:
                edge[0] = True
            elif (x[0], y[0]) == open_[i][:2]:
                total[0] += open_[i][2]
                edge[0] = open_[i][3]
            else:  # it has ended with the batch before
                x, y, total, edge = np.r_[open_[i][0], x], np.r_[open_[i][1], y], np.r_[open_[i][2], total], np.r_[open_[i][3], edge]
            open_[i] = (int(x[-1]), int(y[-1]), int(total[-1]), bool(edge[-1]))
            keep = ((total >= least) | edge)[:-1] & (True if marks[i] is None else (y[:-1] >> marks[i] & 0xFFFFFFFF) != 0)
            out.append((x[:-1][keep], y[:-1][keep], total[:-1][keep]))
        yield rows(out)
    last = [(np.array([x]), np.array([y]), np.array([n])) for i, (x, y, n, _) in enumerate(filter(None, open_)) if marks[i] is None or y >> marks[i] & 0xFFFFFFFF]
    if last:
        yield rows(last)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (lang, text) rows, as numbers of their words."""
    block, held, parts = TaskContext.get().partitionId() << 32, 0, []
    langs: dict[str, defaultdict[bytes, int]] = {}
    number = count(1)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal langs, number
        n = np.bincount(np.concatenate(parts), minlength=1)
        order = np.argsort(-n[1:], kind="stable") + 1  # frequent words get small numbers, which pack well
        new = np.zeros(len(n), np.int32)
        new[order] = np.arange(1, len(n))
        words, of = [b""] * len(n), [""] * len(n)
        for lang, known in langs.items():
            for w, i in known.items():
                words[i], of[i] = w, lang
        yield _row(block, _WORDS, 0, pa.record_batch([pa.array([of[i] for i in order], pa.string()), pa.array([words[i] for i in order], pa.binary()), pa.array(n[order], pa.int64())], ["lang", "word", "n"]))
        for i, p in enumerate(parts):
            yield _row(block, _TEXTS, i, pa.record_batch([pa.array(new[p])], ["at"]))
        langs, number = {}, count(1)

    for batch in batches:
        for part in slices(batch, 1, _SLICE):
            ids = []
            for lang, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                if lang not in langs:
                    langs[lang] = defaultdict(number.__next__)
                known = langs[lang]
                found = _TOKEN.findall(text.encode().translate(_LOWER))
                ids.append(np.fromiter((0 if w in _BREAKS else known[w] for w in found), np.int32, len(found)))
                ids.append(np.zeros(1, np.int32))
            parts.append(np.concatenate(ids))
            held += part[1].nbytes
            if held >= size:
                yield from close()
                block, held, parts = block + 1, 0, []
    if parts:
        yield from close()


_ROW = "block long, kind int, at long, payload binary"


def _row(block: int, kind: int, at: int, payload: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([pack(payload)], pa.binary())], ["block", "kind", "at", "payload"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of blocks, a row each."""
    for batch in batches:
        for block, payload in each_row(batch):
            for x in unpack(payload).combine_chunks().to_batches():
                yield pa.record_batch([pa.array(np.full(x.num_rows, block)), pa.array(np.arange(1, x.num_rows + 1)), x["lang"], x["word"].cast(pa.string()), x["n"]], ["block", "at", "lang", "word", "n"])


def _numbered(words: DataFrame) -> DataFrame:
    """words with ids from 1, the same whatever the partitions: by buckets of their hash, and within them in order."""
    bucketed = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(_BUCKETS)))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size"))  # at most _BUCKETS rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return bucketed.withColumn("place", place).join(F.broadcast(first), "bucket").select((F.col("first") + F.col("place")).cast("long").alias("id"), "lang", "word", "f")


def _ids(hi: Column, lo: Column) -> list[Column]:
    low = F.lit((1 << 32) - 1)
    return [F.shiftright(hi, 32), hi.bitwiseAND(low), F.shiftright(lo, 32), lo.bitwiseAND(low)]


def _key(ids: list[Column]) -> Column:
    """The key of one to four ids."""
    ids = [*ids, *[F.lit(0).cast("long")] * (4 - len(ids))]
    return F.struct((F.shiftleft(ids[0], 32).bitwiseOR(ids[1])).alias("hi"), (F.shiftleft(ids[2], 32).bitwiseOR(ids[3])).alias("lo"))


def _parts(ids: list[Column]) -> Column:
    """The cuts of a phrase: k, the first k words and the rest."""
    cuts = [F.when(size, F.struct(F.lit(k).alias("k"), _key(ids[:k]).alias("first"), _key(ids[k:n]).alias("rest"))) for n, size in _sizes(ids) for k in range(1, n)]
    return F.array_compact(F.array(*cuts))


def _inner(ids: list[Column]) -> Column:
    """The phrases of two words and more within a longer one."""
    found = [F.when(size, _key(ids[i:j])) for n, size in _sizes(ids) if n > 2 for i in range(n) for j in range(i + 2, n + 1) if j - i < n]
    return F.array_compact(F.array(*found))


def _sizes(ids: list[Column]) -> list[tuple[int, Column]]:
    return [(2, ids[2] == 0), (3, (ids[2] != 0) & (ids[3] == 0)), (4, ids[3] != 0)]


def _wide(c: str) -> str:
    """A long as a decimal, whose products don't overflow."""
    return f"cast({c} as decimal(19, 0))"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, inside: int = 80, block_mb: int = 8) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score.

    Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. A phrase of 2 to
    `longest` words that occurs a >= least times within pieces is a candidate; of its cuts into two parts that occur l and r times
    the one with the lowest floor(2000000 a / (l + r)) is its score, the first of equal ones. Candidates within a longer one that
    occurs at least `inside` percent as often go. n counts all words of the language. Ranks are by score and a, falling, then by
    the phrase's bytes.

    Counts are over all rows and whole texts; repeated rows count each time. A null text has no words; a null language is `und`, as is
    one of that name. Other columns don't matter. No phrase, no row. ValueError for phrases of more than four words or fewer than two;
    more than 2^31 - 1 words that reach `least` raise an error, as a key holds no more."""
    if not 2 <= longest <= 4 or least < 1:
        raise ValueError("phrases have 2 to 4 words and occur at least once")
    spark, size = docs.sparkSession, block_mb << 20
    parts = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    packed = cut(rows.mapInArrow(lambda b: _packed(b, size), _ROW))

    named = packed.filter(F.col("kind") == _WORDS).select("block", "payload").mapInArrow(_named, "block long, at long, lang string, word string, n long")
    counts = named.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = cut(counts.groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f")))  # the rare words of a language in one row
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    id_fits = F.when(F.col("id") < (1 << 31), F.col("id")).otherwise(F.raise_error(F.lit("more words than ids of 31 bits")))
    words = cut(_numbered(counts.filter("word is not null")).withColumn("id", id_fits.cast("long")))

    answers = named.join(words, ["lang", "word"]).select("block", F.lit(_WORDS).alias("kind"), "at", F.lit(None).cast("binary").alias("payload"), "id")
    texts = packed.filter(F.col("kind") == _TEXTS).withColumn("id", F.lit(None).cast("long"))

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, ids, seqs = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if seqs and at:
                where, which = np.concatenate(at), np.concatenate(ids)
                seq = np.concatenate(seqs)
                id_of = np.zeros(int(max(seq.max(), where.max())) + 1, np.int64)
                id_of[where] = which
                columns = runs(*keys_of(id_of[seq], longest))
                for low in range(0, len(columns[0]), _BATCH):
                    yield pa.record_batch([pa.array(c[low : low + _BATCH]) for c in columns], ["hi", "lo", "n"])

        for batch in batches:
            blocks, kinds = np.asarray(batch["block"]), np.asarray(batch["kind"])
            edges = np.flatnonzero(np.r_[True, (np.diff(blocks) != 0) | (np.diff(kinds) != 0), True]) if len(blocks) else [0]
            for x, y in zip(edges, edges[1:], strict=False):
                if blocks[x] != now:
                    yield from close()
                    now, at, ids, seqs = blocks[x], [], [], []
                if kinds[x] == _WORDS:
                    at.append(np.asarray(batch["at"].slice(x, y - x)))
                    ids.append(np.asarray(batch["id"].slice(x, y - x)))
                else:
                    seqs += [np.asarray(unpack(p.as_py())["at"].combine_chunks()) for p in batch["payload"].slice(x, y - x)]
        yield from close()

    dealt = answers.unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "kind", "at")
    some = dealt.mapInArrow(count_runs, "hi long, lo long, n long")
    sorted_ = some.repartitionByRange(parts, "hi", "lo").sortWithinPartitions("hi", "lo")
    prefixes = sorted_.mapInArrow(lambda b: _prefixes(b, least, longest), "hi long, lo long, n long")
    found = cut(prefixes.groupBy("hi", "lo").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))

    ids = _ids(F.col("hi"), F.col("lo"))
    known = found.unionByName(words.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("f").alias("a")))
    first, rest = (known.select(F.struct("hi", "lo").alias(name), F.col("a").alias(x)) for name, x in (("first", "l"), ("rest", "r")))
    each = found.select("hi", "lo", "a", F.explode(_parts(ids)).alias("cut")).select("hi", "lo", "a", "cut.*").join(first, "first").join(rest, "rest")
    score = F.expr(f"cast(2000000 as decimal(7, 0)) * {_wide('a')} div ({_wide('l')} + {_wide('r')})").cast("long")
    scored = each.groupBy("hi", "lo", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("hi", "lo", "a", "best.score", "best.l", "best.r")
    longer = found.select(F.explode(_inner(ids)).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer")).select("key.*", "longer")
    kept = scored.join(longer, ["hi", "lo"], "left").filter(F.expr(f"longer is null or cast(100 as decimal(3, 0)) * {_wide('longer')} < cast({int(inside)} as decimal(3, 0)) * {_wide('a')}"))

    kept = kept.select("a", "score", "l", "r", *(c.alias(f"i{j}") for j, c in enumerate(ids)), F.pmod(F.xxhash64("hi", "lo"), F.lit(parts)).alias("salt"))
    for j in range(4):
        word = words.select(F.col("id").alias(f"i{j}"), F.col("word").alias(f"w{j}"), *(["lang"] if j == 0 else []))
        kept = kept.join(word, f"i{j}", "inner" if j < 2 else "left")
    said = kept.select("lang", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score", "salt")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ahead = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    few = said.withColumn("ahead", ahead).filter(F.col("ahead") <= top)  # at most `top` rows for each language and salt
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = 30, top: int = 2000) -> str:
    """DuckDB SQL with the rows of collocations(documents)."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS s, count(*) AS f FROM u, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
c AS (SELECT lang, k, s, f AS a, string_split(s, ' ') AS ws FROM g WHERE k > 1),
cuts AS (SELECT lang, k, s, a, ws, unnest(range(1, k)) AS j FROM c),
scored AS (SELECT c.lang, c.k, c.s, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score FROM cuts c
 JOIN g x ON x.lang = c.lang AND x.k = j AND x.s = array_to_string(ws[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.s = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS s, max(a) AS longer FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ e USING (lang, s) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(s)) AS rank, s AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {top}"""
