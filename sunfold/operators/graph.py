"""Neighbourhood graphs over vectors, their Laplacians, and projections learnt on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunfold.runtime import cut, shuffle_partitions


BLOCK = 1 << 20  # values of a block of vectors; a task compares the rows of _OWN blocks with those of _OTHERS
_OWN, _OTHERS = 4, 8
PIVOTS = 1024  # at most, whose distances from each other are on the driver and in every task


@dataclass
class Cells:
    """Vectors dealt to the cells of pivots, and which cells must meet.

    rows: (id, v, cell, d), d the distance from the cell's pivot. A row of cell r has all its k nearest within `reach` of it, so of
    cell s only rows whose d is at least least[r, s] can be among them. sizes: rows of each cell; share: of all pairs of rows, those in
    cells that must meet."""

    rows: DataFrame
    sizes: np.ndarray
    least: np.ndarray
    must: np.ndarray
    share: float


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed by dimension, so that they are rounded alike in blocks of any size."""
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - y[None, :, j]) ** 2
    return d


def cells(df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None) -> Cells | None:
    """The cells of as many pivots as the root of the number of rows, PIVOTS at most: rows of least hash. None without rows.

    By the triangle inequality, rows x of cell r and y of cell s are at least pivot distance - d(x) - d(y) apart; and any row of r has k
    others within its own d, the pivots' distance, and the d of these rows, of which each cell's k + 1 smallest are known."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    n = rows.count()
    if not n:
        return None
    many = pivots or min(PIVOTS, max(1, round(n**0.5)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(many).dropDuplicates(["v"]).orderBy("id").toPandas()
    p = np.stack(chosen["v"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                d = _distances(np.stack(part["v"]), p)
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype("int32"), d=np.sqrt(d[np.arange(len(d)), cell]))

    kind = df.schema[key].dataType.simpleString()
    dealt = cut(rows.mapInPandas(assign, f"id {kind}, v array<double>, cell int, d double"))
    few = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("d"))
    near = dealt.select("cell", "d", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).withColumn("at", few).filter(F.col("at") <= k + 1)
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).filter(F.col("at") <= k + 1)
    sizes, radius, smallest = np.zeros(len(p), np.int64), np.zeros(len(p)), np.full((len(p), k + 1), np.inf)
    for cell, size, most in dealt.groupBy("cell").agg(F.count("*"), F.max("d")).collect():  # PIVOTS rows at most
        sizes[cell], radius[cell] = size, most
    for cell, at, d in near.select("cell", "at", "d").collect():  # PIVOTS * (k + 1) rows at most
        smallest[cell, at - 1] = d
    apart = np.sqrt(_distances(p, p))
    reach = np.full(len(p), np.inf)
    if n > k + 1:
        for r in range(len(p)):
            reach[r] = radius[r] + np.partition((apart[r][:, None] + smallest).ravel(), k)[k]
    least = apart - (radius + reach)[:, None]
    least -= 1e-9 * (apart + radius.max() + 1)  # for rounding
    must = (least <= radius[None, :]) & (sizes > 0)[:, None] & (sizes > 0)[None, :]
    return Cells(dealt, sizes, least, must, float((must * np.outer(sizes, sizes)).sum() / n**2))


def _blocks(sizes: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its block, and into how many its rows are dealt from there on: small cells share a block, a large one has several."""
    first, pieces, block, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, of
    for i, n in enumerate(sizes):
        if n > of:
            block += room < of
            pieces[i] = -(-n // of)
            first[i], block, room = block, block + pieces[i], of
        else:
            if n > room:
                block, room = block + 1, of
            first[i], room = block, room - n
    return first, pieces


def _nearest(found: Cells, k: int, kind: str, block: int | None) -> DataFrame:
    """(src, dst, d2): for each vector its k nearest others at least, by d2 and then by id, as `knn_edges` says."""
    spark = found.rows.sparkSession
    n, wide = int(found.sizes.sum()), len(found.rows.select("v").first()[0])
    order = np.argsort((found.must * found.sizes).sum(1), kind="stable")
    own_first, own_pieces = _blocks(found.sizes[order], block or max(1, min(max(256, BLOCK // max(1, wide)), -(-n // max(1, int(shuffle_partitions(spark) ** 0.5 * 1.5))))))
    first, pieces = np.zeros_like(own_first), np.ones_like(own_pieces)
    first[order], pieces[order] = own_first, own_pieces
    total = int((first + pieces).max())
    groups = -(-total // _OWN)
    parts = min(total, max(-(-total // _OTHERS), -(-2 * shuffle_partitions(spark) // groups)))
    looks = np.zeros((groups, total), bool)  # whether a block has rows that a group of blocks must meet
    in_block = np.zeros((total, len(first)), bool)  # cells of a block
    for c in range(len(first)):
        in_block[first[c] : first[c] + pieces[c], c] = True
    for g in range(groups):
        looks[g] = in_block[:, found.must[in_block[g * _OWN : (g + 1) * _OWN].any(0)].any(0)].any(1)
    plan = spark.sparkContext.broadcast((found.least, found.must, first, pieces, looks))  # PIVOTS squared at most, and blocks by groups

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, first, pieces, _ = plan.value
        for b in batches:
            cell = b["cell"].to_numpy()
            yield b.assign(block=first[cell] + (pd.util.hash_array(b["id"].to_numpy()) % pieces[cell].astype(np.uint64)).astype(np.int64))

    def pack(table: pa.Table) -> pa.Table:
        v = np.asarray(table["v"].combine_chunks().flatten())
        cell, d = (np.asarray(table[c].combine_chunks()) for c in ("cell", "d"))
        ids = pa.array([table["id"].to_pylist()], pa.list_(table["id"].type))
        return pa.table([table["block"].slice(0, 1), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (v, cell, d))], names=["block", "ids", "v", "cell", "d"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = plan.value[-1]
        for batch in batches:
            for i in range(batch.num_rows):
                row, b = batch.slice(i, 1), batch["block"][i].as_py()
                own = b // _OWN
                to = [(own, p, 0) for p in np.unique(np.flatnonzero(looks[own]) % parts)] + [(g, b % parts, 1) for g in np.flatnonzero(looks[:, b])]
                for g, p, side in to:
                    yield pa.record_batch([pa.array([int(g)]), pa.array([int(p)]), pa.array([side], pa.int32()), *row.columns[1:]], ["own", "part", "side", "ids", "v", "cell", "d"])

    def meet(table: pa.Table) -> pa.Table:
        least, must, *_ = plan.value
        kinds = table["ids"].type.value_type
        if len(pa.compute.unique(table["side"])) < 2:  # blocks without rows
            return pa.table([pa.array([], kinds), pa.array([], kinds), pa.array([], pa.float64())], names=["src", "dst", "d2"])
        ids, v, cell, d = [], [], [], []
        for side in (0, 1):
            t = table.filter(pa.compute.equal(table["side"], side))
            ids.append(np.asarray(t["ids"].combine_chunks().flatten()))
            raw = lambda c, kind, t=t: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]])
            v.append(raw("v", float).reshape(-1, wide))
            cell.append(raw("cell", np.int32))
            d.append(raw("d", float))
        by_id = np.argsort(ids[1])
        known, cell_y, d_y, y = ids[1][by_id], cell[1][by_id], d[1][by_id], v[1][by_id]  # a place in y is an id's rank
        order = np.argsort(cell[0], kind="stable")
        ids_x, cell_x, x = ids[0][order], cell[0][order], v[0][order]
        self_ = np.minimum(np.searchsorted(known, ids_x), len(known) - 1)
        self_ = np.where(known[self_] == ids_x, self_, -1)
        xx, yy = (np.einsum("ij,ij->i", m, m) for m in (x, y))
        wide_x, wide_y = np.c_[x, xx, np.ones(len(x))], np.c_[-2 * y, np.ones(len(y)), yy]  # whose products are squared distances
        slack = 16 * (wide + 8) * np.finfo(float).eps * (xx.max() + yy.max())  # more than what products may be off by
        best, at = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
        starts = np.flatnonzero(np.r_[True, cell_x[1:] != cell_x[:-1]])
        for low, high in zip(starts, np.r_[starts[1:], len(x)], strict=True):
            c = cell_x[low]
            near = np.flatnonzero(must[c, cell_y] & (d_y >= least[c, cell_y]))
            for j in range(0, len(near), 2048):
                other = near[j : j + 2048]
                z = wide_y[other].T
                for i in range(low, high, 256):
                    rows = slice(i, min(high, i + 256))
                    about = wide_x[rows] @ z
                    most = best[rows, -1]
                    if np.isinf(most).any() and len(other) > k + 1:  # of every so-manieth row the k + 1 nearest, one of which may be the row itself
                        some = about[:, :: max(1, min(4, len(other) // (4 * (k + 1))))]
                        most = np.minimum(most, np.partition(some, k, axis=1)[:, k] + slack)
                    r, o = np.nonzero(about <= (most + slack)[:, None])
                    r, o = r + i, other[o]
                    keep = self_[r] != o
                    r, o = r[keep], o[keep]
                    if not len(r):
                        continue
                    exact = np.zeros(len(r))
                    for q in range(wide):
                        exact += (x[r, q] - y[o, q]) ** 2
                    had = np.unique(r)
                    r, o, exact = np.r_[np.repeat(had, k), r], np.r_[at[had].ravel(), o], np.r_[best[had].ravel(), exact]
                    by = np.lexsort((o, exact, r))
                    r, o, exact = r[by], o[by], exact[by]
                    new = np.searchsorted(r, had)
                    take = new[:, None] + np.arange(k)  # each row has k entries at least, infinite ones last
                    best[had], at[had] = exact[take], o[take]
        r, p = np.nonzero(np.isfinite(best))
        return pa.table([pa.array(ids_x[r], kinds), pa.array(known[at[r, p]], kinds), pa.array(best[r, p])], names=["src", "dst", "d2"])

    placed = found.rows.mapInPandas(place, f"id {kind}, v array<double>, cell int, d double, block long")
    packed = placed.groupBy("block").applyInArrow(pack, f"block long, ids array<{kind}>, v binary, cell binary, d binary")
    dealt = packed.mapInArrow(deal, f"own long, part long, side int, ids array<{kind}>, v binary, cell binary, d binary")
    return dealt.groupBy("own", "part").applyInArrow(meet, f"src {kind}, dst {kind}, d2 double")


def _first(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """df with place: the first k rows of each group, found within shares of it first, so that no large group is in one task."""
    salted = df.withColumn("__share", F.pmod(F.xxhash64(order[-1]), F.lit(64)))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    some = salted.withColumn("place", place(*by, "__share")).filter(F.col("place") <= k).drop("place", "__share")
    return some.withColumn("place", place(*by)).filter(F.col("place") <= k)


def knn_edges(df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int | None = None, pivots: int | None = None) -> DataFrame:
    """(src, dst, d2, place): for each vector its k nearest others by squared distance, exactly; ties by id. Null vectors have none.

    Equal vectors are one point: the points' neighbours are found, and of a point's ids the first k + 1 can be neighbours. Points
    are dealt to the cells of pivots, and cells to blocks. Blocks meet only those with cells that may hold neighbours (see `cells`),
    and of these only rows that may be some. A task compares a few blocks with a few others, by products that leave out what is surely
    farther than the k best so far; what they leave is measured exactly, and the best of all tasks are taken. How much the cells leave out is
    up to the data: vectors without structure in many dimensions meet all others, while in few dimensions the share that is met
    falls as rows grow."""
    kind = df.schema[key].dataType.simpleString()
    rows = cut(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null"))
    points = cut(rows.groupBy("v").agg(F.min("id").alias("point"), F.count("*").alias("n")))
    found = cells(points, k, "point", "v", pivots)
    if found is None:
        return df.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, d2 double, place long")
    place = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst")).cast("long")
    near = _nearest(found, k, kind, block).withColumn("place", place).filter(F.col("place") <= k)
    if points.filter("n > 1").isEmpty():
        return near
    near = cut(near)
    copies = points.filter("n > 1").select("v", "point")
    members = cut(rows.join(copies, "v", "left").select("id", F.coalesce("point", "id").alias("point")))
    few = cut(_first(members, ["point"], ["id"], k + 1).select("point", "id"))
    own = few.select(F.col("point").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"))
    others = near.join(few, near["dst"] == few["point"]).select("src", F.col("id").alias("dst"), "d2")
    best = own.unionAll(others).withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d2", "dst"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["dst"] != F.col("id")), 1, k)
    listed = members.join(best, members["point"] == best["src"]).select(F.col("id").alias("src"), F.posexplode(others).alias("at", "b"))
    return listed.select("src", F.col("b.dst").alias("dst"), F.col("b.d2").alias("d2"), (F.col("at") + 1).cast("long").alias("place"))


def similarity(edges: DataFrame, sigma: float = 1.0, mode: str = "mutual") -> DataFrame:
    """(src, dst, w) in both directions, w = exp(-d2 / (2 sigma^2)). mutual: edges that both ends have; union: the mean of both, 0 for a missing one."""
    ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
    w = edges.select(F.explode(F.array(*ends)).alias("e"), F.exp(-F.col("d2") / (2 * sigma * sigma)).alias("w"))  # a union would find neighbours twice
    both = w.select("e.src", "e.dst", "w").groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    if mode == "mutual":
        return both.filter("n = 2").select("src", "dst", (F.col("s") / 2).alias("w"))
    if mode == "union":
        return both.select("src", "dst", (F.col("s") / 2).alias("w"))
    raise ValueError(f"unknown mode {mode}")


def laplacian(graph: DataFrame) -> DataFrame:
    """(src, dst, l): the entries of the normalised Laplacian; nodes without weight have none."""
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d")).filter("d > 1e-10")
    a, b = degree.select(F.col("node").alias("src"), F.col("d").alias("da")), degree.select(F.col("node").alias("dst"), F.col("d").alias("db"))
    off = graph.join(a, "src").join(b, "dst").select("src", "dst", (-F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("l"))
    return off.unionAll(degree.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("l")))


def sparsity(graph: DataFrame, nodes: int, value: str = "w", dense_gb: float = 1.0) -> DataFrame:
    """One row: nodes, nnz (above 1e-10), density, mean, min and max of entries a row, dense and sparse MB, use_sparse."""
    rows = graph.filter(F.abs(value) > 1e-10).groupBy("src").agg(F.count("*").alias("n"))
    one = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.count("*").alias("__rows"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    dense = nodes * nodes * 8 / 2**20
    density = F.col("nnz") / float(nodes * nodes)
    return one.select(F.lit(nodes).cast("long").alias("nodes"), "nnz", density.alias("density"), (F.col("nnz") / nodes).alias("mean_row"), F.when(F.col("__rows") < nodes, 0).otherwise(F.col("least")).alias("min_row"), F.col("most").alias("max_row"), F.lit(dense).alias("dense_mb"), (F.col("nnz") * 16 / 2**20 + (nodes + 1) * 8 / 2**20).alias("sparse_mb"), ((1 - density > 0.9) & F.lit(dense > dense_gb * 1024)).alias("use_sparse"))


@dataclass
class Eigen:
    """What smallest_eigenvectors found: a table (node, f) of orthonormal vectors, and for each its eigenvalue and the norm of L f - value f."""

    vectors: DataFrame
    values: np.ndarray
    residuals: np.ndarray
    products: int  # of the Laplacian with the vectors


class _Blocks:
    """A Laplacian in blocks of about `block` nodes by hash, to be multiplied with matrices of a row for each node.

    names: (node, block, row). edges: (block, (-1, to, rows, starts, columns, l)), for each two blocks with edges those that bring values
    from `block` to `to`. A matrix is (block, (place, rows)), its place among the matrices that it meets. All are dealt by block alike and
    kept, so that what a product shuffles are the sums that blocks send to each other, of rows with edges only."""

    def __init__(self, lap: DataFrame, nodes: DataFrame, n: int, block: int = 1 << 16):
        self.spark, self.n = lap.sparkSession, n
        self.many = max(-(-n // block), min(shuffle_partitions(self.spark), -(-n // 4096)), 1)
        at = F.pmod(F.xxhash64("node"), F.lit(self.many))
        row = F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1
        self.names = cut(nodes.withColumn("block", at).withColumn("row", row))
        one, other = (self.names.select(F.col("node").alias(x), F.col("block").alias(f"{x}_block"), F.col("row").alias(f"{x}_row")) for x in ("src", "dst"))
        named = lap.join(one, "src").join(other, "dst").select(F.col("dst_block").alias("block"), F.col("src_block").alias("to"), "src_row", "dst_row", "l")

        def pack(table: pa.Table) -> pa.Table:
            row, column, value = (np.asarray(table[c].combine_chunks()) for c in ("src_row", "dst_row", "l"))
            order = np.lexsort((column, row))
            row = row[order].astype(np.int32)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            cells = [row[starts], starts.astype(np.int32), column[order].astype(np.int32), value[order]]
            return pa.table([table["block"].slice(0, 1), table["to"].slice(0, 1), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["block", "to", "rows", "starts", "columns", "l"])

        entries = named.groupBy("block", "to").applyInArrow(pack, "block long, to long, rows binary, starts binary, columns binary, l binary")
        kinds = (np.int32, np.int32, np.int32, float)
        self.edges = self._kept(self._dealt(entries.rdd.map(lambda r: (r[0], (-1, r[1], *(np.frombuffer(x, t) for x, t in zip(r[2:], kinds, strict=True)))))))

    def _dealt(self, rdd: RDD) -> RDD:
        return rdd.partitionBy(self.many).mapValues(lambda v: v)  # which are in batches as others are, or each union would make them anew

    @staticmethod
    def _kept(rdd: RDD) -> RDD:
        return rdd.persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def drop(*of: RDD) -> None:
        """Delete kept matrices and what was shuffled for them, which would stay until the driver happens to collect its garbage."""
        for rdd in of:
            rdd._jrdd.rdd().cleanShuffleDependencies(False)
            rdd.unpersist()

    def _meet(self, *of: RDD) -> RDD:
        """(block, all that they have of it); they are dealt alike, so nothing is shuffled."""
        return reduce(lambda a, b: a.union(b), of).groupByKey(self.many)

    def table(self, vectors: DataFrame, place: int = 0) -> RDD:
        """The matrix of a table (node, y); nodes that it lacks are zeros."""

        def pack(table: pa.Table) -> pa.Table:
            rows = np.asarray(table["row"].combine_chunks())
            y = table["y"].combine_chunks()
            known = np.asarray(y.is_valid())
            out = np.zeros((rows.max() + 1, len(y.flatten()) // max(1, known.sum())))
            out[rows[known]] = np.asarray(y.flatten()).reshape(known.sum(), -1)
            return pa.table([table["block"].slice(0, 1), pa.array([out.tobytes()], pa.binary()), pa.array([len(out)])], names=["block", "y", "n"])

        packed = self.names.join(vectors, "node", "left").select("block", "row", "y").groupBy("block").applyInArrow(pack, "block long, y binary, n long")
        return self._kept(self._dealt(packed.rdd.map(lambda r: (r[0], (place, np.frombuffer(r[1]).reshape(r[2], -1))))))

    def times(self, place: int, made: Callable[..., np.ndarray], *of: RDD) -> RDD:
        """The matrix made(product, *of) by rows of the matrices `of`, whose places rise and whose last is multiplied."""

        def part(found: tuple[int, Iterable[tuple]]) -> Iterator[tuple[int, tuple]]:
            edges, own = [], None
            for v in found[1]:
                if v[0] < 0:
                    edges.append(v[1:])
                else:
                    own = v[1]
            for to, rows, starts, columns, value in edges:
                sums = np.empty((len(rows), own.shape[1]))
                for j in range(0, own.shape[1], 16):  # products of all edges are held for a few columns only
                    sums[:, j : j + 16] = np.add.reduceat(value[:, None] * own[columns, j : j + 16], starts, axis=0)
                yield to, (-1, rows, sums)

        def whole(found: Iterable[tuple]) -> tuple[int, np.ndarray]:
            sent, had = [], {}
            for v in found:
                if v[0] < 0:
                    sent.append(v[1:])
                else:
                    had[v[0]] = v[1]
            own = [had[k] for k in sorted(had)]
            total = np.zeros_like(own[0])
            for rows, sums in sent:
                total[rows] += sums
            return place, made(total, *own)

        sums = self._dealt(self._meet(self.edges, of[-1]).flatMap(part))
        return self._kept(self._meet(*of, sums).mapValues(whole))

    def gram(self, *of: RDD) -> np.ndarray:
        """The inner products of all columns, those of the least place first."""

        def add(total: np.ndarray | float, found: tuple[int, Iterable[tuple]]) -> np.ndarray:
            own = [y for _, y in sorted(found[1], key=lambda v: v[0])]
            for low in range(0, len(own[0]), 8192):
                m = np.hstack([y[low : low + 8192] for y in own])
                total = total + m.T @ m
            return total

        return self._meet(*of).treeAggregate(0.0, add, lambda a, b: a + b)

    def mixed(self, turn: np.ndarray, *of: RDD) -> RDD:
        """The matrix of all columns, those of the least place first, times `turn`."""

        def add(found: Iterable[tuple]) -> tuple[int, np.ndarray]:
            own = [y for _, y in sorted(found, key=lambda v: v[0])]
            at = np.cumsum([0, *(y.shape[1] for y in own)])
            return 0, sum(y @ turn[low:high] for y, low, high in zip(own, at[:-1], at[1:], strict=True))

        return self._kept(self._meet(*of).mapValues(add))

    def rows(self, of: RDD) -> DataFrame:
        """(node, f), the rows of a matrix."""
        kinds = "block long, row int, f array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, y, d in zip(*batch.columns, strict=True):
                    m = np.frombuffer(y.as_buffer(), float).reshape(-1, d.as_py())
                    for low in range(0, len(m), 8192):
                        part = m[low : low + 8192]
                        yield pa.record_batch([pa.array(np.full(len(part), block.as_py())), pa.array(np.arange(low, low + len(part), dtype=np.int32)), pa.array(list(part), pa.list_(pa.float64()))], ["block", "row", "f"])

        packed = self.spark.createDataFrame(of.map(lambda v: (v[0], bytearray(v[1][1].tobytes()), v[1][1].shape[1])), "block long, y binary, d long", verifySchema=False)
        return self.names.join(packed.mapInArrow(run, kinds), ["block", "row"]).select("node", "f")


def _ritz(g: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns Y and of L Y = (Y and more columns) m, by the inner products g of Y and more columns: the best approximations to
    eigenvalues within the span of Y, the residuals, and what turns Y to the vectors."""
    size = m.shape[1]
    inner, with_l, both_l = g[:size, :size], g[:size] @ m, m.T @ g @ m
    length = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    scale, basis = np.linalg.eigh(inner / np.outer(length, length))
    basis = basis[:, scale > 1e-13] / np.sqrt(scale[scale > 1e-13]) / length[:, None]
    small = basis.T @ with_l @ basis
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = basis @ turn
    return values, np.sqrt(np.maximum(np.einsum("ij,ij->j", turn, both_l @ turn) - values**2, 0)), turn


def smallest_eigenvectors(lap: DataFrame, d: int, tol: float = 1e-5, degree: int = 12, rounds: int = 200, more: int | None = None, seed: int = 42) -> Eigen:
    """The d eigenvectors of the Laplacian with the smallest eigenvalues, by block Krylov spaces with restarts.

    Of a block of d + more vectors, small matrices of inner products give the best approximations within their span and how far
    these are from eigenvectors (Rayleigh-Ritz). Until the first d are within `tol`, the block becomes the best approximations within the
    span of its products with `degree` Chebyshev polynomials of the Laplacian, lowest first. RuntimeError if `rounds` of that don't suffice.
    Matrices are dealt in blocks of nodes; a product is a shuffle of blocks' sums, and only small matrices pass the driver.
    Where there are fewer than d nodes, there are as many vectors. Equal eigenvalues have any basis of their space."""
    lap = cut(lap)
    nodes = lap.filter("src = dst").select(F.col("src").alias("node"))
    blocks = _Blocks(lap, nodes, nodes.count())
    try:
        return _smallest(blocks, d, tol, degree, rounds, more, seed)
    finally:
        blocks.drop(blocks.edges)


def _smallest(blocks: _Blocks, d: int, tol: float = 1e-5, degree: int = 12, rounds: int = 200, more: int | None = None, seed: int = 42) -> Eigen:
    n, nodes = blocks.n, blocks.names.select("node")
    d = min(d, n)
    size = min(n, d + (max(12, d // 2) if more is None else more))
    if not d:
        return Eigen(nodes.select("node", F.array().cast("array<double>").alias("f")), np.empty(0), np.empty(0), 0)
    start = nodes.select("node", F.array(*(F.sin(F.xxhash64(F.lit(seed + j), "node") % 100_003) for j in range(size))).alias("y"))
    made, products = [blocks.table(start)], 0
    for round_ in range(rounds + 1):
        first = made[-1]
        first.checkpoint()
        now = [first, blocks.times(1, lambda p, y: p - y, first)]
        g = blocks.gram(*now)
        products += 1
        blocks.drop(*made[:-1])
        one, none = np.eye(size), np.zeros((size, size))
        values, residuals, turn = _ritz(g, np.vstack([one, one]))
        if residuals[:d].max() <= tol or size == n:
            found = cut(blocks.rows(blocks.mixed(turn[:, :d], first)))
            blocks.drop(*now)
            return Eigen(found, np.maximum(values[:d], 0), residuals[:d], products)
        if round_ == rounds:
            break
        steps = max(2, min(degree, n // size))
        for i in range(2, steps + 1):
            now.append(blocks.times(i, lambda p, x, y: 2 * (p - y) - x, now[i - 2], now[i - 1]))
        products += steps - 1
        # L times a polynomial is itself and half its neighbours, or itself and the next of the first one
        shift = [[one if k == i or (k, i) == (1, 0) else one / 2 if abs(k - i) == 1 else none for i in range(steps)] for k in range(steps + 1)]
        turn = _ritz(blocks.gram(*now), np.block(shift))[2][:, :size]
        size = turn.shape[1]
        made = [*now, blocks.mixed(turn, *now[:-1])]
    raise RuntimeError(f"{rounds} rounds left residuals of {residuals[:d].max():.2g}")


def gram(df: DataFrame, vector: str, d: int) -> np.ndarray:
    """The sum of outer products of a vector column, summed within tasks first."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for b in batches:
            if len(b):
                x = np.stack(b["x"])
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(d * d), "x": total.ravel()})

    sums = df.select(F.col(vector).alias("x")).mapInPandas(part, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
    return sums["x"].to_numpy().reshape(d, d) if len(sums) else np.zeros((d, d))


def project(df: DataFrame, vector: str, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """df with vector times matrix (m by d), as expressions in the JVM."""
    columns = [F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(v)) for v in matrix[:, j])), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for j in range(matrix.shape[1])]
    return df.withColumn(out, F.array(*columns))


@dataclass
class Projection:
    """What learn_projection found: the matrix (m by d), the history of its rounds, why it stopped, and the graph's eigenvalues."""

    matrix: np.ndarray
    changes: list[float]
    objectives: list[float]
    stopped: str
    values: np.ndarray


def stop_reason(changes: Sequence[float], objectives: Sequence[float], tol: float) -> str:
    """Why iterations stop after these relative changes and objectives; "" to go on. Stopped for a small change; for an objective
    that fell by less than a ten-thousandth over five rounds; for three small changes in a row; for a fairly small one after twenty rounds."""
    i = len(changes) - 1
    if changes[-1] < tol:
        return "converged"
    if i >= 5 and (objectives[-5] - objectives[-1]) / (abs(objectives[-5]) + 1e-10) < 1e-4:
        return "objective stands still"
    if i >= 3 and max(changes[-3:]) < 10 * tol:
        return "small changes"
    if i >= 20 and changes[-1] < 50 * tol:
        return "converged slowly"
    return ""


def learn_projection(rows: DataFrame, lap: DataFrame, d: int, vector: str = "v", key: str = "id", alpha: float = 2.0**-10, beta: float = 0.1, rounds: int = 20, tol: float = 1e-5, **eigen) -> Projection:
    """A projection (m by d) that follows the graph, by alternating directions.

    F starts as the d smallest eigenvectors (see smallest_eigenvectors for `eigen`); where A is not 0, F moves towards X A and is made
    orthonormal again. A's columns are solved in turn with the diagonal of X^T X, and a column lives only if its residual exceeds
    beta / (2 alpha). F is always a sum F0 B + X C of fixed tables, so all rounds work with small matrices of inner products, of the tables
    and of their products with the Laplacian, which are one pass each. Rounds end by `stop_reason`, not before the second."""
    lap = cut(lap)
    nodes = lap.filter("src = dst").select(F.col("src").alias("node"))
    blocks = _Blocks(lap, nodes, nodes.count())
    found = _smallest(blocks, d, **eigen)
    f0, d = found.vectors, len(found.values)
    m = len(rows.select(vector).first()[0])
    joined = blocks.table(rows.join(f0, rows[key] == f0["node"]).select("node", F.concat(F.col(vector).cast("array<double>"), F.col("f")).alias("y")))
    product = blocks.times(1, lambda p, y: p, joined)
    both = blocks.gram(joined, product)
    blocks.drop(joined, product, blocks.edges)
    g, gl = both[: m + d, : m + d], both[: m + d, m + d :]
    xx, xf, ff = g[:m, :m], g[:m, m:], g[m:, m:]
    a, b, c = np.zeros((m, d)), np.eye(d), np.zeros((m, d))  # F = F0 b + X c
    changes, objectives, why, limit = [], [], "", beta / (2 * alpha)
    for _ in range(rounds):
        old = b, c
        if a.any():
            c2 = alpha * a / (1 + alpha)
            inner = b.T @ ff @ b + c2.T @ xf @ b + (c2.T @ xf @ b).T + c2.T @ xx @ c2
            values, vectors = np.linalg.eigh(inner)
            root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
            b, c = b @ root, c2 @ root
        target = xf @ b + xx @ c
        diag = np.diag(xx) + 1e-10
        new = np.zeros_like(a)
        for j in range(d):
            r = target[:, j] if j == 0 else target[:, j] - xx @ a[:, j] + diag * a[:, j]
            norm = np.linalg.norm(r)
            if norm > limit:
                new[:, j] = (1 - limit / norm) * r / diag
        a = new
        whole = np.vstack([c, b])  # F in terms of X and F0
        off = np.vstack([a - c, -b])
        objectives.append(float(np.trace(whole.T @ gl @ whole) + alpha * np.trace(off.T @ g @ off) + beta * np.linalg.norm(a, axis=0).sum()))
        moved = np.vstack([c - old[1], b - old[0]])
        changes.append(float(np.sqrt(max(np.trace(moved.T @ g @ moved), 0)) / max(np.sqrt(d), 1e-10)))
        if len(changes) > 1 and (why := stop_reason(changes, objectives, tol)):
            break
    return Projection(a, changes, objectives, why or "rounds over", found.values)


def reconstruction_error(df: DataFrame, vector: str, matrix: np.ndarray) -> DataFrame:
    """One row: mse, the mean squared difference of vectors and what their projections give back."""
    back = matrix @ np.linalg.pinv(matrix)
    rows = project(df.select(F.col(vector).cast("array<double>").alias("__x")), "__x", back, "__y")
    return rows.select(F.aggregate(F.zip_with("__x", "__y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("e")).agg((F.avg("e") / matrix.shape[0]).alias("mse"))
