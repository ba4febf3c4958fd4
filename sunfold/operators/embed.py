"""Phase-space features: mutual information, delays, lag embedding, local weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, dealt, windowed


def mutual_information(df: DataFrame, column: str = "power", max_lag: int = 10, series: str = SERIES) -> DataFrame:
    """(series, lag, n, bins, ami): mutual information, in nats, of values `lag` rows apart, over histograms of floor(sqrt(n))
    bins of equal width. Lags are columns of one pass; counts combine before the shuffle."""
    rows = windowed(df.select(series, "ts", "row_id", F.col(column).alias("x")), lambda w: {f"y{k}": F.lead("x", k).over(w) for k in range(1, max_lag + 1)}, 0, max_lag, series)
    lags = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in range(1, max_lag + 1)))
    pairs = rows.select(series, "x", F.explode(lags).alias("l")).select(series, "l.lag", "x", "l.y").filter("x is not null and y is not null")
    facts = pairs.groupBy(series, "lag").agg(F.count("*").alias("n"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb")).withColumn("bins", F.greatest(F.floor(F.sqrt("n")), F.lit(1)))
    facts = facts.select(F.col(series).alias("__s"), F.col("lag").alias("__l"), "n", "xa", "xb", "ya", "yb", "bins")

    def place(v: str, lo: str, hi: str) -> Column:
        return F.least(F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(lo)) * F.col("bins"), F.col(hi) - F.col(lo))), F.lit(0)), F.col("bins") - 1)

    binned = pairs.join(facts, F.col(series).eqNullSafe(F.col("__s")) & (F.col("lag") == F.col("__l")))
    cells = binned.groupBy(series, "lag", "n", "bins", place("x", "xa", "xb").alias("i"), place("y", "ya", "yb").alias("j")).agg(F.count("*").alias("c"))
    px = cells.groupBy(F.col(series).alias("s1"), F.col("lag").alias("l1"), F.col("i").alias("i1")).agg(F.sum("c").alias("cx"))
    py = cells.groupBy(F.col(series).alias("s2"), F.col("lag").alias("l2"), F.col("j").alias("j2")).agg(F.sum("c").alias("cy"))
    all_ = cells.join(px, F.col(series).eqNullSafe(F.col("s1")) & (F.col("lag") == F.col("l1")) & (F.col("i") == F.col("i1"))).join(py, F.col(series).eqNullSafe(F.col("s2")) & (F.col("lag") == F.col("l2")) & (F.col("j") == F.col("j2")))
    p = F.col("c") / F.col("n")
    term = p * F.log((p + 1e-12) / (F.col("cx") / F.col("n") * (F.col("cy") / F.col("n")) + 1e-12))
    return all_.groupBy(series, "lag", "n", "bins").agg(F.sum(term).alias("ami"))


def time_delay(ami: DataFrame, series: str = SERIES) -> DataFrame:
    """(series, delay): the lag before the mutual information first rises; without a rise 1."""
    one = ami.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("lag", "ami"))).alias("a"))  # a row for each lag
    rise = F.filter(F.sequence(F.lit(1), F.greatest(F.size("a") - 1, F.lit(1))), lambda i: F.coalesce(F.get("a", i)["ami"] > F.get("a", i - 1)["ami"], F.lit(False)))
    return one.select(series, F.coalesce(F.get("a", F.get(rise, F.lit(0)) - 1)["lag"], F.lit(1)).alias("delay"))


def false_neighbour_ratio(df: DataFrame, column: str = "power", dimension: int = 5, delay: int = 1, tolerance: float = 10.0, series: str = SERIES) -> DataFrame:
    """(series, dimension, ratio): of successive points of the embedding, the share that moves apart more than `tolerance`
    times their distance when a dimension is added."""
    far = dimension * delay

    def columns(w):
        at = lambda k: F.lead(column, k).over(w)
        d2 = sum(((at((i * delay) + 1) - at(i * delay) if i else at(1) - F.col(column)) ** 2 for i in range(dimension)), F.lit(0.0))
        return {"d": F.sqrt(d2), "more": F.abs(at(far + 1) - at(far))}

    rows = windowed(df, columns, 0, far + 1, series).filter("d is not null and more is not null")
    return rows.groupBy(series).agg(F.lit(dimension).alias("dimension"), F.avg(F.when(F.col("more") > tolerance * F.col("d"), 1.0).otherwise(0.0)).alias("ratio"))


def embedding(df: DataFrame, column: str = "power", dimension: int = 5, delay: int = 1, series: str = SERIES) -> DataFrame:
    """df with rn and e0..e<m-1>, the values delay rows on each; rows without all of them are left out."""
    rows = windowed(df, lambda w: {f"e{k}": F.lead(column, k * delay).over(w) if k else F.col(column).cast("double") for k in range(dimension)} | {"__last": F.lead("rn", (dimension - 1) * delay).over(w) if dimension > 1 else F.col("rn")}, 0, max(1, (dimension - 1) * delay), series)
    return rows.filter("__last is not null").drop("__last")


def allocation(total: int, features: int) -> list[int]:
    """Dimensions for each feature: equal shares, the first ones taking what is left."""
    return [total // features + (i < total % features) for i in range(features)]


def reconstruction(df: DataFrame, columns: Sequence[str], weights: Sequence[float] | None = None, total: int = 30, delay: int = 1, series: str = SERIES) -> DataFrame:
    """df with rn and r, the weighted lag embeddings of all columns side by side (array of `total`); rows near the end, where one is incomplete, are all 0."""
    parts = allocation(total, len(columns))
    weights = weights or [1.0] * len(columns)
    reach = (max(parts) - 1) * delay

    def made(w):
        values = [(F.lead(c, k * delay).over(w) if k else F.col(c).cast("double")) * float(x) for c, m, x in zip(columns, parts, weights, strict=True) for k in range(m)]
        whole = (F.lead("rn", reach).over(w) if reach else F.col("rn")).isNotNull()
        return {"r": F.array(*(F.when(whole, F.coalesce(v, F.lit(0.0))).otherwise(0.0) for v in values))}

    return windowed(df, made, 0, max(1, reach), series)


def neighbourhood(df: DataFrame, column: str = "power", length: int = 32, series: str = SERIES) -> DataFrame:
    """df with rn and, over the last `length` rows: n, mean, std (sample), min, max."""

    def columns(w):
        f = w.rowsBetween(-(length - 1), 0)
        return {"n": F.count(column).over(f), "mean": F.avg(column).over(f), "std": F.stddev_samp(column).over(f), "min": F.min(column).over(f), "max": F.max(column).over(f)}

    return windowed(df, columns, length - 1, 0, series)


def neighbourhood_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """How far a label is, on average, from those of its neighbours weighed by exp(-distance), plus penalty * |w|^2; and the gradient."""
    diff = (x[:, None, :] - x[None, :, :]) ** 2
    dist = np.sqrt(diff @ (w * w))
    k = np.exp(-dist)
    live = k > 1e-10
    k = np.maximum(k, 1e-10)
    np.fill_diagonal(k, 0)
    total = k.sum(1) + 1e-8
    p = k / total[:, None]
    r = y - p @ y
    loss = np.abs(r).mean() + penalty * (w * w).sum()
    # d dist / d w = w * diff / dist; d k = -k d dist; r_i = y_i - sum_j p_ij y_j, where p_i adds up to s_i = sum k / total
    back = -np.sign(r)[:, None] / len(y) * (y[None, :] - (p @ y)[:, None]) / total[:, None]
    inner = np.where(live, back * -k, 0) / np.maximum(dist, 1e-12)
    np.fill_diagonal(inner, 0)
    return loss, np.einsum("ij,ijd->d", inner, diff) * w + 2 * penalty * w


def learn_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 100, memory: int = 5) -> np.ndarray:
    """Feature weights from 0 to 1 that predict y from neighbours, adding up to 1: projected limited-memory quasi-Newton from equal
    weights; equal weights where it fails."""
    d, y = x.shape[1], (y - y.mean()) / (y.std() + 1e-8)
    penalty = min(0.1, max(0.001, penalty))
    w = np.full(d, 1 / d)
    loss, g = neighbourhood_loss(x, y, w, penalty)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((w <= 0) & (g > 0)) | ((w >= 1) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-3:
            break
        q, hold = np.where(free, g, 0), []
        for s, t in reversed(steps):
            a = s @ q / (s @ t)
            hold.append(a)
            q = q - a * t
        if steps:
            q = q * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, t), a in zip(steps, reversed(hold), strict=True):
            q = q + s * (a - t @ q / (s @ t))
        q = np.where(free, q, 0)
        if q @ g <= 0:
            q = np.where(free, g, 0)
        size, found = 1.0, False
        for _ in range(30):
            new = np.clip(w - size * q, 0, 1)
            new_loss, new_g = neighbourhood_loss(x, y, new, penalty)
            if new_loss <= loss - 1e-4 * (g @ (w - new)):
                found = True
                break
            size /= 2
        if not found:
            break
        s, t = new - w, new_g - g
        if s @ t > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, t)]
        done = loss - new_loss <= 1e-5 * max(abs(loss), abs(new_loss), 1.0)
        w, loss, g = new, new_loss, new_g
        if done:
            break
    return w / w.sum() if np.isfinite(w).all() and w.sum() > 1e-8 else np.full(d, 1 / d)


def learn_many_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 100, memory: int = 5) -> np.ndarray:
    """learn_weights of many neighbourhoods of one size (x many by n by d), each by the same steps.

    As many go abreast as stay in a core's cache, each at its own step, and who is done makes room for the next, so that arrays are always
    full. Distances are symmetric: there is one for each pair of rows, and sums over a row's pairs are products with the table of pairs'
    ends. Steps that are not taken need no gradient."""
    many, n, d = x.shape
    y = (y - y.mean(1, keepdims=True)) / (y.std(1, keepdims=True) + 1e-8)
    penalty = min(0.1, max(0.001, penalty))
    one, two = np.triu_indices(n, 1)
    ends = np.zeros((len(one), n))
    ends[np.arange(len(one)), one] = ends[np.arange(len(one)), two] = 1
    pairs = np.ascontiguousarray(ends.T)
    some = max(1, (1 << 15) // max(1, len(one)))
    size = min(many, 2 * some)
    who, follow, out = np.arange(size), size, np.full((many, d), 1 / d)
    far, both, own = np.empty((size, d, len(one))), np.empty((size, len(one))), np.empty((size, n))
    w, tried, q, g = np.empty((4, size, d))
    loss, step, age, fails = np.empty(size), np.empty(size), np.empty(size, int), np.empty(size, int)
    s, t = np.zeros((2, memory, size, d))  # the last steps, newest last; none are zeros
    dot = lambda a, b: np.einsum("bd,bd->b", a, b)

    def enter(at: np.ndarray) -> None:
        new = who[at]
        for k in range(d):
            far[at, k] = (x[new][:, one, k] - x[new][:, two, k]) ** 2
        own[at], both[at] = y[new], y[new][:, one] + y[new][:, two]
        w[at], tried[at], q[at], g[at], loss[at], step[at], age[at], fails[at] = 1 / d, 1 / d, 0, 0, np.inf, 1, -1, 0
        s[:, at], t[:, at] = 0, 0

    def looked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """neighbourhood_loss where these try, which of them take the step, and the gradients of those."""
        at = slice(at[0], at[-1] + 1) if at[-1] - at[0] == len(at) - 1 else at  # no copies
        v, f, u, two_y = tried[at], far[at], own[at], both[at]
        dist = ((v * v)[:, None, :] @ f)[:, 0]
        np.sqrt(dist, out=dist)
        k = np.negative(dist)
        np.exp(k, out=k)
        low = k <= 1e-10
        np.maximum(k, 1e-10, out=k)
        near = k @ ends
        total = near + 1e-8
        guess = ((k * two_y) @ ends - u * near) / total  # a pair gives either end the other's label
        r = u - guess
        found = np.abs(r).mean(1) + penalty * dot(v, v)
        good = found <= loss[at] - 1e-4 * dot(g[at], w[at] - v)
        v, f, u, two_y, k, dist = v[good], f[good], u[good], two_y[good], k[good], dist[good]
        k *= ~low[good]
        k /= np.maximum(dist, 1e-12, out=dist)
        c = np.sign(r[good]) / (n * total[good])
        k *= (c @ pairs) * two_y - (c * (u + guess[good])) @ pairs
        return found, good, (f @ k[:, :, None])[:, :, 0] * v + 2 * penalty * v

    i = np.arange(size)
    enter(i)
    while len(i):
        seen = [looked(i[low : low + some]) for low in range(0, len(i), some)]
        found, good, new_g = (np.concatenate(c) for c in zip(*seen, strict=True))
        bad, go = i[~good], np.ones(size, bool)
        fails[bad] += 1
        step[bad] /= 2
        go[bad] = fails[bad] < 30
        at, found = i[good], found[good]
        begun = age[at] >= 0
        moved, turned = tried[at] - w[at], new_g - g[at]
        go[at] = ~begun | (loss[at] - found > 1e-5 * np.maximum(np.maximum(np.abs(loss[at]), np.abs(found)), 1.0))
        known = begun & (dot(moved, turned) > 1e-12)
        put = at[known]
        s[:-1, put], t[:-1, put] = s[1:, put], t[1:, put]
        s[-1, put], t[-1, put] = moved[known], turned[known]
        w[at], loss[at], g[at], step[at], fails[at] = tried[at], found, new_g, 1, 0
        age[at] += 1
        free = ~(((w[at] <= 0) & (new_g > 0)) | ((w[at] >= 1) & (new_g < 0)))
        slope = np.where(free, new_g, 0)
        go[at] &= (age[at] < rounds) & (np.abs(slope).max(1) >= 1e-3)
        on = go[at]
        at, free, slope = at[on], free[on], slope[on]
        new_q, hold = slope, []
        curve = [dot(s[m, at], t[m, at]) for m in range(memory)]
        over = [np.where(c > 0, 1 / np.where(c > 0, c, 1), 0) for c in curve]
        for m in reversed(range(memory)):
            a = dot(s[m, at], new_q) * over[m]
            hold.append(a)
            new_q = new_q - a[:, None] * t[m, at]
        length = dot(t[-1, at], t[-1, at])
        new_q = new_q * np.where(length > 0, curve[-1] / np.where(length > 0, length, 1), 1)[:, None]
        for m, a in zip(range(memory), reversed(hold), strict=True):
            new_q = new_q + s[m, at] * (a - dot(t[m, at], new_q) * over[m])[:, None]
        new_q = np.where(free, new_q, 0)
        q[at] = np.where((dot(new_q, g[at]) <= 0)[:, None], slope, new_q)
        done = i[~go[i]]
        out[who[done]] = w[done]
        more = done[: many - follow]
        who[more] = np.arange(follow, follow + len(more))
        follow += len(more)
        go[more] = True
        i = i[go[i]]
        tried[i] = np.clip(w[i] - step[i, None] * q[i], 0, 1)
        enter(more)
    total = out.sum(1, keepdims=True)
    whole = np.isfinite(out).all(1, keepdims=True) & (total > 1e-8)
    return np.where(whole, out / np.where(whole, total, 1), 1 / d)


def local_weights(df: DataFrame, columns: Sequence[str], label: str = "power", length: int = 32, penalty: float = 0.01, rounds: int = 100, series: str = SERIES, every: int = 1, block: int = 1024) -> DataFrame:
    """df's keys with rn and weights (array): learnt at each row from the last `length` rows (24 to 48), to tell the next row's
    label. every: only at each so-manieth row of a series. A task gets a block of rows and those that its neighbourhoods reach back to."""
    length, d = min(48, max(24, length)), len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = [*dict.fromkeys([series, "ts", "row_id"])]
    features = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x{k}") for k, c in enumerate(columns)]
    rows = df.select(*keys, *(["rn"] if "rn" in df.columns else []), *features, F.col(label).cast("double").alias("__y"))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        rn, own = (table[c].to_numpy() for c in ("rn", "__own"))
        x = np.stack([table[f"__x{k}"].to_numpy() for k in range(d)], 1)
        y, known = (c.to_numpy() for c in (table["__y"], table["__y"].is_valid()))
        y = np.where(np.r_[known[1:], False], np.r_[y[1:], np.nan], y)  # the next row's, or without one the own
        at = np.flatnonzero(own & (rn % every == 0))
        out = np.full((len(at), d), 1 / d)
        full = at >= length - 1
        if full.any():
            near = lambda v: np.lib.stride_tricks.sliding_window_view(v, length, 0)[at[full] - length + 1]
            out[full] = learn_many_weights(near(x).transpose(0, 2, 1), near(y), penalty, rounds)
        for i in np.flatnonzero(~full & (at >= 2)):  # a series' first rows
            out[i] = learn_weights(x[: at[i] + 1], y[: at[i] + 1], penalty, rounds)
        weights = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), pa.array(out.ravel()))
        return table.select([*keys, "rn"]).take(at).append_column("weights", weights)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rn long, weights array<double>"])
    return dealt(rows, length - 1, 1, series, block=block).groupBy(series, "__block").applyInArrow(learn, schema)


def mean_weights(weights: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, weight): mean weights over all rows."""
    at = F.create_map(*(F.lit(v) for i, c in enumerate(columns) for v in (i, c)))
    return weights.select(F.posexplode("weights")).groupBy("pos").agg(F.avg("col").alias("weight")).select(F.element_at(at, F.col("pos")).alias("column"), "weight")
