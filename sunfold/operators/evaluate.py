"""Error metrics, tests and figure data of predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfold.operators.ordered import ROW, SERIES, dealt, numbered, windowed
from sunfold.operators.quantiles import magnitude, quantiles
from sunfold.runtime import cut

EPS = 1e-8


def metric_columns(p: str = "prediction", t: str = "target") -> dict[str, Column]:
    """All metrics as aggregates, for any grouping: one pass, combined before the shuffle."""
    e, x = F.col(p) - F.col(t), F.col(t)
    both = e.isNotNull()
    e, x = F.when(both, e), F.when(both, x)
    rmse = F.sqrt(F.avg(e * e))
    return {
        "n": F.count(e),
        "rmse": rmse,
        "mae": F.avg(F.abs(e)),
        "nrmse": rmse / F.greatest(F.max(x) - F.min(x), F.lit(EPS)),
        "r2": 1 - F.sum(e * e) / F.greatest(F.var_pop(x) * F.count(x), F.lit(EPS)),
        "mape": F.coalesce(F.avg(F.when(F.abs(x) > EPS, F.abs(e / F.when(F.abs(x) > EPS, x)))) * 100, F.lit(0.0)),
        "max_error": F.max(F.abs(e)),
        "min_error": F.min(F.abs(e)),
        "error_std": F.stddev_pop(e),
    }


def metrics(df: DataFrame, by: Sequence[str] = (), **names) -> DataFrame:
    """Metrics of each group, or one row for all."""
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in metric_columns(**names).items()))


def metrics_with_total(df: DataFrame, by: str = "weather", **names) -> DataFrame:
    """Metrics of each class and, with a null class, of all rows, in one pass."""
    return df.rollup(by).agg(*(c.alias(k) for k, c in metric_columns(**names).items()))


def nrmse_variants(df: DataFrame, p: str = "prediction", t: str = "target") -> DataFrame:
    """One row: nrmse by the target's range, mean of absolute values, and sample deviation."""
    e, x = F.col(p) - F.col(t), F.col(t)
    rmse = F.sqrt(F.avg(e * e))
    over = lambda d: rmse / F.greatest(d, F.lit(EPS))
    return df.agg(over(F.max(x) - F.min(x)).alias("by_range"), over(F.avg(F.abs(x))).alias("by_mean"), over(F.stddev_samp(x)).alias("by_std"))


def metrics_long(df: DataFrame, by: str = "weather") -> DataFrame:
    """(class, metric, value)."""
    got = metrics(df, (by,)).withColumn("n", F.col("n").cast("double"))
    names = [c for c in got.columns if c != by]
    return got.unpivot([by], names, "metric", "value")


def metrics_pivot(df: DataFrame, states: Sequence[int] = (0, 1, 2), by: str = "weather") -> DataFrame:
    """(metric, a column for each class)."""
    out = metrics_long(df, by).groupBy("metric").pivot(by, list(states)).agg(F.first("value"))
    return out.select("metric", *(F.col(str(s)).alias(f"class_{s}") for s in states))


def multi_horizon(df: DataFrame, horizons: Sequence[int] = (1, 3, 6), p: str = "prediction", t: str = "target") -> DataFrame:
    """(horizon, metrics): a prediction against the target horizon - 1 rows on, within a series."""
    rows = windowed(df, lambda w: {f"__t{h}": F.lead(t, h - 1).over(w) if h > 1 else F.col(t) for h in horizons}, 0, max(horizons) - 1)
    long = rows.select(p, F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"__t{h}").alias("t")) for h in horizons))).alias("h")).select(p, "h.*")
    return metrics(long.filter("t is not null"), ("horizon",), p=p, t="t")


def paired(a: DataFrame, b: DataFrame, on: Sequence[str], p: str = "prediction", t: str = "target") -> DataFrame:
    """(d): differences of absolute errors of two models on the same rows."""
    x = a.select(*on, F.abs(F.col(p) - F.col(t)).alias("__a"))
    y = b.select(*on, F.abs(F.col(p) - F.col(t)).alias("__b"))
    return x.join(y, list(on)).select((F.col("__a") - F.col("__b")).alias("d"))


def t_test(d: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over differences d, a row (of each group): n, t, p_value (two-sided), cohens_d (by the population deviation), significant (p < 0.05)."""
    row = d.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.stddev_pop("d").alias("pop"))
    t = F.try_divide(F.col("m"), F.col("s") / F.sqrt("n"))
    value = F.pandas_udf(lambda x, n: pd.Series([_t_p(a, b - 1) for a, b in zip(x, n, strict=True)]), "double")
    out = row.select(*by, "n", t.alias("t"), F.try_divide("m", "pop").alias("cohens_d")).withColumn("p_value", value("t", "n"))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def _t_p(t: float, freedom: int) -> float | None:
    """Two-sided odds of Student's t, by the continued fraction of the incomplete beta function."""
    if t is None or freedom < 1 or t != t:
        return None
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x in (0.0, 1.0):
        return float(x)
    flip = x >= (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 + step * d
        d = 1 / (d if abs(d) > 1e-30 else 1e-30)
        c = 1 + step / (c if abs(c) > 1e-30 else 1e-30)
        f *= c * d
        if i and abs(c * d - 1) < 1e-13:
            break
    out = front * (f - 1)
    return 1 - out if flip else out


def with_rows_before(counts: DataFrame, value: str, n: str = "n", each: int = 1024) -> DataFrame:
    """counts, a row for each distinct value, with `before`: how many rows have smaller values. Sums run in two levels, over
    ranges of magnitude (`each` to a factor of e, by sign) and within each, so that no task orders all values."""
    ranged = counts.withColumn("__range", magnitude(F.col(value), each))
    sums = ranged.groupBy("__range").agg(F.sum(n).alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, whatever the rows
    base = sums.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.withColumn("__within", F.coalesce(F.sum(n).over(within), F.lit(0))).join(base, F.col("__range") == F.col("__of"))
    return both.withColumn("before", F.col("__base") + F.col("__within")).drop("__range", "__of", "__base", "__within")


def wilcoxon(d: DataFrame) -> DataFrame:
    """One row over differences d, zeros left out: n, w (the lesser sum of ranks), z and p_value by the normal
    approximation with ties. Ranks come from counts of equal absolute values."""
    rows = d.filter("d <> 0").select(F.abs("d").alias("x"), (F.col("d") > 0).alias("up"))
    ties = rows.groupBy("x").agg(F.count("*").alias("n"), F.count_if("up").alias("ups"))
    ranked = with_rows_before(ties, "x")
    rank = F.col("before") + (F.col("n") + 1) / 2
    one = ranked.agg(F.sum("n").alias("n"), F.sum(rank * F.col("ups")).alias("plus"), F.sum(rank * (F.col("n") - F.col("ups"))).alias("minus"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("tied"))
    n = F.col("n").cast("double")
    w = F.least("plus", "minus")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48))
    normal = F.pandas_udf(lambda x: x.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2))), "double")
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), w.alias("w"), z.alias("z")).withColumn("p_value", normal("z"))


def _uniform(key: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that look random, one for each key and step."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) ^ (step.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (z ^ z >> np.uint64(31)) / 2.0**64


def bootstrap_ci(df: DataFrame, p: str = "prediction", t: str = "target", rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: low and high of the mean absolute error over Poisson resamples. Each task weighs its errors in all rounds and
    passes on two sums for each round; they meet in one aggregate.

    Equal errors are counted first: together c rows weigh a Poisson number of mean c, each on its own one of mean 1. The
    numbers follow from the error and the round alone, so that results don't depend on how rows lie in partitions."""
    chance = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            e, c, k = (batch[name].to_numpy() for name in ("e", "c", "k"))
            for at in range(0, len(e), 2000):
                x = np.searchsorted(chance, _uniform(k[at : at + 2000, None], np.arange(rounds)[None, :] + (seed << 32)))
                for i in np.flatnonzero(c[at : at + 2000] > 1):
                    x[i] = np.random.default_rng([seed, int(k[at + i]) & 0xFFFFFFFF, int(k[at + i]) >> 32 & 0xFFFFFFFF]).poisson(c[at + i], rounds)
                n += x.sum(0)
                s += e[at : at + 2000] @ x
        yield pd.DataFrame({"round": np.arange(rounds), "n": n, "s": s})

    rows = df.select(F.abs(F.col(p) - F.col(t)).alias("e")).filter("e is not null").groupBy("e").agg(F.count("*").alias("c")).withColumn("k", F.xxhash64("e"))
    sums = rows.mapInPandas(run, "round long, n double, s double").groupBy("round").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    q = F.percentile(F.col("s") / F.col("n"), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return sums.filter("n > 0").agg(q.alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def error_histogram(df: DataFrame, bins: int = 50, p: str = "prediction", t: str = "target") -> DataFrame:
    """(bin, low, high, n): counts in bins of equal width over all errors; the last bin is closed; bins without errors are left out."""
    e = df.select((F.col(p) - F.col(t)).alias("e"))
    span = e.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("e") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("long")
    rows = e.filter("e is not null").join(F.broadcast(span), F.lit(True)).groupBy(at.alias("bin"), "lo", width.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def error_ecdf(df: DataFrame, p: str = "prediction", t: str = "target", digits: int = 1) -> DataFrame:
    """(error, share): share of absolute errors up to each of their values, cut to `digits`: a row for each such value."""
    counts = df.select((F.floor(F.abs(F.col(p) - F.col(t)) * 10.0**digits) / 10.0**digits).alias("error")).filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("every"))  # one row
    return with_rows_before(counts, "error").join(F.broadcast(every), F.lit(True)).select("error", ((F.col("before") + F.col("n")) / F.col("every")).alias("share"))


def error_qq(df: DataFrame, p: str = "prediction", t: str = "target", digits: int = 6) -> DataFrame:
    """(error, n, first_p, last_p, first_z, last_z): for each error, cut to `digits`, the normal quantiles that its first and
    last row are drawn at: medians of order statistics, as shares p and as quantiles z of the standard normal."""
    counts = df.select((F.round(F.col(p) - F.col(t), digits) + 0.0).alias("error")).filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))
    rows = with_rows_before(counts, "error").join(F.broadcast(counts.agg(F.sum("n").alias("every"))), F.lit(True))

    def share(place: Column) -> Column:
        every = F.col("every")
        top = F.pow(F.lit(0.5), 1 / every)
        return F.when(place == every, top).when(place == 1, 1 - top).otherwise((place - 0.3175) / (every + 0.365))

    normal = F.pandas_udf(lambda x: x.map(NormalDist().inv_cdf), "double")
    rows = rows.select("error", "n", share(F.col("before") + 1).alias("first_p"), share(F.col("before") + F.col("n")).alias("last_p"))
    return rows.withColumns({"first_z": normal("first_p"), "last_z": normal("last_p")})


def error_density(df: DataFrame, points: int = 200, p: str = "prediction", t: str = "target") -> DataFrame:
    """(point, error, density): a Gaussian kernel density of errors at evenly spaced points from least to greatest, of
    bandwidth deviation * n ** (-1 / 5). Each task adds up its rows' kernels; without two different errors there are no rows."""
    e = df.select((F.col(p) - F.col(t)).alias("e")).filter("e is not null")
    one = e.agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("*").cast("double").alias("rows"), F.stddev_samp("e").alias("sd")).filter("hi > lo")
    one = one.select("lo", ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"), "rows", (F.col("sd") * F.pow("rows", F.lit(-0.2))).alias("h"))
    rows = e.join(F.broadcast(one), F.lit(True)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + F.col("point") * F.col("step")
    u = (at - F.col("e")) / F.col("h")
    sums = rows.groupBy("point", at.alias("error"), "rows", "h").agg(F.sum(F.exp(-u * u / 2)).alias("s"))
    return sums.select("point", "error", (F.col("s") / (F.col("rows") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def error_band(df: DataFrame, by: str = "weather", width: float = 2.0, p: str = "prediction", t: str = "target") -> DataFrame:
    """(class, n, mean, low, high, outside): the band of `width` population deviations around the mean error, and the errors beyond it."""
    e = df.select(by, (F.col(p) - F.col(t)).alias("e"))
    reach = F.stddev_pop("e") * width
    band = e.groupBy(by).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), (F.avg("e") - reach).alias("low"), (F.avg("e") + reach).alias("high"))
    beyond = F.coalesce(~F.col("e").between(F.col("low"), F.col("high")), F.lit(False))
    classes = band.withColumnRenamed(by, "__by")  # a row for each class
    return e.join(F.broadcast(classes), F.col(by).eqNullSafe(F.col("__by"))).groupBy(by, "n", "mean", "low", "high").agg(F.count_if(beyond).alias("outside"))


def error_quartiles(df: DataFrame, by: str = "weather", p: str = "prediction", t: str = "target") -> DataFrame:
    """(class, q1, median, q3, low, high): quartiles of errors, and the furthest errors within 1.5 interquartile ranges."""
    e = df.select(by, (F.col(p) - F.col(t)).alias("e"))
    q = quantiles(e, "e", (0.25, 0.5, 0.75), [by]).select(F.col(by).alias("__by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inner = F.when(F.col("e").between(F.col("q1") - reach, F.col("q3") + reach), F.col("e"))
    return e.join(F.broadcast(q), F.col(by).eqNullSafe(F.col("__by"))).groupBy(by, "q1", "median", "q3").agg(F.min(inner).alias("low"), F.max(inner).alias("high"))


def regression_fit(df: DataFrame, p: str = "prediction", t: str = "target") -> DataFrame:
    """One row: slope, intercept and squared correlation of predictions on targets."""
    return df.agg(F.regr_slope(p, t).alias("slope"), F.regr_intercept(p, t).alias("intercept"), F.regr_r2(p, t).alias("r2"))


def relative_errors(df: DataFrame, p: str = "prediction", t: str = "target") -> DataFrame:
    """df with relative_error in percent (0 where the target is) and estimate: over, under or exact."""
    e = F.col(p) - F.col(t)
    return df.withColumns({"relative_error": F.when(F.col(t) == 0, 0.0).otherwise(e / F.when(F.col(t) != 0, F.col(t)) * 100), "estimate": F.when(e > 0, "over").when(e < 0, "under").otherwise("exact")})


def radar_scores(got: DataFrame) -> DataFrame:
    """Metrics as scores where more is better, for charts: errors e as 1 / (1 + e), mape as 1 - mape / 100 down to 0."""
    return got.select(*(c for c in got.columns if c in ("weather", "horizon")), *((1 / (1 + F.col(c))).alias(c) for c in ("rmse", "mae", "nrmse")), F.greatest(F.lit(0.0), 1 - F.col("mape") / 100).alias("mape"), "r2")


#: Grades' thresholds (fixed values): good below the first, normal below the second; r2 the other way round.
GRADES = {"rmse": (20.0, 30.0), "mae": (15.0, 25.0), "nrmse": (0.1, 0.2), "r2": (0.8, 0.9), "mape": (10.0, 20.0)}


def metric_grades(got: DataFrame, grades: Mapping[str, tuple[float, float]] = GRADES) -> DataFrame:
    """got with <metric>_grade: good, normal or bad."""
    out = {}
    for m, (a, b) in grades.items():
        x = F.col(m)
        out[f"{m}_grade"] = F.when(x > b, "good").when(x > a, "normal").otherwise("bad") if m == "r2" else F.when(x < a, "good").when(x < b, "normal").otherwise("bad")
    return got.withColumns(out)


def _last(k: int) -> Column:
    """The sum of __e over the last k rows of a series, from sums of sixteens: the rest of the first sixteen, whole ones, and the begun one row by
    row. A hundred rows take some twenty additions; it is also the order in which SQL sums over frames, so that a mean which lies
    just on a threshold is rounded to the same side."""
    w, at = Window.partitionBy(SERIES, "__block").orderBy("rn"), F.expr("rn % 16")
    first = F.col("rn") - (k - 1)
    rest = F.when((first > 0) & (F.pmod(first, F.lit(16)) > 0) & (first + 15 - F.pmod(first, F.lit(16)) <= F.col("rn")), F.lag("__rest", k - 1).over(w))
    whole = [F.when((at == 15 if j == 0 else F.lit(True)) & (at + 16 * j <= F.least(F.col("rn"), F.lit(k - 1))), F.lag("__whole", 16 * j).over(w) if j else F.col("__whole")) for j in range(k // 16, -1, -1)]
    begun = F.least(F.pmod(F.col("rn") + 1, F.lit(16)), F.lit(k)).cast("int")
    return F.aggregate(F.slice("__begun", F.size("__begun") + 1 - begun, begun), reduce(lambda x, y: x + F.coalesce(y, F.lit(0.0)), [rest, *whole], F.lit(0.0)), lambda x, y: x + y)


def _rolled(rows: DataFrame, p: str, t: str, window: int, recent: int, percentiles: bool) -> DataFrame:
    """Rolling errors of rows as `dealt` deals them, with window - 1 rows before each that counts."""
    rows = rows.withColumn("__e", F.abs(F.col(p) - F.col(t)).cast("double"))
    sixteen = Window.partitionBy(SERIES, "__block", F.expr("rn div 16")).orderBy("rn")
    rest, whole, begun = (sixteen.rowsBetween(a, b) for a, b in ((0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing), (Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__rest": F.sum("__e").over(rest), "__whole": F.sum("__e").over(whole), "__begun": F.collect_list(F.coalesce("__e", F.lit(0.0))).over(begun)})
    w = Window.partitionBy(SERIES, "__block").orderBy("rn")
    full, last = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(recent - 1), 0)
    tails = {f"error_p{q}": F.percentile("__e", q / 100).over(full) for q in (5, 95)} if percentiles else {}
    rows = rows.withColumns({"__s": _last(window), "__sl": _last(recent), "__nl": F.count("__e").over(last), "error_n": F.count("__e").over(full), "error_std": F.stddev_samp("__e").over(full)} | tails)
    old = F.try_divide(F.col("__s") - F.col("__sl"), F.col("error_n") - F.col("__nl"))
    trend = F.when(F.col("error_n") >= recent, (F.try_divide("__sl", "__nl") - old) / (old + 1e-10))
    return rows.withColumns({"error_mean": F.try_divide("__s", "error_n"), "error_trend": F.coalesce(trend, F.lit(0.0))}).drop("__e", "__rest", "__whole", "__begun", "__s", "__sl", "__nl")


def rolling_errors(df: DataFrame, p: str = "prediction", t: str = "target", window: int = 100, recent: int = 20, percentiles: bool = False) -> DataFrame:
    """df with rn and, over the last `window` absolute errors: mean, std (sample), p5, p95, and trend, the mean of the last
    `recent` against that of those before, relative to it; 0 while there are fewer than `recent`, or none before.
    p5 and p95 are exact and made only if `percentiles` asks for them."""
    return _rolled(dealt(df, window - 1), p, t, window, recent, percentiles).filter("__own").drop("__block", "__own")


def adaptation_levels(df: DataFrame, mean_at: float = 0.1, std_at: float = 0.15, trend_at: float = 0.05, late_at: float = 0.08) -> DataFrame:
    """Rolling errors with level, the highest that holds: 1 mean above its threshold 3 rows running, 2 std 2 rows running,
    3 trend 2 rows running, 4 a mean above `late_at` in at least 4 of the last 5 rows; 0 none."""
    w = Window.partitionBy(SERIES, "__block").orderBy("rn")
    run = lambda c, k: F.coalesce(F.count_if(c).over(w.rowsBetween(-(k - 1), 0)) == k, F.lit(False))
    late = (F.count_if(F.col("error_mean") > late_at).over(w.rowsBetween(-4, 0)) >= 4) & (F.count("*").over(w.rowsBetween(-4, 0)) == 5)
    level = F.when(late, 4).when(run(F.abs("error_trend") > trend_at, 2), 3).when(run(F.col("error_std") > std_at, 2), 2).when(run(F.col("error_mean") > mean_at, 3), 1).otherwise(0)
    rows = _rolled(dealt(df, 99 + 4), "prediction", "target", 100, 20, False)  # each of the last 5 rows has its own 99 before
    return rows.withColumn("level", level).filter("__own").drop("__block", "__own")


def fold_aggregate(got: DataFrame, columns: Sequence[str] = ("rmse", "mae", "nrmse", "r2", "mape"), by: str = "weather") -> DataFrame:
    """(class, folds, mean of each metric over folds) from metrics by fold and class."""
    return got.groupBy(by).agg(F.count_distinct("fold").alias("folds"), *(F.avg(c).alias(c) for c in columns))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, difference, improvement in percent) of two (metric, value) tables; for losses less is better."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
    sign = F.when(F.col("metric").contains("loss"), -1.0).otherwise(1.0)
    return both.withColumn("difference", F.col("b") - F.col("a")).withColumn("improvement", F.coalesce(F.try_divide(sign * F.col("difference"), F.abs("a")) * 100, F.lit(0.0)))


def against_baseline(df: DataFrame, baseline: int = 0, by: str = "weather", **names) -> DataFrame:
    """(class, metric, value, baseline, change in percent): each class's metrics against those of one class; a change is null
    where the baseline is 0 or absent."""
    long = metrics(df, (by,), **names).withColumn("n", F.col("n").cast("double"))
    long = long.unpivot([by], [c for c in long.columns if c != by], "metric", "value")
    base = long.filter(F.col(by) == baseline).select("metric", F.col("value").alias("baseline"))  # a row for each metric
    return long.join(F.broadcast(base), "metric", "left").select(by, "metric", "value", "baseline", (F.try_divide(F.col("value") - F.col("baseline"), F.abs("baseline")) * 100).alias("change"))


def significance_against(df: DataFrame, baseline: int = 0, states: Sequence[int] = (0, 1, 2), test: str = "paired_t", by: str = "weather", p: str = "prediction", t: str = "target", digits: int | None = None) -> DataFrame:
    """(class, mae, baseline_mae, unpaired, and what the test gives) for each other class of `states` with rows: whether its
    absolute errors differ from the baseline's. A positive difference is a greater error of the baseline.

    A class's rows in order of time meet the baseline's by their place, as far as both go; `unpaired` counts the rest of the
    longer, 0 for a proper paired test. Rows without an error don't count. digits: round differences, so that ties are ties.
    Without rows of the baseline or of another class there is no row; without spread t and p_value are null."""
    if test not in ("paired_t", "wilcoxon"):
        raise ValueError(f"unknown test {test}")
    e = df.select(F.col(by), "ts", ROW, F.abs(F.col(p) - F.col(t)).alias("e")).filter(F.col("e").isNotNull() & F.col(by).isin(*states))
    placed = cut(numbered(e, by).select(by, "rn", "e"))
    base = placed.filter(F.col(by) == baseline).select("rn", F.col("e").alias("base"))
    other = placed.filter(F.col(by) != baseline)
    gap = F.col("base") - F.col("e")
    d = cut(other.join(base, "rn").select(by, "e", "base", (gap if digits is None else F.round(gap, digits) + 0.0).alias("d")))
    sizes = other.groupBy(by).agg(F.count("*").alias("__own")).join(F.broadcast(base.agg(F.count("*").alias("__base"))), F.lit(True))
    facts = d.groupBy(by).agg(F.avg("e").alias("mae"), F.avg("base").alias("baseline_mae")).join(sizes, by)
    facts = facts.select(by, "mae", "baseline_mae", F.abs(F.col("__own") - F.col("__base")).alias("unpaired"))
    if test == "paired_t":
        found = t_test(d, (by,))
    else:
        each = [wilcoxon(d.filter(F.col(by) == s)).withColumn(by, F.lit(s).cast(d.schema[by].dataType)) for s in states if s != baseline]
        if not each:
            raise ValueError("no class but the baseline")
        found = reduce(DataFrame.unionByName, each).withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    return facts.join(found, by)
