"""The registry of queries over the driver's tables and of the SQL that must agree with them.

Doubles are rounded on both sides, since sums may be taken in any order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunfold.functions import weather as W
from sunfold.operators import adapt, embed, evaluate, graph, missing, models, modes, quality, recursive, scale, smooth, split
from sunfold.operators.ordered import numbered
from sunfold.plans.views import PRED, PV, PV_DIRTY, pred, pv, pv_dirty, table
from sunfold.runtime import cut
from sunfold.schema import MEASURES, WEATHER

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_OVER = "OVER (PARTITION BY series_id ORDER BY ts, row_id)"
_W = "PARTITION BY series_id ORDER BY ts, row_id"


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, doubles: str = "", digits: int = 7) -> Callable:
    """Registers a query; `doubles` names the columns of its SQL that are rounded. Means over a round number of rows need
    more digits, or they end in a 5."""

    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            names = doubles.split()
            _SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return add


def _each_measure(sql: str, view: str = "pv") -> str:
    """The SQL for each measure, all together; {c} is the measure."""
    return " UNION ALL ".join(sql.format(c=c, view=view) for c in MEASURES)


# --- weather ---------------------------------------------------------------------------------------------------

_SOLAR = """solar AS (SELECT *, 2 * pi() / 365 * (dayofyear(ts) - 1) AS g,
 hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE AS clock FROM pv),
angles AS (SELECT *, 1.000110::DOUBLE + 0.034221::DOUBLE * cos(g) + 0.001280::DOUBLE * sin(g) + 0.000719::DOUBLE * cos(2 * g) + 0.000077::DOUBLE * sin(2 * g) AS e0,
 0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS decl,
 4 * (0.0066::DOUBLE + 7.3525::DOUBLE * cos(g + 1.498::DOUBLE) + 9.9359::DOUBLE * cos(2 * g + 1.1359::DOUBLE) + 0.3387::DOUBLE * cos(3 * g + 0.0607::DOUBLE)) AS eot FROM solar),
heights AS (SELECT *, sin(decl) * sin(radians(38.5::DOUBLE)) + cos(decl) * cos(radians(38.5::DOUBLE)) * cos(pi() * (clock + eot / 60 - 12) / 12) AS h FROM angles),
radiated AS (SELECT *, CASE WHEN h > 0 THEN 1367 * e0 * h ELSE 0 END AS ge, pressure - lag(pressure, 1, pressure) OVER (PARTITION BY series_id ORDER BY ts, row_id) AS dp,
 CASE WHEN bool_or(temperature < 0 OR temperature > 35) OVER (PARTITION BY series_id) THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS tf FROM heights),
indexed AS (SELECT *, greatest(0, least(1.2::DOUBLE, irradiance / CASE WHEN ge > 0 THEN ge ELSE 1e-6::DOUBLE END)) AS ci,
 greatest(0, least(1, (0.4::DOUBLE * greatest(-1, least(1, (1040 - pressure) / 60)) + 0.5::DOUBLE * greatest(0, least(1, humidity / 100)) + 0.1::DOUBLE * greatest(0, least(1, greatest(0, -dp / 0.25::DOUBLE) / 10))) * tf)) AS wsi FROM radiated),
voted AS (SELECT *, CASE WHEN ci <= 0.2::DOUBLE THEN 2 WHEN ci >= 0.6::DOUBLE THEN 0 ELSE 1 END AS a, CASE WHEN wsi > 0.7::DOUBLE THEN 2 WHEN wsi < 0.3::DOUBLE THEN 0 ELSE 1 END AS b,
 least(1, least(abs(ci - 0.2::DOUBLE), abs(ci - 0.6::DOUBLE)) / 0.3::DOUBLE) AS ca, least(1, least(abs(wsi - 0.3::DOUBLE), abs(wsi - 0.7::DOUBLE)) / 0.3::DOUBLE) AS cb FROM indexed),
states AS (SELECT *, CASE WHEN a = b THEN a WHEN abs(a * 0.7::DOUBLE * ca - b * 0.3::DOUBLE * cb) < 0.1::DOUBLE THEN 1 WHEN a * 0.7::DOUBLE * ca > b * 0.3::DOUBLE * cb THEN a ELSE b END AS weather FROM voted)"""
_STATES = f"WITH {PV}, {_SOLAR} "


@query(_STATES + "SELECT series_id, weather, count(*) AS n, avg(ci) AS ci, avg(wsi) AS wsi FROM states GROUP BY ALL", "ci wsi")
def weather_by_series(spark, d):
    return W.classify(pv(spark, d)).groupBy("series_id", "weather").agg(F.count("*").alias("n"), F.avg("ci").alias("ci"), F.avg("wsi").alias("wsi"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather states of all measurements, counted by series."""
    return _QUERIES["weather_by_series"](spark, sf_dir)


@query(_STATES + "SELECT row_id, ge FROM states", "ge")
def extraterrestrial_radiation(spark, d):
    return pv(spark, d).select("row_id", W.extraterrestrial_radiation(F.col("ts")).alias("ge"))


@query(_STATES + "SELECT row_id, ci FROM states", "ci")
def clearness_index(spark, d):
    return W.indices(pv(spark, d)).select("row_id", "ci")


@query(_STATES + "SELECT row_id, wsi FROM states", "wsi")
def weather_state_index(spark, d):
    return W.indices(pv(spark, d)).select("row_id", "wsi")


@query(_STATES + "SELECT row_id, a AS ci_class, b AS wsi_class, ca AS ci_confidence, cb AS wsi_confidence FROM states", "ci_confidence wsi_confidence")
def index_classes(spark, d):
    ci, wsi = F.col("ci"), F.col("wsi")
    return W.indices(pv(spark, d)).select("row_id", W.classify_ci(ci).alias("ci_class"), W.classify_wsi(wsi).alias("wsi_class"), W.confidence(ci, 0.2, 0.6).alias("ci_confidence"), W.confidence(wsi, 0.3, 0.7).alias("wsi_confidence"))


@query(_STATES + "SELECT row_id, weather, CASE weather WHEN 1 THEN 'cloudy' WHEN 2 THEN 'overcast' ELSE 'sunny' END AS name FROM states")
def weather_fusion(spark, d):
    return W.classify(pv(spark, d)).select("row_id", "weather", W.weather_name(F.col("weather"), WEATHER).alias("name"))


@query(_STATES + "SELECT weather, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM states GROUP BY weather", "percent")
def weather_distribution(spark, d):
    return W.distribution(W.classify(pv(spark, d)))


@query(_STATES + f"SELECT series_id, count(*) FILTER (WHERE weather <> before) AS transitions FROM (SELECT series_id, weather, lag(weather) {_OVER} AS before FROM states) GROUP BY series_id")
def weather_transitions(spark, d):
    return W.transitions(W.classify(pv(spark, d)))


@query(_STATES + "SELECT row_id, CASE WHEN 0.7::DOUBLE * ci + 0.3::DOUBLE * wsi < 0.3::DOUBLE THEN 'overcast' WHEN 0.7::DOUBLE * ci + 0.3::DOUBLE * wsi > 0.6::DOUBLE THEN 'sunny' ELSE 'cloudy' END AS state FROM states")
def fixture_states(spark, d):
    return W.indices(pv(spark, d)).select("row_id", W.fixture_state(F.col("ci"), F.col("wsi")).alias("state"))


# --- scans, projections ------------------------------------------------------------------------------------------


@query(
    """SELECT event_id AS row_id, CASE WHEN (SELECT max(value / 1000) FROM events) <= 1.5::DOUBLE THEN value / 1000 * 1000 ELSE value / 1000 END AS power,
 value * 4 AS irradiance, CAST(user_id AS DOUBLE) AS temperature, CAST(event_id % 60 + 980 AS DOUBLE) / 10 * 10 AS pressure,
 greatest(0, least(100, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 2)) AS humidity FROM events""",
    "power irradiance temperature pressure humidity",
)
def scan_normalise_units(spark, d):
    from sunfold.sources.files import canonical

    e = table(spark, d, "events")
    raw = e.select(
        F.col("ts").cast("string").alias("Time(year-month-day  h:m:s)"), F.col("event_id").alias("row_id"), (F.col("value") / 1000).cast("string").alias("Power  (kW)"), (F.col("value") * 4).cast("string").alias("Global horizontal irradiance (W/m2)"), F.col("user_id").cast("string").alias("t"),
        ((F.col("event_id") % 60 + 980).cast("double") / 10).cast("string").alias("Atmospheric pressure (kPa)"), (F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 2).cast("string").alias("Hum"),
    )
    return canonical(raw).select("row_id", *MEASURES)


@query(f"WITH {PV} SELECT row_id, greatest(0, least(50, temperature)) AS temperature, CAST(power AS FLOAT)::DOUBLE AS power FROM pv", "temperature power")
def clip_and_float(spark, d):
    return pv(spark, d).select("row_id", quality.clip(F.col("temperature"), 0.0, 50.0).alias("temperature"), quality.finite_or_zero(F.col("power")).cast("double").alias("power"))


@query(f"WITH {PV_DIRTY} SELECT row_id, CASE WHEN power IN (-99, -999, -9999) THEN NULL ELSE power END AS power FROM pv_dirty", "power")
def null_markers(spark, d):
    return quality.null_markers(pv_dirty(spark, d)).select("row_id", "power")


# --- quality -----------------------------------------------------------------------------------------------------


@query("WITH " + PV_DIRTY + " " + _each_measure("SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*)::DOUBLE AS ratio, (count(*) - count({c})) / count(*)::DOUBLE > 0.3 AS warning FROM pv_dirty"), "ratio")
def null_ratio(spark, d):
    return quality.null_ratios(pv_dirty(spark, d))


@query("WITH " + PV_DIRTY + " " + _each_measure("SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM pv_dirty"), "mean std min q25 median q75 max")
def describe_stats(spark, d):
    return quality.describe(pv_dirty(spark, d))


#: What the SQL holds against the operators' own tables of rules; stated here once more, so that a slip in one of them shows.
_PHYSICAL = {"power": (0, 55000), "irradiance": (0, 1200), "temperature": (-40, 60), "pressure": (850, 1100), "humidity": (0, 100)}
_VALID = {"power": (0, 1000), "irradiance": (0, 1500), "temperature": (-30, 60), "humidity": (0, 100), "pressure": (800, 1100)}


def _range(ranges, c: str) -> str:
    lo, hi = ranges[c]
    return f"coalesce({c} < {lo} OR {c} > {hi}, false)"


_MARK = "coalesce({c} IN (-99, -999, -9999), false)"


@query("WITH " + PV_DIRTY + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(*) FILTER (WHERE {_MARK.format(c=c)}) AS markers, count(*) FILTER (WHERE {_range(_PHYSICAL, c)}) AS out_of_range, avg({c}) AS mean, min({c}) AS min, max({c}) AS max FROM pv_dirty" for c in MEASURES), "mean min max")
def integrity_report(spark, d):
    return quality.integrity_report(pv_dirty(spark, d))


_STEPS = f"(SELECT series_id, (epoch_us(ts) - lag(epoch_us(ts)) {_OVER}) / 1e6::DOUBLE AS step FROM pv)"


@query(f"WITH {PV} SELECT series_id, count(step) AS steps, count(*) FILTER (WHERE step <> 900) AS irregular, min(step) AS shortest, max(step) AS longest, min(step) = max(step) AS regular FROM {_STEPS} GROUP BY series_id", "shortest longest")
def time_gap_report(spark, d):
    return quality.time_gaps(pv(spark, d))


@query(f"WITH {PV}, c AS (SELECT series_id, round(step, 3) AS step, count(*) AS n FROM {_STEPS} WHERE step IS NOT NULL GROUP BY ALL) SELECT series_id, first(step ORDER BY n DESC, step) AS seconds, max(n) / sum(n)::DOUBLE AS share FROM c GROUP BY series_id", "seconds share")
def frequency(spark, d):
    return quality.frequency(pv(spark, d))


@query("WITH " + PV_DIRTY + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_MARK.format(c=c)} OR {_range(_PHYSICAL, c)}) AS outliers, count(*) FILTER (WHERE {_MARK.format(c=c)}) AS markers, count(*) FILTER (WHERE {_range(_PHYSICAL, c)} AND NOT {_MARK.format(c=c)}) AS out_of_range FROM pv_dirty" for c in MEASURES))
def outliers_physical(spark, d):
    return quality.physical_outliers(pv_dirty(spark, d))


_IQR = "(SELECT quantile_cont({c}, 0.25) - 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS low, quantile_cont({c}, 0.75) + 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS high FROM pv_dirty)"
_Z = "(SELECT avg({c}) - 3 * stddev_samp({c}) AS low, avg({c}) + 3 * stddev_samp({c}) AS high FROM pv_dirty)"


@query("WITH " + PV_DIRTY + " " + _each_measure("SELECT '{c}' AS \"column\", low, high, count(*) FILTER (WHERE {c} < low OR {c} > high) AS outliers FROM pv_dirty, " + _IQR + " GROUP BY low, high"), "low high")
def outliers_iqr(spark, d):
    return quality.outlier_counts(pv_dirty(spark, d))


@query("WITH " + PV_DIRTY + " " + _each_measure("SELECT '{c}' AS \"column\", low, high, count(*) FILTER (WHERE {c} < low OR {c} > high) AS outliers FROM pv_dirty, " + _Z + " GROUP BY low, high"), "low high")
def outliers_zscore(spark, d):
    return quality.outlier_counts(pv_dirty(spark, d), method="zscore")


@query("WITH " + PV_DIRTY + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{s}' AS side, place, row_id, {c} AS x FROM (SELECT row_id, {c}, row_number() OVER (ORDER BY {c} {o}, row_id) AS place FROM pv_dirty WHERE {c} IS NOT NULL) WHERE place <= 3" for c in MEASURES for s, o in (("low", "ASC"), ("high", "DESC"))), "x")
def outlier_samples_topk(spark, d):
    return quality.extreme_rows(pv_dirty(spark, d))


def _handled(new: str) -> str:
    return f"WITH {PV_DIRTY}, b AS {_IQR.format(c='power')} SELECT row_id, CASE WHEN power < low OR power > high THEN {new} ELSE power END AS power FROM pv_dirty, b"


_INNER = "(SELECT {agg}(power) FROM pv_dirty, b WHERE power BETWEEN low AND high)"


@query(_handled("CASE WHEN power < low THEN low ELSE high END"), "power")
def handle_outliers_clip(spark, d):
    return quality.handle_outliers(pv_dirty(spark, d), ["power"]).select("row_id", "power")


@query(_handled("NULL"), "power")
def handle_outliers_null(spark, d):
    return quality.handle_outliers(pv_dirty(spark, d), ["power"], "remove").select("row_id", "power")


@query(_handled(_INNER.format(agg="avg")), "power")
def handle_outliers_mean(spark, d):
    return quality.handle_outliers(pv_dirty(spark, d), ["power"], "replace_mean").select("row_id", "power")


@query(_handled(_INNER.format(agg="median")), "power")
def handle_outliers_median(spark, d):
    return quality.handle_outliers(pv_dirty(spark, d), ["power"], "replace_median").select("row_id", "power")


@query("WITH " + PV_DIRTY + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS violations, min({c}) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS least, max({c}) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS greatest, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) = 0 AS passed FROM pv_dirty" for c, (lo, hi) in _VALID.items()), "low high least greatest")
def quality_validation(spark, d):
    return quality.validate(pv_dirty(spark, d))


# --- missing values ------------------------------------------------------------------------------------------------

_NEAR = f"""near AS (SELECT *, row_number() {_OVER} - 1 AS rn FROM pv_dirty),
marks AS (SELECT *, max(CASE WHEN power IS NOT NULL THEN rn END) OVER (PARTITION BY series_id ORDER BY rn) AS p, min(CASE WHEN power IS NOT NULL THEN rn END) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM near),
known AS (SELECT m.*, x.power AS a, y.power AS b FROM marks m LEFT JOIN near x ON m.series_id = x.series_id AND m.p = x.rn LEFT JOIN near y ON m.series_id = y.series_id AND m.q = y.rn)"""


def _filled(near: str, rest: str) -> str:
    return f"WITH {PV_DIRTY}, {_NEAR} SELECT row_id, rn, coalesce(power, {near}, CASE WHEN p IS NOT NULL THEN {rest} END, b) AS power FROM known"


@query(_filled("CASE WHEN rn - p <= 6 THEN CASE WHEN q IS NULL THEN a ELSE a + (b - a) * (rn - p) / (q - p) END END", "CASE WHEN q IS NULL THEN a ELSE a + (b - a) * 6 / (q - p) END"), "power")
def fill_linear_limit(spark, d):
    return missing.fill(pv_dirty(spark, d), "power").select("row_id", "rn", "power")


@query(_filled("CASE WHEN rn - p <= 6 THEN a END", "a"), "power")
def fill_forward_limit(spark, d):
    return missing.fill(pv_dirty(spark, d), "power", "forward").select("row_id", "rn", "power")


@query(_filled("CASE WHEN q - rn <= 6 THEN b END", "a"), "power")
def fill_backward_limit(spark, d):
    return missing.fill(pv_dirty(spark, d), "power", "backward").select("row_id", "rn", "power")


@query(f"WITH {PV_DIRTY} SELECT row_id, power, humidity FROM pv_dirty WHERE power IS NOT NULL AND humidity IS NOT NULL", "power humidity")
def dropna(spark, d):
    return missing.drop_missing(pv_dirty(spark, d), ["power", "humidity"]).select("row_id", "power", "humidity")


@query(f"WITH {PV} SELECT row_id, power, NULL::DOUBLE AS humidity FROM pv WHERE series_id = 'click' UNION ALL SELECT row_id, NULL, humidity FROM pv WHERE series_id <> 'click'", "power humidity")
def merge_concat(spark, d):
    x = pv(spark, d)
    return split.merge_concat([x.filter("series_id = 'click'").select("row_id", "power"), x.filter("series_id <> 'click'").select("row_id", "humidity")])


@query(f"WITH {PV} SELECT date_trunc('hour', ts) AS ts, avg(power) AS power, avg(humidity) AS humidity FROM pv GROUP BY 1", "power humidity")
def merge_average(spark, d):
    return split.merge_average(pv(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["power", "humidity"])


# --- splits ------------------------------------------------------------------------------------------------------

_SPLIT = "sp AS (SELECT *, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS rn, count(*) OVER () AS n FROM pv))"


@query(f"WITH {PV}, {_SPLIT} SELECT row_id, split FROM sp")
def split_temporal(spark, d):
    return split.split_temporal(pv(spark, d)).select("row_id", "split")


@query(f"""WITH {PV}, r AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS rn, count(*) OVER () AS n, (epoch_us(max(ts) OVER ()) - epoch_us(min(ts) OVER ())) / 1e6::DOUBLE AS span FROM pv),
 g AS (SELECT *, floor(86400 / (span / n)) AS gap, floor(n * 0.7::DOUBLE) AS a, floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) AS b FROM r)
 SELECT row_id, CASE WHEN rn < a THEN 'train' WHEN rn >= a + gap AND rn < b THEN 'val' ELSE 'test' END AS split FROM g WHERE rn < a OR (rn >= a + gap AND rn < b) OR rn >= b + gap""")
def split_gap(spark, d):
    return split.split_temporal(pv(spark, d), gap_hours=24).select("row_id", "split")


@query(f"WITH {PV} SELECT row_id, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT row_id, row_number() {_OVER} - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM pv)")
def split_by_station(spark, d):
    return split.split_temporal(pv(spark, d), by="series_id").select("row_id", "split")


@query(f"WITH {PV}, {_SPLIT} " + " UNION ALL ".join(f"SELECT split, '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM sp GROUP BY split" for c in MEASURES), "mean std min max")
def split_statistics(spark, d):
    return split.split_statistics(split.split_temporal(pv(spark, d)), MEASURES)


@query(f"WITH {PV}, {_SPLIT} SELECT split, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share, min(ts) AS first, max(ts) AS last, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::DOUBLE AS hours FROM sp GROUP BY split", "share hours")
def split_ranges(spark, d):
    return split.split_ranges(split.split_temporal(pv(spark, d)))


@query("SELECT false AS empty, false AS overlap, true AS ratio_ok")
def split_validation(spark, d):
    x = numbered(pv(spark, d).withColumn("series_id", F.lit("all"))).withColumn("ts", F.timestamp_add("SECOND", F.col("rn").cast("int"), F.col("ts").cast("timestamp")).cast("timestamp_ntz")).drop("rn")
    return split.validate_split(split.split_temporal(x))


_FOLDS = ((12, 3, 3), (15, 3, 3), (18, 3, 3), (21, 3, 3))
_FOLD_SQL = "s AS (SELECT min(o_orderdate) AS t0 FROM orders), f AS (" + " UNION ALL ".join(f"SELECT {i} AS fold, '{n}' AS split, t0 + INTERVAL {lo} MONTH AS low, t0 + INTERVAL {hi} MONTH AS high, {'true' if i == 3 and n == 'test' else 'false'} AS closed FROM s" for i, (a, b, c) in enumerate(_FOLDS) for n, lo, hi in (("train", 0, a), ("val", a, a + b), ("test", a + b, a + b + c))) + "), w AS (SELECT o.*, fold, split FROM orders o JOIN f ON o_orderdate >= low AND (o_orderdate < high OR (closed AND o_orderdate = high)))"


@query(f"WITH {_FOLD_SQL} SELECT fold, split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(o_orderdate) AS first, max(o_orderdate) AS last FROM w GROUP BY fold, split")
def walk_forward_folds(spark, d):
    w = split.walk_forward(table(spark, d, "orders"), _FOLDS, "o_orderdate")
    return w.groupBy("fold", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query(f"WITH {_FOLD_SQL}, m AS (SELECT fold, max(o_orderdate) FILTER (WHERE split = 'train') AS a, min(o_orderdate) FILTER (WHERE split = 'val') AS b, max(o_orderdate) FILTER (WHERE split = 'val') AS c, min(o_orderdate) FILTER (WHERE split = 'test') AS e FROM w GROUP BY fold) SELECT fold, coalesce(a < b, true) AND coalesce(c < e, true) AS ordered FROM m")
def fold_overlap_check(spark, d):
    return split.folds_overlap(split.walk_forward(table(spark, d, "orders"), _FOLDS, "o_orderdate"), "o_orderdate")


@query(f"WITH {PV}, r AS (SELECT *, row_number() {_OVER} - 1 AS rn FROM pv), w AS (SELECT series_id, rn, count(*) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n, sum(power) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS total, last_value(power) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS last FROM r) SELECT series_id, CAST(rn // 4 AS BIGINT) AS \"window\", total, last FROM w WHERE n = 12 AND rn % 4 = 0", "total last")
def sliding_windows(spark, d):
    w = split.sliding_windows(pv(spark, d), 12, 4)
    return w.select("series_id", "window", F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["power"]).alias("total"), F.get("rows", F.lit(11))["power"].alias("last"))


@query(f"WITH {PV}, r AS (SELECT *, row_number() {_OVER} - 1 AS rn, lead(power, 3) {_OVER} AS y FROM pv), w AS (SELECT *, sum(CAST(power AS FLOAT)::DOUBLE + 2 * CAST(humidity AS FLOAT)::DOUBLE) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS total FROM r) SELECT row_id, rn, total, y FROM w WHERE rn >= 23 AND y IS NOT NULL", "total y")
def sequence_targets(spark, d):
    s = split.sequences(pv(spark, d), 24, ("power", "humidity"), horizon=3)
    return s.select("row_id", "rn", F.aggregate("x", F.lit(0.0), lambda t, v: t + v[0].cast("double") + 2 * v[1].cast("double")).alias("total"), "y")


# --- scaling, smoothing ----------------------------------------------------------------------------------------------


def _scaled(method: str, sql: str):
    facts = " , ".join(f"(SELECT {sql.format(c=c)} FROM lineitem) AS f_{c}(a_{c}, b_{c})" for c in ("l_quantity", "l_extendedprice"))
    text = f"SELECT l_orderkey, l_linenumber, (l_quantity - a_l_quantity) / b_l_quantity AS l_quantity, (l_extendedprice - a_l_extendedprice) / b_l_extendedprice AS l_extendedprice FROM lineitem, {facts}"

    def run(spark, d):
        x = table(spark, d, "lineitem")
        return scale.apply(x, scale.fit(x, ["l_quantity", "l_extendedprice"], method), method).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")

    run.__name__ = f"scale_{method}"
    query(text, "l_quantity l_extendedprice")(run)


_scaled("minmax", "min({c}), max({c}) - min({c})")
_scaled("standard", "avg({c}), stddev_samp({c})")
_scaled("robust", "quantile_cont({c}, 0.5), quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")
_scaled("maxabs", "0, max(abs({c}))")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax * 0 + 7 AS constant FROM lineitem", "l_extendedprice constant")
def scale_inverse(spark, d):
    x = table(spark, d, "lineitem").withColumn("constant", F.col("l_tax") * 0 + 7)
    p = scale.fit(x, ["l_extendedprice", "constant"], "minmax")
    return scale.invert(scale.apply(x, p, low=-1.0), p, low=-1.0).select("l_orderkey", "l_linenumber", "l_extendedprice", "constant")


@query(f"WITH {PV}, r AS (SELECT *, count(power) OVER w AS c, avg(power) OVER w AS m FROM pv WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT row_id, CASE WHEN c = 5 THEN m ELSE power END AS smooth FROM r", "smooth")
def moving_average(spark, d):
    return smooth.moving_average(pv(spark, d), "power").select("row_id", "smooth")


def _gauss() -> str:
    import math

    raw = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
    taps = " + ".join(f"{x / sum(raw)!r}::DOUBLE * (SELECT power FROM r s WHERE s.series_id = r.series_id AND s.rn = CASE WHEN (r.rn + {k} + 2 * r.n) % (2 * r.n) >= r.n THEN 2 * r.n - 1 - (r.rn + {k} + 2 * r.n) % (2 * r.n) ELSE (r.rn + {k} + 2 * r.n) % (2 * r.n) END)" for k, x in zip(range(-4, 5), raw, strict=True))
    return f"WITH {PV}, r AS (SELECT *, row_number() {_OVER} - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM pv) SELECT row_id, {taps} AS smooth FROM r"


@query(_gauss(), "smooth")
def gaussian_smooth(spark, d):
    return smooth.gaussian(pv(spark, d), "power").select("row_id", "smooth")


def _savgol() -> str:
    taps = ", ".join(f"({off}, {k - 2}, {float(t)!r}::DOUBLE)" for off in range(-2, 3) for k, t in enumerate(smooth.savgol_taps(5, 2, off)))
    return f"WITH {PV}, r AS (SELECT *, row_number() {_OVER} - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM pv), m AS (SELECT *, least(greatest(rn, 2), n - 3) AS mid FROM r), w AS (SELECT m.row_id, m.series_id, m.mid + t.k AS at, t.x FROM m JOIN (VALUES {taps}) t(off, k, x) ON t.off = m.rn - m.mid) SELECT w.row_id, sum(w.x * r.power) AS smooth FROM w JOIN r ON r.series_id = w.series_id AND r.rn = w.at GROUP BY w.row_id"


@query(_savgol(), "smooth")
def savgol_smooth(spark, d):
    return smooth.savgol(pv(spark, d), "power").select("row_id", "smooth")


# --- embedding -------------------------------------------------------------------------------------------------------


@query(f"WITH {PV} SELECT * FROM (SELECT row_id, power AS e0, lead(power, 2) {_OVER} AS e1, lead(power, 4) {_OVER} AS e2, lead(row_id, 4) {_OVER} IS NOT NULL AS ok FROM pv) WHERE ok", "e0 e1 e2")
def phase_space_embedding(spark, d):
    return embed.embedding(pv(spark, d), dimension=3, delay=2).select("row_id", "e0", "e1", "e2", F.lit(True).alias("ok"))


@query(f"WITH {PV}, r AS (SELECT row_id, 0.5::DOUBLE * power AS r0, 0.5::DOUBLE * lead(power, 1) {_OVER} AS r1, 0.5::DOUBLE * lead(power, 2) {_OVER} AS r2, 0.25::DOUBLE * humidity AS r3, 0.25::DOUBLE * lead(humidity, 1) {_OVER} AS r4, lead(row_id, 2) {_OVER} IS NOT NULL AS whole FROM pv) SELECT row_id, {', '.join(f'CASE WHEN whole THEN coalesce(r{i}, 0) ELSE 0 END AS r{i}' for i in range(5))} FROM r", "r0 r1 r2 r3 r4")
def dynamic_reconstruction(spark, d):
    r = embed.reconstruction(pv(spark, d), ["power", "humidity"], [0.5, 0.25], total=5)
    return r.select("row_id", *(F.col("r")[i].alias(f"r{i}") for i in range(5)))


@query(f"WITH {PV} SELECT row_id, count(power) OVER w AS n, avg(power) OVER w AS mean, stddev_samp(power) OVER w AS std, min(power) OVER w AS min, max(power) OVER w AS max FROM pv WINDOW w AS ({_W} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)", "mean std min max")
def causal_neighbourhood_stats(spark, d):
    return embed.neighbourhood(pv(spark, d)).select("row_id", "n", "mean", "std", "min", "max")


_AMI = f"""WITH {PV}, leads AS (SELECT series_id, power AS x, {', '.join(f'lead(power, {k}) {_OVER} AS y{k}' for k in range(1, 6))} FROM pv),
l2 AS ({' UNION ALL '.join(f'SELECT series_id, {k} AS lag, x, y{k} AS y FROM leads' for k in range(1, 6))}),
f AS (SELECT *, count(*) OVER g AS n, min(x) OVER g AS xa, max(x) OVER g AS xb, min(y) OVER g AS ya, max(y) OVER g AS yb FROM l2 WHERE y IS NOT NULL WINDOW g AS (PARTITION BY series_id, lag)),
c AS (SELECT series_id, lag, n, CAST(floor(sqrt(n)) AS BIGINT) AS bins, least(floor((x - xa) * floor(sqrt(n)) / (xb - xa)), floor(sqrt(n)) - 1) AS i, least(floor((y - ya) * floor(sqrt(n)) / (yb - ya)), floor(sqrt(n)) - 1) AS j FROM f),
h AS (SELECT series_id, lag, n, bins, i, j, count(*) AS c FROM c GROUP BY ALL),
p AS (SELECT *, sum(c) OVER (PARTITION BY series_id, lag, i) AS cx, sum(c) OVER (PARTITION BY series_id, lag, j) AS cy FROM h)
SELECT series_id, CAST(lag AS INTEGER) AS lag, n, bins, sum(c / n::DOUBLE * ln((c / n::DOUBLE + 1e-12::DOUBLE) / (cx / n::DOUBLE * (cy / n::DOUBLE) + 1e-12::DOUBLE))) AS ami FROM p GROUP BY series_id, lag, n, bins"""


@query(_AMI, "ami")
def average_mutual_information(spark, d):
    return embed.mutual_information(pv(spark, d), max_lag=5)


@query(f"WITH a AS ({_AMI}), r AS (SELECT series_id, lag, round(ami, 9) > lag(round(ami, 9)) OVER (PARTITION BY series_id ORDER BY lag) AS up FROM a) SELECT series_id, coalesce(min(lag - 1) FILTER (WHERE up), 1) AS delay FROM r GROUP BY series_id")
def time_delay_select(spark, d):
    return embed.time_delay(embed.mutual_information(pv(spark, d), max_lag=5).withColumn("ami", F.round("ami", 9)))


@query(f"WITH {PV}, l AS (SELECT series_id, power AS p0, {', '.join(f'lead(power, {k}) {_OVER} AS p{k}' for k in range(1, 5))} FROM pv), q AS (SELECT series_id, sqrt(pow(p1 - p0, 2) + pow(p2 - p1, 2) + pow(p3 - p2, 2)) AS d, abs(p4 - p3) AS more FROM l) SELECT series_id, 3 AS dimension, avg(CASE WHEN more > 10 * d THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM q WHERE d IS NOT NULL AND more IS NOT NULL GROUP BY series_id", "ratio")
def fnn_ratio(spark, d):
    return embed.false_neighbour_ratio(pv(spark, d), dimension=3)


# --- graphs --------------------------------------------------------------------------------------------------------

_KNN = """WITH v AS (SELECT vec_id, list_transform(embedding, x -> x::DOUBLE) AS e FROM embeddings), k AS MATERIALIZED (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, pow(list_distance(a.e, b.e), 2) AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS place FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE place <= 10)""".replace("list_transform(embedding, x -> x::DOUBLE)", "embedding::DOUBLE[]")
_SIM = _KNN + ", w AS (SELECT src, dst, exp(-d2 / 2) AS w FROM k), g AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY src, dst HAVING count(*) = 2)"
_LAP = _SIM + ", deg AS (SELECT src AS node, sum(w) AS d FROM g GROUP BY src HAVING sum(w) > 1e-10)"


def _unit(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


@query(_KNN + " SELECT src, dst, d2, place FROM k", "d2")
def knn_edges(spark, d):
    return graph.knn_edges(_unit(spark, d))


@query(_SIM + " SELECT src, dst, w FROM g", "w")
def similarity_graph(spark, d):
    return graph.similarity(graph.knn_edges(_unit(spark, d)))


@query(_LAP + " SELECT src, dst, -w / sqrt(a.d * b.d) AS l FROM g JOIN deg a ON src = a.node JOIN deg b ON dst = b.node UNION ALL SELECT node, node, 1.0::DOUBLE FROM deg", "l")
def laplacian_edges(spark, d):
    return graph.laplacian(graph.similarity(graph.knn_edges(_unit(spark, d))))


@query(_KNN + ", s AS (SELECT src, count(*) AS n FROM k WHERE abs(d2) > 1e-10 GROUP BY src), n AS (SELECT count(*) AS c FROM embeddings) SELECT (SELECT c FROM n) AS nodes, sum(n)::BIGINT AS nnz, sum(n) / (SELECT c * c FROM n)::DOUBLE AS density, sum(n) / (SELECT c FROM n)::DOUBLE AS mean_row, min(n) AS min_row, max(n) AS max_row FROM s", "density mean_row")
def sparsity_report(spark, d):
    x = _unit(spark, d)
    return graph.sparsity(graph.knn_edges(x), x.count(), "d2").select("nodes", "nnz", "density", "mean_row", F.col("min_row").cast("long").alias("min_row"), "max_row")


@query("""WITH n AS (SELECT count(*) AS n, CAST(floor(pow(count(*), 1.0::DOUBLE / 3) + 1e-9::DOUBLE) AS BIGINT) AS s FROM supplier),
 v AS (SELECT 1 - (cos(2 * pi() * k / n) + cos(2 * pi() * k * s / n) + cos(2 * pi() * k * s * s / n)) / 3 AS value FROM n, range(0, (SELECT count(*) FROM supplier)) t(k))
 SELECT CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS place, value, true AS orthonormal FROM v QUALIFY place <= 5""", "value", 6)
def ring_eigenvalues(spark, d):
    """The five smallest eigenvalues of a ring of all suppliers with chords of length s and s^2, s the cube root of their number,
    whose spectrum is known, and whether their vectors are orthonormal. Keys may leave gaps: suppliers are numbered."""
    numbers = table(spark, d, "supplier").select("s_suppkey").rdd.zipWithIndex().map(lambda r: (r[1],))
    ring = cut(spark.createDataFrame(numbers, "i long"))
    n = ring.count()
    s = int(n ** (1 / 3) + 1e-9)
    to = F.explode(F.array(*(F.pmod(F.col("i") + F.lit(o), F.lit(n)).cast("long") for o in (1, s, s * s, -1, -s, -s * s)))).alias("dst")
    found = graph.smallest_eigenvectors(graph.laplacian(ring.select(F.col("i").cast("long").alias("src"), to, F.lit(1.0).alias("w"))), 5)
    whole = bool(np.abs(graph.gram(found.vectors, "f", 5) - np.eye(5)).max() < 1e-6)
    return spark.createDataFrame([(i + 1, float(v), whole) for i, v in enumerate(found.values)], "place long, value double, orthonormal boolean")


@query("SELECT vec_id, " + ", ".join(f"list_sum([e * cos(i * {j + 1}) for e, i in embedding::DOUBLE[]]) AS p{j}" for j in range(3)) + " FROM embeddings", "p0 p1 p2")
def linear_projection(spark, d):
    x = _unit(spark, d)
    m = len(x.select("embedding").first()[0])
    a = np.cos(np.arange(1, m + 1)[:, None] * np.arange(1, 4)[None, :])
    return graph.project(x, "embedding", a).select("vec_id", *(F.col("projected")[j].alias(f"p{j}") for j in range(3)))


# --- evaluation ------------------------------------------------------------------------------------------------------


def _metrics_sql(p: str = "prediction", t: str = "target") -> str:
    e = f"({p} - {t})"
    return f"count({e}) AS n, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae, sqrt(avg({e} * {e})) / greatest(max({t}) - min({t}), 1e-8) AS nrmse, 1 - sum({e} * {e}) / greatest(var_pop({t}) * count(*), 1e-8) AS r2, coalesce(avg(CASE WHEN abs({t}) > 1e-8 THEN abs({e} / {t}) END) * 100, 0) AS mape, max(abs({e})) AS max_error, min(abs({e})) AS min_error, stddev_pop({e}) AS error_std"


_M = "rmse mae nrmse r2 mape max_error min_error error_std"


@query(f"WITH {PRED} SELECT {_metrics_sql()} FROM pred", _M, 9)
def metrics_overall(spark, d):
    return evaluate.metrics(pred(spark, d))


@query(f"WITH {PRED} SELECT weather, {_metrics_sql()} FROM pred GROUP BY ROLLUP (weather)", _M, 9)
def metrics_by_class(spark, d):
    return evaluate.metrics_with_total(pred(spark, d))


@query(f"WITH {PRED}, h AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, prediction, lead(target, {h - 1}) {_OVER} AS t FROM pred" for h in (1, 3, 6)) + f") SELECT horizon, {_metrics_sql(t='t')} FROM h WHERE t IS NOT NULL GROUP BY horizon", _M, 9)
def metrics_multi_horizon(spark, d):
    return evaluate.multi_horizon(pred(spark, d))


@query(f"WITH {PRED}, r AS (SELECT sqrt(avg(pow(prediction - target, 2))) AS e, max(target) - min(target) AS a, avg(abs(target)) AS b, stddev_samp(target) AS c FROM pred) SELECT e / greatest(a, 1e-8) AS by_range, e / greatest(b, 1e-8) AS by_mean, e / greatest(c, 1e-8) AS by_std FROM r", "by_range by_mean by_std", 9)
def nrmse_variants(spark, d):
    return evaluate.nrmse_variants(pred(spark, d))


_CLASS = f"WITH {PRED}, m AS (SELECT weather, {_metrics_sql()} FROM pred GROUP BY weather), l AS (" + " UNION ALL ".join(f"SELECT weather, '{c}' AS metric, {c}::DOUBLE AS value FROM m" for c in ("n", *_M.split())) + ")"


@query(_CLASS + " SELECT weather, metric, value FROM l", "value", 9)
def metrics_long(spark, d):
    return evaluate.metrics_long(pred(spark, d))


@query(_CLASS + " SELECT metric, " + ", ".join(f"max(value) FILTER (WHERE weather = {s}) AS class_{s}" for s in range(3)) + " FROM l GROUP BY metric", "class_0 class_1 class_2", 9)
def metrics_pivot(spark, d):
    return evaluate.metrics_pivot(pred(spark, d))


_DIFF = f"WITH {PRED}, d AS (SELECT round(abs(prediction - target) - abs(prediction * 0.99::DOUBLE - target), 6) + 0.0 AS d FROM pred)"


def _differences(spark, d) -> DataFrame:
    x = pred(spark, d)
    return evaluate.paired(x, x.withColumn("prediction", F.col("prediction") * 0.99), ["row_id"]).select((F.round("d", 6) + 0.0).alias("d"))


@query(_DIFF + " SELECT count(d) AS n, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, avg(d) / stddev_pop(d) AS cohens_d FROM d", "t cohens_d")
def paired_ttest_stat(spark, d):
    return evaluate.t_test(_differences(spark, d)).select("n", "t", "cohens_d")


@query(_DIFF + ", r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS k FROM d WHERE d <> 0) SELECT count(*) AS n, least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS w FROM r", "w")
def wilcoxon_stat(spark, d):
    return evaluate.wilcoxon(_differences(spark, d)).select("n", "w")


@query(f"WITH {PRED}, e AS (SELECT prediction - target AS e FROM pred), s AS (SELECT min(e) AS lo, (max(e) - min(e)) / 50 AS w FROM e), b AS (SELECT CAST(least(floor((e - lo) / w), 49) AS BIGINT) AS bin, lo, w FROM e, s) SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS n FROM b GROUP BY bin, lo, w", "low high")
def error_histogram(spark, d):
    return evaluate.error_histogram(pred(spark, d))


@query(f"WITH {PRED}, c AS (SELECT floor(abs(prediction - target) * 10.0::DOUBLE) / 10.0::DOUBLE AS error, count(*) AS n FROM pred GROUP BY 1) SELECT error, sum(n) OVER (ORDER BY error) / sum(n) OVER ()::DOUBLE AS share FROM c", "error share")
def error_ecdf(spark, d):
    return evaluate.error_ecdf(pred(spark, d))


@query(f"WITH {PRED}, c AS (SELECT round(prediction - target, 6) + 0.0 AS error, count(*) AS n FROM pred GROUP BY 1), r AS (SELECT error, n, sum(n) OVER (ORDER BY error) AS upto, sum(n) OVER () AS every FROM c), b AS (SELECT error, n, upto - n + 1 AS a, upto AS b, every, pow(0.5::DOUBLE, 1 / every::DOUBLE) AS top FROM r) SELECT error, n, CASE WHEN a = every THEN top WHEN a = 1 THEN 1 - top ELSE (a - 0.3175::DOUBLE) / (every + 0.365::DOUBLE) END AS first_p, CASE WHEN b = every THEN top WHEN b = 1 THEN 1 - top ELSE (b - 0.3175::DOUBLE) / (every + 0.365::DOUBLE) END AS last_p FROM b", "error first_p last_p")
def error_qq(spark, d):
    return evaluate.error_qq(pred(spark, d)).select("error", "n", "first_p", "last_p")


@query(f"WITH {PRED}, e AS (SELECT prediction - target AS e FROM pred), s AS (SELECT min(e) AS lo, (max(e) - min(e)) / 199 AS step, count(*)::DOUBLE AS rows, stddev_samp(e) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM e), g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * step AS error, rows, h FROM s, range(200) r(i)) SELECT point, error, sum(exp(-pow((error - e) / h, 2) / 2)) / (rows * h * sqrt(2 * pi())) AS density FROM g, e GROUP BY point, error, rows, h", "error density")
def error_density(spark, d):
    return evaluate.error_density(pred(spark, d))


@query(f"WITH {PRED}, e AS (SELECT weather, prediction - target AS e FROM pred), b AS (SELECT weather, count(e) AS n, avg(e) AS mean, avg(e) - 2 * stddev_pop(e) AS low, avg(e) + 2 * stddev_pop(e) AS high FROM e GROUP BY weather) SELECT weather, n, mean, low, high, count(*) FILTER (WHERE NOT (e BETWEEN low AND high)) AS outside FROM e JOIN b USING (weather) GROUP BY ALL", "mean low high")
def error_band(spark, d):
    return evaluate.error_band(pred(spark, d))


@query(f"WITH {PRED}, e AS (SELECT weather, prediction - target AS e FROM pred), q AS (SELECT weather, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM e GROUP BY weather) SELECT weather, q1, median, q3, min(e) FILTER (WHERE e BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS low, max(e) FILTER (WHERE e BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS high FROM e JOIN q USING (weather) GROUP BY ALL", "q1 median q3 low high")
def error_quartiles(spark, d):
    return evaluate.error_quartiles(pred(spark, d))


@query(f"WITH {PRED} SELECT regr_slope(prediction, target) AS slope, regr_intercept(prediction, target) AS intercept, regr_r2(prediction, target) AS r2 FROM pred", "slope intercept r2")
def regression_fit(spark, d):
    return evaluate.regression_fit(pred(spark, d))


@query(f"WITH {PRED} SELECT row_id, CASE WHEN target = 0 THEN 0 ELSE (prediction - target) / target * 100 END AS relative_error, CASE WHEN prediction > target THEN 'over' WHEN prediction < target THEN 'under' ELSE 'exact' END AS estimate FROM pred", "relative_error")
def relative_error(spark, d):
    return evaluate.relative_errors(pred(spark, d)).select("row_id", "relative_error", "estimate")


_BY = f"WITH {PRED}, m AS (SELECT weather, {_metrics_sql()} FROM pred GROUP BY weather)"


@query(_BY + " SELECT weather, 1 / (1 + rmse) AS rmse, 1 / (1 + mae) AS mae, 1 / (1 + nrmse) AS nrmse, greatest(0, 1 - mape / 100) AS mape, r2 FROM m", "rmse mae nrmse mape r2")
def radar_scores(spark, d):
    return evaluate.radar_scores(evaluate.metrics(pred(spark, d), ("weather",)))


def _grade_sql(m: str) -> str:
    a, b = evaluate.GRADES[m]
    return f"CASE WHEN {m} > {b} THEN 'good' WHEN {m} > {a} THEN 'normal' ELSE 'bad' END" if m == "r2" else f"CASE WHEN {m} < {a} THEN 'good' WHEN {m} < {b} THEN 'normal' ELSE 'bad' END"


@query(_BY + " SELECT weather, " + ", ".join(f"{_grade_sql(m)} AS {m}_grade" for m in evaluate.GRADES) + " FROM m")
def metric_grades(spark, d):
    return evaluate.metric_grades(evaluate.metrics(pred(spark, d), ("weather",))).select("weather", *(f"{m}_grade" for m in evaluate.GRADES))


_ROLL = f"""WITH {PRED}, e AS (SELECT series_id, row_id, ts, abs(prediction - target) AS e FROM pred),
r AS (SELECT *, avg(e) OVER f AS error_mean, stddev_samp(e) OVER f AS error_std, count(e) OVER f AS error_n, sum(e) OVER f AS s, sum(e) OVER l AS sl, count(e) OVER l AS nl FROM e WINDOW f AS ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), l AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, coalesce(CASE WHEN error_n >= 20 AND error_n > nl THEN (sl / nl - (s - sl) / (error_n - nl)) / ((s - sl) / (error_n - nl) + 1e-10::DOUBLE) END, 0) AS error_trend FROM r)"""


@query(_ROLL + " SELECT row_id, error_n, error_mean, error_std, error_trend FROM t", "error_mean error_std error_trend")
def rolling_error_stats(spark, d):
    return evaluate.rolling_errors(pred(spark, d)).select("row_id", "error_n", "error_mean", "error_std", "error_trend")


@query(f"WITH {PRED} SELECT row_id, quantile_cont(abs(prediction - target), 0.05) OVER w AS error_p5, quantile_cont(abs(prediction - target), 0.95) OVER w AS error_p95 FROM pred WINDOW w AS ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)", "error_p5 error_p95")
def rolling_error_percentiles(spark, d):
    return evaluate.rolling_errors(pred(spark, d), percentiles=True).select("row_id", "error_p5", "error_p95")


def _run_sql(cond: str, k: int) -> str:
    return f"(count(*) FILTER (WHERE {cond}) OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) = {k}"


_LEVELS = _ROLL + f""", v AS (SELECT row_id, {_run_sql('error_mean > 3.4', 3)} AS l1, {_run_sql('error_std > 2.2', 2)} AS l2, {_run_sql('abs(error_trend) > 0.2', 2)} AS l3,
 (count(*) FILTER (WHERE error_mean > 3.6) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) >= 4 AND (count(*) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) = 5 AS l4 FROM t)
SELECT row_id, CASE WHEN l4 THEN 4 WHEN l3 THEN 3 WHEN l2 THEN 2 WHEN l1 THEN 1 ELSE 0 END AS level FROM v"""


@query(_LEVELS)
def adaptation_triggers(spark, d):
    return evaluate.adaptation_levels(pred(spark, d), 3.4, 2.2, 0.2, 3.6).select("row_id", "level")


_FOLDED = f"WITH {PRED}, m AS (SELECT CAST(row_id % 4 AS INTEGER) AS fold, weather, {_metrics_sql()} FROM pred GROUP BY ALL)"


@query(_FOLDED + " SELECT weather, count(DISTINCT fold) AS folds, avg(rmse) AS rmse, avg(mae) AS mae, avg(nrmse) AS nrmse, avg(r2) AS r2, avg(mape) AS mape FROM m GROUP BY weather", "rmse mae nrmse r2 mape", 9)
def fold_metric_aggregate(spark, d):
    x = pred(spark, d).withColumn("fold", (F.col("row_id") % 4).cast("int"))
    return evaluate.fold_aggregate(evaluate.metrics(x, ("fold", "weather")))


@query(_CLASS + " SELECT l.weather, l.metric, l.value, b.value AS baseline, CASE WHEN b.value <> 0 THEN (l.value - b.value) / abs(b.value) * 100 END AS change FROM l LEFT JOIN l b ON l.metric = b.metric AND b.weather = 0", "value baseline change", 9)
def metrics_against_baseline(spark, d):
    return evaluate.against_baseline(pred(spark, d))


_MET = f"""WITH {PRED}, e AS (SELECT weather, abs(prediction - target) AS e, row_number() OVER (PARTITION BY weather ORDER BY ts, row_id) AS k FROM pred WHERE prediction - target IS NOT NULL),
 c AS (SELECT weather, count(*) AS c FROM e GROUP BY weather),
 d AS (SELECT a.weather, a.e, b.e AS base, round(b.e - a.e, 6) + 0.0 AS d FROM e a JOIN e b ON a.k = b.k AND b.weather = 0 WHERE a.weather <> 0),
 f AS (SELECT d.weather, avg(e) AS mae, avg(base) AS baseline_mae, any_value(abs(own.c - zero.c)) AS unpaired FROM d JOIN c own ON own.weather = d.weather JOIN c zero ON zero.weather = 0 GROUP BY d.weather)"""


@query(_MET + " SELECT f.*, count(d) AS n, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, avg(d) / stddev_pop(d) AS cohens_d FROM f JOIN d USING (weather) GROUP BY ALL", "mae baseline_mae t cohens_d")
def significance_ttest(spark, d):
    """Errors of each weather state against the first's, paired by place in time."""
    return evaluate.significance_against(pred(spark, d), digits=6).select("weather", "mae", "baseline_mae", "unpaired", "n", "t", "cohens_d")


@query(_MET + ", r AS (SELECT weather, d, rank() OVER (PARTITION BY weather ORDER BY abs(d)) + (count(*) OVER (PARTITION BY weather, abs(d)) - 1) / 2.0::DOUBLE AS k FROM d WHERE d <> 0) SELECT f.*, count(*) AS n, least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS w FROM f JOIN r USING (weather) GROUP BY ALL", "mae baseline_mae w")
def significance_wilcoxon(spark, d):
    return evaluate.significance_against(pred(spark, d), test="wilcoxon", digits=6).select("weather", "mae", "baseline_mae", "unpaired", "n", "w")


@query(_CLASS + " SELECT a.metric, a.value AS a, b.value AS b, b.value - a.value AS difference, coalesce((b.value - a.value) / CASE WHEN a.value <> 0 THEN abs(a.value) END * 100, 0) AS improvement FROM l a JOIN l b ON a.metric = b.metric AND a.weather = 0 AND b.weather = 1", "a b difference improvement", 9)
def checkpoint_compare(spark, d):
    long = evaluate.metrics_long(pred(spark, d))
    return evaluate.compare_runs(long.filter("weather = 0"), long.filter("weather = 1"))


# --- what moves from batch to batch -------------------------------------------------------------------------------------

_BATCHES = f"""{PRED}, b AS (SELECT series_id, (row_number() {_OVER} - 1) // 50 AS batch, weather, abs(prediction - target) AS e FROM pred),
 e AS (SELECT series_id, batch, coalesce(avg(e) FILTER (WHERE weather = 0), 0) AS s, coalesce(avg(e) FILTER (WHERE weather = 1), 0) AS c, coalesce(avg(e) FILTER (WHERE weather = 2), 0) AS o, avg(e) AS error FROM b GROUP BY series_id, batch)"""


@query(f"""WITH RECURSIVE {_BATCHES}, t AS (SELECT series_id, -1::BIGINT AS batch, 0.2::DOUBLE AS ci_low, 0.6::DOUBLE AS ci_high FROM e GROUP BY series_id
 UNION ALL SELECT t.series_id, e.batch, least(0.25::DOUBLE, greatest(0.15::DOUBLE, ci_low + 0.005::DOUBLE * sign(s - c))), least(0.65::DOUBLE, greatest(0.55::DOUBLE, ci_high + 0.005::DOUBLE * sign(c - o))) FROM t JOIN e ON e.series_id = t.series_id AND e.batch = t.batch + 1)
 SELECT series_id, batch, ci_low, ci_high, ci_low * 1.75::DOUBLE AS wsi_low, ci_high * 1.25::DOUBLE AS wsi_high FROM t WHERE batch >= 0""", "ci_low ci_high wsi_low wsi_high")
def thresholds_over_time(spark, d):
    got = adapt.adapted_thresholds(_batches(spark, d), order=("at",), block=64)
    return got.select("series_id", "batch", "ci_low", "ci_high", "wsi_low", "wsi_high")


@query(f"""WITH RECURSIVE {_BATCHES}, t AS (SELECT series_id, -1::BIGINT AS batch, 0.3::DOUBLE AS w FROM e GROUP BY series_id
 UNION ALL SELECT t.series_id, e.batch, CASE WHEN error > 0.1 THEN least(0.9::DOUBLE, w + 0.01::DOUBLE * error) ELSE w END FROM t JOIN e ON e.series_id = t.series_id AND e.batch = t.batch + 1)
 SELECT series_id, batch, 1 - w AS ci_weight, w AS wsi_weight FROM t WHERE batch >= 0""", "ci_weight wsi_weight")
def fusion_over_time(spark, d):
    return adapt.adapted_fusion(_batches(spark, d), order=("at",), block=64).select("series_id", "batch", "ci_weight", "wsi_weight")


def _batches(spark, d) -> DataFrame:
    return adapt.batch_errors(pred(spark, d), 50).withColumn("at", F.timestamp_seconds("batch"))


def _forgotten(share: str) -> str:
    return f"""WITH {PRED}, w AS (SELECT weather, target AS x, prediction AS y, pow({share}, 3 - row_id % 4) AS w FROM pred),
 s AS (SELECT weather, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM w GROUP BY weather)
 SELECT weather, (n * xy - x * y) / (n * xx - x * x) AS slope, (y - x * (n * xy - x * y) / (n * xx - x * x)) / n AS intercept FROM s"""


def _recursive(spark, d, forgetting: float) -> DataFrame:
    x = pred(spark, d).withColumn("features", F.array("target"))
    model = recursive.RecursiveLeastSquares(forgetting, penalty=0.0)
    for batch in range(4):
        model.update(x.filter(F.col("row_id") % 4 == batch), label="prediction")
    return spark.createDataFrame([(s, float(w[1]), float(w[0])) for s, w in model.weights().items()], "weather int, slope double, intercept double")


@query(_forgotten("1.0::DOUBLE"), "slope intercept", 6)
def recursive_fit(spark, d):
    """Weights learnt batch by batch are those of all rows at once."""
    return _recursive(spark, d, 1.0)


@query(_forgotten("0.5::DOUBLE"), "slope intercept", 6)
def recursive_fit_that_forgets(spark, d):
    return _recursive(spark, d, 0.5)


# --- what SQL can't express: rows only ---------------------------------------------------------------------------------


@query()
def vmd_modes(spark, d):
    return modes.vmd(pv(spark, d), modes=4)


@query()
def vmd_diagnostics(spark, d):
    return modes.diagnostics(modes.vmd(pv(spark, d), modes=4, carry=["power"]), modes=4)


@query()
def vmd_centre_frequencies(spark, d):
    return modes.centre_frequencies(pv(spark, d), modes=4)


@query()
def nca_weights(spark, d):
    names = ["power", "temperature", "humidity"]
    x = pv(spark, d)
    return embed.mean_weights(embed.local_weights(x, names, length=24, rounds=20), names)


@query()
def admm_mapping(spark, d):
    x = _unit(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    lap = graph.laplacian(graph.similarity(graph.knn_edges(x, key="id", vector="v"), mode="union"))
    a = graph.learn_projection(x, lap, 3, alpha=0.5).matrix
    return graph.project(x, "v", a).select("id", *(F.col("projected")[j].alias(f"f{j}") for j in range(3)))


@query()
def bootstrap_ci(spark, d):
    return evaluate.bootstrap_ci(pred(spark, d), rounds=200)


def _modelled(spark, d):
    x = W.classify(pv(spark, d)).withColumn("y", F.col("power"))
    rows = models.vectors(x, ["irradiance", "temperature", "pressure", "humidity"])
    rows = cut(rows.select("weather", "y", "features"))  # read by each state's training and by the predictions
    return rows, models.train_bank(rows)


@query()
def per_class_model(spark, d):
    rows, bank = _modelled(spark, d)
    return evaluate.metrics_with_total(models.predict(rows, bank).withColumn("target", F.col("y")))


@query()
def ensemble_predict(spark, d):
    rows, bank = _modelled(spark, d)
    odds = {s: F.when(F.col("weather") == s, 0.6).otherwise(0.4 / max(1, len(bank) - 1)) for s in bank}
    return evaluate.metrics(models.ensemble(rows, bank, odds).withColumn("target", F.col("y")))


# --- series in blocks of frequencies --------------------------------------------------------------------------------------


@query(f"WITH {PV} SELECT series_id, count(*) AS n, sum(power * power) AS energy FROM pv GROUP BY series_id", "energy", 3)
def spectrum_energy(spark, d):
    """The energy of each series, from its distributed Fourier transform: the sum of squares over its length, by Parseval."""
    found = modes.spectra(pv(spark, d))
    twice = F.when((F.col("at") == 0) | (2 * F.col("at") == F.col("n")), 1.0).otherwise(2.0)
    energy = F.sum(twice * (F.col("v")[0] ** 2 + F.col("v")[1] ** 2)) / F.first("n")
    return found.groupBy(F.get_json_object("key", "$.series_id").alias("series_id")).agg(F.first("n").alias("n"), energy.alias("energy"))


def _tones(spark, d) -> DataFrame:
    """pv with two tones as power, of heights 3 and 2 and of a twentieth and a fifth of a cycle a row."""
    at = F.col("rn") * (2 * float(np.pi))
    return numbered(pv(spark, d)).withColumn("power", 3 * F.sin(at * 0.05) + 2 * F.cos(at * 0.2)).drop("rn")


@query(f"WITH {PV} SELECT series_id, count(*) AS n, 3.0::DOUBLE AS low, 2.0::DOUBLE AS high FROM pv GROUP BY series_id", "low high")
def vmd_planted_tones(spark, d):
    """The heights of two planted tones, from the modes of series in blocks, however short."""
    height = lambda c: F.round(F.sqrt(2 * F.avg(F.col(c) ** 2)), 0)
    return modes.vmd(_tones(spark, d), modes=2, longest=0).groupBy("series_id").agg(F.count("*").alias("n"), height("imf1").alias("low"), height("imf2").alias("high"))


@query(f"WITH {PV} SELECT DISTINCT series_id, mode, frequency FROM pv, (VALUES (1, 0.05::DOUBLE), (2, 0.2::DOUBLE)) t(mode, frequency)", "frequency", 2)
def vmd_planted_centres(spark, d):
    """Their frequencies, likewise."""
    return modes.centre_frequencies(_tones(spark, d), modes=2, longest=0)


# --- statements that hold of the rows above, which SQL can make ---------------------------------------------------------


@query(f"WITH {PV} SELECT series_id, count(*) AS n, sum(power) AS total, true AS near FROM pv GROUP BY series_id", "total", 4)
def vmd_modes_cover(spark, d):
    """The modes of every row are there, and what they leave of the series is at most four fifths of its size. Series of
    events are noise, of which so few narrow modes can take no more."""
    x = pv(spark, d)
    found = modes.vmd(x, modes=4, carry=["power"])
    off = F.col("power") - sum((F.col(f"imf{k}") for k in range(1, 5)), F.lit(0.0))
    size = lambda c: F.coalesce(F.sqrt(F.sum(c * c)), F.lit(0.0))  # noqa: E731  of nothing known 0
    return found.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("power").alias("total"), (size(off) <= 0.8 * size(F.col("power"))).alias("near"))


@query(f"WITH {PV} SELECT series_id, CAST(k AS INTEGER) AS mode, true AS within FROM (SELECT DISTINCT series_id FROM pv), range(1, 5) t(k)")
def vmd_centres_rise(spark, d):
    """Centre frequencies lie between 0 and a half and rise with the mode's number."""
    got = modes.centre_frequencies(pv(spark, d), modes=4)
    before = F.coalesce(F.lag("frequency").over(Window.partitionBy("series_id").orderBy("mode")), F.lit(0.0))
    return got.select("series_id", "mode", ((F.col("frequency") >= before) & (F.col("frequency") <= 0.5)).alias("within"))


@query(f"WITH {PRED} SELECT avg(abs(prediction - target)) AS mae, true AS inside, true AS narrow FROM pred", "mae", 9)
def bootstrap_ci_holds(spark, d):
    """The interval holds the mean absolute error, and is as wide as 3.92 standard errors, give or take a fifth."""
    x = pred(spark, d)
    e = F.abs(F.col("prediction") - F.col("target"))
    facts = x.agg(F.avg(e).alias("mae"), (F.stddev_samp(e) / F.sqrt(F.count(e))).alias("se"))
    both = evaluate.bootstrap_ci(x).join(facts, F.lit(True))
    return both.select("mae", ((F.col("low") <= F.col("mae")) & (F.col("mae") <= F.col("high"))).alias("inside"), (F.abs((F.col("high") - F.col("low")) / F.col("se") / 3.92 - 1) < 0.2).alias("narrow"))


@query("SELECT 3 AS columns, true AS bounded, 1.0::DOUBLE AS total", "total", 6)
def nca_weights_add_up(spark, d):
    """Learnt weights lie between 0 and 1 and add up to 1."""
    names = ["power", "temperature", "humidity"]
    got = embed.mean_weights(embed.local_weights(pv(spark, d), names, length=24), names)
    return got.agg(F.count("*").cast("int").alias("columns"), F.bool_and(F.col("weight").between(0, 1)).alias("bounded"), F.sum("weight").alias("total"))


@query(f"{_STATES} SELECT weather, count(*) AS n, true AS better FROM states GROUP BY weather")
def per_class_model_beats_the_mean(spark, d):
    """On the rows that it learnt from, each state's model errs less than the state's mean."""
    rows, bank = _modelled(spark, d)
    return evaluate.metrics(models.predict(rows, bank).withColumn("target", F.col("y")), ("weather",)).select("weather", "n", (F.col("r2") > 0).alias("better"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
