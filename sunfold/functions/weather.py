"""Weather states from solar geometry and meteorological indices, as expressions over columns."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunfold.operators.ordered import SERIES, windowed
from sunfold.operators.quality import clip

# Site, sun and the series of solar geometry.
LATITUDE, LONGITUDE, SOLAR_CONSTANT = 38.5, 105.0, 1367.0
_E0 = (1.000110, 0.034221, 0.001280, 0.000719, 0.000077)
_DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
_TIME = (0.0066, 7.3525, 1.498, 9.9359, 1.1359, 0.3387, 0.0607)


def extraterrestrial_radiation(ts: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE, tz_offset: int | None = None) -> Column:
    """Radiation on a level plane above the air, W/m2; 0 while the sun is down. Time zone: `tz_offset`, or that of the longitude."""
    offset = round(longitude / 15) if tz_offset is None else tz_offset
    g = (F.dayofyear(ts) - 1) * (2 * math.pi / 365)
    a, b, c, d, e = _E0
    e0 = a + b * F.cos(g) + c * F.sin(g) + d * F.cos(2 * g) + e * F.sin(2 * g)
    a, b, c, d, e, f, h = _DECLINATION
    declination = a + b * F.cos(g) + c * F.sin(g) + d * F.cos(2 * g) + e * F.sin(2 * g) + f * F.cos(3 * g) + h * F.sin(3 * g)
    a, b, c, d, e, f, h = _TIME
    minutes = 4 * (a + b * F.cos(g + c) + d * F.cos(2 * g + e) + f * F.cos(3 * g + h))
    clock = F.hour(ts) + F.minute(ts) / 60 + F.floor(F.second(ts)) / 3600
    true_time = clock + (minutes + 4 * (longitude - 15 * offset)) / 60
    angle = (true_time - 12) * (math.pi / 12)
    phi = math.radians(latitude)
    height = F.sin(declination) * math.sin(phi) + F.cos(declination) * math.cos(phi) * F.cos(angle)
    return F.when(height > 0, SOLAR_CONSTANT * e0 * height).otherwise(0.0)


def clearness_index(ghi: Column, ge: Column) -> Column:
    """Share of the radiation above the air that arrives, 0 to 1.2; without sun the divisor is 1e-6."""
    return clip(ghi / F.when(ge > 0, ge).otherwise(1e-6), 0.0, 1.2)


def weather_state_index(pressure: Column, humidity: Column, pressure_step: Column, temperature_factor: Column, pressure_base: float = 1040.0, minutes: float = 15.0) -> Column:
    """Weighted low pressure, humidity and fall of pressure, times the factor, 0 to 1."""
    low = clip((pressure_base - pressure) / 60, -1.0, 1.0)
    humid = clip(humidity / 100, 0.0, 1.0)
    fall = clip(F.greatest(F.lit(0.0), -pressure_step / (minutes / 60)) / 10, 0.0, 1.0)
    return clip((0.4 * low + 0.5 * humid + 0.1 * fall) * temperature_factor, 0.0, 1.0)


def classify_ci(ci: Column, low: float = 0.2, high: float = 0.6) -> Column:
    """0 sunny from `high` on, 2 overcast up to `low`, else 1 cloudy."""
    return F.when(ci <= low, 2).when(ci >= high, 0).otherwise(1)


def classify_wsi(wsi: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """0 sunny below `low`, 2 overcast above `high`, else 1 cloudy."""
    return F.when(wsi > high, 2).when(wsi < low, 0).otherwise(1)


def confidence(x: Column, low: float, high: float) -> Column:
    """Distance to the nearest threshold, 0.3 and more being certain."""
    return F.least(F.lit(1.0), F.least(F.abs(x - low), F.abs(x - high)) / 0.3)


def fuse(ci: Column, wsi: Column, weights: tuple[float, float] = (0.7, 0.3), ci_at: tuple[float, float] = (0.2, 0.6), wsi_at: tuple[float, float] = (0.3, 0.7)) -> Column:
    """One state from both indices: where they agree, that; else votes of state times weight times confidence, and cloudy if they are within 0.1."""
    a, b = classify_ci(ci, *ci_at), classify_wsi(wsi, *wsi_at)
    wa, wb = (w / sum(weights) for w in weights)
    va, vb = a * wa * confidence(ci, *ci_at), b * wb * confidence(wsi, *wsi_at)
    return F.when(a == b, a).when(F.abs(va - vb) < 0.1, 1).when(va > vb, a).otherwise(b)


def indices(df: DataFrame, pressure_base: float = 1040.0, per_row: bool = False, **site) -> DataFrame:
    """df with rn, ge, ci and wsi. The temperature factor is 1.1 for a whole series in which any temperature is below 0
    or above 35, or with `per_row` for such rows only."""
    rows = windowed(df, lambda w: {"__step": F.coalesce(F.col("pressure") - F.lag("pressure").over(w), F.lit(0.0))}, 1)
    extreme = (F.col("temperature") < 0) | (F.col("temperature") > 35)
    if per_row:
        rows = rows.withColumn("__hot", F.coalesce(extreme, F.lit(False)))
    else:
        any_ = df.groupBy(F.col(SERIES).alias("__s")).agg(F.coalesce(F.bool_or(extreme), F.lit(False)).alias("__hot"))
        rows = rows.join(any_, F.col(SERIES).eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("ge", extraterrestrial_radiation(F.col("ts"), **site))
    factor = F.when(F.col("__hot"), 1.1).otherwise(1.0)
    return rows.withColumns({"ci": clearness_index(F.col("irradiance"), F.col("ge")), "wsi": weather_state_index(F.col("pressure"), F.col("humidity"), F.col("__step"), factor, pressure_base)}).drop("__step", "__hot")


def classify(df: DataFrame, weights: tuple[float, float] = (0.7, 0.3), **how) -> DataFrame:
    """df with rn, ge, ci, wsi and weather (0 sunny, 1 cloudy, 2 overcast)."""
    return indices(df, **how).withColumn("weather", fuse(F.col("ci"), F.col("wsi"), weights))


def weather_name(state: Column, names: Mapping[int, str]) -> Column:
    """The state's name; sunny for unknown ones."""
    table = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    return F.coalesce(F.element_at(table, state), F.lit("sunny"))


def distribution(df: DataFrame, state: str = "weather") -> DataFrame:
    """(state, n, percent) over all rows."""
    return df.groupBy(state).agg(F.count("*").alias("n")).withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy()))


def transitions(df: DataFrame, state: str = "weather", series: str = SERIES) -> DataFrame:
    """(series, transitions): changes of state between rows."""
    rows = windowed(df, lambda w: {"__changed": F.col(state) != F.lag(state).over(w)}, 1)
    return rows.groupBy(series).agg(F.count_if("__changed").alias("transitions"))


def fixture_state(ci: Column, wsi: Column) -> Column:
    """The simpler rule of labelled test data."""
    score = 0.7 * ci + 0.3 * wsi
    return F.when(score < 0.3, "overcast").when(score > 0.6, "sunny").otherwise("cloudy")


def updated_weights(weights: tuple[float, float], error: float, rate: float = 0.01) -> tuple[float, float]:
    """Fusion weights moved towards the state index where errors exceed 0.1."""
    if error <= 0.1:
        return weights
    w = min(0.9, weights[1] + rate * error)
    return 1 - w, w
