"""Station files: scans, canonical columns and units."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunfold.schema import ALIASES, MEASURES, TIME_NAMES
from sunfold.sources.excel import read_excel

_LOWER = {k.lower(): v for k, v in ALIASES.items()}


def alias_of(name: str) -> str:
    """The canonical name of a raw column; itself if there is none."""
    return ALIASES.get(name) or ALIASES.get(name.strip()) or _LOWER.get(name.strip().lower()) or name


def time_column(names: Sequence[str]) -> str:
    """The first of the known time columns, or else the first whose name holds "time"."""
    for n in TIME_NAMES:
        if n in names:
            return n
    for n in names:
        if "time" in n.lower():
            return n
    raise ValueError(f"no time column among {list(names)}")


def canonical(raw: DataFrame, station: Column | None = None, required: Sequence[str] = MEASURES) -> DataFrame:
    """raw, all text, as ts, station and numbers under canonical names and units; other columns are carried.

    Unreadable numbers are null. Megawatts become kilowatts, also where a power column never exceeds 1.5; without either, power_kwh
    is taken as it is; kilopascals become hectopascals; irradiance falls back on total, direct and diffuse; humidity is held within 0 and 100. A required column
    that is missing raises ValueError."""
    names = [re.sub(r"\s+", " ", c).strip() for c in raw.columns]
    df = raw.toDF(*names)
    time = time_column(names)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    held: dict[str, Column] = {}
    rest = []
    for c in names:
        to = alias_of(c)
        if c == time:
            continue
        if to == c and c not in MEASURES:
            rest.append(c)
        else:
            held[to] = F.coalesce(held[to], number(c)) if to in held else number(c)
    if "power_mw" in held:
        held["power"] = F.coalesce(held["power"], held.pop("power_mw") * 1000) if "power" in held else held.pop("power_mw") * 1000
    elif "power" in held:
        most = df.agg(F.max(held["power"])).first()[0]  # one number
        if most is not None and most <= 1.5:
            held["power"] = held["power"] * 1000
    elif energy := next((c for c in rest if c.lower() == "power_kwh"), None):
        held["power"] = number(energy)
        rest.remove(energy)
    chain = [held.pop(c) for c in ("irradiance", "irradiance_total", "dni", "dhi") if c in held]
    if chain:
        held["irradiance"] = F.coalesce(*chain)
    if "pressure_kpa" in held:
        held["pressure"] = F.coalesce(held["pressure"], held.pop("pressure_kpa") * 10) if "pressure" in held else held.pop("pressure_kpa") * 10
    if missing := [c for c in required if c not in held]:
        raise ValueError(f"missing columns: {missing}")
    if "humidity" in held:
        h = held["humidity"]
        held["humidity"] = F.when(h.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), h)))
    ts = F.expr(f"try_to_timestamp(`{time}`)").cast("timestamp_ntz").alias("ts")
    where = [] if station is None else [station.alias("station")]
    return df.select(ts, *where, *(x.alias(c) for c, x in held.items()), *(F.col(f"`{c}`") for c in rest if c != "station" or station is None))


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def read_station(spark: SparkSession, path: str) -> DataFrame:
    """One station's file, or files of one layout: csv, txt, xlsx or parquet, by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "txt"):
        raw = spark.read.option("header", True).csv(path)
    elif suffix == "parquet":
        raw = spark.read.parquet(path)
        raw = raw.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns))
    elif suffix == "xlsx":
        raw = read_excel(spark, path)
    elif suffix == "xls":
        raise ValueError("workbooks of the old binary format can't be read; save them as .xlsx")
    else:
        raise ValueError(f"unsupported file type: {suffix}")
    named = raw if "station" in raw.columns else raw.select("*", _stem().alias("station"))
    return canonical(named)


def station_files(spark: SparkSession, folder: str) -> list[str]:
    """The station files directly in a folder, by name; files of other types are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = (f.getPath().toString() for f in fs.listStatus(at))
    return sorted(p for p in found if p.rsplit(".", 1)[-1].lower() in ("csv", "txt", "parquet", "xlsx", "xls"))


def numeric_columns(df: DataFrame) -> list[str]:
    """The names of columns that hold numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def power_column(df: DataFrame, wanted: str = "power") -> str:
    """The column to decompose: the wanted one, else one whose name has power in it, else the first of numbers."""
    if wanted in df.columns:
        return wanted
    named = [c for c in df.columns if "power" in c.lower()]
    if found := named or numeric_columns(df):
        return found[0]
    raise ValueError("no column of numbers")


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ("series_id", "ts", "row_id")) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(*order).limit(n)


def read_stations(spark: SparkSession, paths: Sequence[str], merge: str = "concat", station: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Many stations as one frame, and what went wrong with files that had to be left out.

    concat: all rows, columns that a file lacks being null. average: the mean over stations at each time. single: only
    the named station's file, or the first, is read. A path that ends in / is a folder, of which all station files are read."""
    from sunfold.operators.split import merge_average, merge_concat

    paths = [f for p in paths for f in (station_files(spark, p) if p.endswith("/") else [p])]

    stem = lambda p: p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if merge == "single":
        paths = [next((p for p in paths if stem(p) == station), paths[0])]
    frames, failed = [], {}
    for p in paths:
        try:
            frames.append(read_station(spark, p))
        except Exception as e:  # a file that can't be read must not stop the others
            failed[p] = str(e).splitlines()[0]
    if not frames:
        raise ValueError(f"no readable files: {failed}")
    out = merge_concat(frames)
    return (merge_average(out, MEASURES) if merge == "average" else out), failed


def synthetic(spark: SparkSession, days: int = 7, minutes: int = 5, start: str = "2024-06-01", noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(ts and the measures) of an invented plant: sun by day, nothing by night."""
    n = days * 24 * 60 // minutes + 1
    ts = F.timestamp_add("MINUTE", (F.col("id") * minutes).cast("int"), F.lit(start).cast("timestamp")).cast("timestamp_ntz")
    rows = spark.range(n).select(ts.alias("ts"), F.col("id").alias("i"), *(F.randn(seed + k).alias(f"z{k}") for k in range(5)), F.rand(seed + 9).alias("u"))
    hour = F.hour("ts") + F.minute("ts") / 60
    day = (hour >= 6) & (hour <= 18)
    sun = F.sin((hour - 6) * (math.pi / 12))
    season = 0.8 + 0.4 * F.sin((F.dayofyear("ts") - 80) * (2 * math.pi / 365))
    rows = rows.withColumn("irradiance", F.when(day, F.greatest(F.lit(0.0), 1000 * sun * season * (0.7 + 0.3 * F.col("u")) * (1 + noise * F.col("z0")))).otherwise(0.0))
    rows = rows.withColumn("temperature", F.when(day, 25 + 10 * sun + 5 * F.col("z1")).otherwise(15 + 3 * F.col("z1")))
    power = F.greatest(F.lit(0.0), F.col("irradiance") * 0.8 * (1 - 0.004 * (F.col("temperature") - 25)) * (1 + noise * F.col("z2")))
    humidity = F.greatest(F.lit(10.0), F.least(F.lit(95.0), 60 - 0.5 * F.col("temperature") + 10 * F.col("z4")))
    return rows.select("ts", "irradiance", power.alias("power"), "temperature", (1013 + 20 * F.sin(0.001 * F.col("i")) + 5 * F.col("z3")).alias("pressure"), humidity.alias("humidity"))
