"""Canonical columns, their aliases in station files, and the rule tables of the checks. All fixed values."""

from __future__ import annotations

#: Columns that every station frame has, with time and series.
MEASURES = ("power", "irradiance", "temperature", "pressure", "humidity")
TIME_NAMES = ("Time(year-month-day h:m:s)", "timestamp", "Timestamp", "time", "datetime")

#: Spellings in raw files and what they mean; looked up as they are, stripped, then in lower case.
ALIASES = {
    "P": "power",
    "Power (MW)": "power_mw",
    "Power (kW)": "power",
    "I": "irradiance",
    "Global horizontal irradiance (W/m2)": "irradiance",
    "Total solar irradiance (W/m2)": "irradiance_total",
    "Direct normal irradiance (W/m2)": "dni",
    "Diffuse horizontal irradiance (W/m2)": "dhi",
    "Air temperature (°C)": "temperature",
    "Temperature (°C)": "temperature",
    "T": "temperature",
    "Atmosphere (hpa)": "pressure",
    "Atmospheric pressure (hPa)": "pressure",
    "Atmospheric pressure (kPa)": "pressure_kpa",
    "Pre": "pressure",
    "Relative humidity (%)": "humidity",
    "Humidity (%)": "humidity",
    "Hum": "humidity",
}

#: What loggers write for a missing value.
ERROR_MARKERS = (-99.0, -999.0, -9999.0)

#: Physically possible values: outliers lie outside.
PHYSICAL_RANGES = {"power": (0.0, 55000.0), "irradiance": (0.0, 1200.0), "temperature": (-40.0, 60.0), "pressure": (850.0, 1100.0), "humidity": (0.0, 100.0)}

#: Values that pass the quality validation.
VALID_RANGES = {"power": (0.0, 1000.0), "irradiance": (0.0, 1500.0), "temperature": (-30.0, 60.0), "humidity": (0.0, 100.0), "pressure": (800.0, 1100.0)}

WEATHER = {0: "sunny", 1: "cloudy", 2: "overcast"}
