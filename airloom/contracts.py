"""Declared table contracts: ordered columns, types, keys and event time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The five contract types.
TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class Contract:
    """One table: (name, type, nullable) columns, logical key and event time."""

    name: str
    version: int
    primary_key: tuple[str, ...]
    event_time: str
    columns: tuple[tuple[str, str, bool], ...]

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]

    @property
    def logical_key(self) -> list[str]:
        return list(dict.fromkeys([*self.primary_key, self.event_time]))

    @property
    def required(self) -> list[str]:
        return list(dict.fromkeys([*self.logical_key, *[c[0] for c in self.columns if not c[2]]]))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[k], True) for n, k, _ in self.columns])

    def problems(self) -> list[str]:
        """Self-check of the declaration."""
        found = []
        if len(set(self.names)) != len(self.names):
            found.append("duplicate column names")
        found += [f"unknown type {k}" for _, k, _ in self.columns if k not in TYPES]
        found += [f"key column {k} is not declared" for k in self.logical_key if k not in self.names]
        found += [f"key column {n} is nullable" for n, _, nullable in self.columns if nullable and n in self.logical_key]
        if dict((n, k) for n, k, _ in self.columns).get(self.event_time) != "timestamp":
            found.append("event time is not a timestamp")
        return found


# The ten hourly weather variables in model order.
WEATHER = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "surface_pressure",
    "precipitation",
    "rain",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
)

# Stored weather column -> accepted source names, first match wins.
WEATHER_ALIASES = {
    "temperature_2m_c": ("temperature_2m_c", "temperature_2m"),
    "relative_humidity_2m_pct": ("relative_humidity_2m_pct", "relative_humidity_2m"),
    "dew_point_2m_c": ("dew_point_2m_c", "dew_point_2m"),
    "surface_pressure_hpa": ("surface_pressure_hpa", "surface_pressure"),
    "precipitation_mm": ("precipitation_mm", "precipitation"),
    "rain_mm": ("rain_mm", "rain"),
    "cloud_cover_pct": ("cloud_cover_pct", "cloud_cover"),
    "wind_speed_10m_kmh": ("wind_speed_10m_kmh", "wind_speed_10m"),
    "wind_direction_10m_deg": ("wind_direction_10m_deg", "wind_direction_10m"),
    "wind_gusts_10m_kmh": ("wind_gusts_10m_kmh", "wind_gusts_10m"),
}

LAGS = (1, 3, 6, 12, 24)
MEANS = (3, 6, 12, 24)
CHANGES = (1, 6, 24)
MAX_HORIZON = 72
TARGET = "target_pm25_ug_m3"


def _calendar(prefix: str) -> list[str]:
    names = [f"{prefix}{n}" for n in ("hour", "day_of_week", "month")]
    return names + [f"{n}_{f}" for n in names for f in ("sin", "cos")]


def _weather(prefix: str) -> list[str]:
    return [f"{prefix}{n}" for n in WEATHER] + [f"{prefix}wind_direction_10m_{f}" for f in ("sin", "cos")]


REFERENCE_FEATURES = (
    ["pm25_current"]
    + [f"pm25_lag_{h}h" for h in LAGS]
    + [f"pm25_mean_{h}h" for h in MEANS]
    + [f"pm25_change_{h}h" for h in CHANGES]
    + _weather("")
    + _calendar("reference_")
)
TARGET_FEATURES = _weather("target_") + _calendar("target_")
MODEL_FEATURES = REFERENCE_FEATURES + ["forecast_horizon_hours"] + TARGET_FEATURES

_LINEAGE = (
    ("source", "string", False),
    ("retrieved_at_utc", "timestamp", False),
    ("pipeline_run_id", "string", False),
    ("source_data_version", "string", False),
)

PM25 = Contract(
    "pm25_hourly", 1, ("location_key", "sensor_id"), "datetime_utc",
    (
        ("location_key", "string", False),
        ("location_id", "bigint", False),
        ("sensor_id", "bigint", False),
        ("datetime_utc", "timestamp", False),
        ("pm25_ug_m3", "double", True),
        ("pm25_quality_status", "string", False),
        ("pm25_is_missing", "boolean", False),
        *_LINEAGE,
    ),
)
WEATHER_TABLE = Contract(
    "weather_hourly", 1, ("location_key",), "datetime_utc",
    (
        ("location_key", "string", False),
        ("datetime_utc", "timestamp", False),
        *[(n, "double", True) for n in WEATHER_ALIASES],
        *_LINEAGE,
    ),
)
ENGINEERED = Contract(
    "engineered_hourly", 1, ("location_key",), "reference_time",
    (
        ("location_key", "string", False),
        ("reference_time", "timestamp", False),
        *[(n, "double", True) for n in REFERENCE_FEATURES],
        ("pipeline_run_id", "string", False),
        ("source_data_version", "string", False),
    ),
)
VALUE = Contract(
    "value_hourly", 1, ("location_key",), "datetime_utc",
    (("location_key", "string", False), ("datetime_utc", "timestamp", False), ("value", "double", True)),
)
