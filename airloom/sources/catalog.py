"""Site catalogue: nested locations and their sensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE = (
    "id bigint, name string, isMonitor boolean, isMobile boolean, timezone string, "
    "provider struct<name: string>, coordinates struct<latitude: double, longitude: double>, "
    "datetimeFirst struct<utc: string>, datetimeLast struct<utc: string>, "
    "sensors array<struct<id: bigint, name: string, parameter: struct<name: string, displayName: string, units: string>>>"
)


def parse_sites(df: DataFrame, json_column: str) -> DataFrame:
    return df.select(F.from_json(json_column, SITE).alias("_s")).select("_s.*")


def site_catalog(sites: DataFrame) -> DataFrame:
    """One report row per location; pollutant names are distinct, sorted and joined.

    A location may come in several payloads, each with a page of its sensors; pages are summed, and what is gathered
    per location is its set of pollutant names, never its sensors.
    """
    names = F.transform("sensors", lambda s: F.lower(s["parameter"]["name"]))
    known = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.coalesce(F.length(n) > 0, F.lit(False)))))
    described = sites.select(
        F.col("id").alias("location_id"),
        "name",
        F.col("provider.name").alias("provider"),
        F.coalesce("isMonitor", F.lit(False)).alias("is_reference_monitor"),
        F.coalesce("isMobile", F.lit(False)).alias("is_mobile"),
        F.col("coordinates.latitude").alias("latitude"),
        F.col("coordinates.longitude").alias("longitude"),
        "timezone",
        F.col("datetimeFirst.utc").alias("datetime_first_utc"),
        F.col("datetimeLast.utc").alias("datetime_last_utc"),
        F.coalesce(known, F.array().cast("array<string>")).alias("_known"),
        F.greatest(F.coalesce(F.size("sensors"), F.lit(0)), F.lit(0)).alias("_n"),
    )
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_known")))), ", ")
    return described.groupBy(*[c for c in described.columns if c not in ("_known", "_n")]).agg(
        names.alias("pollutants"), F.sum("_n").alias("sensor_count")
    )


def sensor_candidates(sites: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """One row per sensor that measures a required pollutant and has integer ids."""
    rows = sites.filter(F.col("id").isNotNull()).select("*", F.explode("sensors").alias("_s"))
    parameter = F.lower(F.coalesce("_s.parameter.name", F.lit("")))
    return rows.filter(parameter.isin(list(pollutants)) & F.col("_s.id").isNotNull()).select(
        F.col("id").alias("location_id"),
        F.coalesce("name", F.concat(F.lit("Location "), F.col("id").cast("string"))).alias("location_name"),
        F.coalesce("provider.name", F.lit("Unknown provider")).alias("provider_name"),
        F.coalesce("isMonitor", F.lit(False)).alias("is_reference_monitor"),
        F.col("coordinates.latitude").alias("latitude"),
        F.col("coordinates.longitude").alias("longitude"),
        F.col("datetimeFirst.utc").alias("location_first_utc"),
        F.col("datetimeLast.utc").alias("location_last_utc"),
        F.col("_s.id").alias("sensor_id"),
        F.coalesce("_s.name", F.lit("")).alias("sensor_name"),
        parameter.alias("parameter_name"),
        F.coalesce("_s.parameter.displayName", parameter).alias("parameter_display_name"),
        F.coalesce("_s.parameter.units", F.lit("")).alias("units"),
    )
