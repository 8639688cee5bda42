"""Row preparation, contract checks and data-quality reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.contracts import TYPES, WEATHER_ALIASES, Contract
from airloom.functions.hours import floor_hour, hour_index, utc_hour
from airloom.functions.numbers import is_infinite, reading

TIME_NAMES = ("datetime_utc", "timestamp_utc", "date_utc", "datetime")
VALUE_NAMES = ("pm25_ug_m3", "pm25", "value")


def normalize_hours(df: DataFrame, t: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct UTC hours (per key); unparsable stamps are dropped."""
    return df.select(*keys, utc_hour(t).alias("datetime_utc")).filter(F.col("datetime_utc").isNotNull()).distinct()


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], keep: str = "last") -> DataFrame:
    """One row per logical key, first or last by an explicit order.

    An aggregate, not a window: copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    order = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order_by)])
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def clean_measurements(df: DataFrame, v: str, out: str = "pm25_ug_m3") -> DataFrame:
    """Flag zero and negative readings and null them; high readings stay, NaN and infinities are missing."""
    value = reading(v)
    return df.withColumns(
        {
            "pm25_zero_flag": F.coalesce(value == 0, F.lit(False)),
            "pm25_negative_flag": F.coalesce(value < 0, F.lit(False)),
            out: F.when(value > 0, value),
        }
    )


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values outside the allowed set."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed))).select(column).distinct()


def _resolve(df: DataFrame, names: Sequence[str]) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(names)} is a column")


def prepare_pm25_rows(
    df: DataFrame, location_id: Column, sensor_id: Column, run_id: str, version: str, source: str, retrieved_at: Column
) -> DataFrame:
    """Project to the observation contract with missing flag, status and lineage."""
    t, v = _resolve(df, TIME_NAMES), _resolve(df, VALUE_NAMES)
    number = reading(F.expr(f"try_cast({v} AS double)"))
    value = F.when(number > 0, number)
    return df.select(
        F.trim(F.col("location_key").cast("string")).alias("location_key"),
        location_id.cast("bigint").alias("location_id"),
        sensor_id.cast("bigint").alias("sensor_id"),
        utc_hour(t).alias("datetime_utc"),
        value.alias("pm25_ug_m3"),
        F.when(value.isNull(), F.lit("MISSING")).otherwise(F.lit("VALID")).alias("pm25_quality_status"),
        value.isNull().alias("pm25_is_missing"),
        F.lit(source).alias("source"),
        retrieved_at.alias("retrieved_at_utc"),
        F.lit(run_id).alias("pipeline_run_id"),
        F.lit(version).alias("source_data_version"),
    )


def prepare_weather_rows(
    df: DataFrame,
    run_id: str,
    version: str,
    source: str,
    retrieved_at: Column,
    aliases: Mapping[str, Sequence[str]] = WEATHER_ALIASES,
) -> DataFrame:
    """Project weather to its contract; the first matching source name of each column wins."""
    values = [F.expr(f"try_cast({_resolve(df, names)} AS double)").alias(out) for out, names in aliases.items()]
    return df.select(
        F.trim(F.col("location_key").cast("string")).alias("location_key"),
        utc_hour(_resolve(df, TIME_NAMES)).alias("datetime_utc"),
        *values,
        F.lit(source).alias("source"),
        retrieved_at.alias("retrieved_at_utc"),
        F.lit(run_id).alias("pipeline_run_id"),
        F.lit(version).alias("source_data_version"),
    )


def prepare_engineered_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str] = ("forecast_horizon_hours",)
) -> DataFrame:
    """One reusable feature row per reference hour of an expanded table (keep first)."""
    wanted = df.select(*keys, "reference_time", *columns, *[c for c in order_by if c not in columns])
    return dedupe(wanted, [*keys, "reference_time"], order_by, keep="first").select(*keys, "reference_time", *columns)


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast to the declared types in the declared order; bad text becomes null.

    `_coercion_errors` counts, per row, values lost by the cast and null integers.
    """
    casts, errors = [], F.lit(0)
    for name, kind, nullable in contract.columns:
        cast = F.expr(f"try_cast(`{name}` AS {TYPES[kind].simpleString()})")
        casts.append(cast.alias(name))
        lost = F.col(name).isNotNull() & cast.isNull()
        if kind == "bigint":
            lost = cast.isNull()
        errors = errors + lost.cast("int")
    return df.select(*casts, errors.alias("_coercion_errors"))


def contract_violations(df: DataFrame, contract: Contract, by: Sequence[str] = ()) -> DataFrame:
    """Missing and extra columns, null keys and surplus rows per logical key."""
    missing = [c for c in contract.names if c not in df.columns]
    extra = [c for c in df.columns if c not in contract.names]
    key = [c for c in contract.logical_key if c in df.columns]
    has_null = F.lit(False)
    for c in key:
        has_null = has_null | F.col(c).isNull()
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_null", has_null)
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key_rows"),
    ).withColumns(
        {
            "missing_columns": F.lit(", ".join(missing)),
            "additional_columns": F.lit(", ".join(extra)),
        }
    )


# The eleven physical-range rules (name, column, SQL test).
RANGE_RULES = (
    ("humidity_below_0", "relative_humidity_2m", "< 0"),
    ("humidity_above_100", "relative_humidity_2m", "> 100"),
    ("cloud_cover_below_0", "cloud_cover", "< 0"),
    ("cloud_cover_above_100", "cloud_cover", "> 100"),
    ("negative_precipitation", "precipitation", "< 0"),
    ("negative_rain", "rain", "< 0"),
    ("negative_wind_speed", "wind_speed_10m", "< 0"),
    ("negative_wind_gusts", "wind_gusts_10m", "< 0"),
    ("wind_direction_below_0", "wind_direction_10m", "< 0"),
    ("wind_direction_above_360", "wind_direction_10m", "> 360"),
    ("non_positive_pressure", "surface_pressure", "<= 0"),
)


def _nan(c: str) -> Column:
    return F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))


def range_violations(
    df: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], rules: Sequence[tuple[str, str, str]] = RANGE_RULES
) -> DataFrame:
    """Range, null, infinity, duplicate and missing-hour counters per key in one pass; NaN counts as null.

    The first aggregate is per (key, hour), which also yields the duplicates.
    """
    names = [r[0] for r in rules]
    hourly = df.groupBy(*keys, floor_hour(t).alias("_t")).agg(
        F.count("*").alias("_rows"),
        *[F.count_if(~_nan(c) & F.expr(f"`{c}` {test}")).alias(n) for n, c, test in rules],
        F.sum(sum(((F.col(c).isNull() | _nan(c)).cast("int") for c in columns), F.lit(0))).alias("_nulls"),
        F.sum(sum((is_infinite(c).cast("int") for c in columns), F.lit(0))).alias("_infinite"),
    )
    return hourly.groupBy(*keys).agg(
        F.sum("_rows").alias("row_count"),
        *[F.sum(n).alias(n) for n in names],
        F.sum("_nulls").alias("null_values"),
        F.sum("_infinite").alias("infinite_values"),
        F.sum(F.col("_rows") - 1).alias("duplicate_rows"),
        (F.max(hour_index("_t")) - F.min(hour_index("_t")) + 1 - F.count("*")).alias("missing_hours"),
        sum((F.sum(n) for n in names), F.lit(0)).alias("range_violations"),
    )


def between_hours(df: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Inclusive filter with literal bounds, so that it reaches the scan."""
    return df.filter(F.col(t).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def observed_window(df: DataFrame, references: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Rows up to each key's reference hour (drops forecast weather)."""
    from airloom.operators.series import attach_per_key

    one = references.select(*keys, F.col("reference_time").alias("_ref"))
    return attach_per_key(df, one, keys, t).filter(F.col(t) <= F.col("_ref")).drop("_ref").select(*df.columns)


def column_profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long-form profile: rows, nulls, infinities, zeros, negatives, min, max, mean, median per column."""
    from airloom.operators.quantiles import exact_quantiles

    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_c")).select(*keys, "_c.column_name", "_c.value")
    finite = F.when(~is_infinite("value") & ~F.isnan("value"), F.col("value"))
    stats = long.groupBy(*keys, "column_name").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.count_if(is_infinite("value")).alias("infinite_count"),
        F.count_if(F.col("value") == 0).alias("zero_count"),
        F.count_if(F.col("value") < 0).alias("negative_count"),
        F.min(finite).alias("minimum"),
        F.max(finite).alias("maximum"),
        F.avg(finite).alias("mean"),
    )
    median = exact_quantiles(long.withColumn("value", finite), [*keys, "column_name"], "value", {"median": 0.5})
    return stats.join(median, [*keys, "column_name"], "left")


# Name parts that mark a field as secret.
SECRET_MARKERS = (
    "api_key",
    "apikey",
    "authorization",
    "access_token",
    "refresh_token",
    "password",
    "secret",
    "connection_string",
    "storage_key",
    "credential",
)
REDACTED = "[REDACTED]"
# Tokens of JSON text: strings, structure, literals; a lone quote of broken text is a token of its own.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++|"'
_CHUNK = 256  # tokens read in one fold


def redact_fields(df: DataFrame, json_column: str, markers: Sequence[str] = SECRET_MARKERS) -> DataFrame:
    """Replace values of fields whose name holds a secret marker, at any depth of objects and arrays.

    The text is read token by token: after a secret name, the next value is replaced as a whole, whatever it holds.
    A fold copies its state at every step, so the text never is part of it: a first pass over chunks of tokens finds the
    state in which each chunk begins, a second one writes the chunks, which are joined once.
    Fields keep their order, repeated names are all treated, blanks between tokens go. Text that does not begin
    like an object or array stays as it is, and so does null; broken JSON is redacted as far as it has names.
    """

    any_marker = "|".join(re.escape(m) for m in markers) or "(?!)"

    def secret(name: Column) -> Column:
        # Escapes in a name are read as JSON reads them.
        plain = F.coalesce(F.get_json_object(F.concat(F.lit("["), name, F.lit("]")), "$[0]"), name)
        clean = F.replace(F.lower(F.trim(plain)), F.lit("-"), F.lit("_"))
        return F.regexp(clean, F.lit(any_marker))  # one test for all markers: the name is read once

    def state(depth: Column, hidden: Column, name: Column, await_: Column) -> Column:
        return F.struct(depth.alias("depth"), hidden.alias("hidden"), name.alias("name"), await_.alias("await"))

    none, no = F.lit(-1), F.lit(False)

    def replaced(s: Column, x: Column) -> Column:
        return s["await"] & ~x.isin("}", "]", ",", ":")

    def moved(s: Column, x: Column) -> Column:
        opens, closes = x.isin("{", "["), x.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        inside = state(depth, F.when(closes & (depth <= s["hidden"]), none).otherwise(s["hidden"]), s["name"], no)
        value = state(depth, F.when(opens, s["depth"]).otherwise(none), s["name"], no)
        shown = state(depth, none, F.when(x.startswith('"'), x).otherwise(s["name"]), (x == ":") & secret(s["name"]))
        return F.when(s["hidden"] >= 0, inside).when(replaced(s, x), value).otherwise(shown)

    def written(s: Column, x: Column) -> Column:
        return F.when(s["hidden"] >= 0, F.lit("")).when(replaced(s, x), F.lit(f'"{REDACTED}"')).otherwise(x)

    def redacted(tokens: Column) -> Column:
        def chunk(i: Column) -> Column:
            return F.slice(tokens, i * _CHUNK + 1, F.lit(_CHUNK))

        first = state(F.lit(0), none, F.lit(""), no)
        chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / _CHUNK).cast("int") - 1, F.lit(0)))
        begun = F.struct(F.array().cast("array<struct<depth:int,hidden:int,name:string,await:boolean>>").alias("starts"), first.alias("now"))

        def pass_chunk(s: Column, i: Column) -> Column:
            return F.struct(F.array_append(s["starts"], s["now"]).alias("starts"), F.aggregate(chunk(i), s["now"], moved).alias("now"))

        def write_chunk(start: Column, i: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                return F.struct(F.concat(s["out"], written(s["now"], x)).alias("out"), moved(s["now"], x).alias("now"))

            return F.aggregate(chunk(i), F.struct(F.lit("").alias("out"), start.alias("now")), step, lambda s: s["out"])

        starts = F.aggregate(chunks, begun, pass_chunk, lambda s: s["starts"])
        return F.array_join(F.transform(starts, write_chunk), "")

    # A lambda's argument is found once; the tokens would otherwise be searched anew for every chunk.
    tokens = F.array(F.regexp_extract_all(json_column, F.lit(_TOKENS), F.lit(0)))
    folded = F.get(F.transform(tokens, redacted), 0)
    return df.withColumn(json_column, F.when(F.regexp(json_column, F.lit(r"^\s*[{\[]")), folded).otherwise(F.col(json_column)))
