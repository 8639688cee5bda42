"""Complete hour grids, gaps, short-gap repair and completeness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.hours import floor_hour, hour_index, hour_start, hours_between, plus_hours
from airloom.functions.numbers import RAW_SCALE, fixed_point, is_finite, reading, round_half_up
from airloom.operators.series import HOUR, halo, hour_window, numbered_hours, own_rows, with_previous

METHOD = "linear"


def _bound(value: str | None, fallback: Column) -> Column:
    return fallback if value is None else hour_index(F.lit(value).cast("timestamp"))


def hour_range(df: DataFrame, keys: Sequence[str], t: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every hour per key between bounds (default: its own first and last hour)."""
    bounds = df.groupBy(*keys).agg(
        _bound(start, F.min(hour_index(t))).alias("_first"), _bound(end, F.max(hour_index(t))).alias("_last")
    )
    # Two explodes: bucket starts first, so that no row ever carries a long array.
    step = 24
    return (
        bounds.filter("_first <= _last")
        .withColumn("_day", F.explode(F.sequence("_first", "_last", F.lit(step).cast("bigint"))))
        .withColumn("_h", F.explode(F.sequence(F.col("_day"), F.least(F.col("_day") + (step - 1), F.col("_last")))))
        .select(*keys, hour_start("_h").alias(t))
    )


def hourly_grid(df: DataFrame, keys: Sequence[str], t: str = "datetime_utc", start: str | None = None, end: str | None = None) -> DataFrame:
    """Complete hour grid per key with the data left-joined on (key, hour)."""
    return hour_range(df, keys, t, start, end).join(df, [*keys, t], "left")


def _stamp(value: str | Column) -> Column:
    return floor_hour((F.lit(value) if isinstance(value, str) else value).cast("timestamp"))


def detect_gaps(df: DataFrame, keys: Sequence[str], t: str, start: str | Column, end: str | Column) -> DataFrame:
    """Missing intervals inside an inclusive range, without building the grid.

    A gap lies between two neighbouring present hours; sentinel hours just
    outside the range turn leading and trailing gaps into interior ones.
    """
    first, last = _stamp(start), _stamp(end)
    present = df.select(*keys, floor_hour(t).alias("_t")).filter(F.col("_t").between(first, last))
    fences = df.select(*keys).distinct().withColumn(
        "_t", F.explode(F.array(plus_hours(first, -1), plus_hours(last, 1)))
    )
    hours = present.unionByName(fences).distinct()
    linked = with_previous(hours, keys, "_t", ["_t"])
    return linked.filter(hour_index("_t") - hour_index("prev__t") > 1).select(
        *keys,
        plus_hours("prev__t", 1).alias("start_time_utc"),
        plus_hours("_t", -1).alias("end_time_utc"),
        (hour_index("_t") - hour_index("prev__t") - 1).alias("missing_hours"),
    )


def islands(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Runs of consecutive hours: start, end, length."""
    runs = numbered_hours(df.select(*keys, t), keys, t).withColumn("_run", hour_index(t) - F.col("_number"))
    return (
        runs.groupBy(*keys, "_run")
        .agg(F.min(t).alias("start_time_utc"), F.max(t).alias("end_time_utc"), F.count("*").alias("hours"))
        .drop("_run")
    )


def gap_summary(df: DataFrame, keys: Sequence[str], t: str, v: str) -> DataFrame:
    """Runs of null values on a gridded series (sort by `missing_hours` to read the worst first)."""
    return islands(df.filter(F.col(v).isNull()), keys, t).withColumnRenamed("hours", "missing_hours")


def longest_missing_run(df: DataFrame, keys: Sequence[str], t: str, v: str) -> DataFrame:
    """Longest run of null values per key; keys without a gap report 0."""
    longest = gap_summary(df, keys, t, v).groupBy(*keys).agg(F.max("missing_hours").alias("longest_gap_hours"))
    return (
        df.select(*keys).distinct().join(longest, list(keys), "left")
        .withColumn("longest_gap_hours", F.coalesce("longest_gap_hours", F.lit(0)).cast("bigint"))
    )


def completeness_report(df: DataFrame, keys: Sequence[str], t: str, v: str, start: str, end: str) -> DataFrame:
    """Coverage, longest gap, duplicates and value statistics per key over `[start, end)`.

    Raw rows are first reduced to one row per (key, hour) with their counts, so
    later steps only see the calendar. The median is the distributed exact one.
    """
    from airloom.operators.quantiles import exact_quantiles

    first, last = F.lit(start).cast("timestamp"), plus_hours(F.lit(end).cast("timestamp"), -1)
    expected = hour_index(last) - hour_index(first) + 1
    rows = df.withColumn("_t", floor_hour(t)).filter(F.col("_t").between(first, last))
    hourly = rows.groupBy(*keys, "_t").agg(
        F.count("*").alias("_rows"),
        F.count(v).alias("_values"),
        F.max_by(F.col(v).isNotNull(), F.col(t)).alias("_present"),
        F.count_if(F.col(v) < 0).alias("_neg"),
        F.count_if(F.col(v) == 0).alias("_zero"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        F.sum(fixed_point(v, RAW_SCALE)).alias("_sum"),
        F.min(t).alias("_first"),
        F.max(t).alias("_last"),
    )
    stats = hourly.groupBy(*keys).agg(
        F.sum("_rows").alias("raw_records"),
        F.count_if("_present").alias("observed_hours"),
        F.sum(F.when(F.col("_rows") > 1, F.col("_rows")).otherwise(0)).alias("duplicate_hour_rows"),
        F.sum("_neg").alias("negative_values"),
        F.sum("_zero").alias("zero_values"),
        round_half_up(F.min("_min"), 3).alias("minimum"),
        round_half_up(F.max("_max"), 3).alias("maximum"),
        round_half_up(F.sum("_sum").cast("double") / F.lit(float(RAW_SCALE)) / F.sum("_values"), 3).alias("mean"),
        F.min("_first").alias("first_observation"),
        F.max("_last").alias("last_observation"),
    )
    gaps = hourly.filter("_present").select(*keys, "_t")
    longest = detect_gaps(gaps, keys, "_t", start, last).groupBy(*keys).agg(F.max("missing_hours").alias("_longest"))
    median = exact_quantiles(rows, keys, v, {"_median": 0.5})
    joined = stats.join(longest, list(keys), "left").join(median, list(keys), "left")
    return joined.select(
        *keys,
        expected.alias("expected_hours"),
        "raw_records",
        "observed_hours",
        (expected - F.col("observed_hours")).alias("missing_hours"),
        round_half_up(F.lit(100.0) * F.col("observed_hours") / expected, 2).alias("completeness_pct"),
        F.when(F.col("observed_hours") == 0, expected)
        .otherwise(F.coalesce("_longest", F.lit(0)))
        .cast("bigint")
        .alias("longest_gap_hours"),
        "duplicate_hour_rows",
        "negative_values",
        "zero_values",
        "minimum",
        "maximum",
        "mean",
        round_half_up("_median", 3).alias("median"),
        "first_observation",
        "last_observation",
    )


def impute_short_gaps(
    df: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    max_gap: int = 3,
    enabled: bool = True,
) -> DataFrame:
    """Linear repair of interior gaps of at most `max_gap` hours between positive finite readings.

    Frames reach at most `max_gap` hours, so a bucket needs no more context than
    that. Nothing else is ever filled and no reading is overwritten.
    """
    grid = hourly_grid(df.withColumn(v, reading(v)), keys, t)
    if not enabled:
        return grid.withColumn("is_imputed", F.lit(False)).withColumn("imputation_method", F.lit(None).cast("string"))
    w = hour_window(keys)
    back, ahead = w.rangeBetween(-max_gap, -1), w.rangeBetween(1, max_gap)
    near = (
        halo(grid, keys, t, back=max_gap, ahead=max_gap)
        .withColumn("_known", F.when(F.col(v).isNotNull(), F.col(HOUR)))
        .withColumns(
            {
                "_ph": F.max("_known").over(back),
                "_nh": F.min("_known").over(ahead),
                "_pv": F.last(v, ignorenulls=True).over(back),
                "_nv": F.first(v, ignorenulls=True).over(ahead),
            }
        )
    )
    usable = (
        F.col(v).isNull()
        & (F.col("_nh") - F.col("_ph") - 1 <= max_gap)
        & is_finite("_pv")
        & is_finite("_nv")
        & (F.col("_pv") > 0)
        & (F.col("_nv") > 0)
    )
    step = (F.col("_nv") - F.col("_pv")) / (F.col("_nh") - F.col("_ph"))
    filled = (
        near.withColumn("is_imputed", F.coalesce(usable, F.lit(False)))
        .withColumn(v, F.when(F.col("is_imputed"), F.col("_pv") + (F.col(HOUR) - F.col("_ph")) * step).otherwise(F.col(v)))
        .withColumn("imputation_method", F.when(F.col("is_imputed"), F.lit(METHOD)))
    )
    return own_rows(filled).drop("_known", "_ph", "_nh", "_pv", "_nv")


def window_quality(
    df: DataFrame, keys: Sequence[str], t: str = "datetime_utc", v: str = "pm25_ug_m3", hours: int = 24, label: Column | None = None
) -> DataFrame:
    """Quality of the window `[t - hours, t]` ending at every hour of an imputed grid.

    The timestamp lists hold at most `hours + 1` entries. With `label`, a text of the hour of `t`, they hold the labels
    in the order of the hours: a label is made once a row, not once for every window that sees it.
    """
    frame = hour_window(keys).rangeBetween(-hours, 0)
    imputed = F.col("is_imputed")
    unresolved = F.col(v).isNull()
    near = halo(df, keys, t, back=hours).withColumn("_entry", F.col(t) if label is None else label)
    # Frames are in the order of their hours; only timestamps inside one hour are left to sort.
    ordered = F.sort_array if label is None else (lambda entries: entries)
    out = near.withColumns(
        {
            "imputed_timestamps": ordered(F.collect_list(F.when(imputed, F.col("_entry"))).over(frame)),
            "unresolved_timestamps": ordered(F.collect_list(F.when(unresolved, F.col("_entry"))).over(frame)),
        }
    )
    out = own_rows(out).withColumn("imputed_hours", F.size("imputed_timestamps"))
    return out.select(
        *keys,
        F.col(t).alias("reference_time"),
        F.when(F.col("imputed_hours") > 0, F.lit("DEGRADED")).otherwise(F.lit("GOOD")).alias("quality_status"),
        (F.col("imputed_hours") > 0).alias("pm25_imputation_used"),
        F.when(F.col("imputed_hours") > 0, F.lit(METHOD)).alias("imputation_method"),
        "imputed_hours",
        "imputed_timestamps",
        F.size("unresolved_timestamps").alias("unresolved_hours"),
        "unresolved_timestamps",
    )


def sensor_ranking(report: DataFrame, by: str = "completeness_pct", name: str = "location_key") -> DataFrame:
    """Rank of each sensor by completeness, nulls last; equal values share a rank.

    Ranks come from the distinct values (at most 10,001 two-decimal percentages),
    so the global window never sees the sensors themselves.
    """
    levels = report.groupBy(by).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc_nulls_last(by)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select(
        F.col(by).alias("_level"), (F.coalesce(F.sum("_n").over(order), F.lit(0)) + 1).alias("completeness_rank")
    )
    return report.join(ranks, report[by].eqNullSafe(ranks["_level"])).drop("_level")


def timeline_diff(df: DataFrame, expected: DataFrame, keys: Sequence[str], t: str = "datetime_utc") -> DataFrame:
    """Expected-but-missing and unexpected hours."""
    on = [*keys, t]
    have, want = df.select(*on).distinct(), expected.select(*on).distinct()
    missing = want.join(have, on, "left_anti").withColumn("difference", F.lit("missing"))
    extra = have.join(want, on, "left_anti").withColumn("difference", F.lit("unexpected"))
    return missing.unionByName(extra)


def forecast_coverage(
    df: DataFrame, keys: Sequence[str], issued: str, t: str, columns: Sequence[str], hours: int = 72
) -> DataFrame:
    """Coverage of each issued forecast over the `hours` after issue.

    An issue has a fixed horizon, so after the hours are made distinct a
    window per issue never holds more than the returned hours of one forecast.
    """
    group = [*keys, issued]
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    in_range = F.col(t).between(plus_hours(issued, 1), plus_hours(issued, hours))
    hourly = df.groupBy(*group, t).agg(
        F.count("*").alias("_rows"),
        F.max(complete & in_range).alias("_complete"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns],
    )
    w = Window.partitionBy(*group).orderBy(t)
    stepped = hourly.withColumn("_step", hour_index(t) - F.lag(hour_index(t)).over(w)).withColumn(
        "_gap",
        F.when(
            F.col("_complete"),
            hour_index(t)
            - F.coalesce(
                F.max(F.when(F.col("_complete"), hour_index(t))).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                hour_index(issued),
            )
            - 1,
        ),
    )
    out = stepped.groupBy(*group).agg(
        F.sum("_rows").alias("returned_rows"),
        F.count("*").alias("unique_hours"),
        F.sum(F.col("_rows") - 1).alias("duplicate_rows"),
        F.count_if("_complete").alias("complete_hours"),
        *[F.sum(f"_null_{c}").alias(f"null_{c}") for c in columns],
        F.greatest(
            F.coalesce(F.max("_gap"), F.lit(0)),
            hour_index(issued) + hours - F.coalesce(F.max(F.when(F.col("_complete"), hour_index(t))), hour_index(issued)),
        ).alias("longest_gap_hours"),
        F.coalesce(F.bool_and(F.col("_step") == 1), F.lit(True)).alias("hourly_steps"),
    )
    return out.withColumn("expected_hours", F.lit(hours)).withColumn(
        "is_valid",
        (F.col("complete_hours") == hours) & (F.col("duplicate_rows") == 0) & F.col("hourly_steps"),
    )
