"""Training tables: 72-hour expansion, completeness, chronological splits, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.contracts import LAGS, MAX_HORIZON, MODEL_FEATURES, REFERENCE_FEATURES, TARGET, TARGET_FEATURES, WEATHER
from airloom.functions.hours import hour_index, plus_hours
from airloom.operators.features import calendar_features, circular_encode, history_columns, target_weather_features
from airloom.operators.series import HOUR, attach_per_key, halo, hour_window, numbered_hours, own_rows
from airloom.session import materialized

MIN_NEW_HOURS = 168
RATIOS = (0.70, 0.15)


def _all_present(columns: Sequence[str]):
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def hour_table(
    reference: DataFrame, pollution: DataFrame, weather: DataFrame, keys: Sequence[str], t: str = "datetime_utc", v: str = "pm25_ug_m3"
) -> DataFrame:
    """One row per key and hour `_t`: its reference features, and what it offers as a target (label, weather)."""
    on = [*keys, "_t"]
    refs = reference.select(*keys, F.col("reference_time").alias("_t"), *REFERENCE_FEATURES, F.lit(True).alias("_is_reference"))
    labels = pollution.select(*keys, F.col(t).alias("_t"), F.col(v).alias(TARGET), F.lit(True).alias("_has_label"))
    target = target_weather_features(weather, keys, t).withColumnRenamed("target_time", "_t").withColumn("_has_weather", F.lit(True))
    return refs.join(labels, on, "full").join(target, on, "full")


def _ahead(keys: Sequence[str], flags: dict[str, str], horizons: int) -> dict:
    """Numbers of flagged rows in the next `horizons` hours, each the difference of two running counts.

    Both frames begin with the bucket and only grow, so a row costs the same whatever the horizon.
    """
    w = hour_window(keys)
    upto, here = w.rangeBetween(Window.unboundedPreceding, horizons), w.rangeBetween(Window.unboundedPreceding, 0)
    return {name: F.count_if(F.col(flag)).over(upto) - F.count_if(F.col(flag)).over(here) for name, flag in flags.items()}


def packed_candidates(
    reference: DataFrame,
    pollution: DataFrame,
    weather: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    horizons: int = MAX_HORIZON,
) -> DataFrame:
    """One row per eligible reference, whose whole horizon lies before the last label and the last weather of its key.

    `_labels`, `_features` and `_valid` count its next hours with a label, with all target features and with both
    (`_valid` is 0 if a feature of the reference itself is missing); `_targets` lists those hours. The hour table is
    written once, because limits, counts and lists all read it.
    """
    hours = materialized(hour_table(reference, pollution, weather, keys, t, v), "training-hours")
    latest = [F.max(F.when(F.col(has), F.col("_t"))) for has in ("_has_label", "_has_weather")]
    # `least` passes over nulls: a key without one of them has no eligible reference.
    ends = hours.groupBy(*keys).agg(F.when(latest[0].isNotNull() & latest[1].isNotNull(), plus_hours(F.least(*latest), -horizons)).alias("_eligible"))
    flagged = hours.withColumns({"_ok": F.col(TARGET).isNotNull(), "_full": _all_present(TARGET_FEATURES)})
    near = halo(flagged.withColumn("_both", F.col("_ok") & F.col("_full")), keys, "_t", ahead=horizons)
    target = F.struct(F.col(HOUR).alias("_th"), TARGET, *TARGET_FEATURES)
    counts = _ahead(keys, {"_labels": "_ok", "_features": "_full", "_valid": "_both"}, horizons)
    near = near.withColumns({**counts, "_targets": F.collect_list(target).over(hour_window(keys).rangeBetween(1, horizons))})
    chosen = own_rows(near.filter("_home AND _is_reference")).withColumnRenamed("_t", "reference_time")
    chosen = attach_per_key(chosen, ends, keys, "reference_time").filter("reference_time <= _eligible")
    return chosen.select(
        *keys,
        "reference_time",
        *REFERENCE_FEATURES,
        _all_present(REFERENCE_FEATURES).alias("_complete"),
        "_labels",
        "_features",
        F.when(_all_present(REFERENCE_FEATURES), F.col("_valid")).otherwise(0).alias("_valid"),
        "_targets",
    )


def candidate_rows(packed: DataFrame, keys: Sequence[str], horizons: int = MAX_HORIZON) -> DataFrame:
    """Packed references -> one row per horizon, absent hours with nulls; a narrow explode after the last shuffle."""
    kind = packed.schema["_targets"].dataType.elementType
    first = hour_index("reference_time")

    def at(h):
        absent = F.struct((first + h).alias("_th"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:]])
        return F.coalesce(F.get(F.filter("_targets", lambda x: x["_th"] == first + h), F.lit(0)), absent.cast(kind))

    whole = F.when(F.size("_targets") == horizons, F.col("_targets")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(horizons)), at))
    return _expanded(packed, keys, whole)


def complete_rows(packed: DataFrame, keys: Sequence[str], horizons: int = MAX_HORIZON) -> DataFrame:
    """Training rows of the references that keep all their horizons; nothing incomplete is ever expanded."""
    return _expanded(packed.filter(F.col("_valid") == horizons), keys, F.col("_targets"))


def rejection_counts(packed: DataFrame, keys: Sequence[str], horizons: int = MAX_HORIZON) -> DataFrame:
    """Candidate rows with a missing feature, a missing label, and valid rows lost with a partial reference.

    Counts per reference add up, so no row is expanded.
    """
    whole = F.col("_valid") == horizons
    lacking = F.when(F.col("_complete"), F.lit(horizons) - F.col("_features")).otherwise(horizons)
    return packed.groupBy(*keys).agg(
        (F.count("*") * horizons).alias("candidate_rows"),
        F.sum(lacking).alias("missing_feature_rows"),
        F.sum(F.lit(horizons) - F.col("_labels")).alias("missing_target_rows"),
        F.sum(F.when(whole, 0).otherwise(F.col("_valid"))).alias("partial_reference_rows_removed"),
        (F.count_if(whole) * horizons).alias("final_rows"),
    )


def training_candidates(
    reference: DataFrame,
    pollution: DataFrame,
    weather: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    horizons: int = MAX_HORIZON,
) -> DataFrame:
    """Eligible references x horizons with target weather and label, from separate tables."""
    return candidate_rows(packed_candidates(reference, pollution, weather, keys, t, v, horizons), keys, horizons)


def complete_references(
    canonical_hours: DataFrame, keys: Sequence[str], t: str = "datetime_utc", v: str = "pm25_ug_m3", horizons: int = MAX_HORIZON
) -> DataFrame:
    """Rows (keys, reference_time) of the references that `labelled_references` keeps, without their features.

    Split bounds, counts and purge need no more than this, one row an hour.
    """
    hours = canonical_hours.select(*keys, t, v, _all_present(WEATHER).alias("_weather")).withColumn("_ok", F.col("_weather") & F.col(v).isNotNull())
    history = history_columns(hour_window(keys), v)
    near = halo(hours, keys, t, back=max(LAGS), ahead=horizons).withColumns({**history, **_ahead(keys, {"_valid": "_ok"}, horizons)})
    whole = F.col("_home") & F.col("_ok") & (F.col("_valid") == horizons) & _all_present(list(history))
    return near.filter(whole).select(*keys, F.col(t).alias("reference_time"))


def complete_training_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] = MODEL_FEATURES, horizons: int = MAX_HORIZON
) -> DataFrame:
    """Rows without missing feature or label, of references that keep all their horizons.

    Rows whose target does not follow the reference are refused (leakage).
    """
    if TARGET in columns:
        raise ValueError("the target is among the features")
    good = df.filter(_all_present([*columns, TARGET]) & (F.col("target_time") > F.col("reference_time")))
    on = [*keys, "reference_time"]
    full = good.groupBy(*on).agg(F.count_distinct("forecast_horizon_hours").alias("_h")).filter(F.col("_h") == horizons)
    return good.join(full.select(*on), on, "left_semi").select(
        *keys, "reference_time", "target_time", *columns, TARGET
    )


def labelled_references(
    canonical_hours: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    horizons: int = MAX_HORIZON,
) -> DataFrame:
    """One row per complete reference hour: its features and the packed list of its target hours.

    One window over (key, time bucket) yields both. Split bounds, counts and
    anything else about references should be computed here, before the expansion.
    """
    w = hour_window(keys)
    hours = _with_target_columns(canonical_hours, t)
    target = F.struct(F.col(HOUR).alias("_th"), F.col(v).alias(TARGET), *TARGET_FEATURES)
    usable = _all_present([v, *TARGET_FEATURES])
    near = halo(hours, keys, t, back=max(LAGS), ahead=horizons).withColumns(
        {**history_columns(w, v), "_targets": F.collect_list(F.when(usable, target)).over(w.rangeBetween(1, horizons))}
    )
    out = own_rows(near.filter("_home").filter(F.size("_targets") == horizons))
    out = out.withColumn("pm25_current", F.col(v)).withColumn("reference_time", F.col(t))
    out = circular_encode(out, "wind_direction_10m", "wind_direction_10m")
    out = calendar_features(out, "reference_time", "reference_").filter(_all_present(REFERENCE_FEATURES))
    return out.select(*keys, "reference_time", *REFERENCE_FEATURES, "_targets")


def expand_references(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed references -> training rows; a narrow explode that carries any extra columns along."""
    known = [*keys, "reference_time", *REFERENCE_FEATURES, "_targets"]
    return _expanded(packed, keys, F.col("_targets"), [c for c in packed.columns if c not in known])


def _expanded(packed: DataFrame, keys: Sequence[str], targets: Column, extra: Sequence[str] = ()) -> DataFrame:
    out = packed.select(*keys, "reference_time", *REFERENCE_FEATURES, *extra, F.inline(targets))
    return (
        out.withColumn("target_time", F.timestamp_seconds(F.col("_th") * 3600))
        .withColumn("forecast_horizon_hours", (F.col("_th") - hour_index("reference_time")).cast("int"))
        .select(*keys, "reference_time", "target_time", *MODEL_FEATURES, TARGET, *extra)
    )


def training_set(
    canonical_hours: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    horizons: int = MAX_HORIZON,
) -> DataFrame:
    """Canonical hours -> complete labelled rows, expanding after the last shuffle.

    Incomplete references are dropped while they are still one row, and the
    72-fold explode is the final, narrow step: nothing 72 times larger is ever
    shuffled or sorted.
    """
    return expand_references(labelled_references(canonical_hours, keys, t, v, horizons), keys)


def split_training_set(
    canonical_hours: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    horizons: int = MAX_HORIZON,
    purge: bool = True,
) -> DataFrame:
    """Complete, split and purged training rows. Labels and purge work on packed references, bounds on their hours alone."""
    bounds = _known(split_bounds(materialized(complete_references(canonical_hours, keys, t, v, horizons), "complete-references")))
    packed = chronological_split(labelled_references(canonical_hours, keys, t, v, horizons), bounds=bounds)
    return expand_references(purge_references(packed, bounds, horizons) if purge else packed, keys)


def _known(bounds: DataFrame) -> DataFrame:
    """The one row of bounds, found once, as constants: every use of a scalar subquery would find it again."""
    row = bounds.first()
    return bounds.sparkSession.range(1).select(*[F.lit(row[c]).cast("timestamp").alias(c) for c in bounds.columns])


def split_references(
    canonical_hours: DataFrame,
    keys: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    horizons: int = MAX_HORIZON,
    purge: bool = True,
) -> DataFrame:
    """Rows (keys, reference_time, split) of the complete references, purged on request: what counts and reports need.

    The references are written once, since both bounds and the result read them.
    """
    hours = materialized(complete_references(canonical_hours, keys, t, v, horizons), "complete-references")
    bounds = _known(split_bounds(hours))
    split = chronological_split(hours, bounds=bounds)
    return purge_references(split, bounds, horizons) if purge else split


def purge_references(packed: DataFrame, bounds: DataFrame, horizons: int = MAX_HORIZON) -> DataFrame:
    """Reference purge on packed rows, whose last target is the reference plus the horizon."""
    return purge_split(packed, horizons=horizons, bounds=bounds)


def describe_references(references: DataFrame, horizons: int = MAX_HORIZON) -> DataFrame:
    """Rows, reference hours and time ranges per split of complete references, which have every horizon."""
    per_hour = references.groupBy("split", "reference_time").agg(F.count("*").alias("_n"))
    return per_hour.groupBy("split").agg(
        (F.sum("_n") * horizons).alias("row_count"),
        F.count("*").alias("reference_count"),
        F.min("reference_time").alias("reference_start"),
        F.max("reference_time").alias("reference_end"),
        plus_hours(F.min("reference_time"), 1).alias("target_start"),
        plus_hours(F.max("reference_time"), horizons).alias("target_end"),
    )


def reference_coverage(references: DataFrame, horizons: int = MAX_HORIZON) -> DataFrame:
    """Rows per horizon and split of complete references; no rows without any."""
    splits = ("train", "validation", "test")
    counts = references.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in splits])
    some = counts.filter(" + ".join(f"{s}_rows" for s in splits) + " > 0")
    return some.select(F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("forecast_horizon_hours"), *[f"{s}_rows" for s in splits])


def _with_target_columns(hours: DataFrame, t: str) -> DataFrame:
    """Target-side weather and calendar, computed once per hour instead of once per horizon."""
    out = hours.withColumns({f"target_{c}": F.col(c).cast("double") for c in WEATHER})
    out = circular_encode(out, "target_wind_direction_10m", "target_wind_direction_10m")
    return calendar_features(out, t, "target_")


def rejection_report(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] = MODEL_FEATURES, horizons: int = MAX_HORIZON
) -> DataFrame:
    """Rows with a missing feature, a missing label, and valid rows lost with a partial reference."""
    valid = _all_present([*columns, TARGET])
    per_reference = df.groupBy(*keys, "reference_time").agg(
        F.count("*").alias("_rows"),
        F.count_if(~_all_present(columns)).alias("_feature"),
        F.count_if(F.col(TARGET).isNull()).alias("_target"),
        F.count_if(valid).alias("_valid"),
        F.count_distinct(F.when(valid, F.col("forecast_horizon_hours"))).alias("_h"),
    )
    partial = F.when(F.col("_h") == horizons, F.col("_valid") - horizons).otherwise(F.col("_valid"))
    return per_reference.groupBy(*keys).agg(
        F.sum("_rows").alias("candidate_rows"),
        F.sum("_feature").alias("missing_feature_rows"),
        F.sum("_target").alias("missing_target_rows"),
        F.sum(partial).alias("partial_reference_rows_removed"),
        F.sum(F.when(F.col("_h") == horizons, F.lit(horizons)).otherwise(0)).alias("final_rows"),
    )


def split_bounds(df: DataFrame, t: str = "reference_time", ratios: Sequence[float] = RATIOS) -> DataFrame:
    """One row with the first validation and first test reference hour.

    Splits are cut on *distinct* hours. They are numbered bucket by bucket, which
    also yields their count, and only the two boundary rows are kept.
    """
    ranked = numbered_hours(df.select(F.col(t).alias("_t")).distinct(), [], "_t", total="_total")
    train = F.floor(F.col("_total") * F.lit(float(ratios[0])))
    validation = F.floor(F.col("_total") * F.lit(float(ratios[1])))
    return ranked.agg(
        F.min(F.when(F.col("_number") == train + 1, F.col("_t"))).alias("validation_start"),
        F.min(F.when(F.col("_number") == train + validation + 1, F.col("_t"))).alias("test_start"),
    )


def chronological_split(
    df: DataFrame, t: str = "reference_time", ratios: Sequence[float] = RATIOS, bounds: DataFrame | None = None
) -> DataFrame:
    """Label rows train / validation / test; the two bounds enter as scalar subqueries, so nothing is joined."""
    bounds = split_bounds(df, t, ratios) if bounds is None else bounds
    return df.withColumn(
        "split",
        F.when(F.col(t) < bounds.select("validation_start").scalar(), F.lit("train"))
        .when(F.col(t) < bounds.select("test_start").scalar(), F.lit("validation"))
        .otherwise(F.lit("test")),
    )


def purge_split(
    df: DataFrame,
    mode: str = "reference",
    horizons: int | None = None,
    bounds: DataFrame | None = None,
    reference: str = "reference_time",
    target: str = "target_time",
) -> DataFrame:
    """Drop rows whose labels reach into the next split.

    'reference' drops a reference hour whose last target reaches it, 'row' only
    the rows that do. With `horizons` every reference is known to be complete, so
    its last target is arithmetic; otherwise it is aggregated per reference hour.
    """
    if bounds is None:
        bounds = df.agg(
            F.min(F.when(F.col("split") == "validation", F.col(reference))).alias("validation_start"),
            F.min(F.when(F.col("split") == "test", F.col(reference))).alias("test_start"),
        )
    if mode == "row":
        last = F.col(target)
        work = df
    elif horizons is not None:
        last = plus_hours(reference, horizons)
        work = df
    else:
        ends = df.groupBy(reference).agg(F.max(target).alias("_last"))
        work = df.join(ends, [reference])
        last = F.col("_last")
    keep = (
        (F.col("split") == "test")
        | ((F.col("split") == "train") & (last < bounds.select("validation_start").scalar()))
        | ((F.col("split") == "validation") & (last < bounds.select("test_start").scalar()))
    )
    return work.filter(keep).select(*df.columns)


def describe_split(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, reference hours and time ranges per split."""
    per_hour = df.groupBy(*keys, "split", "reference_time").agg(
        F.count("*").alias("_n"), F.min("target_time").alias("_min"), F.max("target_time").alias("_max")
    )
    return per_hour.groupBy(*keys, "split").agg(
        F.sum("_n").alias("row_count"),
        F.count("*").alias("reference_count"),
        F.min("reference_time").alias("reference_start"),
        F.max("reference_time").alias("reference_end"),
        F.min("_min").alias("target_start"),
        F.max("_max").alias("target_end"),
    )


def horizon_coverage(df: DataFrame) -> DataFrame:
    """Rows per horizon and split."""
    return df.groupBy("forecast_horizon_hours").agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "test")]
    )


def retraining_eligibility(
    df: DataFrame,
    keys: Sequence[str],
    trained_until: DataFrame,
    min_hours: int = MIN_NEW_HOURS,
    force: bool = False,
) -> DataFrame:
    """Per key: are there enough labelled reference hours after the last consumed one?

    `trained_until` holds (keys, production_training_end); null or absent means
    unknown. A forced run reports 0 new hours.
    """
    hours = df.select(*keys, "reference_time").distinct()
    end = trained_until.select(*keys, F.date_trunc("hour", "production_training_end").alias("production_training_end"))
    counted = attach_per_key(hours, end, keys, "reference_time", "left").groupBy(*keys, "production_training_end").agg(
        F.max("reference_time").alias("latest_reference_time"),
        F.count_if(F.col("reference_time") > F.col("production_training_end")).alias("_new"),
    )
    known = F.col("production_training_end").isNotNull()
    enough = F.col("_new") >= min_hours
    reason = (
        F.when(F.lit(force), F.lit("Retraining was explicitly forced."))
        .when(~known, F.lit("Production metadata does not contain a usable training-end timestamp."))
        .when(enough, F.lit("Enough new labeled reference hours exist."))
        .otherwise(F.lit("Not enough new labeled reference hours are available."))
    )
    return counted.select(
        *keys,
        (F.lit(force) | (known & enough)).alias("eligible"),
        F.lit(force).alias("forced"),
        "latest_reference_time",
        "production_training_end",
        F.when(F.lit(force) | ~known, F.lit(0)).otherwise(F.col("_new")).cast("bigint").alias("new_labeled_hours"),
        F.lit(min_hours).alias("minimum_required_hours"),
        reason.alias("reason"),
    )


def training_frame_checks(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Missing columns, duplicate keys, null features and null targets per split."""
    missing = [c for c in (*columns, TARGET, "reference_time", "forecast_horizon_hours") if c not in df.columns]
    present = [c for c in columns if c in df.columns]
    nulls = sum((F.col(c).isNull().cast("int") for c in present), F.lit(0))
    per_key = df.groupBy(*keys, "split", "reference_time", "forecast_horizon_hours").agg(
        F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"), F.count_if(F.col(TARGET).isNull()).alias("_targets")
    )
    return per_key.groupBy("split").agg(
        F.sum("_n").alias("row_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_keys"),
        F.sum("_nulls").alias("missing_feature_values"),
        F.sum("_targets").alias("missing_targets"),
    ).withColumn("missing_columns", F.lit(", ".join(missing)))


def top_k(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The n largest rows: per-partition heaps, then one merge of n rows each."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(n)
