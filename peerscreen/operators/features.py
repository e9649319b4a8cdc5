"""Early-window features: one row per component measurement history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import as_number, finite, percent_change, ratio, refuse_null
from peerscreen.operators import ordering, peers

GRID_LIMIT = 32
CONTEXT_COLUMNS = ["temperature_c", "humidity_pct", "test_condition", "data_source"]


def as_of(readings: DataFrame, as_of_hour: float | Sequence[float]) -> DataFrame:
    """Readings at or before the cutoff, tagged with it.

    A list of cutoffs answers a whole ladder in one job: every reading is
    repeated once per cutoff it precedes (the list is a literal, so bounded).
    """
    if isinstance(as_of_hour, (int, float)):
        if as_of_hour < 0:
            raise ValueError("as_of_hour cannot be negative")
        early = readings.filter(F.col("hours") <= float(as_of_hour))
        return early.withColumn("as_of_hour", F.lit(float(as_of_hour)))
    hours = F.array(*[F.lit(float(h)) for h in sorted(as_of_hour)])
    return readings.withColumn(
        "as_of_hour", F.explode(F.filter(hours, lambda h: F.col("hours") <= h))
    )


def checkpoint_grid(readings: DataFrame) -> list[float] | None:
    """The distinct reading hours if there are few of them, else None."""
    rows = readings.select("hours").distinct().limit(GRID_LIMIT + 1).collect()
    hours = sorted(r.hours for r in rows if r.hours is not None)
    return hours if len(rows) <= GRID_LIMIT else None


def _bend(t1, t2, tm, tn) -> F.Column:
    """(last-pair slope - first-pair slope) / span; arguments are (hour, value) column pairs."""
    early_dt, late_dt = t2[0] - t1[0], tn[0] - tm[0]
    change = (tn[1] - tm[1]) / late_dt - (t2[1] - t1[1]) / early_dt
    return F.when((early_dt > 0) & (late_dt > 0), change / (tn[0] - t1[0]))


def acceleration(early: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Acceleration when the hours follow no small grid; of repeated hours the largest value counts.

    Only the two first and two last readings matter. Ranking with a bound of two
    lets Spark drop the rest on the map side, so no history is ever collected.
    """
    keys = list(keys)

    early = early.groupBy(*keys, "hours").agg(F.max("measurement_value").alias("measurement_value"))

    def edge(order, a, b):
        w = Window.partitionBy(*keys).orderBy(order)
        top = early.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
        pick = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
        return top.groupBy(*keys).agg(
            pick("hours", 1).alias(f"{a}h"),
            pick("measurement_value", 1).alias(f"{a}v"),
            pick("hours", 2).alias(f"{b}h"),
            pick("measurement_value", 2).alias(f"{b}v"),
        )

    first = edge(F.col("hours").asc(), "_t1", "_t2")
    last = edge(F.col("hours").desc(), "_tn", "_tm")
    pair = lambda name: (F.col(f"{name}h"), F.col(f"{name}v"))
    bend = _bend(pair("_t1"), pair("_t2"), pair("_tm"), pair("_tn"))
    return ordering.null_safe_join(first, last, keys, "inner").select(*keys, bend.alias("_bend"))


def history_features(
    readings: DataFrame,
    as_of_hour: float | Sequence[float] = S.AS_OF_HOUR,
    *,
    minimum_observations: int = 2,
    grid: Sequence[float] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Level, change, slope and spread of every history up to the cutoff.

    ``grid`` lists every hour that occurs in the readings. With it the value at
    each checkpoint is one more bounded aggregate and the whole row comes from a
    single aggregation; without it the acceleration takes two ranking passes.
    ``carry`` names further columns whose last value rides along.
    """
    if minimum_observations < 1:
        raise ValueError("minimum_observations must be at least one")
    early = as_of(readings, as_of_hour)
    keys = ["as_of_hour", *S.KEY4]
    value, hours = F.col("measurement_value"), F.col("hours")
    context = [c for c in CONTEXT_COLUMNS if c in readings.columns] + list(carry)
    last_cutoff = as_of_hour if isinstance(as_of_hour, (int, float)) else max(as_of_hour)
    used = [h for h in grid if h <= last_cutoff] if grid is not None else []
    at_hour = {f"_v{i}": F.max(F.when(hours == h, value)) for i, h in enumerate(used)} if len(used) > 2 else {}
    base = early.groupBy(*keys).agg(
        F.max(hours).alias("last_observed_hour"),
        F.count(F.lit(1)).cast("int").alias("n_observations"),
        F.min_by(value, hours).alias("initial_value"),
        F.max_by(value, hours).alias("current_value"),
        F.regr_slope(value, hours).alias("slope"),
        F.stddev_pop(value).alias("variability"),
        F.max_by("upper_limit", hours).alias("upper_limit"),
        *[F.max_by(c, hours).alias(c) for c in context],
        *[agg.alias(name) for name, agg in at_hour.items()],
        *([F.bool_or(~hours.isin(*[float(h) for h in grid])).alias("_off_grid")] if grid is not None else []),
    ).filter(F.col("n_observations") >= minimum_observations)
    base = base.withColumn("slope", F.coalesce(finite("slope"), F.lit(0.0)))
    if grid is None:
        base = ordering.null_safe_join(base, acceleration(early, keys), keys)
        bend = F.col("_bend")
    elif at_hour:
        points = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.col(n).alias("v")) for n, h in zip(at_hour, used)])
        base = base.withColumn("_p", F.filter(points, lambda p: p["v"].isNotNull()))
        pair = lambda i: (F.try_element_at("_p", F.lit(i))["h"], F.try_element_at("_p", F.lit(i))["v"])
        bend = _bend(pair(1), pair(2), pair(-2), pair(-1))
    else:
        bend = F.lit(0.0)
    bend = F.when(F.col("n_observations") >= 3, F.coalesce(bend, F.lit(0.0))).otherwise(0.0)
    if grid is not None:
        on_grid = F.when(~F.coalesce("_off_grid", F.lit(False)), True)
        bend = refuse_null(bend, on_grid, "a reading's hour is not in the grid")
    base = base.withColumn("acceleration", bend).drop("_bend", "_p", "_off_grid", *at_hour)
    for c in CONTEXT_COLUMNS:
        if c not in context:
            kind = "double" if c in S.OPTIONAL_NUMERIC else "string"
            base = base.withColumn(c, F.lit(None).cast(kind))
    limit, current, initial = F.col("upper_limit"), F.col("current_value"), F.col("initial_value")
    return base.withColumns(
        {
            "delta": current - initial,
            "percent_change": percent_change(initial, current),
            "delta_fraction_of_limit": ratio(current - initial, limit),
            "slope_fraction_per_hour": ratio(F.col("slope"), limit),
            "acceleration_fraction_per_hour2": ratio(F.col("acceleration"), limit),
            "variability_fraction_of_limit": ratio(F.col("variability"), limit),
            "limit_fraction": ratio(current, limit),
            "initial_fraction_of_limit": ratio(initial, limit),
            "distance_to_upper_limit": limit - current,
            "distance_fraction_to_upper_limit": ratio(limit - current, limit),
        }
    )


def build_component_features(
    readings: DataFrame,
    *,
    as_of_hour: float | Sequence[float] = S.AS_OF_HOUR,
    minimum_observations: int = 2,
    grid: Sequence[float] | None = None,
    carry: Sequence[str] = (),
    hot: bool | None = None,
) -> DataFrame:
    """History features plus robust z of level and drift against batch peers."""
    if hot is None:
        # The readings of a peer group outnumber its histories: a cheap upper
        # bound that touches three columns of the scan.
        hot = ordering.has_hot_group(readings, S.PEER)
    if grid is None:
        grid = checkpoint_grid(readings)
    last_cutoff = as_of_hour if isinstance(as_of_hour, (int, float)) else max(as_of_hour)
    if not hot:
        # One exchange of the raw early rows serves the aggregation per history
        # and the windows per batch, because the history key contains the peer key.
        readings = readings.filter(F.col("hours") <= float(last_cutoff)).repartition(*S.PEER)
    features = history_features(
        readings,
        as_of_hour,
        minimum_observations=minimum_observations,
        grid=grid,
        carry=carry,
    )
    return peers.robust_z(
        features,
        {"current_value": "current_batch_robust_z", "slope": "slope_batch_robust_z"},
        hot=hot,
    )


def capacitor_extras(early: DataFrame) -> DataFrame:
    """Electrical side features of the capacitor profile, NULL where an input is missing.

    Columns the input does not carry are treated as missing.
    """
    present = set(early.columns)
    number = lambda c: finite(c) if c in present else F.lit(None).cast("double")
    last = lambda c: F.max_by(number(c), F.col("hours"))
    first = lambda c: F.min_by(number(c), F.col("hours"))
    got = early.groupBy(*S.KEY4).agg(
        last("nominal_capacitance_nf").alias("_nominal"),
        last("rated_voltage_v").alias("_rated"),
        last("applied_voltage_v").alias("_applied"),
        first("capacitance_nf").alias("_cap0"),
        last("capacitance_nf").alias("_cap1"),
        first("dissipation_factor_pct").alias("initial_dissipation_factor_pct"),
        last("dissipation_factor_pct").alias("current_dissipation_factor_pct"),
        last("measurement_temperature_c").alias("measurement_temperature_c"),
        last("measurement_voltage_v").alias("measurement_voltage_v"),
        last("prior_storage_humidity_pct").alias("prior_storage_humidity_pct"),
    )
    nominal = F.when(F.col("_nominal") > 0, F.col("_nominal"))
    rated = F.when(F.col("_rated") > 0, F.col("_rated"))
    return got.withColumns(
        {
            "voltage_stress_ratio": ratio(F.col("_applied"), rated),
            "initial_capacitance_fraction": ratio(F.col("_cap0"), nominal),
            "current_capacitance_fraction": ratio(F.col("_cap1"), nominal),
            "capacitance_change_fraction": ratio(F.col("_cap1") - F.col("_cap0"), nominal),
            "dissipation_factor_change_pct": F.col("current_dissipation_factor_pct")
            - F.col("initial_dissipation_factor_pct"),
        }
    ).drop("_nominal", "_rated", "_applied", "_cap0", "_cap1")


def feature_matrix(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric feature columns with text and infinities turned into missing; unknown names fail."""
    missing = [c for c in columns if c not in features.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(sorted(missing))}")
    text = {f.name for f in features.schema.fields if f.dataType.typeName() == "string"}
    return features.withColumns({c: as_number(c) if c in text else finite(c) for c in columns})


def missing_list(columns: Sequence[str]):
    """Names of the given columns that are NULL in a row, in order."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))


# --- fixed values: columns that identify a row or tell its outcome -----------
LEAKAGE_COLUMNS = [
    "component_id",
    "batch_id",
    "scenario",
    "scenario_label",
    "will_fail",
    "future_failure",
    "failed",
    "final_value",
    "final_measurement_value",
    "outcome",
    "label",
    "true_label",
    "target",
]
FORBIDDEN_TOKENS = [
    "component_id",
    "batch_id",
    "profile_id",
    "part_number",
    "scenario",
    "final_value",
    "true_final",
    "is_future",
    "is_observed",
    "is_defect",
    "is_healthy",
    "is_tester",
    "onset",
    "ever_latent",
    "tester_id",
    "tester_channel",
    "board_position",
]
# --- end of fixed values -----------------------------------------------------


def strip_leakage_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.casefold() in LEAKAGE_COLUMNS])


def require_clean_feature_names(columns: Sequence[str]) -> None:
    bad = [c for c in columns if any(token in c for token in FORBIDDEN_TOKENS)]
    if bad:
        raise ValueError(f"feature list contains forbidden columns: {', '.join(bad)}")
