"""Scores, reasons, recommendations and the records built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import flag, logistic, ratio, severity_band, true_reasons

# --- fixed values: texts that appear in results -------------------------------
CURRENT_ABOVE = "Current value is unusually above the batch norm"
CURRENT_BELOW = "Current value is unusually below the batch norm"
DRIFT_FASTER = "Drift is unusually faster than comparable components"
DRIFT_SLOWER = "Drift is unusually slower than comparable components"
NEAR_LIMIT = "Current value has used at least 80% of the safety limit"
ACCELERATING = "The rate of change is accelerating"
UNUSUAL_MIX = "The combination of early measurements is unusual"
AT_LIMIT = "The current measurement has crossed the approved limit"
PREDICTED_CROSSING = "The predicted final value crosses the approved limit"
POSSIBLE_CROSSING = "The prediction range includes a possible limit crossing"
WEAK_PEERS = "Fewer than eight comparable peers; batch comparison is weak"
EXTRAPOLATES = (
    "Forecast extrapolates beyond observed training conditions; validation and interval coverage do not transfer"
)
WARNING_TEXTS = {
    "UNSCORED_RECORDS_PRESENT": "Some histories could not be screened and are listed in unscored_records. "
    "They have not passed; they were not assessed. decision_counts covers scored records only.",
    "PROVISIONAL_RECOMMENDATIONS": "Some recommendations were made without a 168 h forecast and are marked "
    "provisional. They rest on early-window anomaly evidence alone.",
    "FORECAST_EXTRAPOLATES": "Some components have inputs beyond the ranges seen in training. Their forecasts "
    "extrapolate and the interval coverage does not transfer.",
    "SYNTHETIC_DATA": "The uploaded file is marked synthetic. This is not measured hardware data.",
    "UNKNOWN_PROVENANCE": "The file declares no data_source, so its provenance is unknown. Unknown is not the "
    "same as verified measured data.",
}
# --- end of fixed values --------------------------------------------------------


def apply_robust_baseline(features: DataFrame, *, threshold: float | Column = S.ROBUST_THRESHOLD) -> DataFrame:
    """Deviation = larger |z| of level and drift; flag at the threshold, logistic score around it."""
    missing = {"current_batch_robust_z", "slope_batch_robust_z"} - set(features.columns)
    if missing:
        raise ValueError(f"missing robust feature columns: {', '.join(sorted(missing))}")
    deviation = F.greatest(F.abs("current_batch_robust_z"), F.abs("slope_batch_robust_z"))
    return features.withColumn("robust_deviation_score", deviation).withColumns(
        {
            "robust_anomaly_score": logistic(F.col("robust_deviation_score"), threshold),
            "is_robust_anomaly": F.col("robust_deviation_score") >= threshold,
        }
    )


def combine_scores(scored: DataFrame) -> DataFrame:
    """Either rule may flag; the stronger score ranks. Without a model the robust rule stands alone."""
    if "model_anomaly_score" not in scored.columns:
        scored = scored.withColumns(
            {"model_anomaly_score": F.lit(None).cast("double"), "is_model_anomaly": F.lit(False)}
        )
    scored = scored.withColumns(
        {
            "anomaly_score": F.greatest("robust_anomaly_score", "model_anomaly_score"),
            "is_anomaly": F.col("is_robust_anomaly") | flag("is_model_anomaly"),
        }
    )
    return scored.withColumn("reason_codes", reason_codes())


def reason_codes() -> Column:
    current, slope = F.col("current_batch_robust_z"), F.col("slope_batch_robust_z")
    found = true_reasons(
        [
            (current >= 3.5, CURRENT_ABOVE),
            (current <= -3.5, CURRENT_BELOW),
            (slope >= 3.5, DRIFT_FASTER),
            (slope <= -3.5, DRIFT_SLOWER),
            (F.col("limit_fraction") >= 0.8, NEAR_LIMIT),
            (F.col("acceleration") > 0, ACCELERATING),
        ]
    )
    return F.when((F.size(found) == 0) & F.col("is_anomaly"), F.array(F.lit(UNUSUAL_MIX))).otherwise(found)


def with_recommendation(scored: DataFrame) -> DataFrame:
    """Add ``recommendation`` and ``recommendation_reasons``.

    Forecast columns (predicted_final_value, prediction_lower, prediction_upper)
    and data_quality_warning are optional; NULL or absent means "not available".
    """
    have = set(scored.columns)
    value = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    limit = F.col("upper_limit")
    warning = value("data_quality_warning", "string")
    warned = F.coalesce(warning, F.lit("")) != ""
    crossed = F.coalesce(F.col("current_value") >= limit, F.lit(False))
    predicted = F.coalesce(value("predicted_final_value", "double") >= limit, F.lit(False))
    surely = F.coalesce(value("prediction_lower", "double") >= limit, F.lit(False))
    possible = F.coalesce(value("prediction_upper", "double") >= limit, F.lit(False))
    anomalous = flag("is_anomaly")
    action = (
        F.when(warned, "RETEST")
        .when(crossed, "ENGINEER_REVIEW")
        .when(anomalous & (predicted | surely), "ENGINEER_REVIEW")
        .when((F.col("anomaly_score") >= 0.8) | predicted, "RETEST")
        .when(anomalous | possible, "MONITOR")
        .otherwise("ACCEPT")
    )
    open_case = ~warned & ~crossed
    extra = true_reasons(
        [
            (warned, warning),
            (~warned & crossed, AT_LIMIT),
            (open_case & predicted, PREDICTED_CROSSING),
            (open_case & possible, POSSIBLE_CROSSING),
        ]
    )
    return scored.withColumns(
        {"recommendation": action, "recommendation_reasons": F.concat(F.col("reason_codes"), extra)}
    )


def provisional_recommendation(scored: DataFrame) -> DataFrame:
    """Fallback without a forecast: needs ``is_anomaly`` and ``headroom_fraction``."""
    near = F.coalesce(F.col("headroom_fraction") <= 0.1, F.lit(False))
    return scored.withColumns(
        {
            "recommendation": F.when(~flag("is_anomaly"), "ACCEPT")
            .when(near, "ENGINEER_REVIEW")
            .otherwise("MONITOR"),
            "provisional": F.lit(True),
            "recommendation_basis": F.lit("anomaly_only"),
        }
    )


def limit_info(df: DataFrame) -> DataFrame:
    """Applicable limit, headroom and its fraction, by ``limit_direction``."""
    have = set(df.columns)
    lower = F.col("lower_limit") if "lower_limit" in have else F.lit(None).cast("double")
    low_side = F.col("limit_direction") == "lower" if "limit_direction" in have else F.lit(False)
    applicable = F.when(low_side, lower).otherwise(F.col("upper_limit"))
    sign = F.when(low_side, -1.0).otherwise(1.0)
    df = df.withColumn("applicable_limit", applicable)
    df = df.withColumn("headroom", sign * (F.col("applicable_limit") - F.col("current_value")))
    return df.withColumn(
        "headroom_fraction",
        F.when(F.col("applicable_limit") != 0, F.col("headroom") / F.abs("applicable_limit")),
    )


def predicted_to_cross(df: DataFrame) -> DataFrame:
    """Strictly beyond the applicable limit; NULL when the limit is unknown."""
    low_side = F.col("limit_direction") == "lower" if "limit_direction" in df.columns else F.lit(False)
    predicted, limit = F.col("predicted_final_value"), F.col("applicable_limit")
    return df.withColumn(
        "predicted_to_cross_limit", F.when(low_side, predicted < limit).otherwise(predicted > limit)
    )


def outside_ranges(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Names of the inputs outside the training range, and the readiness state.

    ``bounds`` has one entry per condition column, so it is a handful of literals.
    """
    outside = true_reasons([(~F.col(c).between(lo, hi), c) for c, (lo, hi) in bounds.items()])
    missing = F.col("missing_optional_features") if "missing_optional_features" in df.columns else F.array()
    df = df.withColumn("out_of_training_range_features", outside)
    out = F.size("out_of_training_range_features") > 0
    return df.withColumns(
        {
            "prediction_readiness": F.when(out, "outside_training_conditions")
            .when(F.size(missing) > 0, "optional_inputs_imputed")
            .otherwise("ready"),
            "prediction_readiness_warning": F.when(out, EXTRAPOLATES),
        }
    )


def extrapolation_report(df: DataFrame, bounds: dict[str, tuple[float, float]], carry: Sequence[str] = ()) -> DataFrame:
    """One row per component and feature outside its range, with the verdict."""
    names = list(bounds)
    tall = df.select(
        "component_id",
        "batch_id",
        *carry,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(c).cast("double").alias("parsed_value"),
                        F.lit(float(bounds[c][0])).alias("training_min"),
                        F.lit(float(bounds[c][1])).alias("training_max"),
                    )
                    for c in names
                ]
            )
        ).alias("x"),
    ).select("component_id", "batch_id", *carry, "x.*")
    value, lo, hi = F.col("parsed_value"), F.col("training_min"), F.col("training_max")
    # Fixed texts.
    verdict = (
        F.when(value.isNull(), "value not in upload (imputed) or no declared bound")
        .when(value < lo, "below training minimum")
        .when(value > hi, "above training maximum")
    )
    return tall.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull()).withColumn(
        "amount", F.when(value < lo, lo - value).when(value > hi, value - hi)
    )


def extrapolation_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("feature", "verdict").agg(F.count(F.lit(1)).alias("flags"))


def urgency(c: str | Column = "recommendation") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("int")
    for name, level in S.URGENCY.items():
        out = F.when(c == name, level).otherwise(out)
    return out


def by_urgency(records: DataFrame) -> DataFrame:
    return records.orderBy(urgency().desc(), "component_id", "measurement_name")


def decision_counts(records: DataFrame) -> DataFrame:
    """One row: scored records per recommendation."""
    return records.agg(*[F.count_if(F.col("recommendation") == r).alias(r) for r in S.URGENCY])


def decision_counts_with_unscored(records: DataFrame, unscored: DataFrame) -> DataFrame:
    """Counts where an unscored history counts as RETEST."""
    both = records.select("recommendation", F.lit("scored").alias("status")).unionByName(
        unscored.select(F.lit("RETEST").alias("recommendation"), F.lit("unscored").alias("status"))
    )
    return both.groupBy("recommendation").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "unscored").alias("unscored")
    )


def summary(records: DataFrame, unscored: DataFrame) -> DataFrame:
    """Component, scored, unscored and within-limit-but-anomalous counts in one row."""
    unusual = flag("is_anomaly") & (F.col("current_value") < F.col("upper_limit"))
    both = records.select(F.lit(1).alias("s"), F.lit(0).alias("u"), unusual.cast("int").alias("w")).unionByName(
        unscored.select(F.lit(0).alias("s"), F.lit(1).alias("u"), F.lit(0).alias("w"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        F.count(F.lit(1)).alias("component_count"),
        total("s").alias("scored_count"),
        total("u").alias("unscored_count"),
        total("w").alias("within_limit_but_anomalous"),
    )


def component_summary(records: DataFrame, unscored: DataFrame) -> DataFrame:
    """Most urgent scored recommendation per component and its measurement coverage.

    The name list holds distinct measurement names, which a catalogue bounds.
    """
    keys = ["component_id", "batch_id", "component_family"]
    both = records.select(*keys, "measurement_name", "recommendation").unionByName(
        unscored.select(*keys, "measurement_name", F.lit(None).cast("string").alias("recommendation"))
    )
    level = F.max(urgency())
    name = F.lit(None).cast("string")
    for text, number in S.URGENCY.items():
        name = F.when(level == number, text).otherwise(name)
    return both.groupBy(*keys).agg(
        name.alias("summary_recommendation"),
        F.count("recommendation").alias("scored_measurement_count"),
        F.count_if(F.col("recommendation").isNull()).alias("unscored_measurement_count"),
        (F.count_if(F.col("recommendation").isNull()) > 0).alias("partial_coverage"),
        F.array_sort(F.collect_set("measurement_name")).alias("measurement_names"),
    )


def batch_overview(tagged: DataFrame) -> DataFrame:
    """Per batch: components, share not accepted, compound mechanisms, actions."""
    r = F.col("recommendation")
    return tagged.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.avg((r != "ACCEPT").cast("double")).alias("anomaly_rate"),
        F.count_if("is_compound").alias("compound_count"),
        *[F.count_if(r == name).alias(f"n_{name.lower()}") for name in S.URGENCY],
    )


def mechanism_tags(df: DataFrame) -> DataFrame:
    """Which mechanisms a record shows; compound when two or more do."""
    crosses = F.coalesce(F.col("predicted_final_value") >= F.col("upper_limit"), F.lit(False))
    rapid = (F.coalesce(F.col("slope"), F.lit(0.0)) >= 0.0025) | (
        F.coalesce(F.col("percent_change"), F.lit(0.0)) >= 45
    )
    outlier = F.abs(F.coalesce(F.col("current_batch_robust_z"), F.lit(0.0))) >= 2.0
    latent = flag("is_anomaly") & (F.col("current_value") < F.col("upper_limit")) & ~crosses
    tags = true_reasons(
        [(crosses, "HUB_LIMIT"), (rapid, "HUB_DRIFT"), (outlier, "HUB_OUTLIER"), (latent, "HUB_LATENT")]
    )
    df = df.withColumn("_tags", tags)
    return df.withColumns(
        {
            "mechanisms": F.when(F.size("_tags") == 0, F.array(F.lit("HUB_NOMINAL"))).otherwise(F.col("_tags")),
            "is_compound": F.size("_tags") >= 2,
        }
    ).drop("_tags")


def mechanism_counts(tagged: DataFrame) -> DataFrame:
    return (
        tagged.select(F.explode("mechanisms").alias("mechanism"), "recommendation")
        .groupBy("mechanism")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("recommendation") != "ACCEPT").alias("flagged"),
        )
    )


def display_enrichment(records: DataFrame, outcomes: DataFrame, *, target_hour: float = S.TARGET_HOUR) -> DataFrame:
    """Attach observed later values: trajectory, value at the target hour, crossing.

    A trajectory has one point per observed hour of its history, so repeated
    observations are merged before the points are listed.
    """
    keys = ["component_id", "measurement_name"]
    at_target = lambda c: F.max(F.when(F.col("observed_hour") == target_hour, F.col(c)))
    points = outcomes.groupBy(*keys, "observed_hour").agg(
        F.max("observed_value").alias("observed_value"),
        F.bool_or("crossed_applicable_limit").alias("crossed_applicable_limit"),
    )
    later = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("observed_hour").alias("hour"), F.col("observed_value").alias("value")))).alias(
            "outcome_trajectory"
        ),
        at_target("observed_value").alias("observed_at_target"),
        at_target("crossed_applicable_limit").alias("crossed_at_target"),
    )
    return records.join(later, keys, "left").withColumn(
        "within_limit_but_unusual",
        F.coalesce((F.col("current_value") < F.col("upper_limit")) & flag("is_anomaly"), F.lit(False)),
    )


def outcome_records(outcomes: DataFrame, early: DataFrame) -> DataFrame:
    """Later readings against the limit of the early table; unknown limit keeps the verdict NULL."""
    limits = early.groupBy(*S.KEY4).agg(F.max("upper_limit").alias("applicable_limit"))
    return outcomes.join(limits, S.KEY4, "left").select(
        *S.KEY4,
        F.col("measurement_value").alias("observed_value"),
        F.col("hours").alias("observed_hour"),
        "applicable_limit",
        F.when(F.col("applicable_limit").isNotNull(), F.col("measurement_value") > F.col("applicable_limit")).alias(
            "crossed_applicable_limit"
        ),
    )


def search(records: DataFrame, term: str = "", quick: str = "ALL", sort_by: str = "component_id", ascending: bool = True) -> DataFrame:
    """Free-text search over ids, one quick filter, one sort field."""
    if term:
        needle = term.lower()
        cols = [c for c in ("component_id", "batch_id", "profile_id") if c in records.columns]
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
        records = records.filter(hit)
    if quick in S.URGENCY:
        records = records.filter(F.col("recommendation") == quick)
    elif quick == "UNUSUAL":
        records = records.filter(flag("within_limit_but_unusual"))
    elif quick == "ANOMALY":
        records = records.filter(flag("is_anomaly"))
    elif quick == "CROSSING":
        records = records.filter(flag("predicted_to_cross_limit"))
    key = F.col(sort_by)
    return records.orderBy(key.asc() if ascending else key.desc(), "component_id", "measurement_name")


def decision_quota(records: DataFrame, quota: dict[str, int]) -> DataFrame:
    """First n records per decision; Spark bounds the ranking before the shuffle."""
    w = Window.partitionBy("recommendation").orderBy("component_id", "measurement_name")
    wanted = F.lit(0)
    for name, n in quota.items():
        wanted = F.when(F.col("recommendation") == name, n).otherwise(wanted)
    ranked = records.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(quota.values()))
    return ranked.filter(F.col("_r") <= wanted).drop("_r")


def score_ranking(records: DataFrame, n: int) -> DataFrame:
    return records.orderBy(F.col("anomaly_score").desc(), "component_id", "measurement_name").limit(n)


def response_warnings(records: DataFrame, unscored: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row per warning that applies, with its count."""
    have = set(records.columns)
    provisional = flag("provisional") if "provisional" in have else F.lit(False)
    extrapolating = (
        F.size("out_of_training_range_features") > 0
        if "out_of_training_range_features" in have
        else F.lit(False)
    )
    both = records.select(
        F.lit(0).alias("u"), provisional.cast("int").alias("p"), extrapolating.cast("int").alias("x")
    ).unionByName(unscored.select(F.lit(1).alias("u"), F.lit(0).alias("p"), F.lit(0).alias("x")))
    counts = both.agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("x").alias("x"))
    codes = [("UNSCORED_RECORDS_PRESENT", "u"), ("PROVISIONAL_RECOMMENDATIONS", "p"), ("FORECAST_EXTRAPOLATES", "x")]
    rows = counts.select(
        F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(c).cast("bigint").alias("count")) for code, c in codes])).alias("w")
    ).select("w.*").filter(F.col("count") > 0)
    if provenance is not None:
        kind = F.col("provenance")
        about = provenance.select(
            F.when(kind.isin("synthetic", "mixed"), "SYNTHETIC_DATA").when(kind == "unknown", "UNKNOWN_PROVENANCE").alias("code"),
            F.lit(None).cast("bigint").alias("count"),
        ).filter(F.col("code").isNotNull())
        rows = rows.unionByName(about)
    message = F.create_map(*[F.lit(x) for pair in WARNING_TEXTS.items() for x in pair])
    return rows.withColumn("message", message[F.col("code")])


def screening_record(df: DataFrame) -> DataFrame:
    """Nested response record: one struct per kind of evidence, context as a string map."""
    have = set(df.columns)
    pick = lambda c, kind="double": (F.col(c) if c in have else F.lit(None).cast(kind)).alias(c)
    context = [c for c in S.OPTIONAL_TEXT + ["temperature_c", "humidity_pct", "tester_channel", "profile_id"] if c in have]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in context])
    return df.select(
        *S.KEY4,
        "as_of_hour",
        "initial_value",
        F.col("current_value").alias("latest_value"),
        F.col("delta").alias("absolute_change"),
        F.when(F.col("initial_value") != 0, F.col("percent_change")).alias("percent_change"),
        F.col("slope").alias("slope_per_hour"),
        F.struct(pick("upper_limit"), pick("applicable_limit"), pick("headroom"), pick("headroom_fraction")).alias("limits"),
        F.struct(
            F.col("anomaly_score").alias("score"),
            "is_anomaly",
            "robust_deviation_score",
            pick("model_anomaly_score"),
            F.lit("ranking score, not failure probability").alias("kind"),
        ).alias("anomaly"),
        F.struct(
            pick("peer_count", "bigint"),
            pick("current_batch_robust_z"),
            pick("slope_batch_robust_z"),
            F.when(pick("peer_count", "bigint") < S.MIN_PEERS, WEAK_PEERS).alias("warning"),
        ).alias("peers"),
        F.struct(
            pick("predicted_final_value"),
            pick("prediction_lower"),
            pick("prediction_upper"),
            F.lit(S.TARGET_HOUR).alias("target_hour"),
            pick("predicted_to_cross_limit", "boolean"),
        ).alias("forecast"),
        "reason_codes",
        "recommendation",
        "recommendation_reasons",
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("context")
        if context
        else F.create_map().cast("map<string,string>").alias("context"),
    )


def severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", severity_band(F.col("limit_fraction")))


def share_of_total(df: DataFrame, keys: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Group counts with their share of all rows; the window sees one row per group."""
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (extra or {}).items()]
    )
    return counted.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))
