"""Screening jobs: readings in, explained recommendations out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from peerscreen import schema as S
from peerscreen.operators import decide, features as feats, forecast, intervals, iforest, ordering, peers, quality


@dataclass
class EarlyTable:
    """Result of the eligibility gate."""

    features: DataFrame
    early: DataFrame
    rejects: DataFrame


def prepare_early_features(
    readings: DataFrame,
    *,
    family: str = "MLCC_X7R",
    measurement: str | None = "leakage_ua",
    strict: bool = True,
    hot: bool | None = None,
) -> EarlyTable:
    """Eligible histories with every forecast feature; the rest with their reasons.

    Structural faults (one id for two devices, a batch that mixes part or test
    types) refuse the input when ``strict``.
    """
    missing = [c for c in S.REQUIRED_COLUMNS if c not in readings.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(sorted(missing))}")
    if strict and not quality.blank_identity(readings).isEmpty():
        raise ValueError("identity columns cannot be blank")
    verdict = quality.eligibility(readings, family=family, measurement=measurement)
    rejects = verdict.filter(F.size("reasons") > 0)
    good = verdict.filter(F.size("reasons") == 0).select(*S.KEY4)
    early = readings.filter(F.col("hours").isin(S.CHECKPOINTS)).join(good, S.KEY4, "left_semi")
    if strict:
        if not quality.shared_component_ids(early, families=False).isEmpty():
            raise ValueError("component_id must identify one device across the upload")
        mixed = quality.mixed_batches(early, [*quality.CONSTANT_COLUMNS, "upper_limit"]).limit(5).collect()
        if mixed:
            raise ValueError("mixed values within a batch: " + ", ".join(sorted({m["column"] for m in mixed})))
    if hot is None:
        hot = ordering.has_hot_group(early, S.PEER)
    carry = [c for c in ("profile_id", "tester_channel") if c in readings.columns]
    table = feats.build_component_features(early, grid=S.CHECKPOINTS, carry=carry, hot=hot)
    extras = feats.capacitor_extras(early)
    return EarlyTable(table.join(extras, S.KEY4), early, rejects)


def augment_features(features: DataFrame, *, hot: bool | None = None) -> DataFrame:
    """Humidity rank inside the batch and leave-one-out channel statistics."""
    if hot is None:
        hot = ordering.has_hot_group(features, S.PEER)
    if "prior_storage_humidity_pct" in features.columns:
        features = peers.percentile_rank(features, "prior_storage_humidity_pct", S.HUMIDITY_RANK, hot=hot)
    else:
        features = features.withColumn(S.HUMIDITY_RANK, F.lit(None).cast("double"))
    if "tester_channel" in features.columns:
        return peers.channel_peers(features, hot=hot)
    return features.withColumns({c: F.lit(None).cast("double") for c in S.CHANNEL_FEATURES})


def score(
    features: DataFrame,
    *,
    detector: iforest.IsolationModel | None = None,
    contamination: float = 0.1,
    robust_threshold: float = S.ROBUST_THRESHOLD,
) -> DataFrame:
    """Anomaly scores and reasons; without a detector the robust rule stands alone."""
    if detector is not None:
        return detector.score(features, contamination=contamination, robust_threshold=robust_threshold)
    return decide.combine_scores(decide.apply_robust_baseline(features, threshold=robust_threshold))


def decide_all(
    scored: DataFrame,
    prediction: Column,
    *,
    radius: float | None = None,
    margins: DataFrame | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    optional: Sequence[str] = (),
) -> DataFrame:
    """Forecast column -> bounds in units -> recommendation with reasons and readiness."""
    df = scored.withColumn("forecast", prediction)
    if margins is not None:
        df = intervals.apply_margins(df, margins, "forecast")
    elif radius is not None:
        r = F.lit(float(radius))
        df = df.withColumns(
            {"lower": F.greatest(F.col("forecast") - r, F.lit(0.0)), "upper": F.col("forecast") + r}
        )
    else:  # not calibrated
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("lower", "upper")})
    df = forecast.in_units(df)
    if optional:
        df = df.withColumn("missing_optional_features", feats.missing_list(optional))
    if bounds is not None:
        df = decide.outside_ranges(df, bounds)
    df = decide.limit_info(df)
    df = decide.predicted_to_cross(df)
    return decide.with_recommendation(df)


def screen(
    readings: DataFrame,
    *,
    as_of_hour: float = S.AS_OF_HOUR,
    detector: iforest.IsolationModel | None = None,
    prediction: Column | None = None,
    radius: float | None = None,
    margins: DataFrame | None = None,
    grid: Sequence[float] | None = None,
    carry: Sequence[str] = (),
    hot: bool | None = None,
) -> DataFrame:
    """Whole path for clean readings; the forecast defaults to persistence.

    Bounds come from a calibrated ``radius`` or ``margins`` only; without either they are NULL and
    no recommendation rests on them.
    """
    if hot is None:
        hot = ordering.has_hot_group(readings, S.PEER)
    table = feats.build_component_features(readings, as_of_hour=as_of_hour, grid=grid, carry=carry, hot=hot)
    table = peers.peer_count(table, hot=hot)
    scored = score(table, detector=detector)
    return decide_all(scored, prediction if prediction is not None else forecast.persistence(), radius=radius, margins=margins)


@dataclass
class Screened:
    """Records of the scored histories, the rest with reasons, counts, and what happened later."""

    records: DataFrame
    unscored: DataFrame
    summary: DataFrame
    outcomes: DataFrame | None = None


def screen_readings(
    readings: DataFrame,
    bundle=None,
    *,
    model: str | None = None,
    outcomes: DataFrame | None = None,
    family: str = "MLCC_X7R",
    measurement: str | None = "leakage_ua",
    strict: bool = True,
    hot: bool | None = None,
) -> Screened:
    """Screen readings with the frozen models of a bundle (:class:`peerscreen.plans.training.Bundle`).

    Histories that fail the eligibility gate, or whose profile the bundle has not seen, are not scored.
    Without a bundle there is no forecast and no bound: each record is provisional and rests on the
    anomaly rule alone. ``outcomes`` are later readings; they are joined to the screened histories
    for a reveal and reach neither features nor records.
    """
    if outcomes is not None and (missing := [c for c in (*S.KEY4, "hours", "measurement_value") if c not in outcomes.columns]):
        raise ValueError("the outcomes lack columns: " + ", ".join(missing))
    prepared = prepare_early_features(readings, family=family, measurement=measurement, strict=strict, hot=hot)
    if hot is None:
        hot = ordering.has_hot_group(prepared.early, S.PEER)
    table, unscored = prepared.features, prepared.rejects.select(*S.KEY4, "reasons")
    if bundle is not None and bundle.supported_profiles is not None:
        known = table if "profile_id" in table.columns else table.withColumn("profile_id", F.lit(None).cast("string"))
        table, other = quality.supported_profiles(known, bundle.supported_profiles)
        unscored = unscored.unionByName(other.select(*S.KEY4, "reasons"))
    table = peers.peer_count(augment_features(table, hot=hot), hot=hot)
    if bundle is not None:
        records = bundle.screen(table, model=model).withColumns({"provisional": F.lit(False), "recommendation_basis": F.lit("combined")})
    else:
        scored = decide.limit_info(score(table)).withColumn("recommendation_reasons", F.col("reason_codes"))
        empty = {c: F.lit(None).cast("double") for c in ("predicted_final_value", "prediction_lower", "prediction_upper")}
        records = decide.provisional_recommendation(scored.withColumns(empty | {"forecast_model": F.lit(None).cast("string")}))
    later = None
    if outcomes is not None:
        ids = records.select(*S.KEY4).unionByName(unscored.select(*S.KEY4))
        later = outcomes.filter(F.col("hours") > S.AS_OF_HOUR).join(ids, S.KEY4, "left_semi").select(*S.KEY4, "hours", "measurement_value")
    return Screened(records, unscored, decide.summary(records, unscored), later)


def forecast_table(
    prepared: EarlyTable,
    prediction: Column,
    *,
    supported: Sequence[str] | None = None,
    used_features: Sequence[str] = (),
    name: str = "persistence",
    hot: bool | None = None,
) -> DataFrame:
    """One row per history: forecast with peer and imputation counts, or unavailable with the reason."""
    if hot is None:
        hot = ordering.has_hot_group(prepared.early, S.PEER)
    table = prepared.features
    unavailable = prepared.rejects.select(*S.KEY4, F.array_join("reasons", "; ").alias("unavailable_reason"))
    if supported is not None:
        table, other = quality.supported_profiles(table, supported)
        unavailable = unavailable.unionByName(
            other.select(*S.KEY4, F.array_join("reasons", "; ").alias("unavailable_reason"))
        )
    table = peers.peer_count(table, hot=hot)
    pred, limit = prediction, F.col("upper_limit")
    done = table.select(
        *S.KEY4,
        F.lit("forecast").alias("status"),
        (pred * limit).alias("predicted_final_value"),
        pred.alias("predicted_normalized"),
        limit.alias("upper_limit"),
        F.col("current_value").alias("value_at_24h"),
        F.col("current_value").alias("persistence_final_value"),
        "peer_count",
        F.col("weak_peers").alias("weak_peer_warning"),
        F.size(feats.missing_list(used_features) if used_features else F.array()).alias("imputed_feature_count"),
    )
    both = done.unionByName(unavailable.withColumn("status", F.lit("unavailable")), allowMissingColumns=True)
    return both.withColumns(
        {
            "target_hour": F.lit(S.TARGET_HOUR),
            "as_of_hour": F.lit(S.AS_OF_HOUR),
            "candidate_name": F.lit(name),
        }
    )
