"""Evaluation jobs. Loops over hours, seeds and parameters are joins with small literal tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import flag, logistic, ratio, refuse_null
from peerscreen.operators import decide, features as feats, iforest, metrics, ordering, peers, splits

TRUTH = ["scenario", "is_defect", "is_tester_fault", "anomaly_onset_hour", "first_exceedance_hour"]
PLAIN_METHODS = ["fixed_limit", "robust_mad", "robust_mad_strict"]


@dataclass(frozen=True)
class ScreeningConfig:
    as_of_hour: float = 24.0
    contamination: float = 0.1
    robust_threshold: float = 3.5
    fixed_limit_fraction: float = 1.0
    random_state: int = 42
    fit_scope: str = "per_family"
    minimum_observations: int = 2

    def __post_init__(self):
        if self.fit_scope not in ("per_family", "pooled"):
            raise ValueError("fit_scope must be 'per_family' or 'pooled'")
        if not 0.0 < self.fixed_limit_fraction <= 2.0:
            raise ValueError("fixed_limit_fraction must sit in (0, 2]")


def fit_detectors(train: DataFrame, config: ScreeningConfig = ScreeningConfig(), *, extra_keys: Sequence[str] = ()) -> iforest.IsolationModel:
    """One forest per family and measurement, or a pooled one; contamination is applied when scoring."""
    scope = S.SCOPE if config.fit_scope == "per_family" else []
    return iforest.fit(train, keys=[*extra_keys, *scope], seed=config.random_state)


def screen_components(
    features: DataFrame,
    config: ScreeningConfig = ScreeningConfig(),
    *,
    detector: iforest.IsolationModel | None = None,
    contaminations: Sequence[float] | None = None,
    heat: ordering.Heat | None = None,
) -> DataFrame:
    """Flag and score columns of every method, side by side.

    Without a detector the forest columns stay empty and unflagged.
    """
    heat = heat or ordering.measure(features)
    strict = peers.mad_z(features, {"current_value": "_sc", "slope": "_ss"}, hot=heat.peer)
    strict = strict.withColumn("robust_mad_strict_deviation", F.greatest(F.abs("_sc"), F.abs("_ss"))).drop("_sc", "_ss")
    if detector is not None:
        scored = detector.score(
            strict,
            contamination=contaminations or config.contamination,
            robust_threshold=config.robust_threshold,
            hot=heat.scope if detector.keys else heat.table,
        )
        # A scope without a fitted forest fails the job instead of passing unflagged.
        message = "no fitted detector for some family / measurement; eight training components are needed"
        known = F.col("isolation_score")
        scored = scored.withColumns(
            {c: refuse_null(F.col(c), known, message) for c in ("is_model_anomaly", "model_anomaly_score", "is_anomaly", "anomaly_score")}
        )
    else:
        scored = decide.combine_scores(decide.apply_robust_baseline(strict, threshold=config.robust_threshold))
    scored = metrics.method_flags(scored, fixed_limit_fraction=config.fixed_limit_fraction)
    deviation = F.col("robust_mad_strict_deviation")
    return scored.withColumns(
        {
            "robust_mad_strict_flag": deviation >= config.robust_threshold,
            "fixed_limit_score": F.least(ratio(F.col("current_value"), F.col("upper_limit")), F.lit(2.0)),
            "robust_mad_score": F.col("robust_anomaly_score"),
            "isolation_forest_score": F.col("model_anomaly_score"),
            "combined_score": F.col("anomaly_score"),
            "robust_mad_strict_score": logistic(deviation, config.robust_threshold),
        }
    )


def build_split_features(readings: DataFrame, split: DataFrame, as_of_hour, *, minimum_observations: int = 2, grid: Sequence[float] | None = None, heat: ordering.Heat | None = None):
    """(train, test) features. Peer windows never cross batches, so one pass serves both sides."""
    heat = heat or ordering.measure(readings)
    table = feats.build_component_features(
        readings, as_of_hour=as_of_hour, minimum_observations=minimum_observations, grid=grid, hot=heat.peer
    )
    # One row per batch, found by a scan: keep it instead of scanning once per side.
    split = ordering.stable(split)
    return splits.select_side(table, split, "train"), splits.select_side(table, split, "test")


def evaluate_dataset(
    readings: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    *,
    as_of_hour=S.AS_OF_HOUR,
    contamination: float = 0.1,
    robust_threshold: float = S.ROBUST_THRESHOLD,
    with_forest: bool = True,
    seed: int = 42,
    grid: Sequence[float] | None = None,
    heat: ordering.Heat | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, scenario metrics, scored rows) of four methods on the held-out batches.

    A list of hours gives a time sweep from the same job.
    """
    heat = heat or ordering.measure(readings)
    train, test = build_split_features(readings, split, as_of_hour, grid=grid, heat=heat)
    if with_forest:
        train = ordering.stable(train)
        model = iforest.fit(train, keys=["as_of_hour"], seed=seed)
        scored = model.score(test, contamination=contamination, robust_threshold=robust_threshold, hot=heat.table)
        methods = ["fixed_limit", "robust_mad", "isolation_forest", "combined"]
    else:
        scored = decide.combine_scores(decide.apply_robust_baseline(test, threshold=robust_threshold))
        methods = ["fixed_limit", "robust_mad"]
    truth = metrics.with_onset(labels)
    scored = metrics.join_truth(metrics.method_flags(scored), truth, TRUTH)
    return (
        metrics.review_metrics(scored, methods),
        metrics.scenario_rates(scored, methods, ["as_of_hour"]),
        metrics.truth_flags(scored),
    )


def evaluate_repeated_splits(
    readings: DataFrame,
    labels: DataFrame,
    seeds: Sequence[int] = (101, 211, 307, 401, 503),
    *,
    as_of_hour: float = S.AS_OF_HOUR,
    contamination: float = 0.1,
    test_fraction: float = 1.0 / 3.0,
    with_forest: bool = True,
    grid: Sequence[float] | None = None,
    heat: ordering.Heat | None = None,
) -> DataFrame:
    """Metrics per split seed: rows repeat once per seed, everything else is one query."""
    heat = heat or ordering.measure(readings)
    table = feats.build_component_features(readings, as_of_hour=as_of_hour, grid=grid, hot=heat.peer)
    sides = splits.repeated_splits(readings, seeds, test_fraction=test_fraction)
    seeded = table.join(sides, "batch_id")
    test = seeded.filter(F.col("side") == "test").drop("side")
    if with_forest:
        seeded = ordering.stable(seeded)
        test = seeded.filter(F.col("side") == "test").drop("side")
        train = seeded.filter(F.col("side") == "train").drop("side")
        model = iforest.fit(train, keys=["split_seed"])
        scored = model.score(test, contamination=contamination, hot=heat.table)
        methods = ["fixed_limit", "robust_mad", "isolation_forest", "combined"]
    else:
        scored = decide.combine_scores(decide.apply_robust_baseline(test))
        methods = ["fixed_limit", "robust_mad"]
    scored = metrics.join_truth(metrics.method_flags(scored), metrics.with_onset(labels), TRUTH)
    return metrics.review_metrics(scored, methods, ["split_seed", "as_of_hour"])


def holdout(
    readings: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    config: ScreeningConfig = ScreeningConfig(),
    *,
    hours: Sequence[float] | None = None,
    with_forest: bool = True,
    grid: Sequence[float] | None = None,
    heat: ordering.Heat | None = None,
) -> DataFrame:
    """Held-out rows with every method's flag and their truth; ``hours`` makes a ladder."""
    heat = heat or ordering.measure(readings)
    at = list(hours) if hours else config.as_of_hour
    train, test = build_split_features(
        readings, split, at, minimum_observations=config.minimum_observations, grid=grid, heat=heat
    )
    model = fit_detectors(ordering.stable(train), config, extra_keys=["as_of_hour"]) if with_forest else None
    screened = screen_components(test, config, detector=model, heat=heat)
    return metrics.join_truth(screened, metrics.with_onset(labels), [*TRUTH, "is_healthy"])


def early_warning_ladder(
    readings: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    config: ScreeningConfig = ScreeningConfig(),
    *,
    hours: Sequence[float] = tuple(S.LADDER_HOURS),
    with_forest: bool = True,
    grid: Sequence[float] | None = None,
    heat: ordering.Heat | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics per hour, lead time per component and method, summary per method)."""
    methods = S.METHODS if with_forest else PLAIN_METHODS
    rows = holdout(readings, labels, split, config, hours=hours, with_forest=with_forest, grid=grid, heat=heat)
    per_hour = metrics.harness_metrics(rows, methods)
    leads = lead_times(rows, methods)
    return per_hour, leads, summarise_lead_times(leads)


def lead_times(rows: DataFrame, methods: Sequence[str]) -> DataFrame:
    """First flagged hour per method and component against its first exceedance."""
    tall = metrics.by_method(rows, methods)
    first = tall.groupBy("method", "component_id", "batch_id").agg(
        F.max("scenario").alias("scenario"),
        F.bool_or(flag("is_defect")).alias("is_defect"),
        F.bool_or(flag("is_tester_fault")).alias("is_tester_fault"),
        F.min("anomaly_onset_hour").alias("anomaly_onset_hour"),
        F.min(F.when(F.col("flagged"), F.col("as_of_hour"))).alias("first_flag_hour"),
        F.min("first_exceedance_hour").alias("first_exceedance_hour"),
    )
    return first.withColumn("lead_hours", F.col("first_exceedance_hour") - F.col("first_flag_hour"))


def summarise_lead_times(leads: DataFrame) -> DataFrame:
    seen, early = F.col("first_flag_hour").isNotNull(), F.coalesce(F.col("lead_hours") > 0, F.lit(False))
    n = F.count_if
    return leads.filter("is_defect").groupBy("method").agg(
        F.count(F.lit(1)).alias("n_defects"),
        n(seen).alias("n_ever_flagged"),
        n(seen & early).alias("n_flagged_before_crossing"),
        n(seen & F.col("first_exceedance_hour").isNull()).alias("n_flagged_never_crossing"),
        # Hours of the ladder: few distinct values.
        F.median("first_flag_hour").alias("median_first_flag_hour"),
        F.median(F.when(early, F.col("lead_hours"))).alias("median_lead_hours"),
        F.avg(F.when(early, F.col("lead_hours"))).alias("mean_lead_hours"),
    )


def parameter_sweep(
    readings: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    *,
    hours: Sequence[float] = (12.0, 24.0, 48.0),
    contaminations: Sequence[float] = (0.05, 0.1, 0.15, 0.2),
    robust_thresholds: Sequence[float] = (2.5, 3.5, 4.5),
    fixed_limit_fractions: Sequence[float] = (0.8, 1.0),
    config: ScreeningConfig = ScreeningConfig(),
    with_forest: bool = True,
    grid: Sequence[float] | None = None,
    heat: ordering.Heat | None = None,
) -> DataFrame:
    """Metrics for every grid point.

    Scores are computed once per hour (forest included, it sees no threshold). One aggregation
    then counts every grid point by its own condition, so no row is repeated per threshold or
    fraction, and no method is counted under a parameter that it can't see.
    """
    heat = heat or ordering.measure(readings)
    train, test = build_split_features(
        readings, split, list(hours), minimum_observations=config.minimum_observations, grid=grid, heat=heat
    )
    model = fit_detectors(ordering.stable(train), config, extra_keys=["as_of_hour"]) if with_forest else None
    screened = screen_components(
        test, config, detector=model, contaminations=list(contaminations) if with_forest else None, heat=heat
    )
    rows = metrics.join_truth(screened, metrics.with_onset(labels), [*TRUTH, "is_healthy"])
    deviation, strict = F.col("robust_deviation_score"), F.col("robust_mad_strict_deviation")
    points = [("fixed_limit", None, x, F.col("current_value") >= F.col("upper_limit") * float(x)) for x in fixed_limit_fractions]
    points += [("robust_mad", t, None, deviation >= float(t)) for t in robust_thresholds]
    points += [("robust_mad_strict", t, None, strict >= float(t)) for t in robust_thresholds]
    if with_forest:
        points.append(("isolation_forest", None, None, flag("is_model_anomaly")))
        points += [("combined", t, None, (deviation >= float(t)) | flag("is_model_anomaly")) for t in robust_thresholds]
    number = lambda x: F.lit(x).cast("double")
    entries = [
        F.struct(F.lit(m).alias("method"), number(t).alias("robust_threshold"), number(x).alias("fixed_limit_fraction"), *_sweep_metrics(flag(on)))
        for m, t, x, on in points
    ]
    keys = ["as_of_hour", *(["contamination"] if with_forest else [])]
    out = rows.groupBy(*keys).agg(F.array(*entries).alias("_points")).select(*keys, F.inline("_points"))
    # Methods that see no contamination have equal numbers under each: keep those of the first.
    forest = F.col("method").isin("isolation_forest", "combined")
    if with_forest:
        out = out.filter(forest | (F.col("contamination") == float(contaminations[0])))
    c = F.when(forest, F.col("contamination")) if with_forest else F.lit(None).cast("double")
    out = out.withColumns({"contamination": c, "fit_scope": F.when(forest, F.lit(config.fit_scope if with_forest else None))})
    front = ["method", "as_of_hour", "contamination", "robust_threshold", "fixed_limit_fraction"]
    return out.select(*front, *[n for n in out.columns if n not in front])


def _sweep_metrics(on: Column) -> list[Column]:
    n, tester = F.count_if, flag("is_tester_fault")
    defect, healthy = flag("is_defect") & ~tester, ~flag("is_defect") & ~tester
    first, as_of = F.col("first_exceedance_hour"), F.col("as_of_hour")
    later = on & defect & F.coalesce(first > as_of, F.lit(False))
    return [
        ratio(n(on & defect), n(defect)).alias("defect_recall"),
        ratio(n(~on & defect), n(defect)).alias("false_negative_rate"),
        ratio(n(on & healthy), n(healthy)).alias("false_positive_rate"),
        ratio(n(on & defect), n(on & (defect | healthy))).alias("precision"),
        # Lead times are differences of checkpoint hours: few distinct values.
        F.median(F.when(later, first - as_of)).alias("median_lead_time_hours"),
        n(later).alias("n_early_warnings"),
    ]


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Drop parameters a method cannot see, then remove duplicate rows."""
    visible = {p: [m for m, ps in S.METHOD_PARAMETERS.items() if p in ps] for p in ("contamination", "robust_threshold", "fixed_limit_fraction", "fit_scope")}
    out = sweep.withColumns({p: F.when(F.col("method").isin(ms), F.col(p)) for p, ms in visible.items() if p in sweep.columns})
    keys = [c for c in ("method", "as_of_hour", *visible) if c in out.columns]
    return out.dropDuplicates(keys)


def compare_fit_scopes(readings: DataFrame, labels: DataFrame, split: DataFrame, config: ScreeningConfig = ScreeningConfig(), *, grid: Sequence[float] | None = None, heat: ordering.Heat | None = None) -> DataFrame:
    """Forest methods under per-family and pooled fits (two fits on one feature table)."""
    heat = heat or ordering.measure(readings)
    train, test = build_split_features(readings, split, config.as_of_hour, grid=grid, heat=heat)
    train, test = ordering.stable(train), ordering.stable(test)
    out = None
    for scope in ("per_family", "pooled"):
        c = replace(config, fit_scope=scope)
        rows = screen_components(test, c, detector=fit_detectors(train, c), heat=heat)
        rows = metrics.join_truth(rows, metrics.with_onset(labels), [*TRUTH, "is_healthy"])
        part = metrics.harness_metrics(rows, ["isolation_forest", "combined"]).withColumn("fit_scope", F.lit(scope))
        out = part if out is None else out.unionByName(part)
    return out


def summarise_recommendations(screened: DataFrame, labels: DataFrame) -> DataFrame:
    """Recommended action with its share and the truth behind it (no forecast involved)."""
    routed = decide.with_recommendation(screened.drop("predicted_final_value", "prediction_lower", "prediction_upper"))
    joined = metrics.join_truth(
        routed.drop("is_defect", "is_tester_fault", "scenario"), labels, ["scenario", "is_defect", "is_tester_fault"], strict=False
    )
    return decide.share_of_total(
        joined,
        ["recommendation"],
        {"n_true_defects": F.count_if("is_defect"), "n_tester_faults": F.count_if("is_tester_fault")},
    )


def pattern_audit(predictions: DataFrame, pattern: str = "scenario") -> DataFrame:
    """Rows, error and coverage per truth pattern."""
    y, covered = F.col("y"), (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    return predictions.groupBy(pattern).agg(
        F.count(F.lit(1)).alias("components"),
        F.avg(F.abs(F.col("pred") - y) * F.col("upper_limit")).alias("mae_unit"),
        F.avg(covered.cast("double")).alias("interval_coverage"),
    )
