"""Training, cross-validation, interval experiments and persisted models.

All models of a job, whatever their configuration, fold and seed, are fitted in the same passes over
one table, and score it in one pass. Out-of-fold rows of all configurations end up in one table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import flag, refuse_null
from peerscreen.operators import boosting, forecast, iforest, intervals, metrics, ordering, splits
from peerscreen.operators.boosting import CandidateConfig, Ensemble, FittedModel
from peerscreen.plans import screening

FORMAT = "peerscreen-bundle-2"


# --- cross-validation ---------------------------------------------------------------


def training_table(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with y and truth; refuses rows without a usable final value."""
    truth = [c for c in ("is_defect", "is_tester_fault", "is_healthy", "is_future_failure", "scenario", "anomaly_onset_hour", "tester_fault_onset_hour") if c in labels.columns]
    table = forecast.joined_labels(features, labels).join(labels.select(*S.KEY4, *truth), S.KEY4, "left")
    message = "every training component needs a finite nonnegative final_value"
    return table.withColumn("y", refuse_null(F.col("y"), F.col("y"), message))


def run_cross_validation(
    table: DataFrame,
    configs: Sequence[CandidateConfig],
    folds: DataFrame,
    *,
    seed: int = 26170,
    train_filter=None,
) -> DataFrame:
    """Out-of-fold rows: the held-out batches of every fold, scored by a model that never saw them.

    ``train_filter`` thins the training rows only (prevalence read-out). ``train_mae`` is the error
    of the row's model on its own training rows.
    """
    names = [c.name for c in configs]
    if len(set(names)) != len(names):
        raise ValueError("two configurations share a name")
    return _out_of_fold(table, [(c.name, c, seed) for c in configs], folds, train_filter)


def _out_of_fold(table: DataFrame, named: Sequence[tuple[str, CandidateConfig, int]], folds: DataFrame, train_filter=None) -> DataFrame:
    """One row per held-out row and (name, configuration, seed)."""
    table = ordering.stable(table.join(folds.select("batch_id", "fold"), "batch_id"))
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())  # the number of folds
    inside = [(F.col("fold") != k) & (F.coalesce(train_filter, F.lit(False)) if train_filter is not None else F.lit(True)) for k in numbers]
    jobs = [boosting.Job(c, seed, at) for _, c, seed in named for at in range(len(numbers))]
    models = boosting.fit_many(table, jobs, inside)
    scored = ordering.stable(table.withColumn("_p", boosting.joint_predictions(models)))
    error = lambda i: F.avg(F.when(inside[i % len(numbers)], F.abs(F.element_at("_p", i + 1) - F.col("y"))))
    fitted = scored.agg(*[error(i).alias(f"e{i}") for i in range(len(jobs))]).first()  # one number per model
    own = F.array_position(F.array(*[F.lit(k) for k in numbers]), F.col("fold")).cast("int")
    entries = []
    for at, (name, _, _) in enumerate(named):
        first = at * len(numbers)
        errors = F.array(*[F.lit(fitted[f"e{first + i}"]).cast("double") for i in range(len(numbers))])
        entries.append(F.struct(F.lit(name).alias("config"), F.element_at("_p", own + first).alias("pred"), F.element_at(errors, own).alias("train_mae")))
    return scored.withColumn("_e", F.explode(F.array(*entries))).select(*table.columns, "_e.*")


def cross_validation_report(oof: DataFrame, configs: Sequence[CandidateConfig] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comparison table, metrics per fold, error per batch)."""
    excluded = [c.name for c in configs if c.model not in forecast.BASELINES and uses_conditions(c)]
    oof = ordering.stable(oof)
    pooled = metrics.forecast_metrics(oof, keys=["config"])
    fitted = oof.groupBy("config", "fold").agg(F.max("train_mae").alias("train_mae"))
    per_fold = ordering.stable(metrics.forecast_metrics(oof, keys=["config", "fold"], medians=False).join(fitted, ["config", "fold"]))
    per_batch = ordering.stable(metrics.batch_mae(oof))
    return metrics.comparison_table(pooled, per_fold, per_batch, excluded), per_fold, per_batch


def uses_conditions(config: CandidateConfig) -> bool:
    return bool(set(config.feature_columns) & set(S.CONDITION_FEATURES))


def run_seed_check(table: DataFrame, config: CandidateConfig, folds: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Pooled error of one configuration per seed."""
    oof = _out_of_fold(table, [(str(int(x)), config, int(x)) for x in seeds], folds)
    found = metrics.forecast_metrics(oof, keys=["config"], medians=False)
    return found.withColumns({"seed": F.col("config").cast("int"), "config": F.lit(config.name)})


def run_prevalence_readout(
    table: DataFrame, configs: Sequence[CandidateConfig], folds: DataFrame, *, keep_fraction: float = 0.5, seed: int = 26170
) -> DataFrame:
    """Metrics after part of the defects left the training rows; held-out rows are untouched.

    Thinning is the diagnostic itself: defects are kept by a hash of their identity.
    """
    draw = F.pmod(F.xxhash64(*S.KEY4, F.lit(seed)), F.lit(1_000_000)) < int(keep_fraction * 1_000_000)
    keep = ~F.coalesce(F.col("is_defect"), F.lit(False)) | draw
    return metrics.forecast_metrics(run_cross_validation(table, configs, folds, seed=seed, train_filter=keep), keys=["config"])


# --- interval experiment --------------------------------------------------------------

INTERVAL_METHODS = [
    "symmetric_absolute",
    "asymmetric_signed",
    "stratified_asymmetric_signed",
    "stratified_one_sided_upper",
    "cqr_quantile",
]


def quantile_configs(config: CandidateConfig, alpha: float) -> tuple[CandidateConfig, CandidateConfig]:
    def at(level: float, tag: str) -> CandidateConfig:
        params = {**{k: v for k, v in config.params.items() if k != "gate"}, "quantile": level}
        return CandidateConfig(f"{config.name}_{tag}", "boosted", config.target, config.feature_set, "quantile", params)

    return at(alpha / 2, "q_low"), at(1 - alpha / 2, "q_high")


def run_interval_experiment(
    table: DataFrame,
    config: CandidateConfig,
    folds: DataFrame,
    *,
    alpha: float = 0.1,
    per_profile: int = 2,
    seed: int = 26170,
    with_quantiles: bool = True,
) -> DataFrame:
    """Rows with lower and upper bounds per method and fold (nested calibration).

    In every fold whole batches per profile are set aside from the training
    part; residual quantiles come from them only.
    """
    table = ordering.stable(table.join(folds.select("batch_id", "fold"), "batch_id"))
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())  # the number of folds
    batches = table.select("batch_id", "profile_id", "fold").distinct()
    reserved = None
    for k in numbers:
        one = splits.calibration_batches(batches.filter(F.col("fold") != k).drop("fold"), per_profile=per_profile, rotation=k).withColumn("_k", F.lit(k))
        reserved = one if reserved is None else reserved.unionByName(one)
    reserved = ordering.stable(reserved)
    if not reserved.filter("not enough").isEmpty():
        raise ValueError("a profile has too few batches to set some aside for calibration")
    held_out = reserved.groupBy("batch_id").agg(F.collect_set("_k").alias("_reserved"))  # folds for which a batch calibrates
    table = ordering.stable(table.join(held_out, "batch_id", "left").withColumn("_reserved", F.coalesce("_reserved", F.array().cast("array<int>"))))
    calibrates = lambda k: F.array_contains("_reserved", k)
    configs = [config, *(quantile_configs(config, alpha) if with_quantiles else ())]
    jobs = [boosting.Job(c, seed, at) for at in range(len(numbers)) for c in configs]
    models = boosting.fit_many(table, jobs, [(F.col("fold") != k) & ~calibrates(k) for k in numbers])
    scored = ordering.stable(table.withColumn("_p", boosting.joint_predictions(models)))
    out = None
    for at, k in enumerate(numbers):
        own = {n: F.element_at("_p", at * len(configs) + i + 1) for i, n in enumerate(("pred", "_ql", "_qh")[: len(configs)])}
        here = scored.withColumns(own).drop("_p", "_reserved")
        cal = scored.withColumns(own).filter((F.col("fold") != k) & calibrates(k)).drop("_p", "_reserved").withColumn("residual", F.col("y") - F.col("pred"))
        held = here.filter(F.col("fold") == k)
        part = _fold_intervals(cal.drop("_ql", "_qh"), held.drop("_ql", "_qh"), alpha)
        if with_quantiles:
            part = part.unionByName(_widened(cal, held, alpha))
        out = part if out is None else out.unionByName(part)
    return out


def _fold_intervals(cal: DataFrame, held: DataFrame, alpha: float) -> DataFrame:
    plain = ["lower", "upper"]
    keep = [c for c in held.columns if c not in plain]
    radius = intervals.apply_radius(held, intervals.conformal_radius(cal, "residual", alpha=alpha), "pred")
    pooled = intervals.signed_bounds(cal, "residual", alpha=alpha)
    two = held.crossJoin(F.broadcast(pooled.select(F.col("lower_two_sided").alias("_l"), F.col("upper_two_sided").alias("_u"))))  # one row
    two = two.withColumns({"lower": F.greatest(F.col("pred") + F.col("_l"), F.lit(0.0)), "upper": F.col("pred") + F.col("_u")})
    margins = intervals.stratified_margins(cal, "residual", alpha=alpha)
    strat = intervals.apply_margins(held, margins, "pred")
    pick = lambda df, lo, up, name: df.select(*keep, lo.alias("lower"), up.alias("upper"), F.lit(name).alias("method"))
    return (
        pick(radius, F.col("lower"), F.col("upper"), INTERVAL_METHODS[0])
        .unionByName(pick(two, F.col("lower"), F.col("upper"), INTERVAL_METHODS[1]))
        .unionByName(pick(strat, F.col("lower_two_sided"), F.col("upper_two_sided"), INTERVAL_METHODS[2]))
        .unionByName(pick(strat, F.lit(0.0), F.col("upper"), INTERVAL_METHODS[3]))
    )


def _cqr(low: FittedModel, high: FittedModel, cal: DataFrame, held: DataFrame, alpha: float) -> DataFrame:
    """Conformalized quantile regression by two fitted models."""
    band = lambda df: high.transform(low.transform(df, "_ql"), "_qh")
    return _widened(band(cal), band(held), alpha)


def _widened(cal: DataFrame, held: DataFrame, alpha: float) -> DataFrame:
    """The band between _ql and _qh, widened by one order statistic of what calibration rows miss it by."""
    keep = [c for c in held.columns if c not in ("lower", "upper", "_ql", "_qh")]
    band = lambda df: df.withColumns({"_lo": F.least("_ql", "_qh"), "_hi": F.greatest("_ql", "_qh")})
    scores = band(cal).withColumn("_s", F.greatest(F.col("_lo") - F.col("y"), F.col("y") - F.col("_hi")))
    rank = lambda n: F.ceil((n + 1).cast("double") * F.lit(1.0 - alpha))
    adjust = ordering.order_statistics(scores, [], "_s", {"_adjust": rank}).select("_adjust")
    out = band(held).crossJoin(F.broadcast(adjust))  # one row
    return out.select(
        *keep,
        F.greatest(F.col("_lo") - F.col("_adjust"), F.lit(0.0)).alias("lower"),
        (F.col("_hi") + F.col("_adjust")).alias("upper"),
        F.lit(INTERVAL_METHODS[4]).alias("method"),
    )


def interval_summary(rows: DataFrame) -> DataFrame:
    """Per method: mean and spread over folds of coverage and width."""
    per_fold = intervals.interval_metrics(rows, keys=["method", "fold"])
    return per_fold.groupBy("method").agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("coverage").alias("coverage_mean"),
        F.coalesce(F.stddev_samp("coverage"), F.lit(0.0)).alias("coverage_std"),
        F.min("coverage").alias("coverage_min"),
        F.max("coverage").alias("coverage_max"),
        F.avg("upper_only_coverage").alias("upper_only_coverage_mean"),
        F.min("batch_coverage_min").alias("batch_coverage_min"),
        F.max("batch_coverage_max").alias("batch_coverage_max"),
        F.avg("median_width").alias("median_width_mean"),
        F.avg("coverage_healthy").alias("coverage_healthy_mean"),
        F.avg("coverage_nonhealthy").alias("coverage_nonhealthy_mean"),
        F.avg("share_upper_below_limit").alias("share_upper_below_limit_mean"),
    )


# --- training a bundle -------------------------------------------------------------------

# Fixed values of records.
SYMMETRIC_INTERVAL = "split_conformal_absolute_residual"
STRATIFIED_INTERVAL = "stratified_asymmetric_split_conformal_signed_residual"

NOT_SELECTED = "Another model of the bundle had the smaller error on the inner held-out batches"


@dataclass
class Bundle:
    """Everything needed to screen new parts; small except the detector's training scores."""

    selected: str
    models: dict[str, FittedModel]
    radii: dict[str, float]
    margins: list[dict]
    detector: iforest.IsolationModel | None  # none: the robust rule flags alone
    contamination: float = 0.1
    alpha: float = 0.1
    supported_profiles: DataFrame | None = None  # one column, profile_id
    condition_ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    validation_mae: dict[str, float] = field(default_factory=dict)
    stratified: str = boosting.FINAL.name  # the model that the margins belong to

    def margin_table(self, spark: SparkSession) -> DataFrame:
        rows = [[m["stratum"], *[m[c] for c in intervals.MARGINS]] for m in self.margins]
        return spark.createDataFrame(rows, "stratum int, " + ", ".join(f"{c} double" for c in intervals.MARGINS))

    def screen(self, features: DataFrame, *, model: str | None = None) -> DataFrame:
        """Scores, forecast with bounds, recommendation, readiness, and which interval it is."""
        name = model or self.selected
        if name not in self.models:
            raise ValueError(f"the bundle has no model named {name}")
        scored = screening.score(features, detector=self.detector, contamination=self.contamination)
        stratified = name == self.stratified
        out = screening.decide_all(
            scored,
            self.models[name].prediction(scored),
            radius=self.radii[name],
            margins=self.margin_table(features.sparkSession) if stratified else None,
            bounds={c: r for c, r in self.condition_ranges.items() if c in features.columns},
            optional=[c for c in S.FORECAST_FEATURES if c in features.columns],
        )
        limit, none = F.col("upper_limit"), F.lit(None)
        wide = {f"prediction_{c}": F.col(c) * limit if stratified else none.cast("double") for c in ("lower_two_sided", "upper_two_sided")}
        return out.withColumns(
            {
                "forecast_model": F.lit(name),
                "interval_method": F.lit(STRATIFIED_INTERVAL if stratified else SYMMETRIC_INTERVAL),
                "interval_stratum": F.concat(F.lit("slope_z_stratum_"), F.col("stratum").cast("string")) if stratified else none.cast("string"),
                "interval_nominal_coverage": F.lit(1.0 - 2 * self.alpha if stratified else 1.0 - self.alpha),
                "upper_bound_nominal_level": F.lit(1.0 - self.alpha) if stratified else none.cast("double"),
                "selection_warning": F.lit(NOT_SELECTED) if name != self.selected else none.cast("string"),
                **wide,
            }
        )


def train_bundle(
    train: DataFrame,
    calibration: DataFrame,
    test: DataFrame,
    *,
    configs: Sequence[CandidateConfig] = (boosting.RIDGE, boosting.HIST, boosting.SQUARED, boosting.FINAL),
    alpha: float = 0.1,
    seed: int = 26170,
    stratified: str = boosting.FINAL.name,
    with_detector: bool = True,
) -> tuple[Bundle, DataFrame]:
    """Select on inner held-out batches, refit, calibrate once, evaluate once on untouched batches.

    Inputs are training tables (features, y, truth). Returns the bundle and the
    evaluation table. The model named ``stratified`` gets margins per slope stratum, if it is among them.
    """
    train, calibration, test = (ordering.stable(t) for t in (train, calibration, test))
    for a, b in ((train, calibration), (train, test), (calibration, test)):
        if not splits.set_overlaps(a, b).isEmpty():
            raise ValueError("whole batches and devices must be disjoint between the tables")
    if train.select("batch_id").distinct().limit(5).count() < 5:
        raise ValueError("selecting a model takes five training batches or more")
    baselines = [CandidateConfig(n, n) for n in forecast.BASELINES]
    inner = splits.make_batch_split(train, test_fraction=0.25, seed=seed)
    sides = ordering.stable(train.join(inner.select("batch_id", F.col("side").alias("_side")), "batch_id"))
    every = [*baselines, *configs]
    # Models for selection and the final ones are fitted together.
    fitted = boosting.fit_many(sides, [boosting.Job(c, seed, at) for at in (0, 1) for c in every], [F.col("_side") == "train", F.lit(True)])
    probes, finals = fitted[: len(every)], fitted[len(every) :]
    errors = [F.avg(F.abs(F.element_at("_p", i + 1) - F.col("y"))).alias(f"e{i}") for i in range(len(every))]
    tried = sides.filter(F.col("_side") == "test").withColumn("_p", boosting.joint_predictions(probes)).agg(*errors).first()
    mae = {c.name: tried[f"e{i}"] for i, c in enumerate(every)}
    selected = min(mae, key=mae.get)
    models = {c.name: m for c, m in zip(every, finals)}
    detector = iforest.fit(train, seed=seed) if with_detector else None
    entries = [F.struct(F.lit(n).alias("config"), (F.col("y") - F.element_at("_p", i + 1)).alias("residual")) for i, n in enumerate(models)]
    missed = calibration.withColumn("_p", boosting.joint_predictions(list(models.values()))).select(F.inline(F.array(*entries)))
    found = intervals.conformal_radius(missed, "residual", alpha=alpha, keys=["config"]).collect()  # one row per model
    if len(found) < len(models) or any(r["radius"] is None for r in found):
        raise ValueError("the calibration table is too small for this alpha")
    radii = {r["config"]: float(r["radius"]) for r in found}
    margins = []
    if stratified in models:
        residuals = models[stratified].transform(calibration).withColumn("residual", F.col("y") - F.col("pred"))
        margins = [r.asDict() for r in intervals.stratified_margins(residuals, "residual", alpha=alpha).collect()]  # three rows
        if any(m[c] is None for m in margins for c in intervals.MARGINS):
            raise ValueError("the calibration table is too small for one-sided bounds at this alpha")
    present = [c for c in S.CONDITION_FEATURES if c in train.columns]
    edge = train.agg(*[f(c).alias(f"{n}_{c}") for c in present for n, f in (("lo", F.min), ("hi", F.max))]).first() if present else {}
    ranges = {c: (edge[f"lo_{c}"], edge[f"hi_{c}"]) for c in present if edge[f"lo_{c}"] is not None}
    profiles = None
    if "profile_id" in train.columns:
        profiles = ordering.stable(train.select("profile_id").where(F.coalesce("profile_id", F.lit("")) != "").distinct())
    bundle = Bundle(selected, models, radii, margins, detector, 0.1, alpha, profiles, ranges, mae, stratified)
    return bundle, evaluate_bundle(bundle, test)


def _by_model(bundle: Bundle, test: DataFrame) -> DataFrame:
    """One row per test row and model, with the symmetric bounds; all models score in one pass."""
    entries = [F.struct(F.lit(n).alias("config"), F.element_at("_p", i + 1).alias("pred"), F.lit(bundle.radii[n]).alias("_r")) for i, n in enumerate(bundle.models)]
    made = ("config", "pred", "lower", "upper")
    scored = test.withColumn("_p", boosting.joint_predictions(list(bundle.models.values())))
    rows = scored.select(*[c for c in test.columns if c not in made], F.inline(F.array(*entries)))
    bounds = {"lower": F.greatest(F.col("pred") - F.col("_r"), F.lit(0.0)), "upper": F.col("pred") + F.col("_r")}
    return ordering.stable(rows.withColumns(bounds).drop("_r"))


def evaluate_bundle(bundle: Bundle, test: DataFrame) -> DataFrame:
    """Per model: error, crossing confusion and interval quality on untouched batches."""
    return _model_block(_by_model(bundle, test))


def _model_block(rows: DataFrame) -> DataFrame:
    return metrics.forecast_metrics(rows, keys=["config"]).join(
        intervals.interval_metrics(rows, keys=["config"]).drop("components"), "config"
    )


@dataclass
class Evaluation:
    """What a bundle does on untouched batches, in small tables."""

    models: DataFrame  # per model: error, crossings, symmetric interval
    profiles: DataFrame | None  # the same, shorter, per model and profile
    stratified: DataFrame | None  # the interval by margins, of the model that has them
    alerts: DataFrame  # anomalies and recommendations against crossings
    actions: DataFrame  # rows per recommendation
    scenarios: DataFrame | None  # share of alerts per scenario


def evaluate_whole(bundle: Bundle, test: DataFrame, *, model: str | None = None) -> Evaluation:
    """All blocks on untouched batches; the screen is that of ``model``, by default the selected one.

    Blocks whose columns the test table lacks (profile_id, scenario) are None. Latent crossings need
    is_future_failure and is_tester_fault; a row without either counts as not so.
    """
    rows = _by_model(bundle, test)
    y, alert = F.col("y"), F.col("recommendation") != "ACCEPT"
    profiles = None
    if "profile_id" in test.columns:
        error, width = F.abs(F.col("pred") - y), F.col("upper") - F.col("lower")
        profiles = rows.groupBy("config", "profile_id").agg(
            F.count(F.lit(1)).alias("components"),
            F.avg(error).alias("mae_normalized"),
            F.avg(error * F.col("upper_limit")).alias("mae_unit"),
            F.avg(y.between(F.col("lower"), F.col("upper")).cast("double")).alias("interval_coverage"),
            F.avg(width * F.col("upper_limit")).alias("mean_width_unit"),
        )
    stratified = _stratified_block(bundle, rows) if bundle.stratified in bundle.models else None
    screened = ordering.stable(bundle.screen(test, model=model))
    return Evaluation(
        _model_block(rows),
        profiles,
        stratified,
        alert_blocks(screened),
        screened.groupBy("recommendation").agg(F.count(F.lit(1)).alias("components")),
        screened.groupBy("scenario").agg(F.count(F.lit(1)).alias("components"), F.avg(alert.cast("double")).alias("alert_rate")) if "scenario" in test.columns else None,
    )


def _stratified_block(bundle: Bundle, rows: DataFrame) -> DataFrame:
    one = rows.filter(F.col("config") == bundle.stratified).drop("lower", "upper")
    one = ordering.stable(intervals.apply_margins(one, bundle.margin_table(rows.sparkSession), "pred"))
    y, wide = F.col("y"), F.col("y").between(F.col("lower_two_sided"), F.col("upper_two_sided"))
    unit = one.withColumn("_w", (F.col("upper") - F.col("lower")) * F.col("upper_limit"))
    more = one.groupBy("config").agg(
        F.avg(wide.cast("double")).alias("two_sided_coverage"),
        F.avg((F.col("upper") >= 1.0).cast("double")).alias("share_upper_at_or_above_limit"),
        F.avg((y > F.col("upper")).cast("double")).alias("share_above_upper"),
    )
    median = ordering.group_median(unit, ["config"], "_w", "median_width_unit").drop("n")
    return intervals.interval_metrics(one, keys=["config"]).join(more, "config").join(median, "config")


def alert_blocks(screened: DataFrame) -> DataFrame:
    """(alert, target, confusion): anomalies and recommendations against observed and latent crossings, in one pass."""
    columns = set(screened.columns)
    on = {"combined_screening": F.col("recommendation") != "ACCEPT", "anomaly_detection": flag("is_anomaly")}
    targets = {"observed_final_crossing": (F.col("y") >= 1.0, F.lit(True))}
    if {"is_future_failure", "is_tester_fault"} <= columns:
        targets["latent_crossing_without_tester_faults"] = (flag("is_future_failure"), ~flag("is_tester_fault"))
    blocks = [
        F.struct(F.lit(a).alias("alert"), F.lit(t).alias("target"), F.count_if(within).alias("components"), *metrics.confusion(truth, fires, within=within))
        for a, fires in on.items()
        for t, (truth, within) in targets.items()
    ]
    return screened.agg(F.array(*blocks).alias("b")).select(F.inline("b"))


def alert_evaluation(screened: DataFrame) -> DataFrame:
    """Alerts (any recommendation but ACCEPT) and plain anomalies against the observed final crossing."""
    truth = F.col("y") >= 1.0
    pair = F.array(
        F.struct(F.lit("combined_screening").alias("alert"), (F.col("recommendation") != "ACCEPT").alias("on")),
        F.struct(F.lit("anomaly_detection").alias("alert"), F.col("is_anomaly").alias("on")),
    )
    tall = screened.withColumn("_a", F.explode(pair)).select("y", "_a.alert", "_a.on")
    return tall.groupBy("alert").agg(*metrics.confusion(truth, F.col("on")))


def frozen_review(bundle_model: FittedModel, named: dict[str, DataFrame]) -> DataFrame:
    """A frozen model against persistence on several named tables that share no batch or device."""
    seen = None
    out = None
    for name, table in named.items():
        ids = table.select("batch_id", "component_id").distinct()
        if seen is not None and not splits.set_overlaps(seen, ids).isEmpty():
            raise ValueError(f"table {name} shares a batch or device with an earlier one")
        seen = ids if seen is None else seen.unionByName(ids)
        both = bundle_model.transform(table).withColumn("config", F.lit(bundle_model.config.name)).unionByName(
            table.withColumn("pred", forecast.persistence()).withColumn("config", F.lit("persistence"))
        )
        one = metrics.forecast_metrics(both, keys=["config"], medians=False).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def fit_final(table: DataFrame, config: CandidateConfig = boosting.FINAL, *, seed: int = 26170) -> FittedModel:
    """The chosen configuration on all batches."""
    return boosting.fit_model(config, table, seed=seed)


# --- persistence ----------------------------------------------------------------------------


def save_model(model: FittedModel, spark: SparkSession, path: str) -> None:
    """Configuration and medians as JSON, trees as Parquet."""
    facts = {
        "format": FORMAT,
        "config": asdict(model.config),
        "feature_columns": model.columns,
        "medians": model.medians,
        "linear": model.linear,
        "base": model.ensemble.base if model.ensemble else None,
    }
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("errorifexists").text(os.path.join(path, "model"))
    if model.ensemble is not None:
        shape = "number int, weight double, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, cover array<double>, gain array<double>"
        rows = [
            (i, t["weight"], t["feature"], t["threshold"], t["left"], t["right"], t["value"], t["cover"], t["gain"])
            for i, t in enumerate(model.ensemble.trees)
        ]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("errorifexists").parquet(os.path.join(path, "trees"))


def load_model(spark: SparkSession, path: str) -> FittedModel:
    """Refuses another format or a feature list that differs from the configuration's."""
    facts = json.loads(spark.read.text(os.path.join(path, "model")).first()["value"])
    if facts.get("format") != FORMAT:
        raise ValueError("the model was saved in another format")
    config = CandidateConfig(**facts["config"])
    if facts["feature_columns"] != config.feature_columns:
        raise ValueError("the model was saved for other features")
    model = FittedModel(config, facts["medians"])
    if facts["linear"] is not None:
        model.linear = (facts["linear"][0], facts["linear"][1])
    if facts["base"] is not None:
        keys = ["weight", "feature", "threshold", "left", "right", "value", "cover", "gain"]
        rows = spark.read.parquet(os.path.join(path, "trees")).orderBy("number").collect()  # a few hundred trees
        model.ensemble = Ensemble(config.feature_columns, facts["base"], [{k: r[k] for k in keys} for r in rows])
    return model


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    facts = {
        "format": FORMAT,
        "feature_columns": S.FORECAST_FEATURES,
        "selected": bundle.selected,
        "models": list(bundle.models),
        "radii": bundle.radii,
        "margins": bundle.margins,
        "contamination": bundle.contamination,
        "alpha": bundle.alpha,
        "has_profiles": bundle.supported_profiles is not None,
        "condition_ranges": bundle.condition_ranges,
        "validation_mae": bundle.validation_mae,
        "stratified": bundle.stratified,
        "detector_keys": bundle.detector.keys if bundle.detector else None,
        "detector_columns": bundle.detector.columns if bundle.detector else None,
    }
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("errorifexists").text(os.path.join(path, "manifest"))
    for name, model in bundle.models.items():
        save_model(model, spark, os.path.join(path, "models", name))
    if bundle.supported_profiles is not None:
        bundle.supported_profiles.write.mode("errorifexists").parquet(os.path.join(path, "profiles"))
    for name in ("forest", "medians", "train_scores") if bundle.detector else ():
        getattr(bundle.detector, name).write.mode("errorifexists").parquet(os.path.join(path, "detector", name))


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    facts = json.loads(spark.read.text(os.path.join(path, "manifest")).first()["value"])
    if facts.get("format") != FORMAT or facts.get("feature_columns") != S.FORECAST_FEATURES:
        raise ValueError("the bundle was saved in another format or for other features")
    read = lambda n: spark.read.parquet(os.path.join(path, "detector", n))
    detector = None if facts["detector_keys"] is None else iforest.IsolationModel(facts["detector_keys"], facts["detector_columns"], read("forest"), read("medians"), read("train_scores"))
    models = {n: load_model(spark, os.path.join(path, "models", n)) for n in facts["models"]}
    return Bundle(
        facts["selected"], models, facts["radii"], facts["margins"], detector, facts["contamination"], facts["alpha"],
        spark.read.parquet(os.path.join(path, "profiles")) if facts["has_profiles"] else None, {c: tuple(r) for c, r in facts["condition_ranges"].items()}, facts["validation_mae"],
        facts.get("stratified", boosting.FINAL.name),
    )
