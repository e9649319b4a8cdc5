"""Registered queries around learned models.

Boosted fits run the published rounds and steps, over all hours, seeds and configurations. SQL can't
say a fitted model, so where there is an oracle it compares keys, ranges and sums that any fit must keep.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from checks import sql as Q
from checks.metric_queries import HELD, LADDER, LADDER_ROWS, LATENT, REPEATED, SEEDS, SM, STRAT, SWEEP_HOURS
from checks.registry import CARRY, HEAT, KEY, READ, feature_table, labels, query, rounded, tables_grid
from peerscreen.operators import features as feats
from peerscreen import schema as S
from peerscreen.operators import boosting, forecast, iforest, metrics, ordering, splits
from peerscreen.plans import evaluation, screening, stages, training
from peerscreen.sources import export

ABSOLUTE = boosting.FINAL
SQUARED = boosting.COMPARISON[4]
HUBER = boosting.COMPARISON[7]
PERSISTENCE = boosting.COMPARISON[0]
PUBLISHED = boosting.COMPARISON[6]  # of the seed check, the prevalence read-out and the intervals
FIT_SEEDS = (26170, 1, 2, 3)  # the published seed check and its base


def table(spark, d):
    """Training rows: histories with both features and an observed final value."""
    f = forecast.joined_labels(feature_table(spark, d, carry=CARRY), labels(spark, d)).filter("y is not null")
    truth = labels(spark, d).select(*KEY, "is_defect", "is_tester_fault", "is_healthy", "scenario")
    return f.join(truth, KEY)


def with_conditions(r):
    """Readings with the side measurements of a capacitor, told from their own columns."""
    number = F.substring("component_id", 2, 12).cast("int")
    return r.withColumns(
        {
            "applied_voltage_v": F.col("hours") + 100.0,
            "rated_voltage_v": F.lit(120.0),
            "measurement_voltage_v": F.lit(6.0) + number % 3,
            "measurement_temperature_c": F.col("temperature_c") - 95.0,
            "nominal_capacitance_nf": F.lit(50.0),
            "capacitance_nf": F.lit(50.0) - F.col("measurement_value") / 50.0,
            "dissipation_factor_pct": F.lit(1.0) + F.col("measurement_value") / 100.0,
            "prior_storage_humidity_pct": F.when(number % 11 != 0, F.lit(30.0) + number % 17),
        }
    )


def full_table(spark, d):
    """Training rows with the features of every feature set."""
    extras = feats.capacitor_extras(with_conditions(READ(spark, d).filter(F.col("hours").isin(S.CHECKPOINTS))))
    return screening.augment_features(table(spark, d).join(extras, KEY), hot=HEAT(spark, d).peer)


def folds(spark, d):
    return splits.assign_batch_folds(READ(spark, d))


def sides(spark, d):
    f = ordering.stable(feature_table(spark, d))
    split = splits.split_batches(READ(spark, d))
    return splits.select_side(f, split, "train"), splits.select_side(f, split, "test")


@query("J-02_isolation_forest_fit")
def _(spark, d):
    train, _test = sides(spark, d)
    model = iforest.fit(train, keys=S.SCOPE)
    return model.forest.groupBy(*S.SCOPE).agg(F.count(F.lit(1)).alias("trees"), F.max("n_sample").alias("rows_per_tree"), F.sum(F.size("path")).alias("nodes"))


@query("J-03_isolation_forest_score")
def _(spark, d):
    train, test = sides(spark, d)
    out = iforest.fit(train, keys=S.SCOPE).score(test, hot=HEAT(spark, d).scope)
    return rounded(out.select(*KEY, "isolation_score", "model_anomaly_score", "is_model_anomaly", "anomaly_score", "is_anomaly", "reason_codes"))


@query("J-06_pooled_scope")
def _(spark, d):
    train, test = sides(spark, d)
    config = evaluation.ScreeningConfig(fit_scope="pooled")
    out = evaluation.screen_components(test, config, detector=evaluation.fit_detectors(train, config))
    return rounded(out.select(*KEY, "isolation_forest_flag", "isolation_forest_score", "combined_flag", "combined_score"))


CANDIDATES = (boosting.RIDGE, boosting.HIST, boosting.SQUARED)


@query("J-08_candidate_models")
def _(spark, d):
    rows = ordering.stable(full_table(spark, d))
    models = boosting.fit_many(rows, [boosting.Job(c) for c in CANDIDATES])
    out = rows.withColumn("_p", boosting.joint_predictions(models))
    return rounded(out.select(*KEY, "y", *[F.element_at("_p", i + 1).alias(c.name) for i, c in enumerate(CANDIDATES)]))


@query("J-09_absolute_residual_forecast")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    return rounded(boosting.fit_model(ABSOLUTE, rows).transform(rows).select(*KEY, "y", "pred"))


@query("J-12_pseudo_huber_forecast")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    return rounded(boosting.fit_model(HUBER, rows).transform(rows).select(*KEY, "y", "pred"))


@query("J-13_bagged_forecast")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    bagged = boosting.with_params(SQUARED, bags=2)
    return rounded(boosting.fit_model(bagged, rows).transform(rows).select(*KEY, "y", "pred"))


@query("J-16_contributions")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    return rounded(boosting.fit_model(ABSOLUTE, rows).contributions(rows, KEY))


@query("F-12_top_contributions")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    return rounded(boosting.top_contributions(boosting.fit_model(SQUARED, rows).contributions(rows, KEY), KEY))


@query("J-17_gain_importance")
def _(spark, d):
    return rounded(boosting.fit_model(SQUARED, table(spark, d)).importance(spark))


@query("G-04_importance_ranking")
def _(spark, d):
    return rounded(boosting.fit_model(SQUARED, table(spark, d)).importance(spark).filter("importance > 0"))


@query("J-18_permutation_importance")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    split = splits.split_batches(rows, stratum=None)
    model = boosting.fit_model(PUBLISHED, splits.select_side(rows, split, "train"))
    return rounded(boosting.permutation_importance(model, splits.select_side(rows, split, "test")))


@query("J-19_model_selection")
def _(spark, d):
    rows = ordering.stable(full_table(spark, d))
    split = splits.make_batch_split(rows, test_fraction=0.25)
    fit_rows, held = splits.select_side(rows, split, "train"), splits.select_side(rows, split, "test")
    configs = [*boosting.COMPARISON[:2], *CANDIDATES, boosting.FINAL]
    models = boosting.fit_many(fit_rows, [boosting.Job(c) for c in configs])
    entries = [F.struct(F.lit(c.name).alias("config"), F.element_at("_p", i + 1).alias("pred")) for i, c in enumerate(configs)]
    out = held.withColumn("_p", boosting.joint_predictions(models)).select("y", F.inline(F.array(*entries)))
    return rounded(out.groupBy("config").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("validation_mae")).orderBy("validation_mae"))


@query("J-15_quantile_intervals")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    split = splits.three_way_split(rows)
    part = {s: ordering.stable(splits.select_side(rows, split, s, "split")) for s in ("train", "calibration", "test")}
    low, high = boosting.fit_many(part["train"], [boosting.Job(c) for c in training.quantile_configs(ABSOLUTE, 0.1)])
    out = training._cqr(low, high, part["calibration"], part["test"], 0.1)
    return rounded(out.select(*KEY, "y", "lower", "upper"))


@query("K-05_holdout_with_forest")
def _(spark, d):
    r = READ(spark, d)
    return rounded(evaluation.evaluate_dataset(r, labels(spark, d), splits.split_batches(r), grid=tables_grid(), heat=HEAT(spark, d))[0])


@query("K-07_repeated_splits_with_forest")
def _(spark, d):
    return rounded(evaluation.evaluate_repeated_splits(READ(spark, d), labels(spark, d), SEEDS, grid=tables_grid(), heat=HEAT(spark, d)))


@query("K-09_holdout_report")
def _(spark, d):
    r = READ(spark, d)
    rows = evaluation.holdout(r, labels(spark, d), splits.split_batches(r), grid=tables_grid(), heat=HEAT(spark, d))
    return rounded(metrics.harness_metrics(rows, S.METHODS))


@query("K-10_ladder_with_forest")
def _(spark, d):
    r = READ(spark, d)
    return rounded(evaluation.early_warning_ladder(r, labels(spark, d), splits.split_batches(r), hours=LADDER, grid=tables_grid(), heat=HEAT(spark, d))[2])


@query("K-11_grid_with_forest")
def _(spark, d):
    r = READ(spark, d)
    return rounded(evaluation.sweep_summary(evaluation.parameter_sweep(r, labels(spark, d), splits.split_batches(r), hours=SWEEP_HOURS, grid=tables_grid(), heat=HEAT(spark, d))))


@query("K-12_fit_scopes")
def _(spark, d):
    r = READ(spark, d)
    return rounded(evaluation.compare_fit_scopes(r, labels(spark, d), splits.split_batches(r), grid=tables_grid(), heat=HEAT(spark, d)))


@query("K-13_cross_validation")
def _(spark, d):
    oof = training.run_cross_validation(full_table(spark, d), boosting.COMPARISON, folds(spark, d))
    return rounded(metrics.forecast_metrics(oof, keys=["config", "fold"], medians=False))


@query("K-14_configuration_comparison")
def _(spark, d):
    oof = training.run_cross_validation(full_table(spark, d), boosting.COMPARISON, folds(spark, d))
    return rounded(training.cross_validation_report(oof, boosting.COMPARISON)[0])


@query("K-15_seed_check")
def _(spark, d):
    return rounded(metrics.seed_spread(training.run_seed_check(table(spark, d), PUBLISHED, folds(spark, d), FIT_SEEDS)))


@query("K-15_prevalence_readout")
def _(spark, d):
    return rounded(training.run_prevalence_readout(table(spark, d), [PERSISTENCE, PUBLISHED], folds(spark, d)))


@query("K-16_interval_experiment")
def _(spark, d):
    rows = training.run_interval_experiment(table(spark, d), PUBLISHED, folds(spark, d), per_profile=2)
    return rounded(training.interval_summary(rows))


def bundle(spark, d):
    rows = ordering.stable(full_table(spark, d))
    split = splits.three_way_split(rows)
    train, calibration, test = (splits.select_side(rows, split, s, "split") for s in ("train", "calibration", "test"))
    return training.train_bundle(train, calibration, test), test


@query("K-17_train_bundle")
def _(spark, d):
    return rounded(bundle(spark, d)[0][1])


@query("A-16_bundle_reload")
def _(spark, d):
    (fitted, _report), test = bundle(spark, d)
    path = export.scratch(spark, "bundle")
    training.save_bundle(fitted, spark, path)
    out = training.load_bundle(spark, path).screen(test, model="xgboost_v2")
    return rounded(out.select(*KEY, "forecast_model", "predicted_final_value", "prediction_lower", "prediction_upper", "recommendation"))


@query("A-17_candidate_reload")
@query("K-18_final_fit")
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    model = training.fit_final(rows, ABSOLUTE)
    path = export.scratch(spark, "candidate")
    training.save_model(model, spark, path)
    return rounded(training.load_model(spark, path).transform(rows).select(*KEY, "pred"))


@query("K-19_frozen_review")
def _(spark, d):
    """The frozen v2 model on four tables of whole batches that it never saw."""
    rows = ordering.stable(table(spark, d))
    split = splits.three_way_split(rows)
    model = training.fit_final(splits.select_side(rows, split, "train", "split"), ABSOLUTE)
    named = {}
    for side in ("calibration", "test"):
        part = splits.select_side(rows, split, side, "split")
        odd = F.substring("batch_id", 2, 9).cast("int") % 2
        named |= {f"{side}_{i}": part.filter(odd == i) for i in (0, 1)}
    return rounded(training.frozen_review(model, named))


@query("K-20_stress_invariance", "select cast(count(*) as bigint) as changed_rows from events where user_id is null")
def _(spark, d):
    """Later readings scaled a million times must not move a single early score."""
    r = READ(spark, d)
    stressed = r.withColumn("measurement_value", F.when(F.col("hours") > 24, F.col("measurement_value") * 1e6).otherwise(F.col("measurement_value")))
    a, b = (screening.screen(x).select(*KEY, F.round("anomaly_score", 9).alias("s"), "recommendation") for x in (r, stressed))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("changed_rows"))


# --- What SQL can say about learned models: which rows come back, and rules they must keep ---

Z_ROWS = (Q.READINGS, Q.features(), Q.Z)
TRAINED = (Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.ERRORS)
SIDES = Q.split(0.4, 7)
K = Q.KEY


@query(
    "J-02_trees_per_scope",
    Q.query(*Z_ROWS, SIDES, select="select component_family, measurement_name, 250 as trees, least(256, count(*)) as rows_per_tree, true as grown from z join split_t using (batch_id) where side = 'train' group by 1, 2 having count(*) >= 8"),
)
def _(spark, d):
    train, _test = sides(spark, d)
    forest = iforest.fit(train, keys=S.SCOPE).forest
    return forest.groupBy(*S.SCOPE).agg(F.count(F.lit(1)).alias("trees"), F.max("n_sample").alias("rows_per_tree"), (F.min(F.size("path")) > 1).alias("grown"))


@query(
    "J-03_scores_in_range",
    Q.query(*Z_ROWS, SIDES, f"n as (select component_family, measurement_name, count(*) >= 8 as fitted from z join split_t using (batch_id) where side = 'train' group by 1, 2)",
            select=f"select {', '.join('z.' + c for c in S.KEY4)}, coalesce(fitted, false) as scored, true as in_range, true as flagged_above_cut from z join split_t using (batch_id) left join n using (component_family, measurement_name) where side = 'test'"),
)
def _(spark, d):
    train, test = sides(spark, d)
    model = iforest.fit(train, keys=S.SCOPE)
    out = model.score(test, hot=HEAT(spark, d).scope)
    cuts = model.thresholds([0.1]).drop("contamination")
    out = ordering.null_safe_join(out, cuts, S.SCOPE)
    s, m = F.col("isolation_score"), F.col("model_anomaly_score")
    return out.select(
        *KEY,
        s.isNotNull().alias("scored"),
        F.coalesce((s > 0) & (s < 1) & (m >= 0) & (m <= 1), s.isNull()).alias("in_range"),
        F.coalesce(F.col("is_model_anomaly") == (s > F.col("score_cut")), s.isNull()).alias("flagged_above_cut"),
    )


@query("J-06_pooled_rows", Q.query(*Z_ROWS, SIDES, select=f"select {K}, true as scored from z join split_t using (batch_id) where side = 'test'"))
def _(spark, d):
    train, test = sides(spark, d)
    config = evaluation.ScreeningConfig(fit_scope="pooled")
    out = evaluation.screen_components(test, config, detector=evaluation.fit_detectors(train, config))
    return out.select(*KEY, (F.col("isolation_forest_score").isNotNull() & F.col("isolation_forest_flag").isNotNull()).alias("scored"))


GATED = "abs(slope_batch_robust_z) < 2 and abs(current_batch_robust_z) < 2"


@query("J-09_gate_and_sign", Q.query(*TRAINED, select=f"select {K}, round(y, 6) + 0.0 as y, case when {GATED} then round(p_pers, 6) + 0.0 end as gated, true as sensible from y0"))
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    out = boosting.fit_model(ABSOLUTE, rows).transform(rows)
    return rounded(out.select(*KEY, "y", F.when(F.expr(GATED), F.col("pred")).alias("gated"), ((F.col("pred") >= 0) & F.col("pred").isNotNull()).alias("sensible")))


@query("J-16_contributions_sum_up", Q.query(*TRAINED, select=f"select {K}, {len(ABSOLUTE.feature_columns) + 1} as parts, true as sums_up from y0"))
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    model = boosting.fit_model(ABSOLUTE, rows)
    sums = model.contributions(rows, KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("parts"), F.sum("contribution").alias("s"))
    out = model.transform(rows).join(sums, KEY)
    return out.select(*KEY, "parts", (F.abs(F.greatest(F.col("s"), F.lit(0.0)) - F.col("pred")) < 1e-9).alias("sums_up"))


SENSIBLE = "coalesce(pred >= 0, false) as sensible"


@query("J-08_candidates_forecast_all", Q.query(*TRAINED, select=f"select {K}, round(y, 6) + 0.0 as y, true as ridge, true as hist_gradient_boosting, true as xgboost, true as at_most_15_leaves from y0"))
def _(spark, d):
    rows = ordering.stable(full_table(spark, d))
    models = boosting.fit_many(rows, [boosting.Job(c) for c in CANDIDATES])
    leaves = max(sum(f < 0 for f in t["feature"]) for t in models[1].ensemble.trees)
    out = rows.withColumn("_p", boosting.joint_predictions(models))
    good = [F.coalesce(F.element_at("_p", i + 1) >= 0, F.lit(False)).alias(c.name) for i, c in enumerate(CANDIDATES)]
    return rounded(out.select(*KEY, "y", *good, F.lit(leaves <= 15).alias("at_most_15_leaves")))


@query("J-12_bags_and_objectives", Q.query(*TRAINED, select=f"select {K}, true as pseudo_huber, true as bags_average, true as quantiles_widen from y0"))
def _(spark, d):
    """One joint fit: pseudo-Huber, two bags with their two seeds alone, and two quantiles."""
    rows = ordering.stable(table(spark, d))
    low, high = training.quantile_configs(ABSOLUTE, 0.1)
    jobs = [boosting.Job(HUBER), boosting.Job(boosting.with_params(SQUARED, bags=2)), boosting.Job(SQUARED), boosting.Job(SQUARED, 26171), boosting.Job(low), boosting.Job(high)]
    out = rows.withColumn("_p", boosting.joint_predictions(boosting.fit_many(rows, jobs)))
    p = lambda i: F.element_at("_p", i)
    # Forecasts are cut at zero, an average of cut forecasts is not; so only uncut ones compare.
    average = (p(3) <= 0) | (p(4) <= 0) | (F.abs(p(2) - (p(3) + p(4)) / 2) < 1e-9)
    out = ordering.stable(out.select(*KEY, F.coalesce(p(1) >= 0, F.lit(False)).alias("pseudo_huber"), average.alias("bags_average"), (p(6) >= p(5)).alias("_wider")))
    wide = out.agg((F.avg(F.col("_wider").cast("int")) > 0.9).alias("quantiles_widen"))
    return out.drop("_wider").crossJoin(F.broadcast(wide))  # one row


@query("J-17_shares_of_gain", Q.query(*TRAINED, select=f"select {len(SQUARED.feature_columns)} as features, true as sum_to_one, count(*) as explained, 5 as strongest, true as falling from y0"))
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    model = boosting.fit_model(SQUARED, rows)
    gains = model.importance(spark).agg(F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_to_one"))
    top = boosting.top_contributions(model.contributions(rows, KEY), KEY).groupBy(*KEY)
    order = F.array_sort(F.collect_list(F.struct("rank", F.abs("contribution").alias("size"))))
    each = top.agg(F.count(F.lit(1)).alias("n"), F.transform(order, lambda x: x["size"]).alias("s"))
    falling = F.bool_and(F.col("s") == F.reverse(F.array_sort("s")))
    return gains.crossJoin(each.agg(F.count(F.lit(1)).alias("explained"), F.max("n").alias("strongest"), falling.alias("falling")))  # one row each


@query("K-13_rows_out_of_fold", Q.query(*TRAINED, select=f"select {K}, config, case when config = 'persistence' then round(p_pers, 6) + 0.0 end as baseline, true as sensible, true as train_error from y0 cross join (values ('persistence'), ('{PUBLISHED.name}')) c(config)"))
def _(spark, d):
    oof = training.run_cross_validation(table(spark, d), [PERSISTENCE, PUBLISHED], folds(spark, d))
    baseline = F.when(F.col("config") == "persistence", F.col("pred")).alias("baseline")
    return rounded(oof.select(*KEY, "config", baseline, F.expr(SENSIBLE), (F.col("train_mae") >= 0).alias("train_error")))


@query("A-17_reload_changes_nothing", Q.query(*TRAINED, select="select count(*) as compared, 0 as changed from y0"))
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    model = training.fit_final(rows, ABSOLUTE)
    path = export.scratch(spark, "candidate")
    training.save_model(model, spark, path)
    both = training.load_model(spark, path).transform(rows).select(*KEY, F.col("pred").alias("again")).join(model.transform(rows), KEY, "full")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("again").eqNullSafe(F.col("pred"))).alias("changed"))


@query("A-16_ml_pipeline_reload", Q.query(*TRAINED, select="select count(*) as compared, 0 as changed, true as all_scored from y0"))
def _(spark, d):
    """Forests and a ridge fit as one Spark ML pipeline, written, reloaded and compared row by row."""
    rows = ordering.stable(table(spark, d))
    ridge = boosting.CandidateConfig("ridge", "ridge")
    fitted = Pipeline(stages=[stages.PeerDetector(keys=S.SCOPE), stages.Forecaster(ridge)]).fit(rows)
    path = export.scratch(spark, "pipeline")
    fitted.write().save(path)
    told = lambda m, name: m.transform(rows).select(*KEY, F.struct("isolation_score", "is_anomaly", "reason_codes", "pred").alias(name))
    both = told(fitted, "one").join(told(PipelineModel.load(path), "two"), KEY, "full")
    return both.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(~F.col("one").eqNullSafe(F.col("two"))).alias("changed"),
        F.bool_and(F.col("two.isolation_score").isNotNull() & F.col("two.pred").isNotNull()).alias("all_scored"),
    )


@query(
    "J-19_baseline_errors",
    Q.query(*TRAINED, Q.split(0.25, 26170, stratum=None), select="select config, round(avg(abs(pred - y)), 6) + 0.0 as validation_mae from yy join split_t using (batch_id) where side = 'test' group by 1"),
)
def _(spark, d):
    rows = ordering.stable(table(spark, d))
    held = splits.select_side(rows, splits.make_batch_split(rows, test_fraction=0.25), "test")
    out = None
    for c in boosting.COMPARISON[:2]:
        one = boosting.fit_model(c, held).transform(held).withColumn("config", F.lit(c.name))
        out = one if out is None else out.unionByName(one)
    return rounded(out.groupBy("config").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("validation_mae")))


# --- A bundle of the baselines alone, which SQL can follow to the last digit -------------------


def plain_bundle(spark, d):
    """Calibrated on batches of their own; persistence has the margins, the robust rule flags alone."""
    truth = labels(spark, d).select(*KEY, F.expr(LATENT).alias("is_future_failure"))
    rows = ordering.stable(table(spark, d).join(truth, KEY))
    split = splits.three_way_split(rows)
    train, calibration, test = (splits.select_side(rows, split, s, "split") for s in ("train", "calibration", "test"))
    return training.train_bundle(train, calibration, test, configs=(), stratified="persistence", with_detector=False)[0], test


BUNDLE = (
    *TRAINED, Q.SCORED, Q.THREE_WAY,
    "cal as (select yy.* from yy join parts using (batch_id, profile_id) where split = 'calibration')",
    "ranked as (select config, abs(y - pred) as e, row_number() over (partition by config order by abs(y - pred)) as rn, count(*) over (partition by config) as n from cal)",
    "radius as (select config, max(case when rn = ceil((n + 1) * 0.9) then e end) as r from ranked group by config)",
    "iv as (select t.*, greatest(pred - r, 0) as lo, pred + r as hi from yy t join parts using (batch_id, profile_id) join radius using (config) where split = 'test')",
    SM.replace("from y0)", "from cal where config = 'persistence')"),
    f"""st as (select iv.*, m.stratum, greatest(p_pers + m.lower, 0) as slo, p_pers + m.upper as shi, greatest(p_pers + m.lower_two_sided, 0) as wlo, p_pers + m.upper_two_sided as whi
  from iv join margins m on m.stratum = {STRAT} where config = 'persistence')""",
    f"""rec0 as (select st.*, s.anomaly_score, s.is_anomaly, p_pers * st.upper_limit as final_unit, slo * st.upper_limit as lower_unit, shi * st.upper_limit as upper_unit
  from st join scored s using ({K}))""",
    """rec as (select *, case when current_value >= upper_limit then 'ENGINEER_REVIEW' when is_anomaly and (final_unit >= upper_limit or lower_unit >= upper_limit) then 'ENGINEER_REVIEW'
  when anomaly_score >= 0.8 or final_unit >= upper_limit then 'RETEST' when is_anomaly or upper_unit >= upper_limit then 'MONITOR' else 'ACCEPT' end as recommendation from rec0)""",
)
INSIDE = "avg(case when y between {} and {} then 1.0 else 0.0 end)".format


@query("E-21_bundle_profiles", Q.query(*BUNDLE, select=f"""select config, profile_id, count(*) as components, {Q.r6('avg(abs(pred - y)) as mae_normalized', 'avg(abs(pred - y) * upper_limit) as mae_unit', INSIDE('lo', 'hi') + ' as interval_coverage', 'avg((hi - lo) * upper_limit) as mean_width_unit')} from iv group by 1, 2"""))
def _(spark, d):
    return rounded(training.evaluate_whole(*plain_bundle(spark, d), model="persistence").profiles)


@query("E-21_bundle_stratified", Q.query(*BUNDLE, select=f"""select * from (select config, count(*) as components, {Q.r6(INSIDE('slo', 'shi') + ' as coverage', 'avg(case when y <= shi then 1.0 else 0.0 end) as upper_only_coverage', INSIDE('wlo', 'whi') + ' as two_sided_coverage', 'avg(shi - slo) as mean_width', 'median((shi - slo) * upper_limit) as median_width_unit', 'avg(case when shi >= 1 then 1.0 else 0.0 end) as share_upper_at_or_above_limit', 'avg(case when is_healthy then case when y between slo and shi then 1.0 else 0.0 end end) as coverage_healthy', 'avg(case when not is_healthy then case when y between slo and shi then 1.0 else 0.0 end end) as coverage_nonhealthy')} from st group by 1) a
cross join (select {Q.r6('min(c) as batch_coverage_min', 'max(c) as batch_coverage_max')} from (select batch_id, {INSIDE('slo', 'shi')} as c from st group by 1) x) b"""))
def _(spark, d):
    block = training.evaluate_whole(*plain_bundle(spark, d), model="persistence").stratified
    names = ["config", "components", "coverage", "upper_only_coverage", "two_sided_coverage", "mean_width", "median_width_unit", "share_upper_at_or_above_limit", "coverage_healthy", "coverage_nonhealthy", "batch_coverage_min", "batch_coverage_max"]
    return rounded(block.select(*names))


def alert_sql(alert, on, target, truth, within):
    n = lambda c: f"count(*) filter (({within}) and {c})"
    tp, fn, fp, tn = n(f"({truth}) and ({on})"), n(f"({truth}) and not ({on})"), n(f"not ({truth}) and ({on})"), n(f"not ({truth}) and not ({on})")
    rate = lambda a, b, name: f"round({a} / nullif({b}, 0), 6) + 0.0 as {name}"
    counts = f"{n('true')} as components, {tp} as tp, {fn} as fn, {fp} as fp, {tn} as tn"
    return f"select '{alert}' as alert, '{target}' as target, {counts}, {rate(tp, f'({tp} + {fn})', 'recall')}, {rate(fp, f'({fp} + {tn})', 'fpr')}, {rate(tp, f'({tp} + {fp})', 'precision')} from rec"


ALERTS = {"combined_screening": "recommendation <> 'ACCEPT'", "anomaly_detection": "is_anomaly"}
TARGETS = {"observed_final_crossing": ("y >= 1", "true"), "latent_crossing_without_tester_faults": (LATENT, "not is_tester_fault")}


@query("E-21_bundle_alerts", Q.query(*BUNDLE, select=" union all ".join(alert_sql(a, on, t, *truth) for a, on in ALERTS.items() for t, truth in TARGETS.items())))
def _(spark, d):
    return rounded(training.evaluate_whole(*plain_bundle(spark, d), model="persistence").alerts)


@query("E-21_bundle_actions", Q.query(*BUNDLE, select="""select 'action' as kind, recommendation as level, count(*) as components, cast(null as double) as alert_rate from rec group by 2
union all select 'scenario', scenario, count(*), round(avg(case when recommendation <> 'ACCEPT' then 1.0 else 0.0 end), 6) + 0.0 from rec group by 2"""))
def _(spark, d):
    found = training.evaluate_whole(*plain_bundle(spark, d), model="persistence")
    actions = found.actions.select(F.lit("action").alias("kind"), F.col("recommendation").alias("level"), "components", F.lit(None).cast("double").alias("alert_rate"))
    return rounded(actions.unionByName(found.scenarios.select(F.lit("scenario").alias("kind"), F.col("scenario").alias("level"), "components", "alert_rate")))


@query("J-20_calibrated_records", Q.query(*BUNDLE, select=f"""select {K}, 'persistence' as forecast_model, concat('slope_z_stratum_', cast(stratum as varchar)) as interval_stratum,
 {Q.r6('final_unit as predicted_final_value', 'lower_unit as prediction_lower', 'upper_unit as prediction_upper', 'wlo * upper_limit as prediction_lower_two_sided', 'whi * upper_limit as prediction_upper_two_sided', '0.8 as interval_nominal_coverage')}, recommendation from rec"""))
def _(spark, d):
    bundle, test = plain_bundle(spark, d)
    out = bundle.screen(test, model="persistence")
    units = ["predicted_final_value", "prediction_lower", "prediction_upper", "prediction_lower_two_sided", "prediction_upper_two_sided"]
    return rounded(out.select(*KEY, "forecast_model", "interval_stratum", *units, "interval_nominal_coverage", "recommendation"))


@query("K-20_model_invariance", Q.query(*TRAINED, select="select count(*) as compared, 0 as changed from z"))
def _(spark, d):
    """A fitted ridge forecast and a fitted forest give every early score again when later readings grow a million times."""
    r = READ(spark, d)
    stressed = r.withColumn("measurement_value", F.when(F.col("hours") > 24, F.col("measurement_value") * 1e6).otherwise(F.col("measurement_value")))

    def early(readings):
        extras = feats.capacitor_extras(with_conditions(readings.filter(F.col("hours").isin(S.CHECKPOINTS))))
        f = feats.build_component_features(readings, grid=tables_grid(), carry=CARRY, hot=HEAT(spark, d).peer)
        return ordering.stable(screening.augment_features(f.join(extras, KEY), hot=HEAT(spark, d).peer))

    before, after = early(r), early(stressed)
    model, forest = boosting.fit_model(boosting.RIDGE, ordering.stable(full_table(spark, d))), iforest.fit(before)
    told = lambda f, end: model.transform(forest.score(f, hot=HEAT(spark, d).table)).select(*KEY, F.round("pred", 9).alias(f"p{end}"), F.round("isolation_score", 9).alias(f"s{end}"))
    both = told(before, 0).join(told(after, 1), KEY, "full")
    same = F.col("p0").eqNullSafe(F.col("p1")) & F.col("s0").eqNullSafe(F.col("s1")) & F.col("p0").isNotNull() & F.col("s0").isNotNull()
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("changed"))


# --- Jobs with a forest: rows, truth counts and ranges that any forest must keep -----------------

FOREST = ["isolation_forest", "combined"]


def review_rows(df, keys):
    rates = [c for c in ("review_recall", "false_positive_rate", "precision", "defect_recall") if c in df.columns]
    tp, fn, fp, tn = (F.col(c) for c in ("true_positive", "false_negative", "false_positive", "true_negative"))
    sound = F.col("flagged_components") == tp + fp
    for c in rates:
        sound = sound & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))
    return df.select(*keys, "method", "evaluated_components", (tp + fn).alias("faulty"), (fp + tn).alias("sound"), sound.alias("consistent"))


def review_sql(keys, methods):
    return f"select {keys}, method, count(*) as evaluated_components, count(*) filter (truth) as faulty, count(*) filter (not truth) as sound, true as consistent from m cross join (select unnest({methods}) as method) x group by {keys}, method"


@query("K-05_forest_rows", Q.query(*HELD, select=review_sql("as_of_hour", ["fixed_limit", "robust_mad", *FOREST])))
def _(spark, d):
    r = READ(spark, d)
    return review_rows(evaluation.evaluate_dataset(r, labels(spark, d), splits.split_batches(r), grid=tables_grid(), heat=HEAT(spark, d))[0], ["as_of_hour"])


@query("K-07_forest_rows", Q.query(*REPEATED, select=review_sql("split_seed, as_of_hour", ["fixed_limit", "robust_mad", *FOREST])))
def _(spark, d):
    return review_rows(evaluation.evaluate_repeated_splits(READ(spark, d), labels(spark, d), SEEDS, grid=tables_grid(), heat=HEAT(spark, d)), ["split_seed", "as_of_hour"])


def harness_rows(df, *keys):
    kept = (F.col("true_positives") + F.col("false_negatives") == F.col("n_defects")) & (F.col("false_positives") + F.col("true_negatives") == F.col("n_healthy"))
    return df.select(*keys, "as_of_hour", "method", "n_components", "n_defects", "n_healthy", "n_tester_faults", kept.alias("consistent"))


HARNESS_COUNTS = "count(*) as n_components, count(*) filter (d) as n_defects, count(*) filter (h) as n_healthy, count(*) filter (is_tester_fault) as n_tester_faults, true as consistent"


@query("K-09_forest_rows", Q.query(*HELD, select=f"select as_of_hour, method, {HARNESS_COUNTS} from m cross join (select unnest({S.METHODS}) as method) x group by 1, 2"))
def _(spark, d):
    r = READ(spark, d)
    rows = evaluation.holdout(r, labels(spark, d), splits.split_batches(r), grid=tables_grid(), heat=HEAT(spark, d))
    return harness_rows(metrics.harness_metrics(rows, S.METHODS))


@query("K-10_forest_rows", Q.query(*LADDER_ROWS, select=f"select method, count(*) as n_defects, true as nested from (select distinct component_id, batch_id from m where is_defect) c cross join (select unnest({S.METHODS}) as method) x group by 1"))
def _(spark, d):
    r = READ(spark, d)
    out = evaluation.early_warning_ladder(r, labels(spark, d), splits.split_batches(r), hours=LADDER, grid=tables_grid(), heat=HEAT(spark, d))[2]
    ever = F.col("n_ever_flagged")
    return out.select("method", "n_defects", ((ever <= F.col("n_defects")) & (F.col("n_flagged_before_crossing") + F.col("n_flagged_never_crossing") <= ever)).alias("nested"))


@query("K-12_forest_rows", Q.query(*HELD, select=f"select fit_scope, as_of_hour, method, {HARNESS_COUNTS} from m cross join (select unnest({FOREST}) as method) x cross join (values ('per_family'), ('pooled')) f(fit_scope) group by 1, 2, 3"))
def _(spark, d):
    r = READ(spark, d)
    return harness_rows(evaluation.compare_fit_scopes(r, labels(spark, d), splits.split_batches(r), grid=tables_grid(), heat=HEAT(spark, d)), "fit_scope")
