"""Registered queries: joins, aggregations, windows, ordering, set operations, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks import sql as Q
from checks.registry import (
    BOUNDS, CARRY, DIRTY, ERR, K, KEY, PROFILE_SQL, READ, REC, STRATA_LABELS, STRATUM_SQL, TAGS, dirty, error_rows,
    HEAT, event_profiles, feature_table, labels, query, records, rounded, strata_labels, tables_grid, unscored,
)
from peerscreen import schema as S
from peerscreen.functions import columns as C
from peerscreen.operators import decide, features as feats, forecast, intervals, metrics, ordering, peers, quality, splits
from peerscreen.plans import evaluation, screening

FEAT = (Q.READINGS, Q.features())
ZED = (*FEAT, Q.Z)
SCO = (*ZED, Q.SCORED)
SPLIT = Q.split(0.4, 7)
SIDE = "side as (select scored.* from scored join split_t using (batch_id) where side = 'test')"
HELD = (Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.SCORED, SPLIT, SIDE, Q.TRUTH)
PLAIN = ["fixed_limit", "robust_mad", "robust_mad_strict"]
r6 = Q.r6


def held_out(spark, d):
    """Held-out rows of the plain methods with their truth."""
    r = READ(spark, d)
    return evaluation.holdout(r, labels(spark, d), splits.split_batches(r), with_forest=False, grid=tables_grid(), heat=HEAT(spark, d))


# --- D: joins -------------------------------------------------------------------


@query("D-01_scored_with_truth", Q.query(Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.SCORED, select=f"select {K}, {r6('s.anomaly_score as anomaly_score')}, l.scenario as scenario, l.is_defect as is_defect from scored s join labels_t l using ({K})"))
def _(spark, d):
    scored = screening.score(feature_table(spark, d))
    return rounded(metrics.join_truth(scored, labels(spark, d), ["scenario", "is_defect"]).select(*KEY, "anomaly_score", "scenario", "is_defect"))


@query("D-02_screened_with_labels", Q.query(*HELD, select=f"select {K}, scenario, is_healthy, f_fixed_limit as fixed_limit_flag, f_robust_mad as robust_mad_flag, f_robust_mad_strict as robust_mad_strict_flag from m"))
def _(spark, d):
    return held_out(spark, d).select(*KEY, "scenario", "is_healthy", "fixed_limit_flag", "robust_mad_flag", "robust_mad_strict_flag")


@query("D-03_features_with_final_value", Q.query(*ERR, select=f"select {K}, {r6('limit_fraction', 'y')} from y0"))
def _(spark, d):
    out = forecast.joined_labels(feature_table(spark, d), labels(spark, d)).filter("y is not null")
    return rounded(out.select(*KEY, "limit_fraction", "y"))


@query("D-04_features_with_extras", Q.query(Q.READINGS, f"pair as (select r.* from readings r where hours in (0, 24))", Q.features(source="pair"), f"cap as (select {K}, arg_min(measurement_value, hours) / 50.0 as c0 from readings where hours in (0, 24) group by {K})", select=f"select {K}, {r6('limit_fraction', 'c0 as initial_capacitance_fraction')} from feat join cap using ({K})"))
def _(spark, d):
    early = quality.early_readings(READ(spark, d)).withColumns({"nominal_capacitance_nf": F.lit(50.0), "capacitance_nf": F.col("measurement_value")})
    f = feats.history_features(early, grid=S.CHECKPOINTS)
    return rounded(f.join(feats.capacitor_extras(early), KEY).select(*KEY, "limit_fraction", "initial_capacitance_fraction"))


@query("D-05_outcomes_of_records", Q.query(*SCO, select=f"select r.component_id, r.batch_id, r.component_family, r.measurement_name, r.hours, {r6('r.measurement_value as measurement_value')} from readings r join scored using ({K}) where r.hours > 24"))
def _(spark, d):
    later = quality.later_readings(READ(spark, d))
    scored = feature_table(spark, d).select(*KEY)
    return rounded(later.join(scored, KEY).select(*KEY, "hours", "measurement_value"))


@query("D-06_identity_lookup", Q.query(*REC, select=f"select {K}, {r6('anomaly_score', 'predicted_final_value', 'limit_fraction')} from records"))
def _(spark, d):
    f = feature_table(spark, d)
    scored = screening.score(f).select(*KEY, "anomaly_score")
    ahead = f.select(*KEY, (forecast.persistence() * F.col("upper_limit")).alias("predicted_final_value"))
    return rounded(f.select(*KEY, "limit_fraction").join(scored, KEY, "left").join(ahead, KEY, "left"))


@query("D-07_eligible_readings", Q.query(Q.READINGS, Q.UNSCORED, select=f"select r.component_id, r.batch_id, r.component_family, r.measurement_name, r.hours from readings r anti join uns using ({K})"))
def _(spark, d):
    verdict = quality.eligibility(READ(spark, d), family="EVT", measurement=None)
    good = verdict.filter(F.size("reasons") == 0).select(*KEY)
    return READ(spark, d).join(good, KEY, "left_semi").select(*KEY, "hours")


@query("D-08_unknown_identities", Q.query(*DIRTY, select=f"select distinct {K} from dirty anti join readings using ({K})"))
def _(spark, d):
    return dirty(spark, d).select(*KEY).distinct().join(READ(spark, d).select(*KEY), KEY, "left_anti")


FOLDS = """folds as (select batch_id, profile_id, cast((row_number() over (order by profile_id, batch_id) - 1) % 5 as int) as fold from (select distinct batch_id, profile_id from readings) b)"""


@query("D-09_batch_dimension", Q.query(Q.READINGS, FOLDS, select="select fold, count(*) as readings, count(distinct component_id) as components from readings join folds using (batch_id, profile_id) group by fold"))
def _(spark, d):
    r = READ(spark, d)
    return r.join(splits.assign_batch_folds(r).drop("profile_id"), "batch_id").groupBy("fold").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("component_id").alias("components"))


@query("D-10_profile_dimension", Q.query(Q.READINGS, PROFILE_SQL, select=f"select {K}, pid as profile_id, status from (select distinct {K} from readings) h left join prof using (component_family, measurement_name)"))
def _(spark, d):
    return quality.resolve_profiles(READ(spark, d), event_profiles(spark)).select(*KEY, "profile_id", "status")


@query("D-11_range_bounds", Q.query(*FEAT, select=f"select {K}, {r6('temperature_c', 'current_value')} from feat where temperature_c not between 120.5 and 123.0 or current_value not between 5.0 and 110.0"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return rounded(decide.outside_ranges(f, BOUNDS).filter(F.size("out_of_training_range_features") > 0).select(*KEY, "temperature_c", "current_value"))


@query("D-12_external_features", Q.query(*FEAT, select=f"select {K}, {r6('f.slope as slope', 'x.peak as peak')} from feat f join (select {K}, max(measurement_value) as peak from readings group by {K}) x using ({K})"))
def _(spark, d):
    outside = READ(spark, d).groupBy(*KEY).agg(F.max("measurement_value").alias("peak"))
    return rounded(feats.history_features(READ(spark, d), grid=tables_grid()).select(*KEY, "slope").join(outside, KEY))


@query("D-13_paired_batches", Q.query(*ERR, select=f"""select config, count(*) as batches_total, count(*) filter (dlt < -1e-12) as batches_beating_baseline, {r6('avg(dlt) as delta_mean', 'coalesce(stddev_samp(dlt), 0) as delta_std', 'coalesce(stddev_samp(dlt) / sqrt(count(*)), 0) as delta_se')}
from (select a.config, a.mae - b.mae as dlt from (select config, batch_id, avg(abs(pred - y)) as mae from yy group by config, batch_id) a join (select batch_id, avg(abs(p_pers - y)) as mae from y0 group by batch_id) b using (batch_id)) x group by config"""))
def _(spark, d):
    return rounded(metrics.paired_deltas(metrics.batch_mae(error_rows(spark, d))))


@query("D-14_actions_with_truth", Q.query(Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.SCORED, Q.RECORDS, select="select recommendation, l.scenario as scenario, count(*) as n from records left join labels_t l using (component_id, batch_id, component_family, measurement_name) group by all"))
def _(spark, d):
    joined = records(spark, d).join(labels(spark, d).select(*KEY, "scenario"), KEY, "left")
    return joined.groupBy("recommendation", "scenario").agg(F.count(F.lit(1)).alias("n"))


@query("D-15_predictions_with_future", Q.query(*REC, select=f"select {K}, {r6('predicted_final_value', 'f.v as observed', 'abs(predicted_final_value - f.v) as absolute_error')}, f.v between prediction_lower and prediction_upper as inside from records join (select {K}, max(measurement_value) as v from readings where hours = 168 group by {K}) f using ({K})"))
def _(spark, d):
    final = READ(spark, d).filter("hours = 168").groupBy(*KEY).agg(F.max("measurement_value").alias("observed"))
    out = records(spark, d).join(final, KEY)
    p = F.col("predicted_final_value")
    return rounded(out.select(*KEY, "predicted_final_value", "observed", F.abs(p - F.col("observed")).alias("absolute_error"), F.col("observed").between(F.col("prediction_lower"), F.col("prediction_upper")).alias("inside")))


# --- E: aggregations ---------------------------------------------------------------

BASE = ["initial_value", "current_value", "slope", "variability"]


@query("E-01_component_features", Q.query(*FEAT, select=f"select {K}, as_of_hour, last_observed_hour, n_observations, upper_limit, {r6(*BASE)} from feat"))
def _(spark, d):
    return rounded(feats.history_features(READ(spark, d)).select(*KEY, "as_of_hour", "last_observed_hour", "n_observations", "upper_limit", *BASE))


@query("E-02_acceleration", Q.query(Q.READINGS, Q.features((168.0,)), select=f"select {K}, n_observations, {r6('acceleration')} from feat"))
def _(spark, d):
    return rounded(feats.history_features(READ(spark, d), 168.0, grid=tables_grid()).select(*KEY, "n_observations", "acceleration"))


@query("E-02_acceleration_ranked", Q.query(Q.READINGS, Q.features((168.0,)), select=f"select {K}, n_observations, {r6('acceleration')} from feat"))
def _(spark, d):
    return rounded(feats.history_features(READ(spark, d), 168.0, grid=None).select(*KEY, "n_observations", "acceleration"))


@query("E-03_peer_statistics", Q.query(Q.READINGS, select=f"""select batch_id, component_family, measurement_name, count(*) as sample_size, {r6('max(med) as median', 'median(abs(measurement_value - med)) as mad', 'min(measurement_value) as peer_min', 'max(measurement_value) as peer_max')},
 count(*) >= 8 as sufficient, case when count(*) < 8 then 'Only ' || cast(count(*) as varchar) || ' comparable peers were available; at least 8 are required before batch-relative statistics are treated as reliable. Values are shown for context only.' end as note
from (select *, median(measurement_value) over (partition by batch_id, component_family, measurement_name) as med from readings where hours = 24) x group by batch_id, component_family, measurement_name"""))
def _(spark, d):
    return rounded(peers.peer_statistics(READ(spark, d), hot=HEAT(spark, d).peer).drop("status"))


@query("E-04_decision_counts", Q.query(*REC, select="select " + ", ".join(f"count(*) filter (recommendation = '{x}') as \"{x}\"" for x in S.URGENCY) + " from records"))
def _(spark, d):
    return decide.decision_counts(records(spark, d))


@query("E-04_counts_with_unscored", Q.query(*REC, Q.UNSCORED, select="select recommendation, count(*) as records, count(*) filter (status = 'u') as unscored from (select recommendation, 's' as status from records union all select 'RETEST', 'u' from uns) x group by recommendation"))
def _(spark, d):
    return decide.decision_counts_with_unscored(records(spark, d), unscored(spark, d))


@query("E-04_summary", Q.query(*REC, Q.UNSCORED, select="select (select count(*) from records) + (select count(*) from uns) as component_count, (select count(*) from records) as scored_count, (select count(*) from uns) as unscored_count, (select count(*) from records where is_anomaly and current_value < upper_limit) as within_limit_but_anomalous"))
def _(spark, d):
    return decide.summary(records(spark, d), unscored(spark, d))


URG = "case recommendation when 'ACCEPT' then 0 when 'MONITOR' then 1 when 'RETEST' then 2 when 'ENGINEER_REVIEW' then 3 end"


@query("E-05_component_summary", Q.query(*REC, Q.UNSCORED, select=f"""select component_id, batch_id, component_family, arg_max(recommendation, {URG}) as summary_recommendation, count(recommendation) as scored_measurement_count,
 count(*) filter (recommendation is null) as unscored_measurement_count, count(*) filter (recommendation is null) > 0 as partial_coverage, string_agg(distinct measurement_name, '; ' order by measurement_name) as measurement_names
from (select {K}, recommendation from records union all select {K}, null from uns) x group by component_id, batch_id, component_family"""))
def _(spark, d):
    return rounded(decide.component_summary(records(spark, d), unscored(spark, d)))


@query("E-06_dataset_counts", Q.query(Q.READINGS, select=f"select count(distinct batch_id) as batches, count(distinct component_id) as components, count(distinct ({K})) as histories, count(*) as rows from readings"))
def _(spark, d):
    return quality.dataset_counts(READ(spark, d))


@query("E-07_review_metrics", Q.query(*HELD, select=Q.review(["fixed_limit", "robust_mad"])))
def _(spark, d):
    return rounded(metrics.review_metrics(held_out(spark, d), ["fixed_limit", "robust_mad"]))


@query("E-08_harness_metrics", Q.query(*HELD, select=Q.harness(PLAIN)))
def _(spark, d):
    return rounded(metrics.harness_metrics(held_out(spark, d), PLAIN).drop("method_label"))


SCEN = " union all ".join(f"select '{m}' as method, scenario, count(*) as components, count(*) filter (f_{m}) as flagged, round(avg(case when f_{m} then 1.0 else 0.0 end), 6) + 0.0 as flag_rate from m group by scenario" for m in PLAIN)


@query("E-09_scenario_rates", Q.query(*HELD, select=SCEN))
def _(spark, d):
    return rounded(metrics.scenario_rates(held_out(spark, d), PLAIN))


@query("E-10_scenario_rates_wide", Q.query(*HELD, select="select scenario, count(*) as n_components, " + ", ".join(f"round(avg(case when f_{m} then 1.0 else 0.0 end), 6) + 0.0 as {m}" for m in PLAIN) + " from m group by scenario"))
def _(spark, d):
    return rounded(metrics.scenario_rates_wide(held_out(spark, d), PLAIN))


SEEDS = (101, 211, 307, 401, 503)
SEEDED = f"""sp as (
  select split_seed, batch_id, case when pos <= greatest(1, least(cast(round_even(n * (1.0 / 3.0), 0) as bigint), n - 1)) then 'test' else 'train' end as side
  from (select split_seed, batch_id, row_number() over (partition by split_seed order by md5(concat(batch_id, ':', cast(split_seed as varchar)))) as pos, count(*) over (partition by split_seed) as n
        from (select distinct batch_id from readings) b cross join (values {', '.join(f'({s})' for s in SEEDS)}) v(split_seed)) c)"""
REPEATED = (Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.SCORED, SEEDED, "side as (select scored.*, sp.split_seed from scored join sp using (batch_id) where side = 'test')", Q.TRUTH)


def repeated(spark, d):
    return evaluation.evaluate_repeated_splits(READ(spark, d), labels(spark, d), SEEDS, with_forest=False, grid=tables_grid(), heat=HEAT(spark, d))


REVIEWED = Q.review(["fixed_limit", "robust_mad"], "split_seed, as_of_hour").replace(", 6) + 0.0", ", 12)")


@query("E-11_split_summary", Q.query(*REPEATED, f"rv as ({REVIEWED})", select="select method, " + ", ".join(f"round(avg({c}), 6) + 0.0 as {c}_mean, round(stddev_samp({c}), 6) + 0.0 as {c}_std" for c in metrics.SPLIT_SUMMARY) + " from rv group by method"))
def _(spark, d):
    return rounded(metrics.summarize_repeated_splits(repeated(spark, d)))


LADDER = (24.0, 48.0, 72.0, 96.0, 120.0, 144.0)
LADDER_ROWS = (Q.READINGS, Q.LABELS, Q.features(LADDER), Q.Z, Q.SCORED, SPLIT, SIDE, Q.TRUTH)
LEADS = "leads as (" + " union all ".join(f"""select '{m}' as method, component_id, batch_id, max(scenario) as scenario, bool_or(is_defect) as is_defect, bool_or(is_tester_fault) as is_tester_fault,
 min(anomaly_onset_hour) as anomaly_onset_hour, min(case when f_{m} then as_of_hour end) as first_flag_hour, min(first_exceedance_hour) as first_exceedance_hour from m group by component_id, batch_id""" for m in PLAIN) + "), lt as (select *, first_exceedance_hour - first_flag_hour as lead_hours from leads)"


def ladder(spark, d):
    r = READ(spark, d)
    return evaluation.early_warning_ladder(r, labels(spark, d), splits.split_batches(r), hours=LADDER, with_forest=False, grid=tables_grid(), heat=HEAT(spark, d))


@query("E-12_lead_summary", Q.query(*LADDER_ROWS, LEADS, select=f"""select method, count(*) as n_defects, count(first_flag_hour) as n_ever_flagged, count(*) filter (lead_hours > 0) as n_flagged_before_crossing,
 count(*) filter (first_flag_hour is not null and first_exceedance_hour is null) as n_flagged_never_crossing,
 {r6('median(first_flag_hour) as median_first_flag_hour', 'median(case when lead_hours > 0 then lead_hours end) as median_lead_hours', 'avg(case when lead_hours > 0 then lead_hours end) as mean_lead_hours')} from lt where is_defect group by method"""))
def _(spark, d):
    return rounded(ladder(spark, d)[2])


NO_FORECAST = """noforecast as (select *, case when current_value >= upper_limit then 'ENGINEER_REVIEW' when anomaly_score >= 0.8 then 'RETEST' when is_anomaly then 'MONITOR' else 'ACCEPT' end as recommendation from m)"""


@query("E-13_action_summary", Q.query(*HELD, NO_FORECAST, select="select recommendation, count(*) as n, count(*) filter (is_defect) as n_true_defects, count(*) filter (is_tester_fault) as n_tester_faults, round(count(*) / sum(count(*)) over (), 6) + 0.0 as share from noforecast group by recommendation"))
def _(spark, d):
    return rounded(evaluation.summarise_recommendations(held_out(spark, d), labels(spark, d)))


CONF = """count(*) filter (y >= 1 and pred >= 1) as crossing_tp, count(*) filter (y >= 1 and pred < 1) as crossing_fn, count(*) filter (y < 1 and pred >= 1) as crossing_fp, count(*) filter (y < 1 and pred < 1) as crossing_tn,
 round(count(*) filter (y >= 1 and pred >= 1) / nullif(count(*) filter (y >= 1), 0), 6) + 0.0 as crossing_recall, round(count(*) filter (y < 1 and pred >= 1) / nullif(count(*) filter (y < 1), 0), 6) + 0.0 as crossing_fpr,
 round(count(*) filter (y >= 1 and pred >= 1) / nullif(count(*) filter (pred >= 1), 0), 6) + 0.0 as crossing_precision"""


@query("E-14_classification_block", Q.query(*ERR, select=f"select config, {CONF} from yy group by config"))
def _(spark, d):
    return rounded(error_rows(spark, d).groupBy("config").agg(*metrics.confusion(F.col("y") >= 1.0, F.col("pred") >= 1.0, "crossing_")))


FM = f"""count(*) as components, {r6('avg(abs(pred - y)) as mae_normalized', 'sqrt(avg((pred - y) * (pred - y))) as rmse_normalized', 'avg(pred - y) as mean_signed_error', 'avg(abs((pred - y) * upper_limit)) as mae_unit', 'median(abs(pred - y)) as median_abs_error')}, {CONF},
 count(*) filter (limit_fraction >= 1) as already_components, count(*) filter (limit_fraction >= 1 and y >= 1 and pred >= 1) as already_tp, count(*) filter (limit_fraction >= 1 and y >= 1 and pred < 1) as already_fn,
 count(*) filter (limit_fraction < 1 and y >= 1 and pred >= 1) as new_tp, count(*) filter (limit_fraction < 1 and y < 1 and pred >= 1) as new_fp,
 round(count(*) filter (limit_fraction < 1 and y >= 1 and pred >= 1) / nullif(count(*) filter (limit_fraction < 1 and y >= 1), 0), 6) + 0.0 as new_recall,
 round(count(*) filter (limit_fraction < 1 and y < 1 and pred >= 1) / nullif(count(*) filter (limit_fraction < 1 and y < 1), 0), 6) + 0.0 as new_fpr,
 {r6('avg(case when pred <= 0 then 1.0 else 0.0 end) as share_clipped_at_zero', 'avg(case when is_healthy then abs(pred - y) end) as healthy_mae', 'avg(case when not is_healthy then abs(pred - y) end) as nonhealthy_mae', 'avg(case when is_healthy then pred - y end) as healthy_mean_signed_error')}"""
LATENT = "is_defect and first_exceedance_hour is not null"
LATENT_FM = f"""count(*) filter (not is_tester_fault and {LATENT} and pred >= 1) as latent_tp, count(*) filter (not is_tester_fault and {LATENT} and pred < 1) as latent_fn,
 count(*) filter (not is_tester_fault and not ({LATENT}) and pred >= 1) as latent_fp, count(*) filter (not is_tester_fault and not ({LATENT}) and pred < 1) as latent_tn,
 round(count(*) filter (not is_tester_fault and {LATENT} and pred >= 1) / nullif(count(*) filter (not is_tester_fault and {LATENT}), 0), 6) + 0.0 as latent_recall,
 round(count(*) filter (not is_tester_fault and not ({LATENT}) and pred >= 1) / nullif(count(*) filter (not is_tester_fault and not ({LATENT})), 0), 6) + 0.0 as latent_fpr,
 round(count(*) filter (not is_tester_fault and {LATENT} and pred >= 1) / nullif(count(*) filter (not is_tester_fault and pred >= 1), 0), 6) + 0.0 as latent_precision"""


@query("E-15_forecast_metrics", Q.query(*ERR, select=f"select config, {FM}, {LATENT_FM} from yy group by config"))
def _(spark, d):
    rows = error_rows(spark, d).withColumn("is_future_failure", F.expr(LATENT))
    return rounded(metrics.forecast_metrics(rows, keys=["config"], hot=HEAT(spark, d).table))


DIMS = ["profile_id", "scenario", "stratum", "is_healthy"]
GROUPED = f"count(*) as components, {r6('avg(abs(pred - y)) as mae_normalized', 'avg(pred - y) as mean_signed_error', 'avg(abs((pred - y) * upper_limit)) as mae_unit')}, {CONF}"
STRAT_ROWS = f"ys as (select yy.*, case when is_tester_fault then case when (cast(floor(cast(substr(component_id, 2) as int) / 10) as int)) % 2 = 0 then 'tester_fault_onset_0_12' else 'tester_fault_onset_72' end when is_defect then case when anomaly_onset_hour > 24 then 'defect_onset_gt24' else 'defect_onset_le24' end else 'healthy' end as stratum from yy)"


@query("E-16_grouped_metrics", Q.query(*ERR, STRAT_ROWS, select=" union all ".join([f"select config, 'all' as dimension, cast(null as varchar) as level, {GROUPED} from ys group by config"] + [f"select config, '{x}' as dimension, cast({x} as varchar) as level, {GROUPED} from ys group by config, {x}" for x in DIMS])))
def _(spark, d):
    onset = strata_labels(spark, d).select(*KEY, "tester_fault_onset_hour")
    rows = error_rows(spark, d).join(onset, KEY).withColumn("stratum", metrics.retrospective_stratum())
    return rounded(metrics.grouped_forecast_metrics(rows, DIMS, ["config"]))


def fold_rows(spark, d):
    return error_rows(spark, d).join(splits.assign_batch_folds(READ(spark, d)).drop("profile_id"), "batch_id")


def per_fold(spark, d):
    return metrics.forecast_metrics(fold_rows(spark, d), keys=["config", "fold"], medians=False)


PF = f"pf as (select config, fold, avg(abs(pred - y)) as mae_normalized, sqrt(avg((pred - y) * (pred - y))) as rmse_normalized, avg(abs((pred - y) * upper_limit)) as mae_unit, avg(pred - y) as mean_signed_error, avg(case when is_healthy then abs(pred - y) end) as healthy_mae, avg(case when not is_healthy then abs(pred - y) end) as nonhealthy_mae from yy join folds using (batch_id, profile_id) group by config, fold)"


@query("E-17_fold_summary", Q.query(*ERR, FOLDS, PF, select="select config, count(*) as folds, " + ", ".join(r6(f"avg({c}) as {c}_mean", f"coalesce(stddev_samp({c}), 0) as {c}_std", f"min({c}) as {c}_min", f"max({c}) as {c}_max") for c in metrics.FOLD_COLUMNS) + " from pf group by config"))
def _(spark, d):
    return rounded(metrics.fold_summary(per_fold(spark, d)).drop("per_fold"))


@query("E-18_batch_mae", Q.query(*ERR, select=f"select config, batch_id, {r6('avg(abs(pred - y)) as mae')} from yy group by config, batch_id"))
def _(spark, d):
    return rounded(metrics.batch_mae(error_rows(spark, d)))


@query("E-18_folds_beating", Q.query(*ERR, FOLDS, PF, select="select a.config as config, count(*) filter (a.mae_normalized < b.mae_normalized) as folds_beating_baseline, count(*) as folds from pf a join pf b on a.fold = b.fold and b.config = 'persistence' group by a.config"))
def _(spark, d):
    return metrics.folds_beating(per_fold(spark, d))


@query("E-19_comparison_table", Q.query(*ERR, FOLDS, PF, select=f"""select p.config as config, {r6('p.mae as mae_normalized', 'f.fm as mae_fold_mean', 'f.fs as mae_fold_std')}, q.w as folds_beating_baseline,
 p.mae < base.mae - 1e-12 and q.w >= ceil(q.n * 0.8) and coalesce(p.hm <= 0.02, true) as eligible
from (select config, avg(abs(pred - y)) as mae, avg(case when is_healthy then abs(pred - y) end) as hm from yy group by config) p
join (select config, avg(mae_normalized) as fm, coalesce(stddev_samp(mae_normalized), 0) as fs from pf group by config) f using (config)
join (select a.config, count(*) filter (a.mae_normalized < b.mae_normalized) as w, count(*) as n from pf a join pf b on a.fold = b.fold and b.config = 'persistence' group by a.config) q using (config)
cross join (select avg(abs(p_pers - y)) as mae from y0) base"""))
def _(spark, d):
    rows = fold_rows(spark, d)
    table = metrics.comparison_table(
        metrics.forecast_metrics(rows, keys=["config"]), metrics.forecast_metrics(rows, keys=["config", "fold"], medians=False), metrics.batch_mae(rows)
    )
    return rounded(table.select("config", "mae_normalized", "mae_fold_mean", "mae_fold_std", "folds_beating_baseline", "eligible"))


IV = "iv as (select *, greatest(pred - 0.25, 0) as lo, pred + 0.25 as hi from yy)"
IVM = f"""count(*) as components, {r6('avg(case when y >= lo and y <= hi then 1.0 else 0.0 end) as coverage', 'avg(case when y <= hi then 1.0 else 0.0 end) as upper_only_coverage', 'avg(hi - lo) as mean_width', 'median(hi - lo) as median_width',
 'avg(case when hi < 1 then 1.0 else 0.0 end) as share_upper_below_limit', 'avg(case when lo >= 1 then 1.0 else 0.0 end) as share_lower_at_or_above_limit', 'avg(case when is_healthy then case when y >= lo and y <= hi then 1.0 else 0.0 end end) as coverage_healthy',
 'avg(case when not is_healthy then case when y >= lo and y <= hi then 1.0 else 0.0 end end) as coverage_nonhealthy', 'avg(case when y >= 1 then case when y >= lo and y <= hi then 1.0 else 0.0 end end) as coverage_crossers', 'avg(case when y >= 1 then case when hi >= 1 then 1.0 else 0.0 end end) as crossers_with_upper_at_limit')}"""


@query("E-20_interval_metrics", Q.query(*ERR, IV, select=f"""select * from (select config, {IVM} from iv group by config) a join (select config, {r6('min(c) as batch_coverage_min', 'max(c) as batch_coverage_max', 'coalesce(stddev_samp(c), 0) as batch_coverage_std')}
from (select config, batch_id, avg(case when y >= lo and y <= hi then 1.0 else 0.0 end) as c from iv group by config, batch_id) x group by config) b using (config)"""))
def _(spark, d):
    rows = error_rows(spark, d).withColumns({"lower": F.greatest(F.col("pred") - 0.25, F.lit(0.0)), "upper": F.col("pred") + 0.25})
    return rounded(intervals.interval_metrics(rows, keys=["config"], hot=HEAT(spark, d).table))


@query("E-21_model_evaluation", Q.query(*ERR, IV, select=f"""select config, profile_id, count(*) as components, {r6('avg(abs(pred - y)) as mae_normalized', 'avg(case when y >= lo and y <= hi then 1.0 else 0.0 end) as interval_coverage', 'avg((hi - lo) * upper_limit) as mean_width_unit')}, {CONF} from iv group by config, profile_id"""))
def _(spark, d):
    y, p = F.col("y"), F.col("pred")
    lo, hi = F.greatest(p - 0.25, F.lit(0.0)), p + 0.25
    out = error_rows(spark, d).groupBy("config", "profile_id").agg(
        F.count(F.lit(1)).alias("components"), F.avg(F.abs(p - y)).alias("mae_normalized"),
        F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("interval_coverage"), F.avg((hi - lo) * F.col("upper_limit")).alias("mean_width_unit"),
        *metrics.confusion(y >= 1.0, p >= 1.0, "crossing_"),
    )
    return rounded(out)


def nth(expr, rank):
    return f"max(case when rn = {rank} then {expr} end)"


@query("E-22_conformal_radius", Q.query(*ERR, "rk as (select config, abs(y - pred) as e, row_number() over (partition by config order by abs(y - pred)) as rn, count(*) over (partition by config) as n from yy)", select=f"select config, max(n) as n, {r6(nth('e', 'ceil((n + 1) * 0.9)') + ' as radius')} from rk group by config"))
def _(spark, d):
    rows = error_rows(spark, d).withColumn("residual", F.col("y") - F.col("pred"))
    return rounded(intervals.conformal_radius(rows, "residual", keys=["config"], hot=HEAT(spark, d).table))


SB = "rk as (select config, y - pred as e, row_number() over (partition by config order by y - pred) as rn, count(*) over (partition by config) as n from yy)"
RANKS = {"lower": "floor((n + 1) * 0.1)", "upper": "ceil((n + 1) * 0.9)", "lower_two_sided": "floor((n + 1) * 0.05)", "upper_two_sided": "ceil((n + 1) * 0.95)"}


@query("E-23_signed_bounds", Q.query(*ERR, SB, select="select config, max(n) as n, " + r6(*[f"{nth('e', r)} as {m}" for m, r in RANKS.items()]) + " from rk group by config"))
def _(spark, d):
    rows = error_rows(spark, d).withColumn("residual", F.col("y") - F.col("pred"))
    return rounded(intervals.signed_bounds(rows, "residual", keys=["config"], hot=HEAT(spark, d).table))


STRAT = "case when slope_batch_robust_z < 2 then 0 when slope_batch_robust_z < 5 then 1 else 2 end"
SM = f"""res as (select {STRAT} as stratum, y - p_pers as e from y0),
own as (select stratum, max(n) as n, {', '.join(f"{nth('e', r)} as {m}" for m, r in RANKS.items())} from (select *, row_number() over (partition by stratum order by e) as rn, count(*) over (partition by stratum) as n from res) a group by stratum),
pool as (select {', '.join(f"{nth('e', r)} as p_{m}" for m, r in RANKS.items())} from (select *, row_number() over (order by e) as rn, count(*) over () as n from res) a),
mg as (select s.stratum, coalesce(n, 0) as n, not coalesce(n >= 20 and {' and '.join(f'{m} is not null' for m in RANKS)}, false) as fb, {', '.join(f'{m}, p_{m}' for m in RANKS)} from (values (0), (1), (2)) s(stratum) cross join pool left join own using (stratum)),
margins as (select stratum, n as calibration_components, fb as pooled_fallback, {', '.join(('least' if m.startswith('lower') else 'greatest') + f"(case when fb then p_{m} else {m} end, 0) as {m}" for m in RANKS)} from mg)"""


@query("E-24_stratified_margins", Q.query(*ERR, SM, select=f"select stratum, calibration_components, pooled_fallback, {r6(*RANKS)} from margins"))
def _(spark, d):
    rows = error_rows(spark, d).filter("config = 'persistence'").withColumn("residual", F.col("y") - F.col("pred"))
    return rounded(intervals.stratified_margins(rows, "residual", hot=HEAT(spark, d).table))


@query("E-25_median_vector", Q.query(*ZED, select="select " + ", ".join(r6(f"coalesce(median({c}), 0) as {c}") for c in ("limit_fraction", "slope_fraction_per_hour", "current_batch_robust_z")) + " from z"))
def _(spark, d):
    from peerscreen.operators import boosting
    return rounded(boosting.medians(feature_table(spark, d), ["limit_fraction", "slope_fraction_per_hour", "current_batch_robust_z"]))


@query("E-26_condition_ranges", Q.query(*FEAT, select="select min(temperature_c) as temperature_c_min, max(temperature_c) as temperature_c_max from feat"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return f.agg(F.min("temperature_c").alias("temperature_c_min"), F.max("temperature_c").alias("temperature_c_max"))


@query("E-27_pattern_audit", Q.query(*ERR, IV, select=f"select scenario, count(*) as components, {r6('avg(abs(pred - y) * upper_limit) as mae_unit', 'avg(case when y >= lo and y <= hi then 1.0 else 0.0 end) as interval_coverage')} from iv where config = 'persistence' group by scenario"))
def _(spark, d):
    rows = error_rows(spark, d).filter("config = 'persistence'").withColumns({"lower": F.greatest(F.col("pred") - 0.25, F.lit(0.0)), "upper": F.col("pred") + 0.25})
    return rounded(evaluation.pattern_audit(rows))


@query("E-28_counts", Q.query(Q.READINGS, Q.LABELS, select="select 'scenario' as kind, scenario as level, count(*) as n from labels_t group by scenario union all select 'batch', batch_id, count(*) from readings group by batch_id"))
def _(spark, d):
    a = labels(spark, d).groupBy(F.lit("scenario").alias("kind"), F.col("scenario").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    b = READ(spark, d).groupBy(F.lit("batch").alias("kind"), F.col("batch_id").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query("E-29_batch_overview", Q.query(*REC, TAGS, select="select batch_id, count(*) as records, round(avg(case when recommendation <> 'ACCEPT' then 1.0 else 0.0 end), 6) + 0.0 as anomaly_rate, count(*) filter (len(hubs) >= 2) as compound_count, " + ", ".join(f"count(*) filter (recommendation = '{x}') as n_{x.lower()}" for x in S.URGENCY) + " from tagged group by batch_id"))
def _(spark, d):
    return rounded(decide.batch_overview(decide.mechanism_tags(records(spark, d))))


@query("E-30_distinct", Q.query(Q.READINGS, select="select batch_id, count(distinct component_id) as components, count(distinct hours) as hours_seen from readings group by batch_id"))
def _(spark, d):
    return READ(spark, d).groupBy("batch_id").agg(F.count_distinct("component_id").alias("components"), F.count_distinct("hours").alias("hours_seen"))


# --- F: windows -----------------------------------------------------------------------

ZCOLS = ["current_batch_robust_z", "slope_batch_robust_z"]


@query("F-01_robust_z", Q.query(*ZED, select=f"select {K}, {r6(*ZCOLS)} from z"))
def _(spark, d):
    return rounded(feats.build_component_features(READ(spark, d)).select(*KEY, *ZCOLS))


@query("F-01_robust_z_spread", Q.query(*ZED, select=f"select {K}, {r6(*ZCOLS)} from z"))
def _(spark, d):
    """The same z-scores through the plan for very large peer groups."""
    return rounded(feats.build_component_features(READ(spark, d), hot=True).select(*KEY, *ZCOLS))


@query("F-02_textbook_mad_z", Q.query(*ZED, select=f"select {K}, {r6('current_mad_z', 'slope_mad_z')} from z"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return rounded(peers.mad_z(f, {"current_value": "current_mad_z", "slope": "slope_mad_z"}, hot=HEAT(spark, d).peer).select(*KEY, "current_mad_z", "slope_mad_z"))


@query("F-03_peer_count", Q.query(*ZED, select=f"select {K}, peer_count, peer_count < 8 as weak_peers from z"))
def _(spark, d):
    return peers.peer_count(feats.history_features(READ(spark, d), grid=tables_grid()), hot=HEAT(spark, d).peer).select(*KEY, "peer_count", "weak_peers")


PR = f"""pr as (select {K}, case when v is not null then (rank() over (partition by {Q.PEER} order by v nulls last) + (count(v) over (partition by {Q.PEER}, v) - 1) / 2.0) / count(v) over (partition by {Q.PEER}) end as pct
from (select *, case when n_observations = 2 then floor(current_value / 10) end as v from feat) x)"""


@query("F-04_percentile_rank", Q.query(*FEAT, PR, select=f"select {K}, {r6('pct')} from pr"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    f = f.withColumn("v", F.when(F.col("n_observations") == 2, F.floor(F.col("current_value") / 10).cast("double")))
    return rounded(peers.percentile_rank(f, "v", "pct", hot=HEAT(spark, d).peer).select(*KEY, "pct"))


LOO = f"""pairs as (select a.component_id, a.batch_id, a.component_family, a.measurement_name, median(b.current_batch_robust_z) as med, avg(case when b.current_batch_robust_z > 3 then 1.0 else 0.0 end) as frac, count(*) as others
from z a join z b on a.batch_id = b.batch_id and a.component_family = b.component_family and a.measurement_name = b.measurement_name and a.tester_channel = b.tester_channel and a.component_id <> b.component_id
group by all having count(*) >= 5)"""


@query("F-05_channel_peers", Q.query(*ZED, LOO, select=f"select {K}, {r6('med as channel_peer_median_current_z_v2', 'frac as channel_peer_elevated_fraction_v2')} from z left join pairs using ({K})"))
def _(spark, d):
    out = peers.channel_peers(feature_table(spark, d, carry=["tester_channel"]), hot=HEAT(spark, d).peer)
    return rounded(out.select(*KEY, *S.CHANNEL_FEATURES))


@query("F-06_first_flag_hour", Q.query(*LADDER_ROWS, LEADS, select="select method, component_id, batch_id, first_flag_hour from lt"))
def _(spark, d):
    return ladder(spark, d)[1].select("method", "component_id", "batch_id", "first_flag_hour")


@query("F-07_lead_hours", Q.query(*LADDER_ROWS, LEADS, select="select method, component_id, batch_id, scenario, is_defect, is_tester_fault, anomaly_onset_hour, first_flag_hour, first_exceedance_hour, lead_hours from lt"))
def _(spark, d):
    return ladder(spark, d)[1]


@query("F-08_demo_batches", Q.query(Q.READINGS, Q.THREE_WAY, select="select profile_id, min(batch_id) as batch_id from parts where split = 'test' group by profile_id"))
def _(spark, d):
    return splits.first_batch_per_profile(splits.three_way_split(READ(spark, d)))


@query("F-09_batch_folds", Q.query(Q.READINGS, FOLDS, select="select batch_id, profile_id, fold from folds"))
def _(spark, d):
    return splits.assign_batch_folds(READ(spark, d))


@query("F-10_calibration_batches", Q.query(Q.READINGS, select="select batch_id, profile_id, true as enough from (select batch_id, profile_id, row_number() over (partition by profile_id order by batch_id) as pos, count(*) over (partition by profile_id) as n from (select distinct batch_id, profile_id from readings) b) c where (pos - 1 - (3 * 2) % n + n) % n < 2"))
def _(spark, d):
    return splits.calibration_batches(READ(spark, d).select("batch_id", "profile_id").distinct(), per_profile=2, rotation=3)


ECDF = f"""ref as (select measurement_name, current_value as v from feat join split_t using (batch_id) where side = 'train'), tst as (select feat.* from feat join split_t using (batch_id) where side = 'test')"""


@query("F-11_empirical_share", Q.query(*FEAT, SPLIT, ECDF, select=f"select {K}, {r6('(select count(*) from ref where ref.measurement_name = tst.measurement_name and ref.v <= tst.current_value) / (select count(*) from ref where ref.measurement_name = tst.measurement_name) as share')} from tst"))
def _(spark, d):
    from peerscreen.operators import iforest
    r = READ(spark, d)
    f = feats.history_features(r, grid=tables_grid())
    split = splits.split_batches(r)
    train = splits.select_side(f, split, "train").select("measurement_name", F.col("current_value").alias("isolation_score"))
    test = splits.select_side(f, split, "test").withColumn("isolation_score", F.col("current_value"))
    return rounded(iforest._training_share(test, train, ["measurement_name"], hot=HEAT(spark, d).scope).select(*KEY, F.col("_share").alias("share")))


@query("F-13_slope_stratum", Q.query(*ZED, select=f"select {K}, {STRAT} as stratum from z"))
def _(spark, d):
    return feature_table(spark, d).select(*KEY, C.slope_stratum(F.col("slope_batch_robust_z")).alias("stratum"))


QUOTA = {"ENGINEER_REVIEW": 5, "RETEST": 6, "MONITOR": 7, "ACCEPT": 10}
QSQL = " ".join(f"when '{k}' then {v}" for k, v in QUOTA.items())


@query("F-14_decision_quota", Q.query(*REC, select=f"select {K}, recommendation from (select *, row_number() over (partition by recommendation order by component_id, measurement_name) as rn from records) x where rn <= case recommendation {QSQL} end"))
def _(spark, d):
    return decide.decision_quota(records(spark, d), QUOTA).select(*KEY, "recommendation")


# --- G, H: ordering and set operations ----------------------------------------------------


@query("G-01_by_urgency", Q.query(*REC, select=f"select {K}, recommendation from records order by {URG} desc, component_id, measurement_name"))
def _(spark, d):
    return decide.by_urgency(records(spark, d)).select(*KEY, "recommendation")


@query("G-02_canonical_order", Q.query(Q.READINGS, select=f"select {K}, hours, round(measurement_value, 6) + 0.0 as measurement_value from readings order by {K}, hours"))
def _(spark, d):
    return rounded(READ(spark, d).select(*KEY, "hours", "measurement_value").orderBy(*KEY, "hours"))


@query("G-03_summary_order", Q.query(*REC, select="select batch_id, component_id, count(*) as n from records group by batch_id, component_id order by batch_id, component_id"))
def _(spark, d):
    return records(spark, d).groupBy("batch_id", "component_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id", "component_id")


@query("G-05_first_offenders", Q.query(*DIRTY, select=f"select {K}, hours, copies from (select distinct {K}, hours, count(*) over (partition by {K}, hours) as copies from dirty) x where copies > 1 order by {K}, hours limit 3"))
def _(spark, d):
    return quality.first_errors(quality.duplicate_readings(dirty(spark, d)).select(*KEY, "hours", "copies").distinct(), [*KEY, "hours"], 3)


@query("G-06_score_ranking", Q.query(*SCO, select=f"select {K}, {r6('anomaly_score')} from scored order by scored.anomaly_score desc, component_id, measurement_name limit 20"))
def _(spark, d):
    return rounded(decide.score_ranking(screening.score(feature_table(spark, d)), 20).select(*KEY, "anomaly_score"))


@query("H-01_union_of_hours", Q.query(Q.READINGS, Q.features((24.0, 72.0)), Q.Z, select=f"select as_of_hour, {K}, {r6('current_batch_robust_z')} from z"))
def _(spark, d):
    a, b = (feature_table(spark, d, h).select("as_of_hour", *KEY, "current_batch_robust_z") for h in (24.0, 72.0))
    return rounded(a.unionByName(b))


@query("H-02_scored_and_unscored", Q.query(*REC, Q.UNSCORED, select=f"select {K}, 'scored' as status, recommendation from records union all select {K}, 'unscored', 'RETEST' from uns"))
def _(spark, d):
    a = records(spark, d).select(*KEY, F.lit("scored").alias("status"), "recommendation")
    b = unscored(spark, d).select(*KEY, F.lit("unscored").alias("status"), F.lit("RETEST").alias("recommendation"))
    return a.unionByName(b)


@query("H-03_early_and_outcomes", Q.query(Q.READINGS, select=f"select {K}, hours, case when hours <= 24 then 120.0 end as upper_limit from readings"))
def _(spark, d):
    r = READ(spark, d).select(*KEY, "hours", "upper_limit")
    return quality.early_readings(r).unionByName(quality.later_readings(r).drop("upper_limit"), allowMissingColumns=True)


@query("H-04_split_overlap", Q.query(*DIRTY, SPLIT, select="""select distinct 'component_id' as identity, component_id as value from dirty join split_t using (batch_id) where side = 'train' and component_id in (select component_id from dirty join split_t using (batch_id) where side = 'test')"""))
def _(spark, d):
    df, split = dirty(spark, d), splits.split_batches(READ(spark, d))
    return splits.set_overlaps(splits.select_side(df, split, "train"), splits.select_side(df, split, "test"))


@query("H-05_uncovered_batches", Q.query(*DIRTY, SPLIT, select="select distinct batch_id from dirty except select batch_id from split_t"))
def _(spark, d):
    return dirty(spark, d).select("batch_id").distinct().exceptAll(splits.split_batches(READ(spark, d)).select("batch_id"))


def grid_sql():
    parts = []
    for m, p, values, on in (
        ("fixed_limit", "fixed_limit_fraction", (0.8, 1.0), "current_value >= upper_limit * p"),
        ("robust_mad", "robust_threshold", (2.5, 3.5, 4.5), "robust_deviation_score >= p"),
        ("robust_mad_strict", "robust_threshold", (2.5, 3.5, 4.5), "strict_deviation >= p"),
    ):
        vals = ", ".join(f"({v})" for v in values)
        other = "robust_threshold" if p == "fixed_limit_fraction" else "fixed_limit_fraction"
        parts.append(f"select m.*, '{m}' as method, cast(p as double) as {p}, cast(null as double) as {other}, {on} as fl from m cross join (values {vals}) v(p)")
    late = "(fl and d and coalesce(first_exceedance_hour > as_of_hour, false))"
    return (
        "g as (" + " union all by name ".join(parts) + ")",
        f"""select method, as_of_hour, robust_threshold, fixed_limit_fraction,
 round(count(*) filter (fl and d) / nullif(count(*) filter (d), 0), 6) + 0.0 as defect_recall, round(count(*) filter (not fl and d) / nullif(count(*) filter (d), 0), 6) + 0.0 as false_negative_rate,
 round(count(*) filter (fl and h) / nullif(count(*) filter (h), 0), 6) + 0.0 as false_positive_rate, round(count(*) filter (fl and d) / nullif(count(*) filter (fl and (d or h)), 0), 6) + 0.0 as precision,
 round(median(case when {late} then first_exceedance_hour - as_of_hour end), 6) + 0.0 as median_lead_time_hours, count(*) filter ({late}) as n_early_warnings from g group by all""",
    )


SWEEP_HOURS = (24.0, 48.0, 72.0)
GRID_CTE, GRID_SELECT = grid_sql()
GRID_ROWS = (Q.READINGS, Q.LABELS, Q.features(SWEEP_HOURS), Q.Z, Q.SCORED, SPLIT, SIDE, Q.TRUTH, GRID_CTE)


def sweep(spark, d):
    r = READ(spark, d)
    return evaluation.parameter_sweep(r, labels(spark, d), splits.split_batches(r), hours=SWEEP_HOURS, with_forest=False, grid=tables_grid(), heat=HEAT(spark, d))


@query("H-06_distinct_parameters", Q.query(*GRID_ROWS, select=GRID_SELECT))
def _(spark, d):
    return rounded(evaluation.sweep_summary(sweep(spark, d)).drop("contamination", "fit_scope"))


# --- I: scalar functions ------------------------------------------------------------------


@query("I-01_scalar_functions", Q.query(Q.READINGS, select=f"""select {K}, hours, {r6('1 / (1 + exp(-(measurement_value - 50) / 10)) as logistic', 'ln(1 + measurement_value) as log1p', 'exp(least(measurement_value, 5)) - 1 as expm1', 'exp((0.7 / 8.617333262e-5) * (1.0 / 398.15 - 1.0 / (temperature_c + 273.15))) as arrhenius', 'round_even(measurement_value, 0) as half_even', 'sqrt(measurement_value) as root')} from readings"""))
def _(spark, d):
    v = F.col("measurement_value")
    out = READ(spark, d).select(
        *KEY, "hours", C.logistic((v - 50) / 10, 0.0).alias("logistic"), F.log1p(v).alias("log1p"), F.expm1(F.least(v, F.lit(5.0))).alias("expm1"),
        C.arrhenius(F.col("temperature_c"), 125.0, 0.7).alias("arrhenius"), F.bround(v, 0).alias("half_even"), F.sqrt(v).alias("root"),
    )
    return rounded(out)


@query("I-02_text_and_arrays", Q.query(Q.READINGS, select=f"""select {K}, lower(trim(' ' || component_id || ' ')) as id_text, contains(measurement_name, 'i') as has_i, starts_with(measurement_name, 'p') as starts_p, string_agg(cast(cast(hours as int) as varchar), '; ' order by hours) as hours_seen from readings group by {K}"""))
def _(spark, d):
    out = READ(spark, d).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("hours").cast("int"))).alias("hours_seen"))
    return rounded(out.select(
        *KEY, F.lower(F.trim(F.concat(F.lit(" "), F.col("component_id"), F.lit(" ")))).alias("id_text"), F.contains("measurement_name", F.lit("i")).alias("has_i"),
        F.startswith("measurement_name", F.lit("p")).alias("starts_p"), "hours_seen",
    ))


# --- J: scores and decisions ----------------------------------------------------------------


@query("J-01_robust_baseline", Q.query(*SCO, select=f"select {K}, is_anomaly as is_robust_anomaly, {r6('robust_deviation_score', 'anomaly_score as robust_anomaly_score')} from scored"))
def _(spark, d):
    return rounded(decide.apply_robust_baseline(feature_table(spark, d)).select(*KEY, "is_robust_anomaly", "robust_deviation_score", "robust_anomaly_score"))


@query("J-04_combined_score", Q.query(*SCO, select=f"select {K}, {r6('greatest(anomaly_score, least(limit_fraction, 1)) as anomaly_score')}, is_anomaly or limit_fraction >= 0.9 as is_anomaly from scored"))
def _(spark, d):
    f = decide.apply_robust_baseline(feature_table(spark, d))
    f = f.withColumns({"model_anomaly_score": F.least(F.col("limit_fraction"), F.lit(1.0)), "is_model_anomaly": F.col("limit_fraction") >= 0.9})
    return rounded(decide.combine_scores(f).select(*KEY, "anomaly_score", "is_anomaly"))


@query("J-05_reason_codes", Q.query(Q.READINGS, Q.features((72.0,)), Q.Z, Q.SCORED, select=f"select {K}, array_to_string(reason_codes, '; ') as reason_codes from scored"))
def _(spark, d):
    return rounded(screening.score(feature_table(spark, d, 72.0)).select(*KEY, "reason_codes"))


@query("J-07_baseline_forecasts", Q.query(*ERR, select=f"select {K}, {r6('p_pers as persistence', 'p_lin as linear_extrapolation')} from y0"))
def _(spark, d):
    f = forecast.joined_labels(feature_table(spark, d), labels(spark, d)).filter("y is not null")
    return rounded(f.select(*KEY, forecast.persistence().alias("persistence"), forecast.linear_extrapolation().alias("linear_extrapolation")))


@query("J-10_quiet_gate", Q.query(*ZED, select=f"select {K}, {r6('case when abs(slope_batch_robust_z) < 2 and abs(current_batch_robust_z) < 2 then greatest(limit_fraction, 0) else greatest(limit_fraction + slope_fraction_per_hour * 144, 0) end as gated')} from z"))
def _(spark, d):
    return rounded(feature_table(spark, d).select(*KEY, forecast.gate(forecast.linear_extrapolation()).alias("gated")))


@query("J-11_target_encodings", Q.query(*ERR, select=f"select {K}, {r6('y as normalized', 'ln(1 + y) as log1p_normalized', 'y - limit_fraction as residual_over_persistence', 'ln(1 + y) - ln(1 + limit_fraction) as log1p_residual_over_persistence', 'y as decoded')} from y0"))
def _(spark, d):
    f = forecast.joined_labels(feature_table(spark, d), labels(spark, d)).filter("y is not null")
    f = f.withColumns({t: forecast.encode_target(F.col("y"), t) for t in forecast.TARGETS})
    last = forecast.TARGETS[-1]
    return rounded(f.select(*KEY, *forecast.TARGETS, forecast.decode_prediction(F.col(last), last).alias("decoded")))


@query("J-14_stratified_bounds", Q.query(*ERR, SM, select=f"select {K}, {STRAT} as stratum, " + r6(*[(f"greatest(p_pers + g.{m}, 0) as {m}" if m.startswith("lower") else f"p_pers + g.{m} as {m}") for m in RANKS]) + f" from y0 join margins g on g.stratum = {STRAT}"))
def _(spark, d):
    rows = error_rows(spark, d).filter("config = 'persistence'").withColumn("residual", F.col("y") - F.col("pred"))
    out = intervals.apply_margins(rows, intervals.stratified_margins(rows, "residual", hot=HEAT(spark, d).table), "pred")
    return rounded(out.select(*KEY, "stratum", *RANKS))


@query("J-20_recommendation", Q.query(*REC, select=f"select {K}, recommendation, reasons as recommendation_reasons from records"))
def _(spark, d):
    return rounded(records(spark, d).select(*KEY, "recommendation", "recommendation_reasons"))


@query("J-21_provisional", Q.query(*REC, select=f"select {K}, case when not is_anomaly then 'ACCEPT' when headroom_fraction <= 0.1 then 'ENGINEER_REVIEW' else 'MONITOR' end as recommendation, true as provisional from records"))
def _(spark, d):
    scored = decide.limit_info(screening.score(feature_table(spark, d)))
    return decide.provisional_recommendation(scored).select(*KEY, "recommendation", "provisional")


@query("J-22_screening_record", Q.query(*REC, select=f"""select {K}, recommendation, peer_count, {r6('current_value as latest_value', 'headroom', 'anomaly_score as score', 'predicted_final_value')}, case when peer_count < 8 then 'Fewer than eight comparable peers; batch comparison is weak' end as warning, profile_id as profile from records"""))
def _(spark, d):
    out = decide.screening_record(records(spark, d))
    return rounded(out.select(
        *KEY, "recommendation", F.col("peers.peer_count").alias("peer_count"), "latest_value", F.col("limits.headroom").alias("headroom"), F.col("anomaly.score").alias("score"),
        F.col("forecast.predicted_final_value").alias("predicted_final_value"), F.col("peers.warning").alias("warning"), F.col("context")["profile_id"].alias("profile"),
    ))


@query("J-23_warnings", Q.query(*REC, Q.UNSCORED, select="""select * from (select 'UNSCORED_RECORDS_PRESENT' as code, (select count(*) from uns) as n union all select 'FORECAST_EXTRAPOLATES', (select count(*) from records where temperature_c not between 120.5 and 123.0 or current_value not between 5.0 and 110.0)) x where n > 0
union all select 'UNKNOWN_PROVENANCE', null"""))
def _(spark, d):
    r = decide.outside_ranges(records(spark, d), BOUNDS)
    out = decide.response_warnings(r, unscored(spark, d), quality.provenance(READ(spark, d)))
    return out.select("code", F.col("count").alias("n"))


@query("J-24_forecast_table", Q.query(Q.READINGS, Q.UNSCORED, f"pair as (select r.* from readings r anti join uns using ({K}) where hours in (0, 24))", Q.features(source="pair"), Q.Z, select=f"""select {K}, case when profile_id = 'P0' then 'forecast' else 'unavailable' end as status, case when profile_id = 'P0' then round(limit_fraction, 6) + 0.0 end as predicted_normalized,
 case when profile_id = 'P0' then peer_count end as peer_count, case when profile_id <> 'P0' then 'Missing or unsupported profile_id for this trained bundle' end as unavailable_reason from z
union all select {K}, 'unavailable', null, null, 'Exactly one 0-hour and one 24-hour reading are required' from uns join (select {K}, count(*) filter (hours in (0, 24)) as c from readings group by {K}) g using ({K}) where c > 0
union all select {K}, 'unavailable', null, null, 'Exactly one 0-hour and one 24-hour reading are required; A positive, unchanged upper_limit is required' from uns join (select {K}, count(*) filter (hours in (0, 24)) as c from readings group by {K}) g using ({K}) where c = 0"""))
def _(spark, d):
    prepared = screening.prepare_early_features(READ(spark, d), family="EVT", measurement=None)
    out = screening.forecast_table(prepared, forecast.persistence(), supported=["P0"])
    return rounded(out.select(*KEY, "status", "predicted_normalized", "peer_count", "unavailable_reason"))


@query("J-25_fixed_limit_screen", Q.query(*FEAT, select=f"select {K}, current_value >= 0.8 * upper_limit as fixed_limit_flag, {r6('least(limit_fraction, 2) as fixed_limit_score')} from feat"))
def _(spark, d):
    out = evaluation.screen_components(feature_table(spark, d), evaluation.ScreeningConfig(fixed_limit_fraction=0.8), heat=HEAT(spark, d))
    return rounded(out.select(*KEY, "fixed_limit_flag", "fixed_limit_score"))


@query("J-26_strict_screen", Q.query(*SCO, select=f"select {K}, strict_deviation >= 3.5 as robust_mad_strict_flag, {r6('strict_deviation as robust_mad_strict_deviation', '1 / (1 + exp(-(least(strict_deviation, 700) - 3.5))) as robust_mad_strict_score')} from scored"))
def _(spark, d):
    out = evaluation.screen_components(feature_table(spark, d), heat=HEAT(spark, d))
    return rounded(out.select(*KEY, "robust_mad_strict_flag", "robust_mad_strict_deviation", "robust_mad_strict_score"))


# --- K: evaluation jobs ----------------------------------------------------------------------


@query("K-01_batch_split", Q.query(Q.READINGS, Q.split("(1.0 / 3.0)", 26170, stratum=None), select="select batch_id, side from split_t"))
def _(spark, d):
    return splits.make_batch_split(READ(spark, d)).select("batch_id", "side")


@query("K-02_stratified_split", Q.query(Q.READINGS, Q.split(0.4, 7, stratum="profile_id"), select="select batch_id, stratum, side from split_t"))
def _(spark, d):
    return splits.split_batches(READ(spark, d), stratum="profile_id")


@query("K-03_three_way_split", Q.query(Q.READINGS, Q.THREE_WAY, select="select batch_id, profile_id, split from parts"))
def _(spark, d):
    return splits.three_way_split(READ(spark, d))


@query("K-04_split_features", Q.query(*ZED, SPLIT, select=f"select {K}, side, {r6('current_batch_robust_z')} from z join split_t using (batch_id)"))
def _(spark, d):
    r = READ(spark, d)
    train, test = evaluation.build_split_features(r, splits.split_batches(r), 24.0, grid=tables_grid(), heat=HEAT(spark, d))
    pick = lambda df, s: df.select(*KEY, F.lit(s).alias("side"), "current_batch_robust_z")
    return rounded(pick(train, "train").unionByName(pick(test, "test")))


@query("K-05_holdout_evaluation", Q.query(*HELD, select=Q.review(["fixed_limit", "robust_mad"])))
def _(spark, d):
    r = READ(spark, d)
    return rounded(evaluation.evaluate_dataset(r, labels(spark, d), splits.split_batches(r), with_forest=False, grid=tables_grid(), heat=HEAT(spark, d))[0])


@query("K-06_time_sweep", Q.query(*LADDER_ROWS, select=Q.review(["fixed_limit", "robust_mad"])))
def _(spark, d):
    r = READ(spark, d)
    return rounded(evaluation.evaluate_dataset(r, labels(spark, d), splits.split_batches(r), as_of_hour=list(LADDER), with_forest=False, grid=tables_grid(), heat=HEAT(spark, d))[0])


@query("K-07_repeated_splits", Q.query(*REPEATED, select=Q.review(["fixed_limit", "robust_mad"], "split_seed, as_of_hour")))
def _(spark, d):
    return rounded(repeated(spark, d))


@query("K-08_screen_components", Q.query(*SCO, select=f"select {K}, current_value >= upper_limit as fixed_limit_flag, is_anomaly as robust_mad_flag, strict_deviation >= 3.5 as robust_mad_strict_flag, {r6('anomaly_score as robust_mad_score')} from scored"))
def _(spark, d):
    out = evaluation.screen_components(feature_table(spark, d), heat=HEAT(spark, d))
    return rounded(out.select(*KEY, "fixed_limit_flag", "robust_mad_flag", "robust_mad_strict_flag", "robust_mad_score"))


@query("K-10_ladder_metrics", Q.query(*LADDER_ROWS, select=Q.harness(PLAIN)))
def _(spark, d):
    return rounded(ladder(spark, d)[0].drop("method_label"))


@query("K-11_parameter_grid", Q.query(*GRID_ROWS, select=GRID_SELECT))
def _(spark, d):
    return rounded(sweep(spark, d).drop("contamination", "fit_scope"))
