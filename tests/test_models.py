import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscreen import schema as S
from peerscreen.operators import boosting, features, forecast, iforest, intervals, metrics, splits
from peerscreen.plans import evaluation, training

KEY = S.KEY4


@pytest.fixture(scope="module")
def table(drifting):
    readings, labels = drifting
    f = features.build_component_features(readings, carry=["profile_id", "tester_channel"])
    return training.training_table(f, labels).cache()


def cloud(spark, scope="IC", n=60, seed=1):
    """Ordinary points with two far outliers (ids o0, o1)."""
    rng = np.random.default_rng(seed)
    rows = [(f"{scope}{i:03d}", "b", scope, "m", 24.0, *map(float, rng.normal(size=3))) for i in range(n)]
    rows += [(f"{scope}_o{i}", "b", scope, "m", 24.0, 9.0 + i, -9.0, 9.0) for i in range(2)]
    return spark.createDataFrame(rows, "component_id string, batch_id string, component_family string, measurement_name string, as_of_hour double, a double, b double, c double")


COLS = ["a", "b", "c"]


def test_outliers_isolate_first_and_repeat(spark):
    df = cloud(spark).unionByName(cloud(spark, "FET", 40, 2))
    model = iforest.fit(df, keys=S.SCOPE, columns=COLS, n_trees=40)
    assert model.forest.count() == 80
    ranked = [r.component_id for r in model.raw_scores(df).filter("component_family = 'IC'").orderBy(F.desc("isolation_score")).collect()]
    assert set(ranked[:2]) == {"IC_o0", "IC_o1"}
    again = iforest.fit(df.orderBy(F.rand(5)), keys=S.SCOPE, columns=COLS, n_trees=40)
    pick = lambda m: m.raw_scores(df).select("component_id", F.round("isolation_score", 12).alias("s"))
    assert pick(model).exceptAll(pick(again)).isEmpty()
    alone = iforest.fit(cloud(spark), keys=S.SCOPE, columns=COLS, n_trees=40)
    assert pick(alone).filter("s is not null").exceptAll(pick(model)).isEmpty()


def test_group_scoring_equals_broadcast_scoring(spark, monkeypatch):
    df = cloud(spark).unionByName(cloud(spark, "FET", 40, 2))
    model = iforest.fit(df, keys=S.SCOPE, columns=COLS, n_trees=20)
    a = model.raw_scores(df).select("component_id", F.round("isolation_score", 12).alias("s"))
    a = {r.component_id: r.s for r in a.collect()}
    monkeypatch.setattr(iforest, "BROADCAST_NODES", 0)
    monkeypatch.setattr(iforest, "ROWS_PER_GROUP", 10)
    b = {r.component_id: r.s for r in model.raw_scores(df).select("component_id", F.round("isolation_score", 12).alias("s")).collect()}
    assert a == b and len(a) == 104


def test_detector_settings(spark, table):
    with pytest.raises(ValueError):
        iforest.PeerAnomalyDetector(contamination=0.5)
    with pytest.raises(ValueError, match="eight"):
        iforest.PeerAnomalyDetector().fit(table.limit(7))
    assert iforest.PeerAnomalyDetector().fit_score(table).filter("is_anomaly").count() >= 16


def test_small_scope_has_no_forest(spark):
    df = cloud(spark).unionByName(cloud(spark, "FET", 3, 2))
    model = iforest.fit(df, keys=S.SCOPE, columns=COLS, n_trees=5)
    out = model.raw_scores(df)
    assert out.filter("isolation_score is null").count() == 5 and out.filter("isolation_score is not null").count() == 62


def test_unknown_scope_fails_the_screen(table):
    model = iforest.fit(table.withColumn("component_family", F.lit("other")), keys=S.SCOPE, n_trees=5)
    with pytest.raises(Exception, match="no fitted detector"):
        evaluation.screen_components(table, detector=model).collect()


def test_unlabelled_training_row_fails(drifting):
    readings, labels = drifting
    f = features.build_component_features(readings)
    with pytest.raises(Exception, match="final_value"):
        training.training_table(f, labels.limit(5)).collect()


def test_detector_flags_the_asked_share(table):
    model = iforest.fit(table)
    a, b = (model.score(table, contamination=[0.1, 0.2], hot=h) for h in (False, True))
    share = {r.contamination: r.s for r in a.groupBy("contamination").agg(F.avg(F.col("is_model_anomaly").cast("double")).alias("s")).collect()}
    assert 0.05 <= share[0.1] <= 0.1 < share[0.2] <= 0.2
    pick = lambda d: d.select(*KEY, "contamination", F.round("model_anomaly_score", 9).alias("m"), "is_anomaly")
    assert pick(a).exceptAll(pick(b)).isEmpty() and a.count() == b.count() == 320
    with pytest.raises(ValueError):
        model.score(table, contamination=0.7)


def test_training_share_is_the_empirical_distribution(spark):
    train = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 0.2, 0.4)], "k string, isolation_score double")
    test = spark.createDataFrame([("a", v) for v in (0.05, 0.2, 0.3, 0.4, 0.9)], "k string, isolation_score double")
    for hot in (False, True):
        got = iforest._training_share(test, train, ["k"], hot=hot).orderBy("isolation_score").collect()
        assert [r._share for r in got] == [0.0, 0.75, 0.75, 1.0, 1.0]


def test_average_path_values():
    assert iforest.average_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(iforest.average_path(256)) == pytest.approx(10.244770920, rel=1e-6)


@pytest.mark.parametrize("hot", [False, True])
def test_conformal_ranks(spark, hot):
    rng = np.random.default_rng(0)
    r = np.round(rng.normal(size=99), 3)
    df = spark.createDataFrame([(float(v), 0.0) for v in r], "residual double, slope_batch_robust_z double")
    assert intervals.conformal_radius(df, "residual", hot=hot).first().radius == np.sort(np.abs(r))[90 - 1]
    got = intervals.signed_bounds(df, "residual", hot=hot).first()
    s = np.sort(r)
    assert (got.lower, got.upper, got.lower_two_sided, got.upper_two_sided) == (s[9], s[89], s[4], s[94])
    few = df.limit(5)
    assert intervals.conformal_radius(few, "residual", alpha=0.01, hot=hot).first().radius is None


def test_margins_pool_small_strata_and_are_capped(spark):
    rows = [(0.5 + i / 1000, 0.0) for i in range(60)] + [(5.0, 3.0)] * 19 + [(-1.0, 9.0)] * 30
    df = spark.createDataFrame(rows, "residual double, slope_batch_robust_z double")
    got = {r.stratum: r for r in intervals.stratified_margins(df, "residual").collect()}
    assert not got[0].pooled_fallback and got[1].pooled_fallback and not got[2].pooled_fallback
    assert got[0].lower == 0.0 and got[2].upper == 0.0 and got[1].calibration_components == 19


def test_boosting_beats_persistence_on_held_out_batches(table):
    split = splits.split_batches(table, stratum="profile_id")
    train, held = splits.select_side(table, split, "train"), splits.select_side(table, split, "test").cache()
    config = boosting.with_params(boosting.FINAL, rounds=12, learning_rate=0.3, min_rows=5)
    model = boosting.fit_model(config, train)
    out = model.transform(held).cache()
    mae = lambda c: out.agg(F.avg(F.abs(c - F.col("y")))).first()[0]
    assert mae(F.col("pred")) < 0.6 * mae(forecast.persistence())
    still = out.filter("abs(slope_batch_robust_z) < 2 and abs(current_batch_robust_z) < 2")
    assert still.count() > 0 and still.filter("pred <> limit_fraction").isEmpty()
    parts = model.contributions(held, KEY)
    sums = parts.groupBy(*KEY).agg(F.sum("contribution").alias("s")).join(out, KEY)
    assert sums.filter("abs(greatest(s, 0) - pred) > 1e-9").isEmpty()
    assert boosting.top_contributions(parts, KEY).groupBy(*KEY).count().filter("count <> 5").isEmpty()


@pytest.mark.parametrize("objective,target", [("squared", "log1p_residual_over_persistence"), ("pseudo_huber", "residual_over_persistence"), ("absolute", "normalized")])
def test_objectives_learn(table, objective, target):
    config = boosting.CandidateConfig("c", "boosted", target, "leakage_only", objective, {"rounds": 6, "learning_rate": 0.5, "min_rows": 5, "penalty": 1.0})
    out = boosting.fit_model(config, table).transform(table)
    start = table.withColumn("pred", forecast.persistence()) if "residual" in target else table.crossJoin(table.agg(F.median("y").alias("pred")))
    mae = lambda d: d.agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0]
    assert mae(out) < mae(start)


def test_quantile_levels_order(table):
    low, high = (boosting.fit_model(c, table) for c in training.quantile_configs(boosting.with_params(boosting.FINAL, rounds=4, learning_rate=0.5), 0.2))
    out = high.transform(low.transform(table, "a"), "b")
    assert out.agg(F.avg((F.col("b") >= F.col("a")).cast("double"))).first()[0] > 0.9


def test_shapley_values_by_enumeration():
    tree = {
        "feature": [0, 1, -1, -1, 0, -1, -1],
        "threshold": [0.5, 0.3, 0, 0, 0.8, 0, 0],
        "left": [1, 2, -1, -1, 5, -1, -1],
        "right": [4, 3, -1, -1, 6, -1, -1],
        "value": [0, 0, 1.0, 2.0, 0, 5.0, 9.0],
        "cover": [10, 6, 2, 4, 4, 3, 1],
        "weight": 0.5,
    }
    model = boosting.Ensemble(["f0", "f1"], 0.25, [tree])

    def expect(row, known, at=0):
        f = tree["feature"][at]
        if f < 0:
            return tree["value"][at]
        l, r = tree["left"][at], tree["right"][at]
        if f in known:
            return expect(row, known, l if row[f] <= tree["threshold"][at] else r)
        c = tree["cover"]
        return (c[l] * expect(row, known, l) + c[r] * expect(row, known, r)) / c[at]

    for row in itertools.product((0.1, 0.6, 0.9), (0.1, 0.9)):
        got = model.shares(np.array([row]))[0]
        for i in range(2):
            j = 1 - i
            want = 0.5 * (expect(row, {i}) - expect(row, set()) + expect(row, {0, 1}) - expect(row, {j})) * 0.5
            assert got[i] == pytest.approx(want)
        assert got.sum() == pytest.approx(model.raw(np.array([row]))[0])


def test_ridge_matches_closed_form(table):
    config = boosting.CandidateConfig("ridge", "ridge")
    model = boosting.fit_model(config, table)
    rows = table.select(*model.columns, "y").toPandas()
    x, y = rows[model.columns].to_numpy(float), rows["y"].to_numpy(float)
    std = x.std(axis=0, ddof=1)
    used = std > 1e-12
    z = (x[:, used] - x[:, used].mean(axis=0)) / std[used]
    w = np.linalg.solve(z.T @ z + boosting.RIDGE_PENALTY * np.eye(used.sum()), z.T @ (y - y.mean()))
    want = np.maximum(z @ w + y.mean(), 0)
    got = model.transform(table).select("pred").toPandas()["pred"].to_numpy()
    np.testing.assert_allclose(np.sort(got), np.sort(want), atol=0.02)


def test_permutation_importance_names_the_signal(table):
    config = boosting.CandidateConfig("c", "boosted", "residual_over_persistence", "leakage_only", "squared", {"rounds": 8, "learning_rate": 0.5, "min_rows": 5})
    model = boosting.fit_model(config, table)
    top = boosting.permutation_importance(model, table, repeats=2).first()
    gain = max(model.ensemble.importance().items(), key=lambda kv: kv[1])[0]
    assert top.mae_increase > 0 and top.feature == gain


def test_cross_validation_uses_other_folds_only(spark, table):
    folds = splits.assign_batch_folds(table)
    config = boosting.CandidateConfig("c", "boosted", "residual_over_persistence", "leakage_only", "squared", {"rounds": 3, "learning_rate": 0.5, "min_rows": 5})
    oof = training.run_cross_validation(table, [boosting.COMPARISON[0], config], folds)
    assert oof.groupBy("config").count().filter("count <> 160").isEmpty()
    own = folds.filter("fold = 0").select("batch_id")
    changed = table.join(own.withColumn("hit", F.lit(True)), "batch_id", "left").withColumn("y", F.when(F.col("hit"), F.col("y") * 100).otherwise(F.col("y"))).drop("hit")
    again = training.run_cross_validation(changed, [config], folds)
    pick = lambda d: d.filter("config = 'c' and fold = 0").select(*KEY, F.round("pred", 9).alias("p"))
    assert pick(oof).exceptAll(pick(again)).isEmpty()
    board = training.cross_validation_report(oof, [config])[0].collect()
    assert board[0].eligible and not board[1].eligible
    assert [r.config for r in board] == ["c", "persistence"] and board[0].folds_beating_baseline == 5


def test_interval_experiment_covers(table):
    config = boosting.CandidateConfig("c", "boosted", "residual_over_persistence", "leakage_only", "squared", {"rounds": 3, "learning_rate": 0.5, "min_rows": 5})
    folds = splits.assign_batch_folds(table, n_splits=2)
    rows = training.run_interval_experiment(table, config, folds, per_profile=1, alpha=0.2)
    got = {r.method: r for r in training.interval_summary(rows).collect()}
    assert set(got) == set(training.INTERVAL_METHODS)
    assert all(r.coverage_mean > 0.6 for r in got.values())


def test_bundle_round_trip(spark, table, tmp_path):
    split = splits.three_way_split(table)
    train, calibration, test = (splits.select_side(table, split, s, "split") for s in ("train", "calibration", "test"))
    configs = (boosting.CandidateConfig("ridge", "ridge"), boosting.with_params(boosting.FINAL, rounds=3, learning_rate=0.5, min_rows=5))
    bundle, report = training.train_bundle(train, calibration, test, configs=configs, alpha=0.2)
    assert {r.config for r in report.collect()} == {"persistence", "linear_extrapolation", "ridge", "xgboost_v2"}
    assert bundle.selected == min(bundle.validation_mae, key=bundle.validation_mae.get)
    training.save_bundle(bundle, spark, str(tmp_path / "bundle"))
    loaded = training.load_bundle(spark, str(tmp_path / "bundle"))
    pick = lambda b: b.screen(test, model="xgboost_v2").select(*KEY, F.round("prediction_upper", 9).alias("u"), "recommendation", F.round("anomaly_score", 9).alias("s"))
    a, b = pick(bundle), pick(loaded)
    assert a.count() == 32 and a.exceptAll(b).isEmpty()
    alerts = training.alert_evaluation(bundle.screen(test, model="xgboost_v2"))
    assert {r.alert for r in alerts.collect()} == {"combined_screening", "anomaly_detection"}
    with pytest.raises(ValueError):
        training.train_bundle(train, train, test, configs=())
    with pytest.raises(ValueError):
        loaded.screen(test, model="nope")


def test_configuration_checks():
    with pytest.raises(ValueError):
        boosting.CandidateConfig("x", "boosted")
    with pytest.raises(ValueError):
        boosting.CandidateConfig("x", "magic")
    assert len(boosting.COMPARISON) == 12 and training.uses_conditions(boosting.COMPARISON[2])
    assert math.isclose(boosting.BOOST_PARAMS["learning_rate"], 0.04)


def test_ladder_and_sweep_on_planted_drift(spark, drifting):
    readings, labels = drifting
    labels = labels.withColumn("first_exceedance_hour", F.when(F.col("is_defect"), 168.0)).withColumn("upper_limit", F.lit(1.0))
    split = splits.split_batches(readings, stratum="profile_id")
    per_hour, leads, summary = evaluation.early_warning_ladder(readings, labels, split, hours=(24.0, 168.0), with_forest=False)
    got = {r.method: r for r in summary.collect()}
    assert got["robust_mad"].n_defects == 16 and got["robust_mad"].n_flagged_before_crossing == 16
    assert got["robust_mad"].median_lead_hours == 144.0
    grid = evaluation.parameter_sweep(readings, labels, split, hours=(24.0,), with_forest=False)
    assert grid.count() == 2 + 3 + 3
    assert evaluation.sweep_summary(grid.unionByName(grid)).count() == 8
    with pytest.raises(Exception, match="no ground-truth label"):
        evaluation.holdout(readings, labels.limit(3), split, with_forest=False).collect()
    with pytest.raises(ValueError):
        metrics.with_onset(labels.drop("anomaly_onset_hour"))
