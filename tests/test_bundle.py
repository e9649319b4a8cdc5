import pytest
from pyspark.sql import functions as F

from peerscreen import schema as S
from peerscreen.operators import splits
from peerscreen.plans import screening, training
from peerscreen.sources import csv


@pytest.fixture(scope="module")
def fitted(drifting):
    """Baselines only, so that the fit takes no boosting rounds; the robust rule flags alone."""
    readings, labels = drifting
    features = screening.augment_features(screening.prepare_early_features(readings).features)
    rows = training.training_table(features, labels.withColumn("is_future_failure", F.col("is_defect")))
    split = splits.three_way_split(rows)
    train, calibration, test = (splits.select_side(rows, split, s, "split") for s in ("train", "calibration", "test"))
    return training.train_bundle(train, calibration, test, configs=(), alpha=0.2, stratified="persistence", with_detector=False)[0], test


def test_whole_evaluation(fitted):
    bundle, test = fitted
    got = training.evaluate_whole(bundle, test, model="persistence")
    assert {r.config: r.components for r in got.models.collect()} == {"persistence": 32, "linear_extrapolation": 32}
    assert {(r.config, r.profile_id): r.components for r in got.profiles.collect()} == {(c, p): 16 for c in bundle.models for p in ("P0", "P1")}
    one = got.stratified.first()
    assert one.config == "persistence" and one.two_sided_coverage >= one.coverage and one.upper_only_coverage == pytest.approx(1 - one.share_above_upper)
    alerts = got.alerts.collect()
    assert len(alerts) == 4 and all(r.tp + r.fn + r.fp + r.tn == r.components == 32 for r in alerts)
    assert sum(r.components for r in got.actions.collect()) == 32
    rates = {r.scenario: (r.components, r.alert_rate) for r in got.scenarios.collect()}
    assert rates["gradual_drift"] == (8, 1.0) and rates["healthy"][0] == 24
    bare = training.evaluate_whole(bundle, test.drop("profile_id", "scenario", "is_future_failure"), model="persistence")
    assert bare.profiles is None and bare.scenarios is None and bare.alerts.count() == 2


def test_bundle_without_a_forest_reloads(spark, fitted, tmp_path):
    bundle, test = fitted
    training.save_bundle(bundle, spark, str(tmp_path / "bundle"))
    loaded = training.load_bundle(spark, str(tmp_path / "bundle"))
    assert loaded.detector is None and loaded.stratified == "persistence"
    pick = lambda b, m: b.screen(test, model=m).select(*S.KEY4, "prediction_upper", "prediction_upper_two_sided", "interval_method", "interval_stratum", "recommendation")
    for name in bundle.models:
        assert pick(bundle, name).exceptAll(pick(loaded, name)).isEmpty()
    assert pick(loaded, "linear_extrapolation").filter("interval_stratum is not null or prediction_upper_two_sided is not null").isEmpty()


def test_screening_with_frozen_models(fitted, drifting):
    bundle, _ = fitted
    readings, _ = drifting
    strange = readings.withColumn("profile_id", F.when(F.col("batch_id") == "B09", "P9").otherwise(F.col("profile_id")))
    got = screening.screen_readings(strange, bundle, model="persistence", outcomes=readings)
    assert got.records.count() == 144 and got.unscored.count() == 16
    assert {tuple(r.reasons) for r in got.unscored.collect()} and got.records.filter("provisional or prediction_upper is null").isEmpty()
    assert got.records.filter("prediction_lower_two_sided > prediction_lower or prediction_upper_two_sided < prediction_upper").isEmpty()
    total = got.summary.first()
    assert (total.component_count, total.scored_count, total.unscored_count) == (160, 144, 16)
    assert {r.hours for r in got.outcomes.select("hours").distinct().collect()} == {168.0}
    stressed = strange.withColumn("measurement_value", F.when(F.col("hours") > 24, F.lit(1e9)).otherwise(F.col("measurement_value")))
    pick = lambda s: s.records.select(*S.KEY4, "prediction_upper", "recommendation")
    assert pick(got).exceptAll(pick(screening.screen_readings(stressed, bundle, model="persistence"))).isEmpty()
    with pytest.raises(ValueError):
        screening.screen_readings(readings, bundle, outcomes=readings.drop("hours"))
    with pytest.raises(ValueError):
        screening.screen_readings(readings, bundle, model="nope")


def test_screening_without_models_is_provisional(drifting):
    readings, _ = drifting
    got = screening.screen_readings(readings)
    assert got.records.count() == 160 and got.unscored.isEmpty()
    assert got.records.filter("not provisional or predicted_final_value is not null or prediction_upper is not null").isEmpty()
    assert {r.recommendation for r in got.records.collect()} <= {"ACCEPT", "MONITOR", "ENGINEER_REVIEW"}
    plain = screening.screen(readings)
    assert plain.filter("prediction_lower is not null or prediction_upper is not null or predicted_final_value is null").isEmpty()


def test_only_line_ends_end_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("h\r\na\u0085b c\x0bd\x0c\x1c\r\n\nx\ry".encode())
    got = [r.line for r in csv.decode(spark, str(tmp_path)).orderBy("line_number").collect()]
    assert got == ["h", "a\u0085b c\x0bd\x0c\x1c", "", "x", "y"]


def test_empty_outcomes_and_readings(spark, drifting, fitted):
    bundle, _ = fitted
    readings, _ = drifting
    none = screening.screen_readings(readings.limit(0), bundle, model="persistence", outcomes=readings.limit(0))
    assert none.records.isEmpty() and none.unscored.isEmpty() and none.outcomes.isEmpty() and none.summary.first().component_count == 0
