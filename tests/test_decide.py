import pytest
from pyspark.sql import functions as F

from peerscreen.operators import decide

SHAPE = "current_value double, upper_limit double, anomaly_score double, is_anomaly boolean, predicted_final_value double, prediction_lower double, prediction_upper double, data_quality_warning string"

CASES = [
    ((10.0, 50.0, 0.1, False, None, None, None, None), "ACCEPT", []),
    ((10.0, 50.0, 0.1, False, None, None, None, "bad cell"), "RETEST", ["bad cell"]),
    ((50.0, 50.0, 0.1, False, 90.0, 80.0, 99.0, None), "ENGINEER_REVIEW", [decide.AT_LIMIT]),
    ((10.0, 50.0, 0.9, True, 55.0, 40.0, 60.0, None), "ENGINEER_REVIEW", [decide.PREDICTED_CROSSING, decide.POSSIBLE_CROSSING]),
    ((10.0, 50.0, 0.1, False, 50.0, 40.0, 60.0, None), "RETEST", [decide.PREDICTED_CROSSING, decide.POSSIBLE_CROSSING]),
    ((10.0, 50.0, 0.8, False, 20.0, 10.0, 30.0, None), "RETEST", []),
    ((10.0, 50.0, 0.1, False, 20.0, 10.0, 50.0, None), "MONITOR", [decide.POSSIBLE_CROSSING]),
    ((10.0, 50.0, 0.5, True, 20.0, 10.0, 30.0, None), "MONITOR", []),
    ((10.0, 50.0, 0.5, True, None, None, None, None), "MONITOR", []),
]


@pytest.mark.parametrize("row,action,reasons", CASES)
def test_every_branch(spark, row, action, reasons):
    df = spark.createDataFrame([row], SHAPE).withColumn("reason_codes", F.array().cast("array<string>"))
    got = decide.with_recommendation(df).first()
    assert (got.recommendation, got.recommendation_reasons) == (action, reasons)


def test_provisional(spark):
    df = spark.createDataFrame([(False, 0.0), (True, 0.1), (True, 0.2), (True, None)], "is_anomaly boolean, headroom_fraction double")
    assert [r.recommendation for r in decide.provisional_recommendation(df).collect()] == ["ACCEPT", "ENGINEER_REVIEW", "MONITOR", "MONITOR"]


def test_limits_by_direction(spark):
    df = spark.createDataFrame([("upper", 8.0, 10.0, 2.0), ("lower", 3.0, 10.0, 2.0), ("lower", 3.0, 10.0, None)], "limit_direction string, current_value double, upper_limit double, lower_limit double")
    got = decide.limit_info(df).collect()
    assert [(r.applicable_limit, r.headroom, r.headroom_fraction) for r in got] == [(10.0, 2.0, 0.2), (2.0, 1.0, 0.5), (None, None, None)]
    crossing = decide.predicted_to_cross(decide.limit_info(df).withColumn("predicted_final_value", F.lit(2.0))).collect()
    assert [r.predicted_to_cross_limit for r in crossing] == [False, False, None]


def test_reason_texts(spark):
    shape = "current_batch_robust_z double, slope_batch_robust_z double, limit_fraction double, acceleration double, is_anomaly boolean"
    df = spark.createDataFrame([(4.0, -4.0, 0.9, 0.1, True), (0.0, 0.0, 0.1, 0.0, True), (0.0, 0.0, 0.1, 0.0, False)], shape)
    got = [r.r for r in df.select(decide.reason_codes().alias("r")).collect()]
    assert got[0] == [decide.CURRENT_ABOVE, decide.DRIFT_SLOWER, decide.NEAR_LIMIT, decide.ACCELERATING]
    assert got[1:] == [[decide.UNUSUAL_MIX], []]


def test_summary_takes_most_urgent(spark):
    shape = "component_id string, batch_id string, component_family string, measurement_name string, recommendation string"
    scored = spark.createDataFrame([("a", "b", "f", "m1", "MONITOR"), ("a", "b", "f", "m2", "RETEST")], shape)
    unscored = spark.createDataFrame([("a", "b", "f", "m3"), ("z", "b", "f", "m1")], shape.rsplit(",", 1)[0])
    got = {r.component_id: r for r in decide.component_summary(scored, unscored).collect()}
    assert got["a"].summary_recommendation == "RETEST" and got["a"].partial_coverage
    assert got["a"].measurement_names == ["m1", "m2", "m3"]
    assert got["z"].summary_recommendation is None and got["z"].scored_measurement_count == 0


def test_ranges_and_readiness(spark):
    df = spark.createDataFrame([(1.0, 5.0), (9.0, 5.0), (None, 5.0)], "a double, b double")
    got = decide.outside_ranges(df, {"a": (0.0, 2.0), "b": (5.0, 6.0)}).collect()
    assert [r.out_of_training_range_features for r in got] == [[], ["a"], []]
    assert [r.prediction_readiness for r in got] == ["ready", "outside_training_conditions", "ready"]
