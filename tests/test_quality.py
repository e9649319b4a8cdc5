import pytest
from pyspark.sql import functions as F

from peerscreen import schema as S
from peerscreen.operators import quality, splits
from peerscreen.plans import screening

SHAPE = "component_id string, batch_id string, component_family string, measurement_name string, hours string, measurement_value string, upper_limit string"
GOOD = [("c1", "b", "MLCC_X7R", "leakage_ua", "0", "0.1", "1"), ("c1", "b", "MLCC_X7R", "leakage_ua", "24", "0.2", "1")]


def frame(spark, rows, shape=SHAPE):
    return spark.createDataFrame(rows, shape)


def counts(df):
    return {r["check"]: r.n for r in df.collect() if r.n}


def test_clean_input_has_no_findings(spark):
    assert counts(quality.check_readings(frame(spark, GOOD))) == {}


@pytest.mark.parametrize(
    "row,check",
    [
        (("c2", "b", "f", "m", "-1", "1", "1"), "negative_hours"),
        (("c2", "b", "f", "m", "0", "abc", "1"), "non_numeric_measurement_value"),
        (("c2", "b", "f", "m", "0", "1d", "1"), "non_numeric_measurement_value"),
        (("c2", "b", "f", "m", "0", "inf", "1"), "non_numeric_measurement_value"),
        (("c2", "b", "f", "m", "0", None, "1"), "null_measurement_value"),
        (("c2", "b", "f", "m", "0", "1", "0"), "non_positive_limit"),
        (GOOD[0], "duplicate_identity"),
        (("c1", "b", "MLCC_X7R", "leakage_ua", "48", "1", "2"), "limit_changes"),
    ],
)
def test_each_planted_fault_is_found(spark, row, check):
    found = counts(quality.check_readings(frame(spark, GOOD + [row])))
    assert check in found
    with pytest.raises(quality.ReadingsError):
        quality.check_readings(frame(spark, GOOD + [row]), strict=True)


def test_missing_column_stops(spark):
    with pytest.raises(quality.ReadingsError, match="upper_limit"):
        quality.check_readings(frame(spark, GOOD).drop("upper_limit"))


def test_eligibility_lists_all_reasons(spark):
    rows = GOOD + [
        ("c2", "b", "OTHER", "volts", "0", "1", "1"),
        ("c3", "b", "MLCC_X7R", "leakage_ua", "0", "-1", "1"),
        ("c3", "b", "MLCC_X7R", "leakage_ua", "24", "x", "2"),
        ("c4", "b", "MLCC_X7R", "leakage_ua", "0", "1", "1"),
        ("c4", "b", "MLCC_X7R", "leakage_ua", "24", "1", "1"),
        ("c4", "b", "MLCC_X7R", "leakage_ua", "24", "1", "1"),
    ]
    got = {r.component_id: r.reasons for r in quality.eligibility(frame(spark, rows)).collect()}
    assert got["c1"] == []
    assert got["c2"] == [quality.WRONG_FAMILY.format(family="MLCC_X7R"), quality.WRONG_MEASUREMENT.format(measurement="leakage_ua"), quality.NEED_BOTH]
    assert got["c3"] == [quality.NOT_FINITE.format(column="measurement_value"), quality.NEGATIVE, quality.BAD_LIMIT]
    assert got["c4"] == [quality.NEED_BOTH]


def test_units_optional_numbers_and_constants(spark):
    shape = SHAPE + ", measurement_unit string, rated_voltage_v string, profile_id string"
    rows = [
        ("c1", "b", "MLCC_X7R", "leakage_ua", "0", "1", "1", "uA", "25", "p"),
        ("c1", "b", "MLCC_X7R", "leakage_ua", "24", "1", "1", "mA", "abc", None),
    ]
    got = quality.eligibility(frame(spark, rows, shape)).first().reasons
    assert got == [
        quality.OPTIONAL_BAD.format(column="rated_voltage_v"),
        quality.CHANGES.format(column="profile_id"),
        quality.CHANGES.format(column="rated_voltage_v"),
        quality.WRONG_UNIT.format(column="measurement_unit"),
    ]
    codes = [r.c for r in spark.createDataFrame([("Exactly one 0-hour",), ("Missing profile_id",), ("Unsupported family",), ("odd",)], "t string").select(quality.unscored_reason(F.col("t")).alias("c")).collect()]
    assert codes == ["missing_checkpoint", "unsupported_profile", "unsupported_profile", "core_error"]


def test_structure_checks(spark):
    rows = [("c1", "b1", "f", "m", "0", "1", "1"), ("c1", "b2", "f", "m", "24", "1", "2"), ("c2", "b2", "f", "m", "24", "1", "3")]
    df = frame(spark, rows)
    assert {r.batch_id for r in quality.shared_component_ids(df).collect()} == {"b1", "b2"}
    assert [(r.batch_id, r.column) for r in quality.mixed_batches(df, ["upper_limit"]).collect()] == [("b2", "upper_limit")]
    assert quality.incompatible_peers(df).count() == 1
    assert quality.duplicate_readings(df.unionByName(df.limit(1))).count() == 2


def test_profiles_and_units(spark):
    rows = GOOD + [("c5", "b", "Digital IC", "leakage_ua", "0", "1", "1"), ("c6", "b", "None", "x", "0", "1", "1"), ("c7", "b", "MLCC_X7R", "leakage_ua", "0", "1", "1")]
    df = frame(spark, rows).withColumn("hours", F.col("hours").cast("double"))
    got = {r.component_id: (r.reason, r.missing_hours) for r in quality.resolve_profiles(df, S.profiles(spark)).collect()}
    assert got["c1"] == (None, [])
    assert got["c5"][0] == "profile_not_available" and got["c6"][0] == "unsupported_profile"
    assert got["c7"] == ("missing_checkpoint", [24.0])
    units = df.withColumn("measurement_unit", F.when(F.col("component_id") == "c1", " MicroAmp ").otherwise("mA"))
    assert {r.component_id for r in quality.unit_mismatches(units, S.profiles(spark)).collect()} == {"c5", "c7"}


def test_provenance_kinds(spark):
    kind = lambda *v: quality.provenance(spark.createDataFrame([(x,) for x in v], "data_source string")).first()[0]
    assert kind("Synthetic v2", "demo") == "synthetic"
    assert kind("bench", None) == "measured_unverified"
    assert kind("bench", "fake") == "mixed"
    assert kind(None, " ") == "unknown"


def test_gate_refuses_structural_faults(spark, drifting):
    readings, _ = drifting
    two = readings.withColumn("batch_id", F.when((F.col("component_id") == "D0000") & (F.col("hours") == 24), "B01").otherwise(F.col("batch_id")))
    prepared = screening.prepare_early_features(two, strict=False)
    assert prepared.rejects.filter("component_id = 'D0000'").count() == 2
    limits = readings.withColumn("upper_limit", F.when(F.col("component_id") == "D0001", 9.0).otherwise(F.col("upper_limit")))
    with pytest.raises(ValueError, match="upper_limit"):
        screening.prepare_early_features(limits)


def test_forecast_table_reports_everyone(spark, drifting):
    readings, _ = drifting
    cut = readings.filter(~((F.col("component_id") == "D0003") & (F.col("hours") == 24)))
    prepared = screening.prepare_early_features(cut)
    from peerscreen.operators import forecast

    out = {r.component_id: r for r in screening.forecast_table(prepared, forecast.persistence(), supported=["P0"]).collect()}
    assert len(out) == 160 and out["D0003"].unavailable_reason == quality.NEED_BOTH
    assert out["D0100"].unavailable_reason == quality.UNKNOWN_PROFILE
    assert out["D0001"].status == "forecast" and out["D0001"].peer_count == 15


def test_diffs_and_reconciliation(spark):
    a = spark.createDataFrame([("x", 1.0, "p"), ("y", 2.0, "q"), ("z", None, "r")], "k string, v double, t string")
    b = spark.createDataFrame([("x", 1.0 + 1e-12, "p"), ("y", 2.1, "s"), ("w", 1.0, "r")], "k string, v double, t string")
    got = {r.field: r.mismatches for r in quality.record_diff(a, b, ["k"], ["t"], ["v"]).collect()}
    assert got == {"only_left": 1, "only_right": 1, "t": 1, "v": 1}
    ok = quality.reconcile(a, a.withColumn("w", F.col("v") * 2), ["k"], {"v": ("w", 2.0)}).first()
    assert not ok.matches  # a missing value on one side is no match
    ok = quality.reconcile(a.dropna(), a.dropna().withColumn("w", F.col("v") * 2), ["k"], {"v": ("w", 2.0)}).first()
    assert ok.matches and ok.max_absolute_error == 0


def test_split_guards(spark, drifting):
    readings, _ = drifting
    split = splits.split_batches(readings, test_fraction=0.4, seed=7)
    assert sum(v for v in counts(splits.check_split(readings, split)).values()) == 0
    sides = {r.batch_id: r.side for r in split.collect()}
    assert sorted(sides.values()).count("test") == 4 and len(sides) == 10
    again = {r.batch_id: r.side for r in splits.split_batches(readings.orderBy(F.rand()), test_fraction=0.4, seed=7).collect()}
    assert sides == again
    with pytest.raises(splits.LeakageError):
        splits.assert_split_is_leakage_safe(readings, split.filter("batch_id <> 'B03'"))
    folds = {r.batch_id: r.fold for r in splits.assign_batch_folds(readings).collect()}
    assert [folds[f"B{b:02d}"] for b in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)] == [0, 1, 2, 3, 4] * 2
    three = {}
    for r in splits.three_way_split(readings).collect():
        three.setdefault((r.profile_id, r.split), []).append(r.batch_id)
    assert {k: len(v) for k, v in three.items()} == {(p, s): n for p in ("P0", "P1") for s, n in (("train", 3), ("calibration", 1), ("test", 1))}
    lone = spark.createDataFrame([("b1", "f"), ("b2", "g"), ("b3", "g")], "batch_id string, component_family string")
    assert {r.batch_id: r.side for r in splits.split_batches(lone).collect()}["b1"] == "train"
