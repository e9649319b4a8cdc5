import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerscreen import schema as S
from peerscreen.operators import decide, features, peers
from peerscreen.plans import screening
from peerscreen.sources import tables

KEY = S.KEY4
Z = ["current_batch_robust_z", "slope_batch_robust_z"]


def table(df, columns):
    return df.select(*KEY, *columns).toPandas().sort_values(KEY).reset_index(drop=True)


def test_demo_part_drifts(demo):
    got = features.build_component_features(demo).filter("component_id = 'C012'").first()
    assert got.slope == pytest.approx(25 / 24)
    assert got.current_batch_robust_z > 3.5 and got.n_observations == 2
    assert got.last_observed_hour == 24.0 and got.acceleration == 0.0


def test_matches_pandas(spark):
    r = tables.readings(spark, "/root/testdata/sf0.001")
    got = features.build_component_features(r, as_of_hour=72.0).toPandas().set_index(KEY)
    raw = r.filter("hours <= 72").toPandas()
    rows = []
    for key, g in raw.groupby(KEY):
        if len(g) < 2:
            continue
        g = g.sort_values("hours")
        h, v = g.hours.to_numpy(), g.measurement_value.to_numpy()
        acc = 0.0
        if len(h) >= 3:
            acc = ((v[-1] - v[-2]) / (h[-1] - h[-2]) - (v[1] - v[0]) / (h[1] - h[0])) / (h[-1] - h[0])
        rows.append((*key, v[-1], np.polyfit(h, v, 1)[0], acc, np.std(v)))
    want = pd.DataFrame(rows, columns=[*KEY, "cv", "slope", "acc", "std"]).set_index(KEY).loc[got.index]
    assert len(want) == len(got)
    for a, b in (("current_value", "cv"), ("slope", "slope"), ("acceleration", "acc"), ("variability", "std")):
        np.testing.assert_allclose(got[a], want[b], atol=1e-9)
    for x, name in (("current_value", Z[0]), ("slope", Z[1])):
        for _, g in got.reset_index().groupby(S.PEER):
            v = g[x]
            med = v.median()
            mad = (v - med).abs().median()
            scale = max(mad, abs(med) * 0.01, (v.std() if len(v) > 1 else 0.0) * 0.1, 1e-9)
            np.testing.assert_allclose(g[name], 0.6745 * (v - med) / scale, atol=1e-6)


def test_future_values_change_nothing(demo):
    loud = demo.withColumn("measurement_value", F.when(F.col("hours") > 24, F.col("measurement_value") * 1e6).otherwise(F.col("measurement_value")))
    a, b = (table(features.build_component_features(d), Z + ["slope"]) for d in (demo, loud))
    pd.testing.assert_frame_equal(a, b)


def test_row_order_and_other_batches_are_irrelevant(demo):
    other = demo.withColumns({"batch_id": F.lit("B99"), "component_id": F.concat(F.lit("X"), "component_id"), "measurement_value": F.col("measurement_value") * 50})
    mixed = demo.unionByName(other).orderBy(F.rand(1))
    a = table(features.build_component_features(demo), Z)
    b = table(features.build_component_features(mixed).filter("batch_id = 'B01'"), Z)
    pd.testing.assert_frame_equal(a, b)


def test_both_acceleration_plans_agree(spark):
    r = tables.readings(spark, "/root/testdata/sf0.001")
    hours = [48.0, 168.0]
    a = features.history_features(r, hours, grid=features.checkpoint_grid(r))
    b = features.history_features(r, hours, grid=None)
    pick = lambda d: d.select("as_of_hour", *KEY, F.round("acceleration", 9).alias("a"))
    assert pick(a).exceptAll(pick(b)).count() == 0 and a.count() == b.count() > 0


def test_spread_plan_equals_window_plan(drifting):
    readings, _ = drifting
    a, b = (features.build_component_features(readings, carry=["tester_channel"], hot=h) for h in (False, True))
    pd.testing.assert_frame_equal(table(a, Z), table(b, Z))
    for fn in (peers.channel_peers, peers.peer_count):
        new = [c for c in fn(a, hot=False).columns if c not in a.columns]
        pd.testing.assert_frame_equal(table(fn(a, hot=False), new), table(fn(b, hot=True), new))
    u, v = (peers.mad_z(a, {"slope": "m"}, hot=h) for h in (False, True))
    pd.testing.assert_frame_equal(table(u, ["m"]), table(v, ["m"]))
    u, v = (peers.peer_statistics(readings, hot=h).toPandas().sort_values(S.PEER).reset_index(drop=True) for h in (False, True))
    pd.testing.assert_frame_equal(u, v[u.columns])


def test_setting_forces_the_spread_plan(spark, drifting):
    readings, _ = drifting
    plain = table(features.build_component_features(readings), Z)
    spark.conf.set("spark.peerscreen.hotGroupRows", "5")
    try:
        forced = table(features.build_component_features(readings), Z)
    finally:
        spark.conf.unset("spark.peerscreen.hotGroupRows")
    pd.testing.assert_frame_equal(plain, forced)


@pytest.mark.parametrize("hot", [False, True])
def test_percentile_rank_like_pandas(spark, hot):
    rows = [("a", f"c{i}", v) for i, v in enumerate([3.0, 1.0, 1.0, None, 7.0, 3.0, 3.0])] + [("b", "c9", 4.0)]
    df = spark.createDataFrame(rows, "batch_id string, component_id string, v double")
    got = peers.percentile_rank(df, "v", "p", keys=["batch_id"], hot=hot).toPandas().sort_values("component_id").reset_index(drop=True)
    want = got.groupby("batch_id")["v"].rank(pct=True, method="average")
    np.testing.assert_allclose(got["p"].fillna(-1), want.fillna(-1))


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("size", [6, 7, 12, 13])
def test_channel_peers_by_brute_force(spark, size, hot):
    rng = np.random.default_rng(size)
    z = np.round(rng.normal(scale=3, size=size), 0)
    df = spark.createDataFrame([("b", "f", "m", f"c{i:02d}", 1, float(v)) for i, v in enumerate(z)], "batch_id string, component_family string, measurement_name string, component_id string, tester_channel int, current_batch_robust_z double")
    got = peers.channel_peers(df, hot=hot).orderBy("component_id").toPandas()
    for i in range(size):
        others = np.delete(z, i)
        assert got[S.CHANNEL_FEATURES[0]][i] == pytest.approx(np.median(others))
        assert got[S.CHANNEL_FEATURES[1]][i] == pytest.approx((others > 3).mean())


def test_too_few_channel_peers_are_undefined(spark):
    df = spark.createDataFrame([("b", "f", "m", f"c{i}", 1, float(i)) for i in range(5)], "batch_id string, component_family string, measurement_name string, component_id string, tester_channel int, current_batch_robust_z double")
    assert peers.channel_peers(df).filter(f"{S.CHANNEL_FEATURES[0]} is not null").count() == 0


def test_bad_arguments(demo):
    with pytest.raises(ValueError):
        features.as_of(demo, -1.0)
    with pytest.raises(ValueError):
        features.history_features(demo, minimum_observations=0)
    with pytest.raises(ValueError):
        features.feature_matrix(demo, ["nope"])
    with pytest.raises(ValueError):
        features.require_clean_feature_names(["slope", "is_defect"])


def test_screen_flags_the_drifting_part(demo):
    got = {r.component_id: r for r in screening.screen(demo).collect()}
    assert got["C012"].is_anomaly and got["C012"].recommendation in ("ENGINEER_REVIEW", "RETEST")
    assert decide.CURRENT_ABOVE in got["C012"].reason_codes
    assert got["C001"].recommendation == "ACCEPT"


def test_one_exchange_per_screen(spark, tmp_path, demo):
    demo.write.parquet(str(tmp_path / "r"))
    df = screening.screen(spark.read.parquet(str(tmp_path / "r")), grid=[0.0, 24.0, 168.0], hot=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "LessThanOrEqual(hours,24.0)" in plan
