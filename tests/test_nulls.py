"""NULL keys, repeated and unexpected hours: every plan gives the same rows, or says why not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscreen import schema as S
from peerscreen.operators import features, iforest, ordering, peers, quality


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(f"c{i}", None if i % 3 == 0 else f"b{i % 2}", "f", "m", 24.0, float(i % 5), i % 2, None if i == 7 else float(i * i % 11)) for i in range(40)]
    return spark.createDataFrame(rows, "component_id string, batch_id string, component_family string, measurement_name string, as_of_hour double, slope double, tester_channel int, current_value double").cache()


def same(a, b):
    key = lambda r: tuple(str(x) for x in (r.component_id, r.batch_id))
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(left) == len(right) == 40
    for x, y in zip(left, right, strict=True):
        for c in a.columns:
            assert x[c] == y[c] or x[c] == pytest.approx(y[c]), (c, x, y)


@pytest.mark.parametrize(
    "operator",
    [
        lambda df, hot: peers.robust_z(df, {"slope": "z"}, keys=S.PEER, hot=hot),
        lambda df, hot: peers.mad_z(df, {"slope": "z"}, keys=S.PEER, hot=hot),
        lambda df, hot: peers.peer_count(df, keys=S.PEER, hot=hot),
        lambda df, hot: peers.percentile_rank(df, "current_value", "rank", keys=S.PEER, hot=hot),
        lambda df, hot: peers.channel_peers(peers.robust_z(df, {"slope": "current_batch_robust_z"}, keys=S.PEER, hot=False), hot=hot),
        lambda df, hot: ordering.numbered(df, S.PEER, "component_id", hot=hot),
    ],
)
def test_null_keys_on_both_plans(grouped, operator):
    ordinary, spread = operator(grouped, False), operator(grouped, True)
    same(ordinary, spread.select(*ordinary.columns))
    assert ordinary.filter("batch_id is null").count() == 14


def test_null_scope_on_both_scoring_plans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", "b", None if i % 2 else "f", "m", 24.0, float(rng.normal()), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "component_id string, batch_id string, component_family string, measurement_name string, as_of_hour double, x double, y double")
    model = iforest.fit(df, keys=S.SCOPE, columns=["x", "y"], n_trees=10)
    score = lambda: {r.component_id: r.isolation_score for r in model.raw_scores(df).collect()}
    small = score()
    monkeypatch.setattr(iforest, "BROADCAST_NODES", 0)
    monkeypatch.setattr(iforest, "ROWS_PER_GROUP", 10)
    large = score()
    assert len(small) == len(large) == 60 and None not in small.values()
    assert all(small[k] == pytest.approx(large[k]) for k in small)


def test_trees_draw_from_all_rows(spark):
    df = spark.range(30_000).select(F.concat(F.lit("c"), "id").alias("component_id"), *[F.lit("x").alias(c) for c in S.KEY4[1:]], F.lit(24.0).alias("as_of_hour"), F.rand(3).alias("x"))
    forest = iforest.fit(df, columns=["x"], n_trees=60).forest.collect()
    assert len(forest) == 60 and all(t.n_sample == 256 for t in forest)
    cuts = [round(c, 12) for t in forest for c, f in zip(t.threshold, t.feature, strict=True) if f >= 0]
    assert len(set(cuts)) > 0.99 * len(cuts)


def test_repeated_hours_are_merged_alike(spark):
    rows = [("c", "b", "f", "m", h, v, 9.0) for h, v in ((0.0, 1.0), (0.0, 2.0), (8.0, 2.5), (16.0, 4.0), (24.0, 5.0), (24.0, 7.0))]
    readings = spark.createDataFrame(rows, "component_id string, batch_id string, component_family string, measurement_name string, hours double, measurement_value double, upper_limit double")
    free = features.history_features(readings).first().acceleration
    grid = features.history_features(readings, grid=[0.0, 8.0, 16.0, 24.0]).first().acceleration
    assert free == pytest.approx(grid) and free != 0.0
    with pytest.raises(Exception, match="not in the grid"):
        features.history_features(readings, grid=[0.0, 8.0, 24.0]).collect()


def test_any_number_of_profiles(spark):
    df = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 1500).alias("profile_id"))
    known = df.filter("profile_id < 'p9'").distinct()
    good, other = quality.supported_profiles(df.unionByName(spark.createDataFrame([(None,)], "profile_id string")), known)
    assert (good.count(), other.count()) == (df.filter("profile_id < 'p9'").count(), df.filter("profile_id >= 'p9'").count() + 1)


def test_no_folder_of_its_own(spark):
    class Unset:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ordering.shared_folder(Unset)
