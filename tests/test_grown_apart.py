import numpy as np
import pytest
from pyspark import RDD, SparkContext
from pyspark.sql import functions as F

from peerscreen.operators import boosting, trees

KINDS = [("squared", {}), ("absolute", {}), ("pseudo_huber", {}), ("quantile", {"quantile": 0.8}), ("squared", {"depth": None, "leaves": 7, "rounds": 9})]


def fits(rounds):
    p = boosting.BOOST_PARAMS | {"huber_slope": 0.5, "min_rows": 5}
    return [trees.Fit((0, 2, 3), t, s, o, p | {"rounds": rounds} | more, 3 + s, bool(s)) for o, more in KINDS for s in (0, 1) for t in (0, 1)]


def table(spark, n=900):
    """Three features of four are used; one has gaps, one has ties; the second training set is a part of the rows."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0
    x = F.array(draw(1), draw(2), F.when(F.col("id") % 7 > 0, draw(3)), F.floor(draw(4) / 3).cast("double"))
    y = F.array(draw(1) - draw(4) / 3 + draw(9) / 50, F.when(draw(1) > 4, 2.0).otherwise(draw(3) / 9))
    return spark.range(n).select("id", x.alias("x"), y.alias("targets"), F.array(F.lit(True), F.col("id") % 3 > 0).alias("members"))


@pytest.fixture
def jobs(monkeypatch):
    seen = []

    def spy(owner, name):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda self, *a, **k: seen.append(name) or real(self, *a, **k))

    spy(RDD, "collect")
    spy(SparkContext, "runJob")
    return seen


def test_all_rounds_of_a_small_table_are_one_job_and_give_the_same_trees(spark, monkeypatch, jobs):
    monkeypatch.setattr(trees, "WORK", 4000)  # several partitions
    df = table(spark)
    fill, apart = trees.grown(df, 4, 2, fits(12))
    few = len(jobs)
    monkeypatch.setattr(trees, "WHOLE", 0)
    expected, passes = trees.grown(df, 4, 2, fits(12))
    assert few < 12 < len(jobs) - few
    np.testing.assert_array_equal(fill, expected)
    assert [len(g.trees) for g in apart] == [f.params["rounds"] for f in fits(12)]
    for a, b in zip(apart, passes, strict=True):
        assert a.base == b.base and a.trees == b.trees


def test_partitions_of_few_rows_are_joined(spark, monkeypatch):
    df, asked = table(spark, 300), fits(10)
    _, one = trees.grown(df, 4, 2, asked)
    blocks_of = trees.blocks_of
    tens = lambda b: [{k: v[at : at + 10] for k, v in b.items()} for at in range(0, len(b["ids"]), 10)]
    monkeypatch.setattr(trees, "blocks_of", lambda df, models: blocks_of(df, models).flatMap(tens).repartition(9))
    _, many = trees.grown(df, 4, 2, asked)
    for a, b in zip(one, many, strict=True):
        np.testing.assert_allclose(_raw(a), _raw(b), atol=1e-9)


def _raw(g):
    x = np.random.default_rng(2).uniform(0, 10, (200, 3))
    return boosting.Ensemble(["a", "b", "c"], g.base, g.trees).raw(x)


def test_a_training_set_without_rows_leaves_a_constant(spark):
    df = table(spark, 60).withColumn("members", F.array(F.lit(True), F.lit(False)))
    p = boosting.BOOST_PARAMS | {"rounds": 10, "huber_slope": 0.5}
    _, (some, none, middle) = trees.grown(df, 4, 2, [trees.Fit((0, 2), 0, s, o, p, 1, False) for s, o in ((0, "squared"), (1, "squared"), (1, "absolute"))])
    assert any(f >= 0 for t in some.trees for f in t["feature"])
    assert all(t["feature"] == [-1] and t["value"] == [0.0] for g in (none, middle) for t in g.trees)


def test_no_rows_at_all_are_refused(spark):
    p = boosting.BOOST_PARAMS | {"rounds": 10, "huber_slope": 0.5}
    with pytest.raises(ValueError, match="no training rows"):
        trees.grown(table(spark, 0), 4, 2, [trees.Fit((0, 2), 0, 0, "absolute", p, 1, True)])
