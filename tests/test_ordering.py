import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscreen.operators import ordering


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [("big", float(v)) for v in np.round(rng.normal(size=501), 1)]
    rows += [("small", 2.0), ("small", 2.0), ("pair", 1.0), ("pair", 4.0), ("one", 7.0), ("gap", None), ("gap", 3.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


def groups(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: np.array(sorted(v)) for g, v in out.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_running_totals_match_brute_force(values, hot):
    rows, df = values
    want = {}
    for g, v in groups(rows).items():
        for x in np.unique(v):
            want[(g, x)] = (int((v == x).sum()), int((v < x).sum()), len(v))
    got = {(r.g, r.v): (r.weight, r.before, r.total) for r in ordering.running_totals(df, ["g"], "v", hot=hot).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [False, True])
def test_median_and_percentile(values, hot):
    rows, df = values
    want = groups(rows)
    for r in ordering.group_median(df, ["g"], "v", "m", hot=hot).collect():
        assert r.m == pytest.approx(np.median(want[r.g]))
    for r in ordering.group_percentile(df, ["g"], "v", 0.9, "p", hot=hot).collect():
        assert r.p == pytest.approx(np.percentile(want[r.g], 90))


@pytest.mark.parametrize("hot", [False, True])
def test_global_order_statistic(values, hot):
    rows, df = values
    everything = np.sort([v for _, v in rows if v is not None])
    got = ordering.order_statistics(df, [], "v", {"third": lambda n: F.lit(3), "last": lambda n: n, "none": lambda n: n + 1}, hot=hot).first()
    assert (got.third, got.last, got.none, got.n) == (everything[2], everything[-1], None, len(everything))


@pytest.mark.parametrize("hot", [False, True])
def test_numbered(spark, hot):
    df = spark.createDataFrame([("a", f"{i:03d}") for i in range(50)] + [("b", "x")], "g string, o string").repartition(5)
    got = {(r.g, r.o): (r.position, r.group_size) for r in ordering.numbered(df, ["g"], "o", hot=hot).collect()}
    assert got[("a", "000")] == (1, 50) and got[("a", "049")] == (50, 50) and got[("b", "x")] == (1, 1)


def test_size_check(values, spark):
    _, df = values
    assert ordering.has_hot_group(df, ["g"], bound=500)
    assert not ordering.has_hot_group(df, ["g"], bound=501)
    assert ordering.has_hot_group(df, [], bound=100)


def test_salted_join_keeps_rows(values):
    _, df = values
    stats = df.groupBy("g").agg(F.count("v").alias("n"))
    joined = ordering.salted_join(df, stats, ["g"])
    assert joined.count() == df.count() and joined.filter("n is null").count() == 0


def test_copies_of_a_salted_join_count_before_they_are_broadcast(spark):
    """30 000 groups fit the bound of a broadcast, their copies for all salts don't."""
    bound = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "2m")
    try:
        df = spark.range(30_000).select((F.col("id") * 0.37).alias("g"))
        stats = ordering.stable(df).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        joined = ordering.salted_join(ordering.stable(df), stats, ["g"])
        rows = joined.agg(F.sum("n"))
        assert rows.collect()[0][0] == 30_000
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set(bound, before)
