import pickle

import pytest
from pyspark import RDD, SparkContext
from pyspark.sql import functions as F

from checks import model_queries  # noqa: F401 (registers its queries)
from checks.registry import QUERIES
from peerscreen.operators import boosting, trees


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """100 parts in ten batches, two measurements, eight checkpoint hours."""
    at = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(1600).select(
        F.col("id").alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(4 * (id % 8) as int))").alias("ts"),
        F.expr("id div 16").alias("user_id"),
        F.when(F.col("id") % 16 < 8, "click").otherwise("view").alias("event_type"),
        (F.lit(20.0) + F.col("id") % 8 * (F.col("id") % 7) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 50).alias("value"),
        F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["K-13_cross_validation", "A-16_bundle_reload", "K-16_interval_experiment", "J-12_bags_and_objectives"])
def test_fits_send_the_driver_less_than_one_histogram(spark, monkeypatch, folder, name):
    """Over six partitions no job of a fit brings the driver a quarter of one partition's histograms."""
    monkeypatch.setitem(boosting.BOOST_PARAMS, "rounds", 2)
    monkeypatch.setitem(boosting.HIST_PARAMS, "rounds", 2)
    grown, blocks_of, sent, told = trees.grown, trees.blocks_of, [], []

    def spy(patch, owner, method):
        real = getattr(owner, method)

        def run(self, *args, **named):
            out = real(self, *args, **named)
            sent.append(len(pickle.dumps(out)))
            return out

        patch.setattr(owner, method, run)

    def watched(df, features, sets, fits):
        sent.clear()
        with pytest.MonkeyPatch.context() as patch:
            spy(patch, RDD, "collect")
            spy(patch, SparkContext, "runJob")
            out = grown(df, features, sets, fits)
        cuts = sets * features * trees.BINS * 24  # ranks and values, once per fit
        told.append((max(sent), cuts + sum(3 * len(f.columns) * trees.BINS * 8 for f in fits) / 4, len(sent)))
        return out

    monkeypatch.setattr(trees, "blocks_of", lambda df, models: blocks_of(df, models).repartition(6))
    monkeypatch.setattr(trees, "grown", watched)
    assert QUERIES[name](spark, folder).count()
    assert told and all(most < bound and jobs > 6 for most, bound, jobs in told), told


def test_few_models_and_leaves_are_merged_in_one_task(spark, monkeypatch):
    """Each task tells the driver some 2 KB whatever it finds, so six partitions of six fits are not merged in six tasks."""
    wide, merged = lambda f: F.pmod(F.xxhash64("id", F.lit(f)), F.lit(1000)) / 100.0, []
    df = spark.range(600).select("id", F.array(wide(1), wide(2)).alias("x"), F.array(wide(1) - wide(2)).alias("targets"), F.array(F.lit(True)).alias("members"))
    p = boosting.BOOST_PARAMS | {"rounds": 2, "huber_slope": 0.05}
    fits = [trees.Fit((0, 1), 0, 0, objective, p, seed, False) for objective in ("squared", "absolute") for seed in (1, 2, 3)]
    blocks_of, by_model, by_group = trees.blocks_of, RDD.repartitionAndSortWithinPartitions, RDD.partitionBy
    monkeypatch.setattr(trees, "blocks_of", lambda df, models: blocks_of(df, models).repartition(6))
    monkeypatch.setattr(RDD, "repartitionAndSortWithinPartitions", lambda self, n, *a, **k: merged.append(("models", n)) or by_model(self, n, *a, **k))
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a: merged.append(("groups", n)) or by_group(self, n, *a))
    trees.grown(df, 2, 1, fits)
    assert {kind for kind, _ in merged} == {"models", "groups"}
    assert all(n == 1 for _, n in merged), merged
