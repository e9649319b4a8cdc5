import pytest
from pyspark.ml import Pipeline, PipelineModel

from peerscreen import schema as S
from peerscreen.operators import boosting, features
from peerscreen.plans import stages, training


@pytest.fixture(scope="module")
def table(drifting):
    readings, labels = drifting
    f = features.build_component_features(readings, carry=["profile_id", "tester_channel"])
    return training.training_table(f, labels).cache()


def shown(df):
    return sorted(map(str, df.select(*S.KEY4, "isolation_score", "is_anomaly", "pred").collect()))


def test_a_reloaded_pipeline_gives_equal_rows(spark, tmp_path, table):
    quick = boosting.with_params(boosting.FINAL, rounds=3)
    pipeline = Pipeline(stages=[stages.PeerDetector(contamination=0.2, keys=["component_family"], numTrees=12, seed=7), stages.Forecaster(quick)])
    pipeline.write().save(str(tmp_path / "unfitted"))
    again = Pipeline.load(str(tmp_path / "unfitted")).getStages()
    assert [type(s) for s in again] == [stages.PeerDetector, stages.Forecaster] and again[1].config() == quick
    assert again[0].getOrDefault("contamination") == 0.2 and again[0].getSeed() == 7

    fitted = pipeline.fit(table)
    rows = shown(fitted.transform(table))
    assert len(rows) == table.count()
    fitted.write().save(str(tmp_path / "fitted"))
    reloaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert shown(reloaded.transform(table)) == rows
    fitted.write().overwrite().save(str(tmp_path / "fitted"))


def test_settings_reach_the_fit(table):
    loose = stages.PeerDetector(contamination=0.3, numTrees=8).fit(table)
    strict = loose.copy({loose.contamination: 0.05})
    flags = lambda m: m.transform(table).filter("is_model_anomaly").count()
    assert flags(loose) > flags(strict) and loose.forest.forest.count() == 8
    with pytest.raises(ValueError):
        stages.PeerDetector(contamination=0.7)
