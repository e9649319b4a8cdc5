import duckdb
import pytest
from pyspark.sql import functions as F

from checks import metric_queries, model_queries
from checks.registry import ORACLE, QUERIES
from peerscreen.operators import boosting, features
from peerscreen.plans import evaluation, training


def settings(config):
    return {**boosting.BOOST_PARAMS, **config.params}


@pytest.mark.parametrize("config", [model_queries.ABSOLUTE, model_queries.SQUARED, model_queries.HUBER])
def test_registered_fits_are_the_published_ones(config):
    assert config in [*boosting.COMPARISON, boosting.FINAL]
    assert (settings(config)["rounds"], settings(config)["learning_rate"]) == (350, 0.04)


class Asked(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "place", "asked", "at"),
    [
        ("K-07_repeated_splits_with_forest", (evaluation, "evaluate_repeated_splits"), metric_queries.SEEDS, 2),
        ("K-10_ladder_with_forest", (evaluation, "early_warning_ladder"), metric_queries.LADDER, "hours"),
        ("K-11_grid_with_forest", (evaluation, "parameter_sweep"), metric_queries.SWEEP_HOURS, "hours"),
        ("K-13_cross_validation", (training, "run_cross_validation"), boosting.COMPARISON, 1),
        ("K-14_configuration_comparison", (training, "run_cross_validation"), boosting.COMPARISON, 1),
        ("K-15_seed_check", (training, "run_seed_check"), (26170, 1, 2, 3), 3),
        ("K-15_prevalence_readout", (training, "run_prevalence_readout"), [boosting.COMPARISON[0], boosting.COMPARISON[6]], 1),
        ("K-16_interval_experiment", (training, "run_interval_experiment"), boosting.COMPARISON[6], 1),
    ],
)
def test_queries_ask_for_all_of_it(spark, monkeypatch, name, place, asked, at):
    def told(*args, **named):
        raise Asked(args[at] if isinstance(at, int) else named[at])

    monkeypatch.setattr(*place, told)
    with pytest.raises(Asked) as e:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == asked


def test_bundle_has_all_candidates(spark, monkeypatch):
    def told(*args, configs=None, **named):
        raise Asked(configs)

    monkeypatch.setattr(training, "train_bundle", told)
    with pytest.raises(Asked) as e:
        QUERIES["K-17_train_bundle"](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] is None  # its default: ridge, histogram, squared, final


@pytest.mark.parametrize("name", ["K-14_configuration_comparison", "K-15_seed_check", "K-16_interval_experiment", "A-16_bundle_reload", "K-13_rows_out_of_fold", "J-08_candidates_forecast_all", "J-12_bags_and_objectives", "J-17_shares_of_gain"])
def test_queries_run_to_the_end(spark, monkeypatch, name):
    """With two rounds instead of hundreds, but on real tables, features and folds, against the oracle where there is one."""
    monkeypatch.setitem(boosting.BOOST_PARAMS, "rounds", 2)
    monkeypatch.setitem(boosting.HIST_PARAMS, "rounds", 2)
    folder = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, folder).collect()
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{folder}/events.parquet'")
        found = con.sql(ORACLE[name])
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(key([r[c] for c in found.columns]) for r in rows) == sorted(map(key, found.fetchall()))


def test_whole_fit_of_a_small_table(spark, drifting):
    readings, labels = drifting
    f = features.build_component_features(readings, carry=["profile_id", "tester_channel"])
    rows = training.training_table(f, labels)
    model = boosting.fit_model(model_queries.SQUARED, rows)
    assert len(model.ensemble.trees) == 350
    assert model.transform(rows).agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0] < 0.1
