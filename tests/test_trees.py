import math
import pickle

import numpy as np
import pytest
from pyspark import RDD, SparkContext
from pyspark.sql import functions as F

from peerscreen.operators import boosting, selection, trees

PARAMS = {"rounds": 4, "depth": 3, "learning_rate": 0.3, "min_rows": 5, "subsample": 1.0, "columns": 1.0, "penalty": 2.0, "huber_slope": 0.5}


# --- exact selection -----------------------------------------------------------------------


def test_keys_sort_like_numbers_and_come_back():
    x = np.array([-np.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 1e-320, 2.5, 1e300, np.inf])
    keys = selection.ordered(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5]
    assert (selection.numbers(keys) == x).all()


@pytest.mark.parametrize("keep", [4096, 8, 1])
def test_order_statistics_equal_numpy(spark, monkeypatch, keep):
    monkeypatch.setattr(selection, "KEEP", keep)
    rng = np.random.default_rng(5)
    data = {"ties": rng.integers(0, 5, 900).astype(float), "wide": rng.normal(size=900) * 10.0 ** rng.integers(-200, 200, 900), "one": np.array([3.0])}
    parts = spark.sparkContext.parallelize([{g: x[i::7] for g, x in data.items()} for i in range(7)], 3)
    levels = (0.0, 0.05, 0.5, 0.77, 1.0)
    # The kept values and counts are settled on the driver too, where the bound is the patched one.
    got = selection.quantiles(parts, lambda b: b, lambda g: levels)
    for g, x in data.items():
        np.testing.assert_allclose(got[g], np.quantile(x, levels), rtol=1e-12)


def test_medians_of_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (4.0, None), (2.0, None), (10.0, None)], "a double, b double")
    assert boosting.medians(df, ["a", "b"]).first().asDict() == {"a": 3.0, "b": 0.0}


# --- a plain version of the trees ------------------------------------------------------------


def plain(x, y, p, objective, cuts, base, leaves=None):
    """Boosting by direct search over the same cut points; returns forecasts and the leaves per round."""
    f, sizes = np.full(len(y), base), []
    for _ in range(p["rounds"]):
        g, h = trees.gradients(objective, y - f, p)
        h = np.ones(len(y)) if h is None else h
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p["penalty"])  # noqa: E731, B023

        def split(rows, depth):
            if p.get("depth") and depth >= p["depth"]:
                return None
            best = None
            for c in range(x.shape[1]):
                for cut in cuts[c]:
                    a, b = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                    if len(a) and len(b) and h[a].sum() >= p["min_rows"] and h[b].sum() >= p["min_rows"]:  # noqa: B023
                        gain = score(a) + score(b) - score(rows)  # noqa: B023
                        if gain > trees.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                            best = (gain, a, b)
            return best

        open_, done = [(split(np.arange(len(y)), 0), np.arange(len(y)), 0)], []
        while open_:
            at = max(range(len(open_)), key=lambda i: open_[i][0][0] if open_[i][0] else -1.0)
            best, rows, depth = open_.pop(at)
            if best is None or leaves and len(open_) + len(done) + 1 >= leaves:
                done.append(rows)
                continue
            open_ += [(split(r, depth + 1), r, depth + 1) for r in best[1:]]
        sizes.append(len(done))
        step = np.zeros(len(y))
        for rows in done:
            if trees.selects(objective):
                step[rows] = np.quantile((y - f)[rows], p.get("quantile", 0.5))
            else:
                step[rows] = -g[rows].sum() / (h[rows].sum() + p["penalty"])
        f = f + p["learning_rate"] * step
    return f, sizes


def table(spark, n=400, d=3, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=n)
    rows = [(int(i), [float(v) for v in r], [float(t)], [True, bool(i % 3)]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, targets array<double>, members array<boolean>"), x, y


def forecasts(grown, x):
    return boosting.Ensemble([str(i) for i in range(x.shape[1])], grown.base, grown.trees).raw(x)


def cuts_of(x):
    n = len(x)
    return [np.unique(np.sort(c)[[max(math.ceil(n * i / trees.BINS) - 1, 0) for i in range(1, trees.BINS)]]) for c in x.T]


@pytest.mark.parametrize("objective", ["squared", "absolute", "pseudo_huber", "quantile"])
def test_trees_equal_a_plain_version(spark, objective):
    df, x, y = table(spark)
    p = PARAMS | ({"quantile": 0.8} if objective == "quantile" else {})
    fits = [trees.Fit((0, 1, 2), 0, 0, objective, p, 1, False), trees.Fit((0, 1, 2), 0, 1, objective, p, 1, True)]
    _, (whole, part) = trees.grown(df, 3, 2, fits)
    base = {"squared": y.mean(), "quantile": np.quantile(y, 0.8)}.get(objective, np.median(y))
    assert whole.base == pytest.approx(base)
    np.testing.assert_allclose(forecasts(whole, x), plain(x, y, p, objective, cuts_of(x), base)[0], atol=1e-9)
    inside = np.arange(len(y)) % 3 > 0
    np.testing.assert_allclose(forecasts(part, x)[inside], plain(x[inside], y[inside], p, objective, cuts_of(x[inside]), 0.0)[0], atol=1e-9)


def test_best_leaf_first_stops_at_the_number_of_leaves(spark):
    df, x, y = table(spark, seed=8)
    p = PARAMS | {"depth": None, "leaves": 7, "min_rows": 10}
    _, (got,) = trees.grown(df, 3, 2, [trees.Fit((0, 1, 2), 0, 0, "squared", p, 1, False)])
    expected, sizes = plain(x, y, p, "squared", cuts_of(x), y.mean(), leaves=7)
    assert [sum(f < 0 for f in t["feature"]) for t in got.trees] == sizes == [7] * 4
    np.testing.assert_allclose(forecasts(got, x), expected, atol=1e-9)


def test_models_do_not_depend_on_company_or_on_row_order(spark):
    df, x, _ = table(spark)
    p = PARAMS | {"subsample": 0.7, "columns": 0.7}
    fit = trees.Fit((0, 1, 2), 0, 1, "absolute", p, 9, True)
    _, (alone,) = trees.grown(df, 3, 2, [fit])
    others = [trees.Fit((0, 2), 0, 0, "squared", p | {"rounds": 2}, 4, False), fit, trees.Fit((1,), 0, 1, "pseudo_huber", p, 9, True)]
    _, (_, among, _) = trees.grown(df.orderBy(F.rand(1)).repartition(5), 3, 2, others)
    np.testing.assert_allclose(forecasts(alone, x), forecasts(among, x), atol=1e-12)
    assert all(len({f for f in t["feature"] if f >= 0}) <= 2 for t in alone.trees)  # of three columns


def test_many_partitions_send_splits_and_not_histograms(spark, monkeypatch):
    """Six partitions give the trees of one, and no job brings more than a few hundred bytes a model to the driver."""
    df, _, _ = table(spark, n=1500)
    p = PARAMS | {"subsample": 0.8}
    kinds = [("squared", p), ("absolute", p), ("squared", p | {"depth": None, "leaves": 7})]
    fits = [trees.Fit((0, 1, 2), 0, s, objective, q, 1, False) for objective, q in kinds for s in (0, 1)]
    _, one = trees.grown(df, 3, 2, fits)
    sent = []

    def spy(owner, name):
        real = getattr(owner, name)

        def run(self, *args, **named):
            out = real(self, *args, **named)
            sent.append(len(pickle.dumps(out)))
            return out

        monkeypatch.setattr(owner, name, run)

    spy(RDD, "collect")
    spy(SparkContext, "runJob")
    blocks_of = trees.blocks_of
    monkeypatch.setattr(trees, "blocks_of", lambda df, models: blocks_of(df, models).repartition(6))
    _, many = trees.grown(df, 3, 2, fits)
    for a, b in zip(one, many):
        assert a.base == pytest.approx(b.base) and len(a.trees) == len(b.trees) == 4
        for t, u in zip(a.trees, b.trees):
            assert t["feature"] == u["feature"] and t["threshold"] == u["threshold"]
            np.testing.assert_allclose(t["value"], u["value"], atol=1e-9)
    # Once per fit, cut points of three features and two sets; after that one split a node.
    assert len(sent) > 12 and max(sent) < 12_000


def test_hist_candidate_has_at_most_fifteen_leaves_of_any_depth():
    p = boosting.settings(boosting.HIST)
    assert (p["leaves"], p["depth"], p["penalty"], p["rounds"]) == (15, None, 5.0, 250)


def test_missing_features_are_named(spark):
    with pytest.raises(ValueError, match="limit_fraction"):
        boosting.fit_model(boosting.FINAL, spark.createDataFrame([(1.0, "a")], "y double, component_id string"))
