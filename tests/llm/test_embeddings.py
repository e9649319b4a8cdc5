import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscreen.llm import hard_negatives, kmeans_tree, queries, whitening

SHAPE = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def table(spark, x, labels=None, ids=None, extra=()):
    ids = list(range(len(x))) if ids is None else ids
    labels = [0] * len(x) if labels is None else labels
    rows = [(i, [float(c) for c in v], int(l)) for i, v, l in zip(ids, x, labels)]
    return spark.createDataFrame([*rows, *extra], SHAPE).repartition(3)


def clustered(n=700, d=12, seed=1, groups=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    label = rng.integers(0, groups, n)
    return (centre[label] + 0.4 * rng.normal(size=(n, d))).astype(np.float32), label


@pytest.fixture(scope="module")
def hostile_vectors(spark):
    """Nulls, values that are no numbers, zeros, other lengths, copies, repeated rows and ids, clashing names."""
    x, label = clustered(60, 6, 2, 3)
    bad = [
        (100, None, 1), (200, [1.0, None, 0.0, 0.0, 0.0, 1.0], 1), (300, [NAN, 0.0, 0.0, 0.0, 0.0, 1.0], 1), (400, [INF, 0.0, 0.0, 0.0, 0.0, 1.0], 1),
        (500, [], 1), (600, [1.0, 2.0], 1), (700, [0.0] * 6, 1), (None, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 1), (800, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0], None),
        (900, [1.0, 0.5, 0.0, 0.0, 0.0, 1.0], 2), (900, [1.0, 0.5, 0.0, 0.0, 0.0, 1.0], 2), (900, [0.0, 0.5, 0.0, 0.0, 0.0, 1.0], 2),
        *[(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 3) for i in range(45)], (None, None, None),
    ]
    df = table(spark, x, label, extra=bad)
    return df.selectExpr("*", *[f"'clash' as {c}" for c in "id v x row at key entry leaf cell rank score query anchor summary chunk block n whitened".split()])


# --- whitening -------------------------------------------------------------------------


def whiten(x):
    x = np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return ((n * x - s) ** 2).sum(axis=1), centred @ vectors[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum()


def test_whitening_equals_numpy_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)
    monkeypatch.setattr(whitening, "MID_BLOCKS", 2)
    monkeypatch.setattr(whitening, "COLUMNS", 5)
    x, _ = clustered()
    rows = whitening.whitened(table(spark, x), components=8).collect()
    deviation, expected, explained = whiten(x)
    assert len(rows) == len(x) and {r["n"] for r in rows} == {len(x)}
    got = np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"])])
    sign = np.sign((got * expected[:, :8]).sum(axis=0))
    assert np.abs(got - expected[:, :8] * sign).max() < 1e-9
    assert [r["deviation"] for r in sorted(rows, key=lambda r: r["vec_id"])] == deviation.tolist()
    assert np.allclose(rows[0]["explained"], explained[:8], rtol=1e-9) and rows[0]["identity_error"] < 1e-9


def test_whitening_of_hostile_rows(spark, hostile_vectors):
    rows = whitening.whitened(hostile_vectors).collect()
    ids = [r["vec_id"] for r in rows]
    assert ids.count(900) == 3 and ids.count(None) == 1 and 700 in ids and 800 in ids  # whitening asks for neither label nor length
    assert not {100, 200, 300, 400, 500, 600} & set(ids) and len(ids) == 60 + 1 + 1 + 1 + 3 + 45
    assert all(len(r["whitened"]) == 6 for r in rows) and rows[0]["identity_error"] < 1e-4


def test_whitening_without_variance_and_without_rows(spark):
    flat = whitening.whitened(table(spark, np.ones((5, 3)))).collect()
    assert [r["whitened"] for r in flat] == [[None] * 3] * 5 and flat[0]["explained"] == [0.0] * 3 and flat[0]["deviation"] == 0
    line = whitening.whitened(table(spark, np.array([[0.0, 0, 1], [1, 0, 1], [2, 0, 1]]))).collect()
    assert {tuple(w is None for w in r["whitened"]) for r in line} == {(False, True, True)}
    assert whitening.whitened(table(spark, [], extra=[(1, None, 1)])).collect() == []


# --- nearest neighbours ------------------------------------------------------------------


def true_neighbours(rows, k):
    """{(query id, vector): ids} by brute force; rows are distinct (id, vector)."""
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in rows if j != i)
            out[i, tuple(v)] = [j for _, j in near[:k]]
    return out


def test_all_leaves_give_the_exact_answer(spark):
    x, _ = clustered(900)
    x[100:160] = x[100]  # copies: more than k of one vector
    df = table(spark, x)
    found = {}
    for r in kmeans_tree.neighbours(df, F.col("vec_id") % 20 == 0, target=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r)
    expected = true_neighbours([(i, tuple(map(float, v))) for i, v in enumerate(x)], 20)
    assert set(found) == {i for i, _ in expected}
    hit = sum(len({r["vec_id"] for r in found[i]} & set(near)) for (i, _), near in expected.items())
    assert hit >= 0.99 * 20 * len(expected)  # calibrated on some of the queries
    assert [r["vec_id"] for r in found[100]] == list(range(101, 121))  # equal scores: smaller ids first
    assert all([r["rank"] for r in rows] == list(range(1, 21)) for rows in found.values())


def test_recall_with_few_visits(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "CELL_ROWS", 100)
    monkeypatch.setattr(kmeans_tree, "CHUNK", 16)
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 40)
    x, _ = clustered(1500, groups=12)
    seen = {}
    calibrated = kmeans_tree.calibrated

    def told(entries, queries_, tree, *args):
        seen["visits"], seen["recall"] = calibrated(entries, queries_, tree, *args)
        seen["leaves"] = tree.leaves
        return seen["visits"], seen["recall"]

    monkeypatch.setattr(kmeans_tree, "calibrated", told)
    found = {}
    for r in kmeans_tree.neighbours(table(spark, x), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    expected = true_neighbours([(i, tuple(map(float, v))) for i, v in enumerate(x)], 20)
    recall = sum(len(found[i] & set(near)) for (i, _), near in expected.items()) / (20 * len(expected))
    assert recall >= 0.9 and seen["visits"] < 0.7 * seen["leaves"]


def test_neighbours_of_hostile_rows(spark, hostile_vectors):
    rows = kmeans_tree.neighbours(hostile_vectors, F.col("vec_id") % 20 == 0, k=70).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    whole = {*range(60), 800, 900, *range(1000, 1045)}
    assert set(by) == {0, 20, 40, 800, 900, 1000, 1020, 1040}
    assert all(i not in near and set(near) <= whole for i, near in by.items())
    assert len(by[0]) == 70 and len(by[900]) == 140  # two vectors under one id
    few = kmeans_tree.neighbours(table(spark, [[1.0, 0], [0, 1], [1, 1]]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(2, 1.0), (1, 0.0)]
    assert kmeans_tree.neighbours(table(spark, [], extra=[(1, None, 1)]), F.col("vec_id") % 20 == 0).collect() == []


# --- hard negatives ----------------------------------------------------------------------


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(4)
    a, x = rng.integers(-300, 300, (20, 21)).astype(float), rng.integers(-300, 300, (50, 21)).astype(float)
    x[:10] = 7
    true, widths = a @ x.T, []
    for least, most in hard_negatives.bounds(hard_negatives.summaries(a), hard_negatives.summaries(x), 21):
        assert (least <= true).all() and (true <= most).all()
        widths.append((most - least).mean())
    assert widths[0] > widths[1] > widths[2]


def brute(rows, positives=5, negatives=10):
    out = set()
    score = lambda a, b: int(sum(int(np.floor(256 * float(p))) * int(np.floor(256 * float(q))) for p, q in zip(a, b)))
    for n, (i, l, v) in enumerate(rows):
        if i % 100:
            continue
        all_ = sorted(((-score(v, w), j, m) for o, (j, m, w) in enumerate(rows) if j != i or m != l))
        for s, p, _ in [r for r in all_ if r[2] == l and r[1] != i][:positives]:
            inside = [(-t, j) for t, j, m in all_ if m != l and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out |= {(i, p, k, j, -s, t) for k, (t, j) in enumerate(inside, 1)}
    return out


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return {tuple(r) for r in hard_negatives.mined(df, F.col("id") % 100 == 0, label=label).collect()}


def test_hard_negatives_equal_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    x, label = clustered(420, 20)
    x[200:240] = x[200]
    rows = [(i, (int(l) + 1) % 10 if i % 7 == 0 else int(l), v) for i, (l, v) in enumerate(zip(label, x))]
    assert mined(table(spark, x, label)) == brute(rows)


def test_hard_negatives_of_hostile_rows_equal_sql(spark, hostile_vectors, tmp_path):
    import duckdb

    hostile_vectors.select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(hostile_vectors) == set(con.sql(f"select {', '.join(names)} from ({queries.OP13_SQL})").fetchall())
    assert mined(table(spark, [], extra=[(1, None, 1)])) == set()
