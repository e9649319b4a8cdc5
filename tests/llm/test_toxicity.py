import random

import numpy as np

from peerscreen.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    df = toxicity.scored(docs.join(labels, "doc_id").where(toxicity.held_out(toxicity.F.col("doc_id"))), toxicity.trained(docs, labels))
    got = df.select("score", "toxic").collect()
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in got]
    assert np.mean(right) > 0.95
    assert np.mean([r.score < 0.5 for r in got if r.toxic == 0]) > 0.99


def test_misspellings_share_subwords():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)]
    say = lambda *extra: " ".join(rng.sample([*(rng.choice(plain) for _ in range(30)), *extra], 30 + len(extra)))
    texts = [say() for _ in range(300)] + [say("wretchedness") for _ in range(150)]
    model = toxicity.fit(texts, np.array([0] * 300 + [1] * 150))
    scores = toxicity.Scorer(*model).scores([say("wretchednes"), say("wretchhedness"), say("wretchedness!!"), say(), say(), "", None, "  "])
    assert (scores[:3] > 0.5).all() and (scores[3:] < 0.5).all()
    again = toxicity.fit(texts, np.array([0] * 300 + [1] * 150))
    assert (again[0] == model[0]).all()


def test_chunks_and_memory_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["a b c " * 50, "", "word", None, "x" * 5000] * 5
    scorer = toxicity.Scorer(rng.normal(size=toxicity.BUCKETS), -0.3)
    want = scorer.scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 2)
    assert np.allclose([scorer.scores([t])[0] for t in texts], want)
    assert np.allclose(scorer.scores(["", None]), 1 / (1 + np.exp(0.3)))


def test_edges(spark, hostile):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (None, 1), (6, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.trained(hostile, labels)
    rows = toxicity.scored(hostile, model).collect()
    assert len(rows) == hostile.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(hostile.limit(0), model).collect() == []
    assert len({r.score for r in toxicity.scored(hostile, toxicity.trained(hostile, labels.limit(0))).collect()}) == 1
