import random

import numpy as np
import pytest

from peerscreen.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.scored(docs, labels).join(labels, "doc_id").where(Q.held_out(Q.F.col("doc_id"))).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in got]) > 0.95
    assert all(r.score >= 0.5 for r in got if r.quality == 1)


def test_posteriors_against_numpy(spark):
    rng = random.Random(12)
    rows = [(i, f"h{rng.choice([0, 0, 0, 0, 1, 2, 3])}" if rng.random() < 0.95 else None, f"p{rng.randint(0, 3)}", rng.random() ** 2) for i in range(500)] + [(900, "lonely", None, 0.9)]
    got = Q.combined(spark.createDataFrame(rows, "doc_id long, host string, path string, p double").selectExpr("*", "'x' as site", "'y' as mean")).collect()
    hosts, paths = {}, {}
    for _, h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    n = len(rows)
    mean = sum(r[3] for r in rows) / n

    def strength(groups, centre):
        between = sum(len(g) * (np.mean(g) - centre(k)) ** 2 for k, g in groups.items()) / n
        within = sum(len(g) * centre(k) * (1 - centre(k)) for k, g in groups.items()) / n
        return max(1.0, within / between - 1)

    sh = strength(hosts, lambda _: mean)
    centre = {h: (sum(g) + mean * sh) / (len(g) + sh) for h, g in hosts.items()}
    sp = strength(paths, lambda k: centre[k[0]])
    logit = lambda x: np.log(np.clip(x, Q.CLIP, 1 - Q.CLIP) / (1 - np.clip(x, Q.CLIP, 1 - Q.CLIP)))
    assert len(got) == n
    for r in got:
        g, k = hosts[r.host], paths[r.host, r.path]
        host = (sum(g) - r.p + mean * sh) / (len(g) - 1 + sh)
        path = (sum(k) - r.p + host * sp) / (len(k) - 1 + sp)
        assert r.site == pytest.approx(path)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(logit(r.p) + Q.WEIGHT * (logit(path) - logit(mean))))))


def test_edges(spark, hostile):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (None, 1), (6, None), (1, 1)], "doc_id long, quality int")
    rows = Q.scored(hostile, labels).collect()
    assert len(rows) == hostile.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.scored(hostile.limit(0), labels).collect() == []
    assert len({round(r.p, 9) for r in Q.scored(hostile, labels.limit(0)).collect()}) == 1
