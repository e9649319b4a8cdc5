import random
import re
import time

from pyspark.sql import functions as F

from peerscreen.llm import secrets
from peerscreen.llm.common import fresh_path

RULES = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), k, m.end(), name) for k, (name, rule, passes) in enumerate(RULES) for m in rule.finditer(text or "") if passes(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def test_spans_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "Token", "API_KEY", "apikey", "sEcret", "passwd", '"', "'", " ", ":", "=", "abc", "AKIA", "AKIA" + "Q7" * 9, "0f" * 13, "é", "🙂", "\n", "deadbeef", "x_y.z-9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, "", "token=token=abcdefgh", "token: token: abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.findings(df, secrets.scan(df)).select("text", secrets.label(F.col("spans")).alias("told"), secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.told == brute(r.text)
        out, at = "", 0
        spans = sorted((int(a), int(b)) for a, b in (x.split(":")[1:] for x in r.told.split(",") if x))
        for a, b in spans:
            if a >= at:
                out += (r.text or "")[at:a] + secrets.MARK
            at = max(at, b)
        assert r.clean == (r.text if not spans else out + r.text[at:])


def test_ledger_scans_what_it_has_not_seen(spark):
    path = fresh_path(spark, "ledger")
    secrets.begin(spark, path)
    one = spark.createDataFrame([(1, "token=abcdef12"), (2, "token=abcdef12"), (3, "clean")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "token=abcdef12"), (1, "a newer version"), (4, "password: hunter2x")], "doc_id long, text string")
    assert secrets.scan(one, path).count() == 2
    assert secrets.scan(one, path).count() == 2
    entries = secrets.scan(two, path)
    assert entries.count() == 4
    assert secrets.scan(two, path, rule_version="2").count() == 3
    assert secrets.ledger(spark, path).count() == 7
    got = sorted((r.doc_id, len(r.spans)) for r in secrets.findings(one.unionByName(two), entries).collect())
    assert got == [(1, 0), (1, 1), (1, 1), (2, 1), (3, 0), (4, 1)]


def test_edges(spark, hostile):
    rows = secrets.findings(hostile, secrets.scan(hostile)).collect()
    assert len(rows) == hostile.count()
    assert {r.doc_id: len(r.spans) > 0 for r in rows if r.doc_id in (2, 3, 4, 5, 6)} == {2: False, 3: False, 4: False, 5: True, 6: True}
    assert secrets.scan(hostile.limit(0)).collect() == []


def test_many_secrets_in_one_text(spark):
    n = 50_000
    text = " ".join(f"{i:024x}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "é" + text[:2000] + "🙂 token=abcdef12")], "doc_id long, text string")
    began = time.time()
    rows = secrets.findings(df, secrets.scan(df)).select("doc_id", secrets.label(F.col("spans")).alias("told"), secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert time.time() - began < 60
    whole, part = sorted(rows, key=lambda r: r.doc_id)
    assert whole.told == brute(text) and whole.clean == " ".join([secrets.MARK] * n)
    assert part.told == brute("é" + text[:2000] + "🙂 token=abcdef12") and part.clean.startswith("é" + secrets.MARK) and part.clean.endswith("🙂 " + secrets.MARK)


def test_a_doubled_ledger_counts_once(spark):
    path = fresh_path(spark, "ledger")
    df = spark.createDataFrame([(1, "token=abcdef12"), (2, "clean")], "doc_id long, text string")
    secrets.begin(spark, path)
    entries = secrets.scan(df, path)
    entries.write.mode("append").parquet(path + "-copy")
    doubled = entries.unionByName(secrets.ledger(spark, path + "-copy"))
    assert sorted((r.doc_id, len(r.spans)) for r in secrets.findings(df, doubled).collect()) == [(1, 1), (2, 0)]
