import random
import re

import pytest

from peerscreen.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    lengths = {len(g) for g in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def tables(rng, short):
    vocabulary = [f"w{i}" for i in range(30)] + ["ÉTÉ", "été", "The", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(10, 40))) for i in range(15)] + [(20, None), (21, "  ..."), (22, "a " * 30), (23, "A, a; " * 12)]
    items += [(30, "w1 w2 w3 w4"), (31, "w5"), (32, "Unique short item of seven words here"), (33, "w1 W2 w3 w4!")] if short else []
    items.append((40, items[0][1]))
    docs = [(1000 + i, say(rng.randint(0, 60))) for i in range(40)]
    for k in range(60):
        w = words(rng.choice(items[:15])[1])
        a = rng.randrange(len(w))
        docs.append((k, f"{say(rng.randint(0, 20))} {'; '.join(w[a : a + rng.randint(3, 30)]).upper()} {say(rng.randint(0, 20))}"))
    return docs + [(500, None), (501, ""), (502, "a " * 25), (503, say(5000) + " " + items[3][1] + " " + say(5000)), docs[50], docs[51]], items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize(("size", "gram", "filter_"), [(10, 5, 50_000), (10, 7, 0), (6, 3, 50_000), (10, 5, 0)])
def test_against_brute_force(spark, monkeypatch, short, size, gram, filter_):
    monkeypatch.setattr(decontaminate, "FILTER", filter_)  # 0: all fingerprints meet in a shuffled join
    docs, items = tables(random.Random(size + short), short)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminated(d, i, carry=["doc_id"], size=size, gram=gram).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got), key=str) == brute(docs, items, size)
    kept = sorted(r.doc_id for r in decontaminate.clean(d, i, size=size, gram=gram).collect())
    assert kept == sorted(x[0] for x in brute(docs, items, size) if not x[4])


def test_every_shared_span_keeps_a_fingerprint(spark):
    rng = random.Random(9)
    rows = [(i, [str(rng.randint(0, 6)) for _ in range(rng.randint(10, 80))]) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, w array<string>").select("w", decontaminate.fingerprints(decontaminate.F.col("w")).alias("f"))
    for r in df.collect():
        kept = {f.at for f in r.f}
        assert all(any(p <= k <= p + 5 for k in kept) for p in range(len(r.w) - 9))
        assert len(kept) < len(r.w) - 4 or len(r.w) < 14


def test_edges(spark, hostile):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").selectExpr("*", "'x' as words", "'y' as class")
    rows = decontaminate.decontaminated(hostile, items, carry=["doc_id", "key", "windows"]).collect()
    assert len(rows) == hostile.count() and sum(r.contaminated for r in rows) == 2
    clean = decontaminate.clean(hostile, items)
    assert clean.columns == hostile.columns and clean.count() == hostile.count() - 2
    assert decontaminate.decontaminated(hostile.limit(0), items, carry=["doc_id"]).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminated(hostile, items.limit(0), carry=["doc_id"]).collect())
