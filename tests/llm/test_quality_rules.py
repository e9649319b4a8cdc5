import random
import re
from collections import Counter

from peerscreen.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    repeated = {q for i, g in enumerate(grams) if count[g] > 1 for q in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


def test_measures_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["a", "b", "c", "été", "🙂", "x|y", "#", "\n", "\n\n", "\x0b", "\t", "same line of words here now\n", "\xa0", " "]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", ""]) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    texts += [None, "", " \n ", "a " * 40, "a b c d e " * 2 + "f g h i j k l m n o p", "\n".join(["w"] * 50)]
    rows = quality_rules.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)


def test_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [("big-bad", bad)] * 60 + [("big-bad", good)] * 5 + [("small-bad", bad)] + [("small-bad", good)] + [(f"h{i % 9}", good) for i in range(400)] + [(None, good), (None, bad)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = quality_rules.judge(docs, carry=["doc_id", "source"]).collect()
    kept = {(r.source, r.base_failed): r.kept for r in got}
    assert kept == {("big-bad", True): False, ("big-bad", False): False, ("small-bad", True): False, ("small-bad", False): True, (None, True): False, (None, False): True} | {
        (f"h{i}", False): True for i in range(9)
    }
    n, f = {}, {}
    for r in got:
        if r.source:
            n[r.source] = n.get(r.source, 0) + 1
            f[r.source] = f.get(r.source, 0) + r.base_failed
    total = sum(n.values())
    mean = sum(f.values()) / total
    var = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n) / total
    strength = max(1.0, mean * (1 - mean) / var - 1)
    assert all(abs(r.host_rate - (f[r.source] + mean * strength) / (n[r.source] + strength)) < 1e-9 for r in got if r.source)


def test_edges(spark, hostile):
    rows = quality_rules.judge(hostile, carry=hostile.columns).collect()
    assert len(rows) == hostile.count() and {r.host for r in rows} == {"clash"}
    assert quality_rules.judge(hostile.limit(0), carry=["doc_id"]).collect() == []
