import itertools
import random
import re

from peerscreen.llm import components, jaccard

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = {i: 0 for i in sets}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    return {(i, find(i), links[i]) for i in sets}


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÉTÉ", "Ünder", "the", "of"]
    docs, i = [], 0
    for size in (3, 6, 40, 120, 300):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            docs.append((i, " ".join(base)))
            i += 1
            for changes in (0, 1, 1, 2, 4, 8):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                docs.append((i, ", ".join(copy).upper() if changes == 1 else " ".join(copy)))
                i += 1
    base = [rng.choice(vocabulary) for _ in range(90)]
    for _ in range(150):  # one large group of near copies of one another
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(90)] = rng.choice(vocabulary)
        docs.append((i, " ".join(copy)))
        i += 1
    return docs + [(i, None), (i + 1, ""), (i + 2, " .,! "), (i + 3, "one"), (i + 4, "ONE!")]


def test_against_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 24)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(jaccard, "BIN", 50)
    docs = corpus()
    rows = jaccard.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows} == brute(docs)


def test_one_of_each(spark, hostile):
    rows = jaccard.one_of_each(hostile).collect()
    assert len(rows) == hostile.count() - 2 and all(r.text_hash == "clash" for r in rows)
    assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert jaccard.one_of_each(hostile.limit(0)).collect() == []


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-7)
    assert sorted(least) == list(range(jaccard.STEP, jaccard.HASHES + 1, jaccard.STEP))
    assert all(0 < m < 0.8 * n for n, m in least.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
