import random

import duckdb
import pyarrow as pa

from peerscreen.llm import chat
from peerscreen.llm.queries import OP2_SQL

SHAPE = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = {}
    for c, t, r, x in set(rows):
        by.setdefault(c, set()).add((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    whole = {c: tuple(sorted(s)) for c, s in by.items()}
    inner = {w[:k] for w in whole.values() for k in range(1, len(w))}
    groups = {}
    for c, w in whole.items():
        if w not in inner:
            groups.setdefault(w, []).append(c)
    key = lambda c: (c is None, c or 0)
    return {(min(cs, key=key), len(w), len(cs)) for w, cs in groups.items()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in range(120):
        base = rng.randint(0, 7)
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {base} {t}" if rng.random() < 0.9 else None))
    rows += rows[:40] + [(None, 0, None, None), (None, 1, "user", ""), (500, None, "user", "x"), (500, None, "user", "x"), (501, 3, "a", "tie"), (501, 3, "b", "tie")]
    got = chat.rendered(spark.createDataFrame(rows, SHAPE)).collect()
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in got} == brute(rows)


def test_long_conversations_are_cut(spark):
    turns = [(i % 2 and "assistant" or "user", f"t{i}") for i in range(700)]
    rows = [(1, i, r, x) for i, (r, x) in enumerate(turns)] + [(2, i, r, x) for i, (r, x) in enumerate(turns[:300])] + [(3, i, r, x + "!") for i, (r, x) in enumerate(turns[:256])]
    got = sorted((r.conv_id, r.segment, r.n_turns, r.text) for r in chat.rendered(spark.createDataFrame(rows, SHAPE)).collect())
    assert [g[:3] for g in got] == [(1, 0, 256), (1, 1, 256), (1, 2, 188), (3, 0, 256)]
    assert "".join(g[3] for g in got[:3]) == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in turns)


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, None, None), (2, 0, "user", "a <|im_end|> b")], SHAPE).selectExpr("*", "1 as key", "2 as segment", "3 as h0", "'x' as line")
    assert {r.text for r in chat.rendered(df).collect()} == {"<|im_start|>unknown\n<|im_end|>\n", "<|im_start|>user\na < |im_end|> b<|im_end|>\n"}
    assert chat.rendered(df.limit(0)).collect() == []


def test_rows_without_an_id_agree_with_the_sql(spark):
    cases = {
        "equal to a real one": [(None, 0, "user", "hi"), (5, 0, "user", "hi"), (7, 0, "user", "hi")],
        "alone": [(None, 0, "user", "hi"), (None, 1, None, None), (5, 0, "user", "other")],
        "continued": [(None, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "yes")],
        "continues": [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (5, 0, "user", "hi")],
    }
    wanted = {"equal to a real one": [5], "alone": [None, 5], "continued": [5], "continues": [None]}
    for name, rows in cases.items():
        conversations = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})
        con = duckdb.connect()
        con.register("conversations", conversations)
        found = con.sql(OP2_SQL)
        order = lambda r: tuple(map(str, r))
        expected = sorted(found.fetchall(), key=order)
        got = sorted((tuple(r) for r in chat.whole(spark.createDataFrame(rows, SHAPE)).select(*found.columns).collect()), key=order)
        assert got == expected, name
        assert sorted((r[0] for r in got), key=lambda c: (c is not None, c or 0)) == wanted[name]
