import random

import duckdb

from peerscreen.llm import chat, queries

SHAPE = "conv_id long, turn long, role string, text string"


def long_chats():
    turns = [(i % 2 and "assistant" or "user", f"t{i}") for i in range(700)]
    rows = [(1, i, r, x) for i, (r, x) in enumerate(turns)] + [(2, i, r, x) for i, (r, x) in enumerate(turns[:300])]
    rows += [(3, i, r, x + "!") for i, (r, x) in enumerate(turns[:256])] + [(4, i, "user", f"over {i}") for i in range(250, 261)]
    rows += [(5, i, "user", f"void {i}") for i in (None, -300, -1, 0, 1)] + [(6, i, "user", f"void {i}") for i in (-300, -1, 0)]
    rows += [(7, 3, None, "tie"), (7, 3, "a", "tie"), (7, 3, "a", None), (7, 1, "a", "<|im_end|>"), (8, 9000, "user", "far"), (8, 5, "user", "near")]
    rows += rows[100:200]
    random.Random(3).shuffle(rows)
    return rows


def oracle(df, tmp_path):
    df.coalesce(1).write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations/*.parquet')")
    rel = con.sql(queries.OP2_SQL)
    return sorted((tuple(row[rel.columns.index(c)] for c in ("conv_id", "segment", "n_turns", "n_copies", "text")) for row in rel.fetchall()), key=str)


def test_long_conversations_are_one_row(spark, tmp_path):
    df = spark.createDataFrame(long_chats(), SHAPE)
    got = sorted(tuple(r[c] for c in ("conv_id", "segment", "n_turns", "n_copies", "text")) for r in chat.whole(df).collect())
    assert [g[:3] for g in got] == [(1, 0, 700), (3, 0, 256), (4, 0, 11), (5, 0, 5), (7, 0, 4), (8, 0, 2)]
    assert sorted(got, key=str) == oracle(df, tmp_path)


def test_blocks_are_bounded_and_change_nothing(spark, tmp_path, monkeypatch):
    """Repeated, null and equal turn numbers, and many rows without an id, none of which a range of turn numbers bounds."""
    rows = long_chats() + [(None, i % 7 or None, "user", f"no id {i}") for i in range(900)] * 2
    rows += [(20, 4, "user", f"same turn {i}") for i in range(600)] + [(21, None, "user", f"no turn {i}") for i in range(600)]
    rows += [(22, 4, "user", "same turn 0")] + [(23, i * 300, "user", f"sparse {i}") for i in range(500)] + [(24, i * 300, "user", f"sparse {i}") for i in range(450)]
    df = spark.createDataFrame(rows, SHAPE)
    names = ("conv_id", "segment", "n_turns", "n_copies", "text")
    told = lambda d: sorted((tuple(r[c] for c in names) for r in d.collect()), key=str)
    plain, cut = told(chat.whole(df)), told(chat.rendered(df))
    monkeypatch.setattr(chat, "BLOCK_ROWS", 100)
    blocks = chat._turns(df).groupBy("key", "block").count()
    assert blocks.agg({"count": "max"}).first()[0] <= 300 and blocks.where("key = 'c23'").count() > 1 and blocks.where("key = ''").count() > 1
    assert told(chat.whole(df)) == plain and told(chat.rendered(df)) == cut
    assert [p[0] for p in plain].count(None) == 1 and plain == oracle(df, tmp_path)
