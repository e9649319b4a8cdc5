"""Chat formatting after cumulative snapshots are collapsed.

Loggers write a conversation again and again as it grows. A rolling hash over the turns gives
each prefix of a conversation an address; a conversation whose whole address is a proper prefix
of another one is a snapshot of it and goes by an anti-join. Of equal conversations the one
with the smallest id stays. What is left is rendered.

Hashes roll by xor over position-bound turn hashes, so that a conversation of any length can be
cut into blocks, rolled within them, and joined up by the blocks' totals; texts too are rendered by
block and then put together, one row per conversation. Sizes are measured first: a conversation of at
most BLOCK_ROWS rows and BLOCK_BYTES is one block, a larger one is dealt by range in the order of its
turns, whatever its turn numbers are. One row holds the whole text of a conversation, so a maximal
conversation of more text than a Spark row takes (2 GB) fails.

Edge cases: turns are taken in the order of turn, role, text, and a turn logged twice counts once;
null roles render as "unknown" and null texts as empty, and both differ from empty ones in the
hash; null turn numbers, roles and texts come last, as in SQL; rows without a conversation id form one conversation
whose id is null, and which yields to an equal one that has an id; markers inside texts are broken up; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen.llm.common import stored

SEGMENT = 256
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 26

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

SEEDS = (17, 71)


def _order() -> list[Column]:
    return [c for name in ("turn", "role", "text") for c in (F.isnull(name).alias(f"no_{name}"), F.col(name))]


def _turns(chats: DataFrame) -> DataFrame:
    rows = chats.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key"),
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    rows = rows.withColumns({"key": F.coalesce("key", F.lit("")), "segment": F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(1 << 62)).cast("long")})
    large = _large(rows)
    if large.isEmpty():
        return rows.withColumn("block", F.lit(0)).repartition("key").distinct()  # texts move once; windows and groups find them in place
    # Equal rows go first, wherever they are; range partitions are then the blocks, kept as they are by writing them.
    n = max(2, large.agg(F.sum("n_blocks")).first()[0])
    dealt = rows.join(large.select("key"), "key", "left_semi").distinct().repartitionByRange(n, "key", *_order())
    dealt = stored(dealt.withColumn("block", F.spark_partition_id()), "turns")
    rest = rows.join(large.select("key"), "key", "left_anti").withColumn("block", F.lit(0))
    return dealt.unionByName(rest).repartition("key", "block").distinct()


def _large(rows: DataFrame) -> DataFrame:
    """(key, n_blocks) of the conversations that are too large for one block."""
    size = F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("bytes"))
    over = sizes.where((F.col("n") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES))
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("long")
    return stored(over.select("key", n_blocks.alias("n_blocks")), "large")


def prefixes(turns: DataFrame) -> DataFrame:
    """(key, conv_id, h0, h1, last): the rolling hash after every turn; `last` marks whole conversations."""
    ordered = Window.partitionBy("key", "block").orderBy(*_order())
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    hashed = turns.withColumns({f"g{i}": F.xxhash64(F.lit(s), "turn", F.isnull("role"), "role", F.isnull("text"), "text") for i, s in enumerate(SEEDS)})
    rolled = hashed.withColumns({f"p{i}": F.bit_xor(f"g{i}").over(so_far) for i in range(2)}).withColumn("final", F.lead("key").over(ordered).isNull())
    rolled = rolled.select("key", "block", "conv_id", "p0", "p1", "final")
    totals = rolled.where("final").select("key", "block", F.col("p0").alias("t0"), F.col("p1").alias("t1"))
    by_block = Window.partitionBy("key").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "key", "block", *[F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"t{i}") for i in range(2)], F.lead("block").over(by_block).isNull().alias("end")
    )
    joined = rolled.join(totals, ["key", "block"])
    return joined.select("key", "conv_id", *[F.col(f"p{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"h{i}") for i in range(2)], (F.col("final") & F.col("end")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(key, conv_id, n_copies) of conversations that no longer one continues, one of each."""
    rows = stored(prefixes(turns), "prefixes")
    whole = rows.where("last").groupBy("h0", "h1").agg(F.min(F.struct(F.isnull("conv_id").alias("no_id"), "conv_id", "key")).alias("one"), F.count(F.lit(1)).alias("n_copies"))
    inner = rows.where(~F.col("last")).select("h0", "h1").distinct()
    return whole.join(inner, ["h0", "h1"], "left_anti").select("one.key", "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    broken = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), broken(role, "unknown"), F.lit("\n"), broken(text, ""), F.lit(CLOSE))


def _rendered(chats: DataFrame, *by: str) -> DataFrame:
    """One row per maximal conversation and value of `by`: blocks first, then what belongs together."""
    turns = _turns(chats)
    turns = turns.join(maximal(turns), "key")
    one = F.struct(*_order(), rendered_turn(F.col("role"), F.col("text")).alias("line"))
    parts = turns.groupBy("key", "block", *by).agg(
        F.first("conv_id").alias("conv_id"), F.first("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(one)).alias("lines")
    )
    parts = parts.withColumn("text", F.array_join(F.col("lines")["line"], ""))
    out = parts.groupBy("key", *by).agg(
        F.first("conv_id").alias("conv_id"), F.first("n_copies").alias("n_copies"), F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("texts")
    )
    return out.withColumn("text", F.array_join(F.col("texts")["text"], ""))


def rendered(chats: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, text) of the maximal conversations, cut into segments of SEGMENT turn numbers."""
    return _rendered(chats, "segment").select("conv_id", "segment", "n_turns", "n_copies", "text")


def whole(chats: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, text): one row per maximal conversation, as segment 0."""
    return _rendered(chats).select("conv_id", F.lit(0).cast("long").alias("segment"), "n_turns", "n_copies", "text")
