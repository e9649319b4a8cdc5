"""Near duplicates: n-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word shingles form one node. Nodes that agree on a band of MinHash
values are candidates. Within blocks of a bucket, candidates are compared a few MinHash values
at a time, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below a tolerance. What survives is verified exactly on whole
shingle sets.

Groups of any size stay distributed: a large bucket or group is dealt into blocks of bounded size
and pairs of blocks, each in a task of its own, and a task gives one row per node (its number of
links and one link towards the smallest node it reaches), never one row per pair. Copies of a
node are counted, not paired.

Edge cases: texts of one to four words are one shingle; null, empty and wordless texts have no
node, no links and a class of their own; repeated rows are copies; a class is named by its
smallest id, null ids apart, and a class without ids has a null name; empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peerscreen.llm.common import stored
from peerscreen.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
BLOCK = 512  # nodes
BLOCK_SHINGLES = 500_000
BIN = 2_000  # rows dealt to one Python call, about
BROADCAST_IDS = 500_000

U = np.uint64
_SEEDS = np.random.default_rng(20240501).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)
_LETTERS = np.zeros(256, dtype=np.uint8)  # a word's bytes, A-Z lowered; 0 separates words
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _LETTERS[_b] = _b
_LETTERS[65:91] = np.arange(97, 123)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, all words hashed in one sweep over the bytes."""
    data = _LETTERS[np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    inside = data != 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    last = np.zeros(len(data), dtype=np.int64)
    last[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(last)
    place[~inside] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    word = mixed(np.add.reduceat(data * powers[place], starts))
    first = np.searchsorted(starts, bounds)
    run = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
    for k in range(size):
        run = run * U(0xD6E8FEB86659FD93) + word[k : k + len(run)]
    run = mixed(run)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            short = U(b - a)
            for w in word[a:b]:
                short = short * U(0xD6E8FEB86659FD93) + w
            out.append(mixed(np.array([short])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per set; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    flat = (np.concatenate(sets) >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * (_SEEDS[0, k] | np.uint32(1)) ^ _SEEDS[1, k], starts)
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * U(0xD6E8FEB86659FD93) + sig[:, k::ROWS].astype(np.uint64))
    return key.view(np.int64)


def chunks(texts: pa.Array, most: int = 3_000_000) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts.cast(pa.binary()):
        b = t.as_py() or b""
        part.append(b)
        size += len(b)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


PRINT = "struct<node:binary,n:int,sig:binary,buckets:array<bigint>>"


def _prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("node", pa.binary()), ("n", pa.int32()), ("sig", pa.binary()), ("buckets", pa.list_(pa.int64()))])
    with np.errstate(over="ignore"):
        for texts in batches:
            out = []
            for part in chunks(texts):
                sets = shingle_sets(part)
                full = [s for s in sets if len(s)]
                sig = signatures(full) if full else np.zeros((0, HASHES), dtype=np.uint32)
                keys = bucket_keys(sig)
                at = 0
                for s in sets:
                    if len(s):
                        node = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        out.append({"node": node, "n": len(s), "sig": sig[at].tobytes(), "buckets": keys[at]})
                        at += 1
                    else:
                        out.append({"node": None, "n": 0, "sig": None, "buckets": None})
            yield pa.array(out, type=kind)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the fewest matches that leave the threshold within reach.

    With a uniform prior, P(similarity >= t | m of n match) is the chance that a binomial
    variable of n + 1 trials at t is at most m.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def surviving(sig: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no comparison has ruled out."""
    near = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
    a, b = a[near], b[near]
    matches = np.zeros(len(a), dtype=np.int32)
    for k in range(0, HASHES, STEP):
        matches += (sig[a, k : k + STEP] == sig[b, k : k + STEP]).sum(axis=1, dtype=np.int32)
        keep = matches >= least[k + STEP]
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one it is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit_pairs(side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    if cross:
        low, high = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
        return np.repeat(low, len(high)), np.tile(high, len(low))
    return np.triu_indices(len(side), 1)


def unit_bounds(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")]).combine_chunks()
    key, i, j = (table[c].to_numpy() for c in ("key", "i", "j"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    return table, np.append(np.flatnonzero(new), len(new))


def _prune(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def prune(table: pa.Table) -> pa.Table:
        """Candidate units -> links between nodes whose pairs survive: one row per linked node."""
        table, cuts = unit_bounds(table)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
        n, side = table["n"].to_numpy(), table["side"].to_numpy()
        cross = table["i"].to_numpy() != table["j"].to_numpy()
        kept_a, kept_b, wait = [], [], []

        def work() -> None:
            if wait:
                a, b = surviving(sig, n, np.concatenate([x for x, _ in wait]), np.concatenate([y for _, y in wait]), threshold, least)
                kept_a.append(a)
                kept_b.append(b)
                wait.clear()

        size = 0
        for x, y in zip(cuts, cuts[1:], strict=False):
            a, b = unit_pairs(side[x:y], cross[x])
            wait.append((a + x, b + x))
            size += len(a)
            if size > 200_000:
                work()
                size = 0
        work()
        label = roots(len(n), np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else np.arange(len(n))
        linked = np.flatnonzero(label != np.arange(len(n)))
        nodes = table["node"]
        return pa.table({"a": nodes.take(pa.array(label[linked])).cast(pa.binary()), "b": nodes.take(pa.array(linked)).cast(pa.binary())})

    return prune


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shared shingles."""
    sizes = [len(s) for s in sets]
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    use = shared[code]
    owner, code = owner[use], column[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(1, 4_000_000 // len(sets))
    total = int(shared.sum())
    for lo in range(0, total, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        block = np.zeros((len(sets), min(width, total - lo)), dtype=np.float32)
        block[owner[a:b], code[a:b] - lo] = 1
        out += block @ block.T
    return out


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        """Units with whole texts -> per node the links it has there and the smallest node it links to."""
        table, cuts = unit_bounds(table)
        side, copies = table["side"].to_numpy(), table["copies"].to_numpy()
        cross = table["i"].to_numpy() != table["j"].to_numpy()
        texts, nodes = table["text"], table["node"].to_pylist()
        out: dict[str, list] = {"node": [], "links": [], "root": []}
        with np.errstate(over="ignore"):
            for x, y in zip(cuts, cuts[1:], strict=False):
                sets = [s for part in chunks(texts.slice(x, y - x).combine_chunks()) for s in shingle_sets(part)]
                size = np.array([len(s) for s in sets])
                a, b = unit_pairs(side[x:y], cross[x])
                common = common_counts(sets)[a, b]
                linked = common * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-6
                a, b = a[linked], b[linked]
                weight = copies[x:y]
                links = np.bincount(a, weight[b], y - x) + np.bincount(b, weight[a], y - x)
                label = roots(y - x, a, b)
                for k in np.flatnonzero(links > 0):
                    out["node"].append(nodes[x + k])
                    out["links"].append(int(links[k]))
                    out["root"].append(nodes[x + label[k]])
        return pa.table(out, schema=pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())]))

    return verify


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows (key, node, ...) into units of one block or of two: columns i, j, side, and bin."""
    side = F.pmod(F.xxhash64("node", F.lit(5)), F.col(blocks)).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    rows = rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", blocks)
    n = max(1, rows.count() // BIN + 1)
    return rows.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n)))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, keeper), one row per document.

    class_id is the smallest id among documents connected by links; n_links counts the other
    documents of similarity `threshold` or more, copies among them; keeper is true for the row
    that stands for its class, and for rows equal to it.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    printed = source.select("doc_id", "text_hash", F.arrow_udf(_prints, PRINT)("text").alias("p")).select("doc_id", "text_hash", "p.*")
    printed = stored(printed, "prints")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = stored(printed.where("node is not null").groupBy("node").agg(F.min(own).alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes")

    # Buckets with two nodes or more; of buckets with the same nodes, one.
    in_bucket = printed.where("node is not null").select("node", F.xxhash64("node").alias("h"), F.explode("buckets").alias("key"))
    shared = in_bucket.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    members = stored(in_bucket.join(shared, "key").select("key", "node", "h").distinct(), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))
    sizes = sizes.groupBy("m", "s", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    units = stored(members.join(sizes, "key").select("key", "node", "blocks"), "units")
    prints = printed.where("node is not null").select("node", "n", "sig").dropDuplicates(["node"])  # copies merge before they move
    prints = prints.join(units.select("node").distinct(), "node", "left_semi")
    dealt = _dealt(units, "blocks").join(prints, "node")
    links = dealt.groupBy("bin").applyInArrow(lambda t: _prune(threshold, tolerance)(t), "a binary, b binary")

    # Groups of surviving pairs, with whole texts, are verified exactly.
    groups = stored(components(links), "groups")
    group_nodes = groups.join(nodes, "node").join(prints.select("node", "n"), "node")
    group_sizes = group_nodes.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks")
    placed = stored(
        group_nodes.join(group_sizes.select("component", blocks), "component").select(F.xxhash64("component").alias("key"), "node", "rep", "copies", "blocks"), "placed"
    )
    wanted = stored(placed.select("node", F.col("rep.doc_id").alias("wanted_id"), F.col("rep.text_hash").alias("text_hash")), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(wanted) if few else wanted, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    texts = texts.select("node", "text").groupBy("node").agg(F.min("text").alias("text"))
    rows = _dealt(placed, "blocks").join(texts, "node").select("bin", "key", "i", "j", "side", "node", "copies", "text")
    verified = stored(rows.groupBy("bin").applyInArrow(lambda t: _verify(threshold)(t), "node binary, links bigint, root binary"), "verified")

    classes = components(verified.select(F.col("root").alias("a"), F.col("node").alias("b")))
    named = classes.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = stored(classes.join(named, "component").join(counted, "node").select("node", "first", "links"), "linked")
    out = printed.select("doc_id", "text_hash", "node").join(nodes, "node", "left").join(linked, "node", "left")
    out = out.withColumn("first", F.coalesce("first", "rep", own))
    return out.select(
        "doc_id",
        "text_hash",
        F.col("first.doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("keeper"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class. Rows are told apart by id and text; equal rows leave one."""
    told = stored(joined(docs, doc_id, text).groupBy("doc_id", "text_hash").agg(F.max("keeper").alias("keeper"), F.count(F.lit(1)).alias("n")), "near-duplicates")
    df = docs.withColumns({"__id": F.col(doc_id), "__hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})

    def rows(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__told_id"), F.col("text_hash").alias("__told_hash"))
        return df.join(keys, (F.col("__hash") == F.col("__told_hash")) & F.col("__id").eqNullSafe(F.col("__told_id")), how)

    # Each side is written by itself: a small one is then known to be small, and texts stay where they are.
    single = rows(stored(told.where("not keeper or n > 1"), "dropped"), "left_anti")
    repeated = rows(stored(told.where("keeper and n > 1"), "repeated"), "left_semi").dropDuplicates(["__id", "__hash"])
    return single.unionByName(repeated).drop("__id", "__hash")
