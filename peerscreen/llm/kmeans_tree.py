"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample: k-means with BRANCH centres, again inside every cluster,
until a cluster stands for at most LEAF_ROWS rows of the table. Every row is indexed: it goes down
the tree to its leaf. A query visits leaves best bin first: a priority queue holds nodes by the
inner product of query and centre, the best node is taken out, its children go in, and a leaf that
comes out is a visit. How many visits are needed is calibrated: a fixed number of queries is
answered exactly against all rows, in blocks, and visits are widened until TARGET of their true
neighbours lie in visited leaves. All other queries use that number.

Neighbouring leaves share a cell of about CELL_ROWS rows; a larger leaf is dealt over several. A
query travels once to each cell in which it visits leaves, and queries of a cell are dealt into
groups of about CHUNK, so groups are bounded whatever is popular. Equal vectors are one entry with
the smallest k + 1 ids, which is all that a query can use of them.

Bounds: at most SAMPLE rows or SAMPLE_NUMBERS numbers, and CALIBRATION queries, reach the driver;
the tree that is broadcast has fewer than two nodes a sampled row.

Edge cases: rows without an id, and vectors that are null, zero, of another length than most, or
hold null, NaN or infinite entries, take no part; repeated rows of one id and vector count once;
rows that share an id but not the vector are candidates each, none of them for a query of that id,
which gives one result for each such vector; ties go to the smaller id; a query visits more leaves
than calibrated if those hold fewer than k candidates; an empty table gives no rows; columns beyond
id and vector are left behind.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen.llm.common import stored
from peerscreen.llm.vectors import common_length, lists, matrix, sound

K = 20
TARGET = 0.96
BRANCH = 8
STEPS = 8
SAMPLE = 32_768
SAMPLE_NUMBERS = 4_000_000
LEAST_LEAF = 8  # sampled rows
LEAF_ROWS = 256
CELL_ROWS = 8192
CHUNK = 2048
STEP = 64  # queries scored at a time
CALIBRATION = 200


@dataclass
class Tree:
    """Nodes in depth-first order; leaves are numbered in that order too."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # its number, or -1
    leaves: int = 0

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: down to the nearest centre, level by level."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = nearest(x[rows], np.stack([self.centres[c] for c in self.children[node]]))
            todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, x: np.ndarray, least: int, rows_in: np.ndarray, rows: int) -> list[list[int]]:
        """Leaves of each query, best bin first: at least `least`, and as many as hold `rows` rows."""
        scores = x @ np.stack(self.centres).T
        out = []
        for s in scores.tolist():
            queue, found, held = [(-s[0], 0)], [], 0
            while queue and (len(found) < least or held < rows):
                _, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    found.append(self.leaf[node])
                    held += rows_in[self.leaf[node]]
                for c in self.children[node]:
                    heapq.heappush(queue, (-s[c], c))
            out.append(found)
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each row; centres that lose all rows are left out."""
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(STEPS):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        centres = np.add.reduceat(x[order], starts) / np.diff(starts, append=len(x))[:, None]
    return centres, nearest(x, centres)


def grown(sample: np.ndarray, leaf: int, seed: int = 12) -> Tree:
    """A tree whose leaves have at most `leaf` sampled rows, unless those can't be told apart."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(rows: np.ndarray, centre: np.ndarray) -> int:
        at = len(tree.centres)
        tree.centres.append(centre)
        tree.children.append([])
        tree.leaf.append(-1)
        if len(rows) > leaf:
            centres, near = k_means(sample[rows], BRANCH, rng)
            parts = [(rows[near == i], c) for i, c in enumerate(centres) if (near == i).any()]
            if len(parts) > 1:
                tree.children[at] = [grow(*p) for p in parts]
                return at
        tree.leaf[at] = tree.leaves
        tree.leaves += 1
        return at

    grow(np.arange(len(sample)), sample.mean(axis=0))
    return tree


def candidates(df: DataFrame, is_query: Column, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(entries: entry, v, ids), (rows: id, v, asks) and the length of the vectors; both tables are written."""
    exact = F.col(vector).cast("array<double>")
    rows = df.where(sound(vector) & F.col(key).isNotNull() & F.exists(exact, lambda x: x != 0)).select(
        F.col(key).alias("id"), exact.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    size = common_length(rows, "v")
    rows = stored(rows.where(F.size("v") == size).groupBy("id", "v").agg(F.max("asks").alias("asks")), "rows")
    # Only the smallest k + 1 ids of equal vectors leave their task, and only they meet.
    order = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entries = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return stored(entries.withColumn("entry", F.monotonically_increasing_id()), "entries"), rows, size


def sampled(entries: DataFrame, n: int, size: int) -> np.ndarray:
    """A bounded sample, drawn by a hash of the vector."""
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // max(size, 1)))
    share = F.lit(min(1.0, 1.2 * most / n) * 2.0**32)
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 32))
    rows = entries.where(drawn < share).orderBy(drawn, "v").limit(most).select("v").toArrow()
    return matrix(rows["v"], size)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties at the border all included."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products that don't depend on where a row stands, unlike those of a matrix product."""
    return (x * q).sum(axis=1)


ANSWER = "query long, id long, score double, ids array<long>"


def answers(queries: pa.Array, ids: pa.Array, hits: list[tuple[np.ndarray, np.ndarray]], entry_ids: pa.ChunkedArray) -> pa.Table:
    """hits: places of entries and their scores, for each query."""
    counts = [len(h[0]) for h in hits]
    own = np.repeat(np.arange(len(hits)), counts)
    places = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, dtype=int)
    scores = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0)
    return pa.table({"query": queries.take(pa.array(own)), "id": ids.take(pa.array(own)), "score": pa.array(scores, pa.float64()), "ids": entry_ids.take(pa.array(places))})


def searched(entries: pa.Table, queries: pa.Table, size: int, k: int) -> pa.Table:
    """The k + 1 best entries of one cell for each query, from the leaves it visits."""
    x, q = matrix(entries["v"], size), matrix(queries["v"], size)
    names, leaf = np.unique(entries["leaf"].to_numpy(), return_inverse=True)
    rows = np.argsort(leaf, kind="stable")
    x, leaf = x[rows], leaf[rows]
    alone = entries["alone"].take(pa.array(rows)).combine_chunks()  # the id of an entry that has but one
    by_id = np.flatnonzero(alone.is_valid().to_numpy(zero_copy_only=False))
    only = alone.take(pa.array(by_id)).to_numpy(zero_copy_only=False).astype(np.int64)
    by_id, only = by_id[np.argsort(only, kind="stable")], np.sort(only)
    ids, told = queries["id"].combine_chunks(), queries["leaves"].combine_chunks()
    own = ids.to_numpy()
    places, counts = np.searchsorted(names, told.flatten().to_numpy()), np.diff(told.offsets.to_numpy())
    known = names[np.minimum(places, len(names) - 1)] == told.flatten().to_numpy()
    visited = np.zeros((len(q), len(names)), dtype=bool)
    visited[np.repeat(np.arange(len(q)), counts)[known], places[known]] = True
    hits = []
    for at in range(0, len(q), STEP):
        part = visited[at : at + STEP]
        columns = np.flatnonzero(part.any(axis=0)[leaf])  # leaves that any of these queries visits
        scores = np.where(part[:, leaf[columns]], q[at : at + STEP] @ x[columns].T, -np.inf)
        for i, s in enumerate(scores, at):
            for j in by_id[np.searchsorted(only, own[i], "left") : np.searchsorted(only, own[i], "right")]:
                c = np.searchsorted(columns, j)
                if c < len(columns) and columns[c] == j:
                    s[c] = -np.inf
            found = best(s, k + 1)
            found = columns[found[s[found] > -np.inf]]
            hits.append((rows[found], exact(x[found], q[i])))
    return answers(queries["query"].combine_chunks(), ids, hits, entries["ids"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query, id, rank, neighbour, score) of the best k over all parts."""
    each = found.select("query", "id", "score", F.explode("ids").alias("neighbour")).where(F.col("neighbour") != F.col("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def truth(entries: DataFrame, asked: pa.Table, size: int, k: int) -> DataFrame:
    """The exact answer of a few queries, against all entries, block by block."""
    spark = entries.sparkSession
    kept = spark.sparkContext.broadcast((matrix(asked["v"], size), asked["query"].to_numpy(), asked["id"].to_numpy()))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, numbers, own = kept.value
        for batch in batches:
            x, hits = matrix(batch["v"], size), []
            only = np.array([v[0] if len(v) == 1 else None for v in batch["ids"].to_pylist()], dtype=object)
            for i, s in enumerate(q @ x.T):
                s = np.where(only == own[i], -np.inf, s)
                at = best(s, k + 1)
                at = at[s[at] > -np.inf]
                hits.append((at, exact(x[at], q[i])))
            t = answers(pa.array(numbers), pa.array(own), hits, pa.chunked_array([batch["ids"]]))
            at = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, dtype=int)
            yield from t.append_column("leaf", batch["leaf"].take(pa.array(at))).to_batches()

    return entries.select("v", "ids", "leaf").mapInArrow(block, f"{ANSWER}, leaf int")


def calibrated(entries: DataFrame, queries: DataFrame, tree: Tree, rows_in: np.ndarray, size: int, k: int, target: float) -> tuple[int, float]:
    """The least number of visits, by steps of a twentieth, that finds `target` of the true neighbours, and what it finds."""
    n = queries.count()
    few = F.pmod(F.xxhash64("v", "id", F.lit(1)), F.lit(1 << 32))
    share = F.lit(min(1.0, 2.0 * CALIBRATION / max(n, 1) + 1e-6) * 2.0**32)
    asked = queries.where(few < share).orderBy(few, "query").limit(CALIBRATION).toArrow()
    if not len(asked) or tree.leaves == 1:
        return 1, 1.0
    true = truth(entries, asked, size, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    each = true.select("query", "id", "score", "leaf", F.explode("ids").alias("neighbour")).where(F.col("neighbour") != F.col("id"))
    near = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "leaf").collect()  # k rows a query
    ways = tree.visits(matrix(asked["v"], size), tree.leaves, rows_in, 0)
    place = {q: {leaf: i for i, leaf in enumerate(way)} for q, way in zip(asked["query"].to_pylist(), ways, strict=True)}
    places = np.array([place[r["query"]][r["leaf"]] for r in near])
    visits = 1
    while len(places) and (places < visits).mean() < target:
        visits += max(1, visits // 20)
    visits = min(visits, tree.leaves)
    return visits, float((places < visits).mean()) if len(places) else 1.0


@dataclass
class Index:
    """Written entries with their leaves, the tree, and how they are dealt."""

    entries: DataFrame  # entry, v, ids, alone, leaf, cell
    tree: Tree
    size: int
    rows_in: np.ndarray
    first_cell: np.ndarray
    cells: np.ndarray  # of each leaf

    def routed(self, queries: DataFrame, visits: int, k: int) -> DataFrame:
        """(query, id, v, cell, leaves): one row for each cell a query goes to."""
        kept = queries.sparkSession.sparkContext.broadcast((self.tree, self.rows_in, self.first_cell, self.cells))
        size = self.size

        @F.arrow_udf("array<struct<cell:int,leaves:array<int>>>")
        def route(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tree, rows_in, first, cells = kept.value
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
            for batch in batches:
                out = []
                for way in tree.visits(matrix(batch, size), visits, rows_in, k + 1):
                    by_cell: dict[int, list[int]] = {}
                    for leaf in way:
                        for c in range(first[leaf], first[leaf] + cells[leaf]):
                            by_cell.setdefault(c, []).append(leaf)
                    out.append([{"cell": c, "leaves": v} for c, v in by_cell.items()])
                yield pa.array(out, type=kind)

        return queries.withColumn("way", route("v")).select("query", "id", "v", F.inline("way"))


def indexed(entries: DataFrame, size: int) -> Index:
    """Every entry with its leaf and cell, written."""
    n = entries.count()
    sample = sampled(entries, n, size)
    tree = grown(sample, max(LEAST_LEAF, LEAF_ROWS * len(sample) // max(n, 1)))
    kept = entries.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def leaf_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(kept.value.leaf_of(matrix(batch, size)), type=pa.int32())

    alone = F.when(F.size("ids") == 1, F.col("ids")[0])
    placed = stored(entries.withColumn("alone", alone).withColumn("leaf", leaf_of("v")), "placed")
    rows_in = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf
        rows_in[r["leaf"]] = r["count"]
    first, cells, cell, room = [], [], -1, 0
    for rows in rows_in.tolist():  # neighbours share a cell while they fit; a large leaf has several of its own
        many = -(-rows // CELL_ROWS)
        if many > 1 or rows > room:
            cell, room = cell + 1, CELL_ROWS
        first.append(cell)
        cells.append(max(1, many))
        cell, room = (cell + many - 1, 0) if many > 1 else (cell, room - rows)
    spread = entries.sparkSession.createDataFrame([(i, f, c) for i, (f, c) in enumerate(zip(first, cells))], "leaf int, first int, cells int")
    # One row a leaf.
    dealt = placed.join(F.broadcast(spread), "leaf").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("entry"), F.col("cells"))).cast("int"))
    return Index(dealt.drop("first", "cells"), tree, size, rows_in, np.array(first), np.array(cells))


def neighbours(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, target: float = TARGET) -> DataFrame:
    """(query_id, rank, the key, score): the k nearest found of every row where is_query holds."""
    entries, rows, size = candidates(df, is_query, key, vector, k)
    if not size:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    asked = stored(rows.where("asks").select("id", "v").withColumn("query", F.monotonically_increasing_id()), "queries")
    index = indexed(entries, size)
    visits, _ = calibrated(index.entries, asked, index.tree, index.rows_in, size, k, target)
    routed = stored(index.routed(asked, visits, k), "routed")
    chunks = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    left = index.entries.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = routed.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
    pairs = left.select("cell", "chunk", "leaf", "v", "ids", "alone").groupBy("cell", "chunk").cogroup(
        right.select("cell", "chunk", "query", "id", "v", "leaves").groupBy("cell", "chunk")
    )
    found = pairs.applyInArrow(lambda a, b: searched(a, b, size, k), ANSWER)
    out = merged(found, k)
    return out.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("neighbour").alias(key), "score")
