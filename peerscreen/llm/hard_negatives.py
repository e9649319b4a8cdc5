"""Hard-negative mining with segment summaries.

A vector is cut into segments; of each, the mean and the deviation (root of the summed squares
around the mean) are stored, for 1, 4 and 16 segments. For anchor a and row x a segment of m
numbers adds m * mean(a) * mean(x), give or take deviation(a) * deviation(x), to their inner
product. So each level bounds all scores; what can't be among the wanted rows goes, the next level
has narrower bounds for the rest, and whatever is left is scored exactly, in integers.

Positives come first: the `positives` best other rows of the anchor's label. Each gives a band of
scores, and of the rows of other labels inside it the `negatives` best are returned. Both steps meet
anchors and all rows in blocks of about BLOCK rows and CHUNK anchors, dealt by hash, so no label,
id or group of copies gathers in one task; each block returns its own best few for each anchor,
and a ranking that drops the rest before the shuffle merges them.

Edge cases: rows without id or label, and vectors that are null, of another length than most, or
hold null, NaN or infinite entries, take no part; rows equal in id, label and vector count once;
rows that share an id but differ are candidates each, and each is an anchor if the id is one, but
never a positive of one another; ties go to the smaller id; anchors without positives or a positive
without rows in its band give no rows; columns beyond id, label and vector are left behind; scores
must stay under 2**53, or the job ends with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen.llm.common import stored
from peerscreen.llm.vectors import common_length, lists, matrix, sound

# Fixed values of the task.
SCALE = 256.0
POSITIVES, NEGATIVES = 5, 10
BAND = (30, 90)  # percent of the positive's score

LEVELS = (1, 4, 16)
BLOCK = 16_384
CHUNK = 512
STEP = 64  # anchors scored at a time


def borders(size: int, segments: int) -> np.ndarray:
    """Where segments begin; those of a finer level lie inside those of a coarser one."""
    return np.arange(segments + 1) * size // segments


def summaries(x: np.ndarray) -> np.ndarray:
    """Means and deviations of all segments of all levels, level by level."""
    parts = []
    for level in LEVELS:
        cut = borders(x.shape[1], level)
        pieces = [x[:, a:b] for a, b in zip(cut, cut[1:])]
        parts.append(np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(x)) for p in pieces], axis=1))
        parts.append(np.stack([np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(pieces, parts[-1].T)], axis=1))
    return np.concatenate(parts, axis=1)


def bounds(a: np.ndarray, x: np.ndarray, size: int):
    """(least, most) of the scores of summarised anchors and rows, level by level."""
    at = 0
    for level in LEVELS:
        lengths = np.diff(borders(size, level))
        middle = (a[:, at : at + level] * lengths) @ x[:, at : at + level].T
        reach = a[:, at + level : at + 2 * level] @ x[:, at + level : at + 2 * level].T
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding
        yield middle - reach - slack, middle + reach + slack
        at += 2 * level


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def exact(a: np.ndarray, x: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Scores of the open pairs, -inf elsewhere. Integers under 2**53 make float products exact."""
    out = np.full(open_.shape, -np.inf)
    columns = np.flatnonzero(open_.any(axis=0))
    if len(columns):
        out[:, columns] = np.where(open_[:, columns], a @ x[columns].T, -np.inf)
    return out


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest finite scores, ties by id."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def same_label(anchors: pa.Table, rows: pa.Table, size: int, k: int) -> pa.Table:
    """The k best rows of its label for each anchor."""
    out: list[tuple[int, int, float]] = []
    x, xs, ids, labels = _arrays(rows, size)
    for part, a, sums, own, label in _steps(anchors, size):
        open_ = (labels[None, :] == label[:, None]) & (ids[None, :] != own[:, None])
        for least, most in bounds(sums, xs, size):
            open_ &= most >= kth(np.where(open_, least, -np.inf), k)[:, None]
        scores = exact(a, x, open_)
        out += [(n, ids[j], scores[i, j]) for i, n in enumerate(part["anchor"].to_pylist()) for j in first(scores[i], ids, k)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.int64()))], ["anchor", "positive", "score"])


def in_bands(anchors: pa.Table, rows: pa.Table, size: int, k: int, band: tuple[int, int]) -> pa.Table:
    """For each anchor and positive, the k best rows of other labels with a score in the band."""
    out: list[tuple[int, int, int, int, int]] = []
    x, xs, ids, labels = _arrays(rows, size)
    for part, a, sums, own, label in _steps(anchors, size):
        told = part["positives"].to_pylist()
        low = np.full((len(a), max(map(len, told))), np.inf)
        high = np.full(low.shape, -np.inf)
        for i, positives in enumerate(told):
            for j, p in enumerate(positives):
                low[i, j], high[i, j] = -(-band[0] * p["score"] // 100), band[1] * p["score"] // 100
        open_ = labels[None, :] != label[:, None]
        for least, most in bounds(sums, xs, size):
            wanted = np.zeros_like(open_)
            for lo, hi in zip(low.T[:, :, None], high.T[:, :, None]):
                sure = open_ & (least >= lo) & (most <= hi)
                enough = np.maximum(lo[:, 0], kth(np.where(sure, least, -np.inf), k))[:, None]
                wanted |= (most >= enough) & (least <= hi)
            open_ &= wanted
        scores = exact(a, x, open_)
        for i, n in enumerate(part["anchor"].to_pylist()):
            for j, p in enumerate(told[i]):
                inside = np.where((scores[i] >= low[i, j]) & (scores[i] <= high[i, j]), scores[i], -np.inf)
                out += [(n, p["rank"], p["positive"], p["score"], ids[c], scores[i, c]) for c in first(inside, ids, k)]
    names = ["anchor", "place", "positive", "positive_score", "negative", "score"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, [pa.int64(), pa.int32()] + [pa.int64()] * 4)], names)


def _arrays(rows: pa.Table, size: int):
    width = sum(2 * level for level in LEVELS)
    return matrix(rows["x"], size), matrix(rows["summary"], width), rows["id"].to_numpy(), rows["label"].to_numpy()


def _steps(anchors: pa.Table, size: int):
    for at in range(0, len(anchors), STEP):
        part = anchors.slice(at, STEP)
        yield part, *_arrays(part, size)


def summarised(df: DataFrame, key: str, label: Column, vector: str) -> tuple[DataFrame, int, int]:
    """(row, id, label, x, summary) as written, the length of vectors and the number of rows."""
    exact_ = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    rows = df.where(sound(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), exact_.alias("x"))
    rows = rows.where("label is not null")
    size = common_length(rows, "x")

    @F.arrow_udf("array<double>")
    def summary(x: pa.Array) -> pa.Array:
        m = matrix(x, size)
        if len(m) and (m * m).sum(axis=1).max() >= 2.0**53:
            raise ValueError("scores beyond 2**53")
        return lists(summaries(m), pa.float64())

    rows = rows.where(F.size("x") == size).distinct().withColumn("summary", summary("x"))
    written = stored(rows.withColumn("row", F.monotonically_increasing_id()), "summaries")
    return written, size, written.count()


def dealt(anchors: DataFrame, rows: DataFrame, n_rows: int):
    """Anchors and rows grouped so that every anchor meets every row in one bounded group."""
    blocks, chunks = -(-n_rows // BLOCK), -(-anchors.count() // CHUNK)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias(name)
    place = lambda c, n: F.pmod(F.xxhash64(c, F.lit(13)), F.lit(max(n, 1))).cast("int")
    left = anchors.select("*", place("anchor", chunks).alias("chunk"), each(blocks, "block"))
    right = rows.select("*", place("row", blocks).alias("block"), each(chunks, "chunk"))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))


def mined(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor tells by `id`."""
    rows, size, n = summarised(df, key, F.col(label) if isinstance(label, str) else label, vector)
    own = rows.where(is_anchor).withColumnRenamed("row", "anchor")
    found = dealt(own, rows, n).applyInArrow(lambda a, b: same_label(a, b, size, positives), "anchor long, positive long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    told = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive", "score"))).alias("positives"))
    ready = stored(own.join(told, "anchor"), "anchors")
    shape = "anchor long, place int, positive long, positive_score long, negative long, score long"
    banded = dealt(ready, rows, n).applyInArrow(lambda a, b: in_bands(a, b, size, negatives, band), shape)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative")
    last = banded.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return last.join(ready.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
