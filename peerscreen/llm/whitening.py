"""Embedding whitening with Spark MLlib's BlockMatrix.

Vectors become integers, x = floor(64 * c) + 1000000. Rows are numbered and written once; their
sums give the means. Centred rows are indexed into a distributed BlockMatrix B, whose product
B' B is the scatter. Its eigenvectors are found locally (dimensions x dimensions numbers reach the
driver), and B times the whitening matrix, again a BlockMatrix product, projects every row.

Both scatter products cut the long middle dimension into splits of MID_BLOCKS blocks, so no task
holds more than those and partial sums are added pairwise. Blocks have at least ROWS rows, more
only beyond MAX_BLOCKS blocks, because MLlib keeps the list of block numbers on the driver.

Edge cases: rows whose vector is null or holds null, NaN or infinite entries take no part, nor do
vectors of another length than most have (an empty vector has no components); a null id stays
null; repeated rows each count and each get their rows; columns beyond id and vector are left
behind; an empty table gives no rows. A component without variance (fewer distinct rows than
dimensions) has whitened null and explained 0, and stays out of identity_error. Deviations
beyond a long end the job with an overflow error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from peerscreen.llm.common import fresh_path, stored
from peerscreen.llm.vectors import common_length, sound

# Fixed values of the integer form of vectors.
SCALE, OFFSET = 64.0, 1_000_000

COMPONENTS = 32
ROWS = 1024
COLUMNS = 1024
MAX_BLOCKS = 100_000
MID_BLOCKS = 16


@dataclass
class Fit:
    """Rows (row, key, x) as written, and what all of them say."""

    rows: DataFrame
    n: int
    sums: list[int]


def numbered(df: DataFrame, key: str, vector: str) -> Fit:
    """Sound rows as integers, numbered from 0 without gaps, with their count and sums."""
    exact = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long"))
    rows = df.where(sound(vector)).select(F.col(key).alias("key"), exact.alias("x"))
    size = common_length(rows, "x")
    written = stored(rows.where(F.size("x") == size).withColumn("at", F.monotonically_increasing_id()), "vectors")
    # `at` is the writing task in the upper bits and the place in it below.
    task = F.shiftright("at", 33)
    each = written.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = each.select("task", (before - F.shiftleft(F.col("task"), 33)).alias("shift"))
    # One small row per writing task.
    rows = written.join(F.broadcast(shift), task == F.col("task")).select((F.col("at") + F.col("shift")).alias("row"), "key", "x")
    totals = written.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count(F.lit(1)).alias("n"))
    found = totals.orderBy("pos").collect()  # one row per dimension
    return Fit(rows, found[0]["n"] if found else 0, [r["s"] for r in found])


def centred_blocks(fit: Fit) -> BlockMatrix:
    """The centred rows as a distributed matrix of dense blocks."""
    means = F.array(*[F.lit(s / fit.n) for s in fit.sums])
    centred = array_to_vector(F.zip_with(F.col("x").cast("array<double>"), means, lambda a, m: a - m))
    rows = MLUtils.convertVectorColumnsFromML(fit.rows.select("row", centred.alias("vector")), "vector")
    tall = max(ROWS, -(-fit.n // MAX_BLOCKS))
    return IndexedRowMatrix(rows, fit.n, len(fit.sums)).toBlockMatrix(tall, min(COLUMNS, len(fit.sums)))


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b, the middle dimension cut into `splits` (Python's own call has no such argument)."""
    found = a._java_matrix_wrapper._java_model.multiply(b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix) -> np.ndarray:
    """m' m: columns x columns numbers, added up by tasks of MID_BLOCKS blocks."""
    return product(m.transpose(), m, max(1, m.numRowBlocks // MID_BLOCKS)).toLocalMatrix().toArray()


def eigen(scattered: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues falling, their vectors as columns, and the trace."""
    v = (scattered + scattered.T) / (2.0 * n)
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1], float(np.trace(v))


def as_blocks(spark, m: np.ndarray, tall: int) -> BlockMatrix:
    """A small local matrix as blocks of `tall` rows."""
    cut = [((i // tall, 0), DenseMatrix(len(p), m.shape[1], p.T.ravel())) for i in range(0, len(m), tall) for p in (m[i : i + tall],)]
    return BlockMatrix(spark.sparkContext.parallelize(cut, 1), tall, m.shape[1], *m.shape)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, n, deviation, whitened (array, one entry per component), explained (array), identity_error."""
    spark = df.sparkSession
    fit = numbered(df, key, vector)
    shape = f"`{key}` {df.schema[key].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not fit.sums:
        return spark.createDataFrame([], shape)
    blocks = centred_blocks(fit).persist(StorageLevel.MEMORY_AND_DISK)
    values, vectors, trace = eigen(scatter(blocks), fit.n)
    width = min(components, len(fit.sums))
    # Rounding leaves tiny eigenvalues where there is no variance.
    spread = values[:width] > max(values[0], 0.0) * len(values) * 1e-13
    matrix = np.where(spread, vectors[:, :width] / np.sqrt(np.where(spread, values[:width], 1.0)), 0.0)
    projected = product(blocks, as_blocks(spark, matrix, blocks.colsPerBlock)).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(projected) / fit.n
    error = float(np.abs(covariance - np.eye(width))[np.ix_(spread, spread)].max(initial=0.0))
    table = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    path = fresh_path(spark, "projected")
    table.select(F.col("index").alias("row"), vector_to_array("vector").alias("w")).write.parquet(path)
    projected._java_matrix_wrapper._java_model.blocks().unpersist(False)
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)

    n = F.lit(fit.n).cast("long")
    far = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in fit.sums]), lambda a, s: n * a - s)
    deviation = F.aggregate(far, F.lit(0).cast("long"), lambda total, d: total + d * d)
    told = F.array(*[F.lit(float(e / trace) if ok else 0.0) for e, ok in zip(values[:width], spread)])
    sure = F.array(*[F.lit(bool(ok)) for ok in spread])
    out = fit.rows.join(spark.read.parquet(path), "row")
    return out.select(
        F.col("key").alias(key),
        n.alias("n"),
        deviation.alias("deviation"),
        F.zip_with("w", sure, lambda w, ok: F.when(ok, w)).alias("whitened"),
        told.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
