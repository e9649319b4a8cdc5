"""What the operators on embeddings share: which rows take part, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def sound(vector: str) -> Column:
    """Whether a vector is there and none of its entries is null, NaN or infinite."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), entry), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The length most vectors have, the longer of two as frequent; 0 without rows."""
    sizes = df.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return sizes["size"] if sizes else 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    """A list column whose lists all have `width` entries."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), width) for p in parts if len(p)]
    return np.concatenate(rows).astype(kind, copy=False) if rows else np.zeros((0, width), dtype=kind)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(rows).ravel(), type=kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], type=pa.int32()), flat)
