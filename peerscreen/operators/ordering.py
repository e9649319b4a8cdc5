"""Exact grouped ranks and order statistics that do not need a whole group in one task.

Medians, quantile ranks, percentile ranks and empirical distributions all come
down to "how much weight lies below this value inside its group". For groups of
ordinary size a window answers that in one exchange. A group that may hold a
large share of the table is sorted by a range exchange instead, so it spreads
over many tasks, and only per-task subtotals (one row per group and task) are
accumulated before being added back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from peerscreen import schema as S

HOT_ROWS_SETTING = "spark.peerscreen.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
SALTS = 32


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS_DEFAULT)))


def has_hot_group(df: DataFrame, keys: Sequence[str], bound: int | None = None) -> bool:
    """Does any group hold more rows than one task should?

    One aggregation with map-side combine; at most one row reaches the driver.
    """
    bound = hot_rows(df.sparkSession) if bound is None else bound
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > bound).isEmpty()


@dataclass(frozen=True)
class Heat:
    """Which groupings hold more rows than one task should: peer groups, scopes, the whole table."""

    peer: bool
    scope: bool
    table: bool


def measure(readings: DataFrame) -> Heat:
    """Size check of all groupings in one job over three columns.

    Readings outnumber the histories built from them, so this bounds every later table.
    """
    bound = hot_rows(readings.sparkSession)
    per_peer = readings.groupBy(*S.PEER).agg(F.count(F.lit(1)).alias("n"))
    per_scope = per_peer.groupBy(*S.SCOPE).agg(F.max("n").alias("p"), F.sum("n").alias("n"))
    top = per_scope.agg(F.max("p").alias("p"), F.max("n").alias("s"), F.sum("n").alias("t")).first()
    return Heat(*[(v or 0) > bound for v in top])


def stable(df: DataFrame) -> DataFrame:
    """Materialise on shared storage so that every later reader sees the same rows.

    A checkpoint survives the loss of executors. The folder is the one the
    session names in spark.checkpoint.dir.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; there is no fallback."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a NULL key meets a NULL key, as it does in grouping and windows."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-group statistics to rows whose groups may be huge.

    The row side is spread over SALTS sub-keys, the statistics are repeated for
    each, so no key value meets in a single task. A cross join repeats them: Spark's size estimate
    counts its copies, those of explode() it does not, and would broadcast them all.
    """
    row_hash = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c in _hashable(big)]), F.lit(SALTS))
    left = big.withColumn("_salt", row_hash)
    right = small.crossJoin(F.broadcast(big.sparkSession.range(SALTS).select(F.col("id").alias("_salt"))))
    return null_safe_join(left, right, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame):
    return {f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")}


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: Column | None = None,
    *,
    hot: bool | None = None,
) -> DataFrame:
    """One row per (keys, distinct value): ``weight``, ``before`` and ``total``.

    ``before`` is the group's weight on strictly smaller values, ``total`` the
    weight of the whole group. NULL values are left out.
    """
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull())
    if hot is None:
        hot = has_hot_group(df, keys)
    amount = weight if weight is not None else F.lit(1).cast("bigint")
    distinct = df.groupBy(*keys, value).agg(F.sum(amount).alias("weight"))
    if not hot:
        group = Window.partitionBy(*keys)
        ordered = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return distinct.withColumns(
            {
                "before": F.sum("weight").over(ordered) - F.col("weight"),
                "total": F.sum("weight").over(group),
            }
        )
    placed = stable(distinct.sort(*keys, value).withColumn("_part", F.spark_partition_id()))
    # Rows here: groups x tasks that hold part of the group.
    parts = placed.groupBy(*keys, "_part").agg(F.sum("weight").alias("_sum"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumns(
        {"_offset": F.sum("_sum").over(upto) - F.col("_sum"), "total": F.sum("_sum").over(group)}
    ).drop("_sum")
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe_join(placed, parts, [*keys, "_part"], "inner")
        .withColumn("before", F.col("_offset") + F.sum("weight").over(inside) - F.col("weight"))
        .select(*keys, value, "weight", "before", "total")
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    *,
    hot: bool | None = None,
) -> DataFrame:
    """Exact order statistics per group: ``ranks`` maps a name to rank(n), 1-based.

    A rank outside 1..n gives NULL. The result also carries ``n``.
    """
    totals = running_totals(df, keys, value, hot=hot)
    n = F.col("total")
    picks = [
        F.max(
            F.when((F.col("before") < rank(n)) & (rank(n) <= F.col("before") + F.col("weight")), F.col(value))
        ).alias(name)
        for name, rank in ranks.items()
    ]
    return totals.groupBy(*keys).agg(F.max("total").alias("n"), *picks)


def median_ranks(prefix: str) -> dict[str, Callable[[Column], Column]]:
    return {
        f"{prefix}_lo": lambda n: F.floor((n + 1) / 2),
        f"{prefix}_hi": lambda n: F.ceil((n + 1) / 2),
    }


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str, *, hot: bool | None = None) -> DataFrame:
    """Exact median per group: keys + ``name`` + ``n``."""
    stats = order_statistics(df, keys, value, median_ranks("_m"), hot=hot)
    return stats.select(*keys, ((F.col("_m_lo") + F.col("_m_hi")) / 2).alias(name), "n")


def group_percentile(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str, *, hot: bool | None = None
) -> DataFrame:
    """Exact linearly interpolated percentile per group."""
    lo = lambda n: F.floor((n - 1) * fraction) + 1
    hi = lambda n: F.ceil((n - 1) * fraction) + 1
    stats = order_statistics(df, keys, value, {"_lo": lo, "_hi": hi}, hot=hot)
    part = (F.col("n") - 1) * fraction - F.floor((F.col("n") - 1) * fraction)
    return stats.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias(name), "n")


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "position", *, hot: bool | None = None) -> DataFrame:
    """1-based position of every row inside its group; ``order`` must be unique per group."""
    keys = list(keys)
    if hot is None:
        hot = has_hot_group(df, keys)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns(
            {name: F.row_number().over(w).cast("bigint"), "group_size": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
        )
    df = stable(df)
    totals = running_totals(df, keys, order, hot=True).select(
        *keys, order, (F.col("before") + 1).alias(name), F.col("total").alias("group_size")
    )
    return null_safe_join(df, totals, [*keys, order], "inner")
