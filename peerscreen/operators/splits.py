"""Whole-batch splits and folds. A batch never straddles two sides.

Batches are put in a random but repeatable order by hashing id and seed, so the
split needs no driver-side shuffle and does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen import schema as S
from peerscreen.operators import ordering


class LeakageError(ValueError):
    """A split that could leak information."""


def _shuffle_key(seed: int) -> Column:
    return F.md5(F.concat(F.col("batch_id"), F.lit(f":{seed}")))


def batch_strata(df: DataFrame, stratum: str | None) -> DataFrame:
    """One row per batch with its stratum: the sorted distinct values joined by '|'."""
    if stratum is None or stratum not in df.columns:
        return df.select("batch_id").distinct().withColumn("stratum", F.lit("*"))
    pairs = df.select("batch_id", F.col(stratum).cast("string").alias("v")).distinct()
    return pairs.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("stratum"))


def split_batches(
    df: DataFrame,
    *,
    test_fraction: float = 0.4,
    seed: int = 7,
    stratum: str | None = "component_family",
    hot: bool | None = None,
) -> DataFrame:
    """(batch_id, stratum, side). A stratum with one batch stays in training."""
    if not 0.0 < test_fraction < 1.0:
        raise ValueError("test_fraction must sit strictly between 0 and 1")
    batches = batch_strata(df, stratum).withColumn("_order", _shuffle_key(seed))
    placed = ordering.numbered(batches, ["stratum"], "_order", "_pos", hot=hot)
    n = F.col("group_size")
    n_test = F.greatest(F.lit(1), F.least(F.bround(n * test_fraction).cast("bigint"), n - 1))
    side = F.when((n > 1) & (F.col("_pos") <= n_test), "test").otherwise("train")
    return placed.select("batch_id", "stratum", side.alias("side"))


def make_batch_split(df: DataFrame, *, test_fraction: float = 1.0 / 3.0, seed: int = 26170, hot: bool | None = None) -> DataFrame:
    """Unstratified variant of :func:`split_batches`."""
    return split_batches(df, test_fraction=test_fraction, seed=seed, stratum=None, hot=hot)


def repeated_splits(df: DataFrame, seeds, *, test_fraction: float = 1.0 / 3.0, hot: bool | None = None) -> DataFrame:
    """(split_seed, batch_id, side) for several seeds in one query."""
    batches = df.select("batch_id").distinct()
    seeded = batches.withColumn("split_seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    seeded = seeded.withColumn("_order", F.md5(F.concat("batch_id", F.lit(":"), F.col("split_seed").cast("string"))))
    placed = ordering.numbered(seeded, ["split_seed"], "_order", "_pos", hot=hot)
    n = F.col("group_size")
    n_test = F.greatest(F.lit(1), F.least(F.bround(n * test_fraction).cast("bigint"), n - 1))
    return placed.select("split_seed", "batch_id", F.when(F.col("_pos") <= n_test, "test").otherwise("train").alias("side"))


def three_way_split(df: DataFrame, *, seed: int = 26170, hot: bool | None = None) -> DataFrame:
    """60/20/20 whole-batch split per profile: train, calibration, test."""
    batches = df.select("batch_id", "profile_id").distinct().withColumn("_order", _shuffle_key(seed))
    placed = ordering.numbered(batches, ["profile_id"], "_order", "_pos", hot=hot)
    n = F.col("group_size")
    fifth = F.floor(n / 5)
    side = (
        F.when(F.col("_pos") <= n - 2 * fifth, "train")
        .when(F.col("_pos") <= n - fifth, "calibration")
        .otherwise("test")
    )
    return placed.select("batch_id", "profile_id", side.alias("split"))


def select_side(df: DataFrame, split: DataFrame, side: str, column: str = "side") -> DataFrame:
    """Rows of one side. The split table has one row per batch; Spark broadcasts it while it is small."""
    if side not in ("train", "test", "calibration"):
        raise ValueError("unknown side")
    return df.join(split.filter(F.col(column) == side).select("batch_id"), "batch_id", "left_semi")


def first_batch_per_profile(split: DataFrame, side: str = "test") -> DataFrame:
    return split.filter(F.col("split") == side).groupBy("profile_id").agg(F.min("batch_id").alias("batch_id"))


def assign_batch_folds(df: DataFrame, *, n_splits: int = 5, hot: bool | None = None) -> DataFrame:
    """(batch_id, profile_id, fold): batches dealt round-robin in (profile, batch) order."""
    if n_splits < 2:
        raise ValueError("at least two folds are required")
    profile = F.col("profile_id") if "profile_id" in df.columns else F.lit("*")
    batches = df.groupBy("batch_id").agg(F.min(profile).alias("profile_id"))
    placed = ordering.numbered(batches, ["profile_id"], "batch_id", "_pos", hot=hot)
    # One row per profile: where its deal starts.
    sizes = batches.groupBy("profile_id").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("profile_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("profile_id", (F.sum("c").over(upto) - F.col("c")).alias("_start"))
    return placed.join(starts, "profile_id").select(
        "batch_id", "profile_id", ((F.col("_start") + F.col("_pos") - 1) % n_splits).cast("int").alias("fold")
    )


def calibration_batches(batches: DataFrame, *, per_profile: int, rotation: int = 0, hot: bool | None = None) -> DataFrame:
    """``per_profile`` batches of every profile; the window moves with ``rotation``.

    ``enough`` is False where a profile has too few batches (the caller refuses).
    """
    one = batches.groupBy("batch_id").agg(F.min("profile_id").alias("profile_id"))
    placed = ordering.numbered(one, ["profile_id"], "batch_id", "_pos", hot=hot)
    n = F.col("group_size")
    start = F.lit(rotation * per_profile) % n
    offset = F.pmod(F.col("_pos") - 1 - start, n)
    return placed.filter(offset < per_profile).select("batch_id", "profile_id", (n > per_profile).alias("enough"))


def check_split(readings: DataFrame, split: DataFrame, features: DataFrame | None = None, *, column: str = "side") -> DataFrame:
    """(check, n): overlaps and gaps that would leak; every n must be zero."""
    counted = lambda df, name: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    both_sides = split.groupBy("batch_id").agg(F.count_distinct(column).alias("c")).filter("c > 1")
    out = counted(both_sides, "batch_on_two_sides")
    batches = readings.select("batch_id").distinct()
    out = out.unionByName(counted(batches.join(split, "batch_id", "left_anti"), "batch_without_side"))
    places = readings.select("component_id", "batch_id").distinct().join(split.select("batch_id", column), "batch_id")
    spread = places.groupBy("component_id").agg((F.min(column) != F.max(column)).alias("v")).filter("v")
    out = out.unionByName(counted(spread, "component_on_two_sides"))
    if features is not None:
        late = features.filter(F.col("last_observed_hour") > F.col("as_of_hour"))
        out = out.unionByName(counted(late, "feature_after_cutoff"))
    return out


def assert_split_is_leakage_safe(readings: DataFrame, split: DataFrame, features: DataFrame | None = None, *, column: str = "side") -> None:
    bad = check_split(readings, split, features, column=column).filter("n > 0").collect()  # four rows at most
    if bad:
        raise LeakageError("; ".join(f"{r['check']}: {r['n']}" for r in bad))


def set_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Batches and components present in both tables (must be empty)."""
    pick = lambda df, c: df.select(F.lit(c).alias("identity"), F.col(c).alias("value"))
    return (
        pick(left, "batch_id").intersect(pick(right, "batch_id"))
        .unionByName(pick(left, "component_id").intersect(pick(right, "component_id")))
    )
