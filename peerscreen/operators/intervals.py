"""Split-conformal radii, signed margins and interval quality.

Ranks are exact order statistics of the calibration residuals (never an
interpolated percentile), found without bringing the residuals into one task
when the calibration table is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import ratio, slope_stratum
from peerscreen.operators import ordering


def _ceil_rank(level: float):
    # Same double arithmetic as ceil((n + 1) * level).
    return lambda n: F.ceil((n + 1).cast("double") * F.lit(float(level)))


def _floor_rank(level: float):
    return lambda n: F.floor((n + 1).cast("double") * F.lit(float(level)))


def conformal_radius(df: DataFrame, residual: str, *, alpha: float = 0.1, keys: Sequence[str] = (), hot: bool | None = None) -> DataFrame:
    """keys + n + radius: order statistic ceil((n+1)(1-alpha)) of |residual|; NULL when n is too small."""
    if not 0 < alpha < 1:
        raise ValueError("0 < alpha < 1 is required")
    work = df.withColumn("_abs", F.abs(F.col(residual)))
    return ordering.order_statistics(work, list(keys), "_abs", {"radius": _ceil_rank(1 - alpha)}, hot=hot)


MARGINS = ["lower", "upper", "lower_two_sided", "upper_two_sided"]


def signed_bounds(df: DataFrame, residual: str, *, alpha: float = 0.1, keys: Sequence[str] = (), hot: bool | None = None) -> DataFrame:
    """keys + n + one-sided and two-sided signed margins; NULL when a rank leaves 1..n."""
    if not 0 < alpha < 0.5:
        raise ValueError("0 < alpha < 0.5 is required")
    ranks = {
        "lower": _floor_rank(alpha),
        "upper": _ceil_rank(1 - alpha),
        "lower_two_sided": _floor_rank(alpha / 2),
        "upper_two_sided": _ceil_rank(1 - alpha / 2),
    }
    return ordering.order_statistics(df, list(keys), residual, ranks, hot=hot)


def stratified_margins(df: DataFrame, residual: str, *, alpha: float = 0.1, z: str = "slope_batch_robust_z", keys: Sequence[str] = (), hot: bool | None = None) -> DataFrame:
    """Margins per slope stratum, pooled where a stratum is small or short of ranks.

    Three rows (per key). Lower margins are capped at zero, upper ones floored.
    """
    keys = list(keys)
    # Each residual counts in its stratum and in the pool (-1): one pass for both.
    pool = -1
    both = df.withColumn("stratum", F.explode(F.array(slope_stratum(F.col(z)), F.lit(pool))))
    found = signed_bounds(both, residual, alpha=alpha, keys=[*keys, "stratum"], hot=hot)
    own = found.filter(F.col("stratum") != pool)
    pooled = found.filter(F.col("stratum") == pool).select(*keys, *[F.col(m).alias(f"_p_{m}") for m in MARGINS])
    strata = pooled.withColumn("stratum", F.explode(F.array(*[F.lit(k) for k in range(len(S.STRATA_EDGES) + 1)])))
    joined = strata.join(own, [*keys, "stratum"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    usable = F.col("n") >= S.MIN_STRATUM
    for m in MARGINS:
        usable = usable & F.col(m).isNotNull()
    joined = joined.withColumn("pooled_fallback", ~F.coalesce(usable, F.lit(False)))
    value = lambda m: F.when(F.col("pooled_fallback"), F.col(f"_p_{m}")).otherwise(F.col(m))
    cap = lambda m: F.least(value(m), F.lit(0.0)) if m.startswith("lower") else F.greatest(value(m), F.lit(0.0))
    return joined.select(
        *keys, "stratum", *[cap(m).alias(m) for m in MARGINS], F.col("n").alias("calibration_components"), "pooled_fallback"
    )


def apply_radius(df: DataFrame, radius: DataFrame, forecast: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Symmetric bounds; the radius table has one row per key."""
    r = radius.select(*keys, "radius")
    joined = df.join(r, list(keys)) if keys else df.crossJoin(F.broadcast(r))  # one row without keys
    return joined.withColumns(
        {"lower": F.greatest(F.col(forecast) - F.col("radius"), F.lit(0.0)), "upper": F.col(forecast) + F.col("radius")}
    ).drop("radius")


def apply_margins(df: DataFrame, margins: DataFrame, forecast: str, *, z: str = "slope_batch_robust_z", keys: Sequence[str] = ()) -> DataFrame:
    """Stratified bounds. The margin table has three rows per key, so it is broadcast when unkeyed."""
    m = margins.select(*keys, "stratum", *[F.col(c).alias(f"_{c}") for c in MARGINS])
    work = df.withColumn("stratum", slope_stratum(F.col(z)))
    joined = work.join(F.broadcast(m) if not keys else m, [*keys, "stratum"], "left")
    bound = lambda c: (
        F.greatest(F.col(forecast) + F.col(f"_{c}"), F.lit(0.0)) if c.startswith("lower") else F.col(forecast) + F.col(f"_{c}")
    )
    return joined.withColumns({c: bound(c) for c in MARGINS}).drop(*[f"_{c}" for c in MARGINS])


def interval_metrics(df: DataFrame, *, keys: Sequence[str] = (), hot: bool | None = None) -> DataFrame:
    """Coverage and width per key. Needs y, lower, upper, batch_id; optional is_healthy, upper_limit.

    Batch coverage is aggregated first, the rest is built on top of it, so the
    large table is grouped once.
    """
    keys = list(keys)
    have = set(df.columns)
    # Read twice (rates, median width): keep the few columns.
    used = [*keys, "batch_id", "y", "lower", "upper", "is_healthy"]
    df = ordering.stable(df.select(*dict.fromkeys(c for c in used if c in have)))
    y, lo, up = F.col("y"), F.col("lower"), F.col("upper")
    covered = ((y >= lo) & (y <= up)).cast("double")
    healthy = F.col("is_healthy") if "is_healthy" in have else F.lit(None).cast("boolean")
    num = lambda cond: cond.cast("double")
    per_batch = df.groupBy(*keys, "batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(covered).alias("c"),
        F.sum(num(y <= up)).alias("u"),
        F.sum(up - lo).alias("w"),
        F.sum(num(up < 1.0)).alias("ub"),
        F.sum(num(lo >= 1.0)).alias("la"),
        F.sum(F.when(healthy, covered)).alias("ch"),
        F.count_if(healthy).alias("nh"),
        F.sum(F.when(~healthy, covered)).alias("cn"),
        F.count_if(~healthy).alias("nn"),
        F.sum(F.when(y >= 1.0, covered)).alias("cx"),
        F.sum(F.when(y >= 1.0, num(up >= 1.0))).alias("ux"),
        F.count_if(y >= 1.0).alias("nx"),
    )
    total = lambda c: F.sum(c)
    rate = F.col("c") / F.col("n")
    out = per_batch.groupBy(*keys).agg(
        total("n").alias("components"),
        ratio(total("c"), total("n")).alias("coverage"),
        ratio(total("u"), total("n")).alias("upper_only_coverage"),
        F.min(rate).alias("batch_coverage_min"),
        F.max(rate).alias("batch_coverage_max"),
        F.coalesce(F.stddev_samp(rate), F.lit(0.0)).alias("batch_coverage_std"),
        ratio(total("w"), total("n")).alias("mean_width"),
        ratio(total("ub"), total("n")).alias("share_upper_below_limit"),
        ratio(total("la"), total("n")).alias("share_lower_at_or_above_limit"),
        ratio(total("ch"), total("nh")).alias("coverage_healthy"),
        ratio(total("cn"), total("nn")).alias("coverage_nonhealthy"),
        ratio(total("cx"), total("nx")).alias("coverage_crossers"),
        ratio(total("ux"), total("nx")).alias("crossers_with_upper_at_limit"),
    )
    widths = df.withColumn("_w", up - lo)
    median = ordering.group_median(widths, keys, "_w", "median_width", hot=hot).drop("n")
    return out.join(median, keys) if keys else out.crossJoin(median)  # one row each without keys
