"""Statistics of a component against the peers of its own batch.

Every function has two plans with the same result. Ordinary batches use windows
over one exchange by peer group. If a group exceeds the hot bound (checked by
the caller or here), medians and ranks come from range-sorted running totals
and are joined back with salting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import robust_scale_z, textbook_mad_z
from peerscreen.operators import ordering

GROUP = ["as_of_hour", *S.PEER]


def _group(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    return [c for c in (keys or GROUP) if c in df.columns]


def center_and_spread(df: DataFrame, columns: Sequence[str], keys: Sequence[str], *, hot: bool) -> DataFrame:
    """Add ``{c}_med``, ``{c}_mad`` and ``{c}_std`` per group for every column."""
    keys = list(keys)
    if not hot:
        w = Window.partitionBy(*keys)
        df = df.withColumns(
            {f"{c}_med": F.median(c).over(w) for c in columns}
            | {f"{c}_std": F.stddev_samp(c).over(w) for c in columns}
        )
        return df.withColumns(
            {f"{c}_mad": F.median(F.abs(F.col(c) - F.col(f"{c}_med"))).over(w) for c in columns}
        )
    df = ordering.stable(df)
    tall = df.select(
        *keys,
        F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("double") for c in columns]))).alias("_c", "_x"),
    )
    tall_keys = [*keys, "_c"]
    medians = ordering.stable(ordering.group_median(tall, tall_keys, "_x", "_med", hot=True).drop("n"))
    deviations = ordering.salted_join(tall, medians, tall_keys).withColumn("_d", F.abs(F.col("_x") - F.col("_med")))
    mads = ordering.group_median(deviations, tall_keys, "_d", "_mad", hot=True).drop("n")
    stds = tall.groupBy(*tall_keys).agg(F.stddev_samp("_x").alias("_std"))
    stats = ordering.null_safe_join(ordering.null_safe_join(medians, mads, tall_keys), stds, tall_keys)
    pick = lambda c, s: F.max(F.when(F.col("_c") == c, F.col(s)))
    wide = stats.groupBy(*keys).agg(
        *[pick(c, f"_{s}").alias(f"{c}_{s}") for c in columns for s in ("med", "mad", "std")]
    )
    return ordering.salted_join(df, wide, keys)


def robust_z(
    features: DataFrame,
    outputs: dict[str, str],
    *,
    keys: Sequence[str] | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """0.6745 * (x - median) / floored scale, per peer group; ``outputs`` maps column to new name."""
    keys = _group(features, keys)
    if hot is None:
        hot = ordering.has_hot_group(features, keys)
    df = center_and_spread(features, list(outputs), keys, hot=hot)
    df = df.withColumns(
        {
            name: robust_scale_z(F.col(c).cast("double"), F.col(f"{c}_med"), F.col(f"{c}_mad"), F.col(f"{c}_std"))
            for c, name in outputs.items()
        }
    )
    return df.drop(*[f"{c}_{s}" for c in outputs for s in ("med", "mad", "std")])


def mad_z(
    features: DataFrame,
    outputs: dict[str, str],
    *,
    keys: Sequence[str] | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Textbook 1.4826 * MAD z-score, a different rule from :func:`robust_z`."""
    keys = _group(features, keys)
    if hot is None:
        hot = ordering.has_hot_group(features, keys)
    df = center_and_spread(features, list(outputs), keys, hot=hot)
    df = df.withColumns(
        {
            name: textbook_mad_z(F.col(c).cast("double"), F.col(f"{c}_med"), F.col(f"{c}_mad"))
            for c, name in outputs.items()
        }
    )
    return df.drop(*[f"{c}_{s}" for c in outputs for s in ("med", "mad", "std")])


def peer_count(features: DataFrame, *, keys: Sequence[str] | None = None, hot: bool | None = None) -> DataFrame:
    """Number of histories in the peer group and the weak-comparison mark."""
    keys = _group(features, keys)
    if hot is None:
        hot = ordering.has_hot_group(features, keys)
    if hot:
        counts = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("peer_count"))
        df = ordering.salted_join(features, counts, keys)
    else:
        df = features.withColumn("peer_count", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df.withColumn("weak_peers", F.col("peer_count") < S.MIN_PEERS)


def percentile_rank(
    features: DataFrame,
    column: str,
    name: str,
    *,
    keys: Sequence[str] | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Rank / non-missing count inside the peer group, ties averaged; NULL stays NULL."""
    keys = _group(features, keys)
    if hot is None:
        hot = ordering.has_hot_group(features, keys)
    if hot:
        features = ordering.stable(features)
        totals = ordering.running_totals(features, keys, column, hot=True)
        ranks = totals.select(
            *keys,
            column,
            ((F.col("before") + (F.col("weight") + 1) / 2) / F.col("total")).alias(name),
        )
        return ordering.salted_join(features, ranks, [*keys, column])
    group, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, column)
    rank = F.rank().over(group.orderBy(F.col(column).asc_nulls_last()))
    average = rank + (F.count(column).over(ties) - 1) / 2
    return features.withColumn(
        name, F.when(F.col(column).isNotNull(), average / F.count(column).over(group))
    )


def channel_peers(features: DataFrame, *, channel: str = "tester_channel", hot: bool | None = None) -> DataFrame:
    """Leave-one-out median and elevated share of the level z on the same tester channel.

    Taking one value out of a sorted group of n moves the middle by at most one
    place, so three order statistics of the full group and the row's own value
    settle the leave-one-out median: no peer list is built.
    """
    keys = [*_group(features, None), channel]
    z = "current_batch_robust_z"
    usable = F.col(channel).isNotNull() & F.col(z).isNotNull()
    present = features.filter(usable)
    if hot is None:
        hot = ordering.has_hot_group(present, keys)
    if hot:
        features = ordering.stable(features)
        present = features.filter(usable)
    half = lambda n: F.floor(n / 2)
    middle = ordering.order_statistics(
        present,
        keys,
        z,
        {"_below": lambda n: half(n) - 1, "_mid": half, "_above": lambda n: half(n) + 1, "_far": lambda n: half(n) + 2},
        hot=hot,
    )
    elevated = present.groupBy(*keys).agg(F.count_if(F.col(z) > S.CHANNEL_Z).alias("_high"))
    stats = ordering.null_safe_join(middle, elevated, keys)
    join = (ordering.salted_join if hot else ordering.null_safe_join)(features, stats, keys)
    own, n = F.col(z), F.col("n")
    # m = n - 1 others. The k-th of the others is the (k+1)-th of all when the
    # own value sits at or below the k-th place, else the k-th.
    kth = lambda at, nxt: F.when(own <= F.col(at), F.col(nxt)).otherwise(F.col(at))
    # n even: m odd, k = n / 2.  n odd: m even, k = (n - 1) / 2 and k + 1.
    median = F.when(n % 2 == 0, kth("_mid", "_above")).otherwise(
        (kth("_mid", "_above") + kth("_above", "_far")) / 2
    )
    enough = usable & (n - 1 >= S.MIN_CHANNEL_PEERS)
    high_others = F.col("_high") - F.when(own > S.CHANNEL_Z, 1).otherwise(0)
    return join.withColumns(
        {
            S.CHANNEL_FEATURES[0]: F.when(enough, median),
            S.CHANNEL_FEATURES[1]: F.when(enough, high_others / (n - 1)),
        }
    ).drop("_below", "_mid", "_above", "_far", "_high", "n")


def peer_statistics(
    early: DataFrame,
    *,
    as_of_hour: float = S.AS_OF_HOUR,
    min_group_size: int = S.MIN_PEERS,
    hot: bool | None = None,
) -> DataFrame:
    """Size, median, MAD and range of the cutoff-hour value per peer group."""
    cutoff = early.filter(F.abs(F.col("hours") - as_of_hour) < S.HOUR_TOLERANCE)
    if hot is None:
        hot = ordering.has_hot_group(cutoff, S.PEER)
    value = "measurement_value"
    if hot:
        cutoff = ordering.stable(cutoff.select(*S.PEER, value))
        med = ordering.stable(ordering.group_median(cutoff, S.PEER, value, "median", hot=True).drop("n"))
        dev = ordering.salted_join(cutoff, med, S.PEER).withColumn("_d", F.abs(F.col(value) - F.col("median")))
        mad = ordering.group_median(dev, S.PEER, "_d", "mad", hot=True).drop("n")
        size = cutoff.groupBy(*S.PEER).agg(
            F.count(F.lit(1)).alias("sample_size"), F.min(value).alias("peer_min"), F.max(value).alias("peer_max")
        )
        stats = ordering.null_safe_join(ordering.null_safe_join(size, med, S.PEER), mad, S.PEER)
    else:
        w = Window.partitionBy(*S.PEER)
        stats = (
            cutoff.withColumn("_med", F.median(value).over(w))
            .groupBy(*S.PEER)
            .agg(
                F.count(F.lit(1)).alias("sample_size"),
                F.min(value).alias("peer_min"),
                F.max(value).alias("peer_max"),
                F.first("_med").alias("median"),
                F.median(F.abs(F.col(value) - F.col("_med"))).alias("mad"),
            )
        )
    enough = F.col("sample_size") >= min_group_size
    # Fixed text.
    note = F.concat(
        F.lit("Only "),
        F.col("sample_size").cast("string"),
        F.lit(
            f" comparable peers were available; at least {min_group_size} are required before "
            "batch-relative statistics are treated as reliable. Values are shown for context only."
        ),
    )
    return stats.withColumns(
        {
            "sufficient": enough,
            "status": F.when(enough, "available").otherwise("insufficient_data"),
            "note": F.when(~enough, note),
        }
    )
