"""Evaluation metrics as conditional aggregates: one partial aggregation, tiny shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import flag, ratio, refuse_null
from peerscreen.operators import ordering


def onset_column(labels: DataFrame) -> str:
    for c in S.ONSET_COLUMNS:
        if c in labels.columns:
            return c
    raise ValueError("labels must carry an onset column, one of: " + ", ".join(S.ONSET_COLUMNS))


def with_onset(labels: DataFrame) -> DataFrame:
    name = onset_column(labels)
    return labels if name == S.ONSET_COLUMNS[0] else labels.withColumnRenamed(name, S.ONSET_COLUMNS[0])


def join_truth(scored: DataFrame, labels: DataFrame, columns: Sequence[str], *, strict: bool = True) -> DataFrame:
    """Truth joins only after scoring, one label row per history.

    ``strict`` fails the job at a scored row without a label; the check rides on
    the truth columns themselves and costs no extra pass.
    """
    truth = labels.select(*S.KEY4, *columns, F.lit(True).alias("_labelled"))
    joined = scored.join(truth, S.KEY4, "left")
    if strict:
        message = "one or more scored components have no ground-truth label"
        joined = joined.withColumns({c: refuse_null(F.col(c), F.col("_labelled"), message) for c in columns})
    return joined.drop("_labelled")


def truth_flags(df: DataFrame) -> DataFrame:
    """True anomaly, started by the cutoff, future failure, early future failure."""
    onset, first, as_of = F.col("anomaly_onset_hour"), F.col("first_exceedance_hour"), F.col("as_of_hour")
    truth = flag("is_defect") | flag("is_tester_fault")
    no = F.lit(False)
    return df.withColumns(
        {
            "is_true_anomaly": truth,
            "is_started_by_as_of": truth & F.coalesce(onset <= as_of, no),
            "is_future_limit_failure": flag("is_defect") & first.isNotNull(),
            "is_early_future_failure": flag("is_defect") & F.coalesce(first > as_of, no),
        }
    )


def method_flags(scored: DataFrame, *, fixed_limit_fraction: float | Column = 1.0) -> DataFrame:
    """Flag columns of the four plain methods."""
    return scored.withColumns(
        {
            "fixed_limit_flag": F.col("current_value") >= F.col("upper_limit") * fixed_limit_fraction,
            "robust_mad_flag": F.col("is_robust_anomaly"),
            "isolation_forest_flag": flag("is_model_anomaly"),
            "combined_flag": F.col("is_anomaly"),
        }
    )


def by_method(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per (row, method) with ``flagged``; the method list is short and fixed."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), flag(f"{m}_flag").alias("flagged")) for m in methods])
    keep = [c for c in df.columns if c not in ("method", "flagged")]
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.method", "_m.flagged")


def review_metrics(df: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("as_of_hour",)) -> DataFrame:
    """Per method: confusion on defect-or-tester-fault, several recalls, median warning lead."""
    tall = by_method(truth_flags(df), methods)
    on, truth = F.col("flagged"), F.col("is_true_anomaly")
    n = F.count_if
    recall = lambda c: ratio(n(on & flag(c)), n(flag(c)))
    lead = F.when(on & F.col("is_early_future_failure"), F.col("first_exceedance_hour") - F.col("as_of_hour"))
    return tall.groupBy(*keys, "method").agg(
        F.count(F.lit(1)).alias("evaluated_components"),
        n(on).alias("flagged_components"),
        n(on & truth).alias("true_positive"),
        n(on & ~truth).alias("false_positive"),
        n(~on & truth).alias("false_negative"),
        n(~on & ~truth).alias("true_negative"),
        ratio(n(on & truth), n(truth)).alias("review_recall"),
        ratio(n(~on & truth), n(truth)).alias("false_negative_rate"),
        ratio(n(on & ~truth), n(~truth)).alias("false_positive_rate"),
        ratio(n(on & truth), n(on)).alias("precision"),
        recall("is_defect").alias("defect_recall"),
        recall("is_tester_fault").alias("tester_fault_recall"),
        recall("is_started_by_as_of").alias("started_anomaly_recall"),
        recall("is_future_limit_failure").alias("future_failure_recall"),
        recall("is_early_future_failure").alias("early_failure_recall"),
        # Leads are differences of checkpoint hours: few distinct values.
        F.median(lead).alias("median_early_warning_lead_hours"),
    )


def harness_metrics(df: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("as_of_hour",)) -> DataFrame:
    """Per method: confusion without tester faults, recall after onset, lead times."""
    tall = by_method(df, methods)
    n, on, tester = F.count_if, F.col("flagged"), flag("is_tester_fault")
    defect, healthy = flag("is_defect") & ~tester, ~flag("is_defect") & ~tester
    first, as_of = F.col("first_exceedance_hour"), F.col("as_of_hour")
    started = defect & F.coalesce(F.col("anomaly_onset_hour") <= as_of, F.lit(False))
    caught = on & defect
    later = caught & F.coalesce(first > as_of, F.lit(False))
    lead = F.when(later, first - as_of)
    tp, fn, fp, tn = n(caught), n(~on & defect), n(on & healthy), n(~on & healthy)
    label = F.create_map(*[F.lit(x) for p in S.METHOD_LABELS.items() for x in p])
    out = tall.groupBy(*keys, "method").agg(
        F.count(F.lit(1)).alias("n_components"),
        n(defect).alias("n_defects"),
        n(healthy).alias("n_healthy"),
        n(tester).alias("n_tester_faults"),
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        tn.alias("true_negatives"),
        ratio(tp, n(defect)).alias("defect_recall"),
        ratio(fn, n(defect)).alias("false_negative_rate"),
        ratio(fp, n(healthy)).alias("false_positive_rate"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(n(on & started), n(started)).alias("recall_after_onset"),
        n(later).alias("n_early_warnings"),
        F.median(lead).alias("median_lead_time_hours"),
        F.avg(lead).alias("mean_lead_time_hours"),
        F.min(lead).alias("min_lead_time_hours"),
        n(caught & F.coalesce(first <= as_of, F.lit(False))).alias("n_detected_after_crossing"),
        n(caught & first.isNull()).alias("n_detected_never_crossing"),
        ratio(n(on & tester), n(tester)).alias("tester_fault_flag_rate"),
        ratio(fp + n(on & tester), tn + fp + n(tester)).alias("false_positive_rate_incl_tester_faults"),
    )
    return out.withColumn("method_label", label[F.col("method")])


def scenario_rates(df: DataFrame, methods: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form: flag rate per method and scenario."""
    return by_method(df, methods).groupBy(*keys, "method", "scenario").agg(
        F.count(F.lit(1)).alias("components"),
        F.count_if("flagged").alias("flagged"),
        F.avg(F.col("flagged").cast("double")).alias("flag_rate"),
    )


def scenario_rates_wide(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Wide form: one column per method."""
    return df.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_components"),
        *[F.avg(flag(f"{m}_flag").cast("double")).alias(m) for m in methods],
    )


SPLIT_SUMMARY = [
    "early_failure_recall",
    "false_negative_rate",
    "false_positive_rate",
    "future_failure_recall",
    "precision",
    "review_recall",
]


def summarize_repeated_splits(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("method").agg(
        *[f(c).alias(f"{c}_{n}") for c in SPLIT_SUMMARY for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    )


def confusion(truth: Column, on: Column, prefix: str = "", within: Column | None = None) -> list[Column]:
    """Reusable aggregate list: tp, fn, fp, tn, recall, false_positive_rate, precision; of rows ``within`` if given."""
    n = (lambda c: F.count_if(c)) if within is None else (lambda c: F.count_if(within & c))
    tp, fn, fp, tn = n(truth & on), n(truth & ~on), n(~truth & on), n(~truth & ~on)
    return [
        tp.alias(f"{prefix}tp"),
        fn.alias(f"{prefix}fn"),
        fp.alias(f"{prefix}fp"),
        tn.alias(f"{prefix}tn"),
        ratio(tp, tp + fn).alias(f"{prefix}recall"),
        ratio(fp, fp + tn).alias(f"{prefix}fpr"),
        ratio(tp, tp + fp).alias(f"{prefix}precision"),
    ]


def forecast_metrics(df: DataFrame, *, keys: Sequence[str] = (), medians: bool = True, hot: bool | None = None) -> DataFrame:
    """Error and crossing metrics of ``pred`` against ``y`` (both in limit fractions).

    Where the true final value is known apart from the tester (``is_future_failure`` with
    ``is_tester_fault``), latent_* rates crossings without the tester's faults.
    """
    keys = list(keys)
    latent = {"is_future_failure", "is_tester_fault"} <= set(df.columns)
    if medians:  # read twice: keep the few columns instead of computing the rows again
        used = [*keys, "pred", "y", "upper_limit", "limit_fraction", "is_healthy", "is_future_failure", "is_tester_fault"]
        df = ordering.stable(df.select(*dict.fromkeys(c for c in used if c in df.columns)))
    pred, y, limit = F.col("pred"), F.col("y"), F.col("upper_limit")
    error = pred - y
    already = F.col("limit_fraction") >= 1.0
    truth, on = y >= 1.0, pred >= 1.0
    healthy = F.col("is_healthy") if "is_healthy" in df.columns else F.lit(None).cast("boolean")
    n = F.count_if
    new_tp, new_fp = n(~already & truth & on), n(~already & ~truth & on)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("components"),
        F.avg(F.abs(error)).alias("mae_normalized"),
        F.sqrt(F.avg(error * error)).alias("rmse_normalized"),
        F.avg(error).alias("mean_signed_error"),
        F.avg(F.abs(error * limit)).alias("mae_unit"),
        *confusion(truth, on, "crossing_"),
        n(already).alias("already_components"),
        n(already & truth & on).alias("already_tp"),
        n(already & truth & ~on).alias("already_fn"),
        new_tp.alias("new_tp"),
        new_fp.alias("new_fp"),
        ratio(new_tp, n(~already & truth)).alias("new_recall"),
        ratio(new_fp, n(~already & ~truth)).alias("new_fpr"),
        F.avg((pred <= 0).cast("double")).alias("share_clipped_at_zero"),
        F.avg(F.when(healthy, F.abs(error))).alias("healthy_mae"),
        F.avg(F.when(~healthy, F.abs(error))).alias("nonhealthy_mae"),
        F.avg(F.when(healthy, error)).alias("healthy_mean_signed_error"),
        *(confusion(~F.col("is_tester_fault") & F.col("is_future_failure"), on, "latent_", ~F.col("is_tester_fault")) if latent else []),
    )
    if not medians:
        return out
    med = ordering.group_median(df.withColumn("_e", F.abs(error)), keys, "_e", "median_abs_error", hot=hot).drop("n")
    return out.join(med, keys) if keys else out.crossJoin(med)  # one row each without keys


def retrospective_stratum(as_of_hour: float = S.AS_OF_HOUR) -> Column:
    """Tester fault (by onset) before defect (by onset) before healthy."""
    tester_onset, onset = F.col("tester_fault_onset_hour"), F.col("anomaly_onset_hour")
    return (
        F.when(flag("is_tester_fault") & (tester_onset > as_of_hour), "tester_fault_onset_72")
        .when(flag("is_tester_fault") & (tester_onset <= as_of_hour), "tester_fault_onset_0_12")
        .when(flag("is_defect") & (onset > as_of_hour), "defect_onset_gt24")
        .when(flag("is_defect") & (onset <= as_of_hour), "defect_onset_le24")
        .otherwise("healthy")
    )


def grouped_forecast_metrics(df: DataFrame, dimensions: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The same metrics over several single groupings at once (GROUPING SETS).

    Output: keys + dimension + level + metrics; dimension 'all' is the total.
    """
    keys, dims = list(keys), list(dimensions)
    error, truth, on = F.col("pred") - F.col("y"), F.col("y") >= 1.0, F.col("pred") >= 1.0
    work = df.withColumns({d: F.col(d).cast("string") for d in dims})
    sets = [[F.col(k) for k in keys]] + [[F.col(k) for k in keys] + [F.col(d)] for d in dims]
    out = work.groupingSets(sets, *[F.col(c) for c in keys + dims]).agg(
        F.count(F.lit(1)).alias("components"),
        F.avg(F.abs(error)).alias("mae_normalized"),
        F.avg(error).alias("mean_signed_error"),
        F.avg(F.abs(error * F.col("upper_limit"))).alias("mae_unit"),
        *confusion(truth, on, "crossing_"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    name, level = F.lit("all"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        level = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(level)
    return out.withColumns({"dimension": name, "level": level}).drop(*dims, *[f"_g_{d}" for d in dims])


FOLD_COLUMNS = ["mae_normalized", "mae_unit", "rmse_normalized", "mean_signed_error", "healthy_mae", "nonhealthy_mae"]


def fold_summary(per_fold: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """Mean, spread, range and the per-fold list (one element per fold) of the headline metrics."""
    aggs = []
    fitted = ["train_mae"] if "train_mae" in per_fold.columns else []
    for c in [*FOLD_COLUMNS, *fitted]:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    folds = F.array_sort(F.collect_list(F.struct("fold", F.col("mae_normalized").alias("mae"))))
    return per_fold.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), *aggs, folds.alias("per_fold"))


def batch_mae(df: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    return df.groupBy(*keys, "batch_id").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))


def _baseline_value(column: str, baseline: str, window) -> Column:
    return F.max(F.when(F.col("config") == baseline, F.col(column))).over(window)


def paired_deltas(per_batch: DataFrame, baseline: str = "persistence") -> DataFrame:
    """Per configuration: batches beating the baseline and the paired difference."""
    # The baseline's own row supplies its value, so it never differs from itself.
    # A batch has one row per configuration.
    with_base = per_batch.withColumn("base", _baseline_value("mae", baseline, Window.partitionBy("batch_id")))
    delta = F.col("mae") - F.col("base")
    sd = F.stddev_samp(delta)
    return (
        with_base.groupBy("config")
        .agg(
            F.count(F.lit(1)).alias("batches_total"),
            F.count_if(delta < 0).alias("batches_beating_baseline"),
            F.avg(delta).alias("delta_mean"),
            F.coalesce(sd, F.lit(0.0)).alias("delta_std"),
            F.coalesce(sd / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("delta_se"),
        )
    )


def folds_beating(per_fold: DataFrame, baseline: str = "persistence") -> DataFrame:
    base = _baseline_value("mae_normalized", baseline, Window.partitionBy("fold"))
    return (
        per_fold.withColumn("base", base)
        .groupBy("config")
        .agg(F.count_if(F.col("mae_normalized") < F.col("base")).alias("folds_beating_baseline"), F.count(F.lit(1)).alias("folds"))
    )


def comparison_table(pooled: DataFrame, per_fold: DataFrame, per_batch: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """One row per configuration, best pooled error first, with the eligibility rule.

    Eligible: beats persistence overall and in four of five folds, moves healthy
    parts by at most 0.02, and is not ``excluded`` (uses batch-constant conditions).
    """
    fitted = [F.avg("train_mae").alias("train_mae_fold_mean")] if "train_mae" in per_fold.columns else []
    table = (
        pooled.join(folds_beating(per_fold), "config")
        .join(paired_deltas(per_batch), "config")
        .join(
            per_fold.groupBy("config").agg(
                F.avg("mae_normalized").alias("mae_fold_mean"),
                F.coalesce(F.stddev_samp("mae_normalized"), F.lit(0.0)).alias("mae_fold_std"),
                *fitted,
            ),
            "config",
        )
    )
    # One row per configuration.
    table = table.withColumn("_base", _baseline_value("mae_normalized", "persistence", Window.partitionBy()))
    enough = F.ceil(F.col("folds") * 0.8)
    eligible = (
        (F.col("mae_normalized") < F.col("_base"))
        & (F.col("folds_beating_baseline") >= enough)
        & F.coalesce(F.col("healthy_mae") <= 0.02, F.lit(True))
        & ~F.col("config").isin(list(excluded))
    )
    return table.withColumn("eligible", eligible).drop("_base").orderBy("mae_normalized", "config")


def seed_spread(per_seed: DataFrame) -> DataFrame:
    return per_seed.groupBy("config").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg("mae_normalized").alias("mae_mean"),
        F.coalesce(F.stddev_samp("mae_normalized"), F.lit(0.0)).alias("mae_std"),
        F.min("mae_normalized").alias("mae_min"),
        F.max("mae_normalized").alias("mae_max"),
    )


def outcome_labels(readings: DataFrame, *, target_hour: float = S.TARGET_HOUR) -> DataFrame:
    """Final value, exceedance at the end (strict), ever exceeded, first hour at or above the limit."""
    value, limit, hours = F.col("measurement_value"), F.col("upper_limit"), F.col("hours")
    at_end = F.when(hours == target_hour, value)
    return readings.groupBy(*S.KEY4).agg(
        F.max(at_end).alias("final_value"),
        F.bool_or(F.when(hours == target_hour, value > limit)).alias("is_final_exceedance"),
        F.bool_or(value > limit).alias("ever_exceeds"),
        F.min(F.when(value >= limit, hours)).alias("first_exceedance_hour"),
    )


def training_profile(features: DataFrame, y: str = "y", *, hot: bool | None = None) -> DataFrame:
    """Size, batch sizes and target quantiles of a training table, in one row.

    The exact quantiles come from order statistics, not from one big buffer.
    """
    per_batch = features.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("s"),
        F.count_if(F.col(y) >= 1.0).alias("x"),
        F.count_if(F.col("limit_fraction") >= 1.0).alias("a"),
    )
    sizes = per_batch.agg(
        F.sum("n").alias("components"),
        F.count(F.lit(1)).alias("batches"),
        F.min("n").alias("batch_min"),
        F.max("n").alias("batch_max"),
        ratio(F.sum("s"), F.sum("n")).alias("y_mean"),
        F.sum("x").alias("final_crossings"),
        F.sum("a").alias("already_at_limit"),
    )
    levels = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
    ranks = {}
    for q in levels:
        tag = str(q).replace("0.", "q")
        ranks[f"{tag}_lo"] = lambda n, q=q: F.floor((n - 1) * q) + 1
        ranks[f"{tag}_hi"] = lambda n, q=q: F.ceil((n - 1) * q) + 1
    stats = ordering.order_statistics(features, [], y, ranks, hot=hot)
    picks = []
    for q in levels:
        tag = str(q).replace("0.", "q")
        lo, hi = F.col(f"{tag}_lo"), F.col(f"{tag}_hi")
        part = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
        picks.append((lo + (hi - lo) * part).alias(f"y_{tag}"))
    return sizes.crossJoin(stats.select(*picks))  # one row each
