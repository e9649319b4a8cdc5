"""Writers and table fingerprints."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peerscreen import schema as S
from peerscreen.operators import ordering, splits


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return os.path.join(ordering.shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, row_hash: Column | None = None) -> DataFrame:
    """Order-insensitive content fingerprint: rows, sum and xor of row hashes.

    ``row_hash`` (a bigint) replaces Spark's own hash where another engine must agree.
    """
    h = row_hash if row_hash is not None else F.xxhash64(*[F.col(c) for c in (columns or df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def split_tables(readings: DataFrame, labels: DataFrame, split: DataFrame) -> dict[str, DataFrame]:
    """readings, early and labels with their ``split`` column, plus the demo subset."""
    tagged = readings.join(split.select("batch_id", "split"), "batch_id")
    demo = splits.first_batch_per_profile(split).select("batch_id")
    demo_rows = readings.join(demo, "batch_id", "left_semi")
    early = F.col("hours").isin(S.CHECKPOINTS)
    return {
        "readings": tagged,
        "early": tagged.filter(early),
        "labels": labels.join(split.select("batch_id", "split"), "batch_id"),
        "demo_early": demo_rows.filter(early),
        "demo_outcomes": demo_rows.filter(F.col("hours") > S.AS_OF_HOUR),
        "demo_labels": labels.join(demo, "batch_id", "left_semi"),
        "batch_splits": split,
    }


def write_split_tables(tables: dict[str, DataFrame], path: str, *, fmt: str = "parquet") -> None:
    """One folder per table; the split is a partition column, so a side is read without a scan of the rest."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists").format(fmt)
        if "split" in df.columns and name != "batch_splits":
            writer = writer.partitionBy("split")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(os.path.join(path, name))


def write_report(tables: dict[str, DataFrame], path: str, metadata: dict | None = None) -> None:
    """Report folder: metric tables as CSV, large ones (name starts with 'scored') as Parquet, metadata as JSON."""
    for name, df in tables.items():
        target = os.path.join(path, name)
        if name.startswith("scored"):
            df.write.mode("errorifexists").parquet(target)
        else:
            df.write.mode("errorifexists").option("header", True).csv(target)
    if metadata is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        rows = [(k, str(v)) for k, v in metadata.items()]
        spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("errorifexists").json(
            os.path.join(path, "run_metadata")
        )


def sample_slice(early: DataFrame, outcomes: DataFrame, *, components: int = 240, hour: float = S.TARGET_HOUR) -> DataFrame:
    """The first components by id with their outcome at one hour, in stable order.

    The id list is a bounded top-n; the tables meet it in semi joins.
    """
    ids = early.select("component_id").distinct().orderBy("component_id").limit(components)
    part = early.join(ids, "component_id", "left_semi")
    later = outcomes.filter(F.col("hours") == hour).join(ids, "component_id", "left_semi")
    return part.unionByName(later, allowMissingColumns=True).orderBy("batch_id", "component_id", "measurement_name", "hours")


def flat_export(df: DataFrame) -> DataFrame:
    """The flat screening table (27 columns, missing inputs are NULL)."""
    have = set(df.columns)
    get = lambda c, kind="double": F.col(c) if c in have else F.lit(None).cast(kind)
    yes_no = lambda c: F.when(F.coalesce(get(c, "boolean"), F.lit(False)), "TRUE").otherwise("FALSE")
    columns = {
        "Component_ID": F.col("component_id"),
        "Batch_ID": F.col("batch_id"),
        "Family": F.col("component_family"),
        "Profile": get("profile_id", "string"),
        "Initial_0h_uA": F.col("initial_value"),
        "Latest_24h_uA": F.col("current_value"),
        "Delta_uA": F.col("delta"),
        "Percent_Change": F.when(F.col("initial_value") != 0, F.col("percent_change")),
        "Slope_Per_Hour": F.col("slope"),
        "Applicable_Limit_uA": get("applicable_limit"),
        "Anomaly_Flag": yes_no("is_anomaly"),
        "Anomaly_Score": F.col("anomaly_score"),
        "Robust_Deviation_Score": F.col("robust_deviation_score"),
        "Peer_Robust_Z": F.col("current_batch_robust_z"),
        "Peer_Sample_Size": get("peer_count", "bigint"),
        "Predicted_168h_uA": get("predicted_final_value"),
        "Interval_Lower_uA": get("prediction_lower"),
        "Interval_Upper_uA": get("prediction_upper"),
        "Interval_Nominal_Coverage": get("interval_nominal_coverage"),
        "Predicted_Limit_Cross": yes_no("predicted_to_cross_limit"),
        "Recommendation": F.col("recommendation"),
        "Recommendation_Reasons": F.array_join("recommendation_reasons", "; "),
        "Observed_168h_uA": get("observed_at_target"),
        "Crossed_Limit_At_168h": yes_no("crossed_at_target"),
        "Board_Position": get("board_position", "string"),
        "Tester_Channel": get("tester_channel", "string").cast("string"),
        "Tester_ID": get("tester_id", "string"),
    }
    return df.select(*[c.alias(n) for n, c in columns.items()])


FLAGGED_COLUMNS = [
    "Component_ID",
    "Batch_ID",
    "Recommendation",
    "Reasons",
    "Latest_24h_uA",
    "Limit_uA",
    "Peer_Robust_Z",
    "Predicted_168h_uA",
    "Interval_Upper_uA",
    "Board_Position",
]


def flagged_export(df: DataFrame) -> DataFrame:
    """Records that were not accepted, 10 columns."""
    flat = flat_export(df).filter(F.col("Recommendation") != "ACCEPT")
    flat = flat.withColumnsRenamed({"Recommendation_Reasons": "Reasons", "Applicable_Limit_uA": "Limit_uA"})
    return flat.select(*FLAGGED_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)
