"""Readings and labels views over the event table of the test data.

``events`` has the shape of test measurements: a series per user and event type,
a time, a value. Thirty days become eight checkpoints of four days.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from peerscreen import schema as S
from peerscreen.operators import ordering

EVENT_LIMIT = 120.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    days = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    user = F.col("user_id")
    grouped = (
        table(spark, sf_dir, "events")
        .withColumn("hours", (F.floor(days / 4) * 24).cast("double"))
        .groupBy("user_id", "event_type", "hours")
        .agg(F.avg("value").alias("measurement_value"))
    )
    return grouped.select(
        F.concat(F.lit("C"), F.lpad(user.cast("string"), 6, "0")).alias("component_id"),
        F.concat(F.lit("B"), F.lpad((user % 10).cast("string"), 2, "0")).alias("batch_id"),
        F.lit("EVT").alias("component_family"),
        F.col("event_type").alias("measurement_name"),
        "hours",
        "measurement_value",
        F.lit(EVENT_LIMIT).alias("upper_limit"),
        F.concat(F.lit("P"), ((user % 10) % 2).cast("string")).alias("profile_id"),
        (F.floor(user / 10) % 2).cast("int").alias("tester_channel"),
        (F.lit(120.0) + (user % 10) * 0.5).alias("temperature_c"),
    )


def heat(spark: SparkSession, sf_dir: str) -> ordering.Heat:
    """Group sizes bounded from the raw events: one pass over two columns."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("batch_id"),
        F.lit("EVT").alias("component_family"),
        F.col("event_type").alias("measurement_name"),
    )
    return ordering.measure(events)


def labels(readings_df: DataFrame) -> DataFrame:
    """Truth planted by arithmetic on the component number; unrelated to the values."""
    k = F.floor(F.substring("component_id", 2, 12).cast("int") / 10).cast("int")
    df = readings_df.withColumn("k", k)
    k = F.col("k")
    defect, tester = k % 5 == 0, k % 7 == 3
    value, hours = F.col("measurement_value"), F.col("hours")
    return df.groupBy(*S.KEY4, "profile_id").agg(
        F.max(F.when(hours == 168, value)).alias("final_value"),
        F.min(F.when(value >= F.col("upper_limit"), hours)).alias("first_exceedance_hour"),
        F.max("upper_limit").alias("upper_limit"),
        F.bool_or(defect).alias("is_defect"),
        F.bool_or(tester).alias("is_tester_fault"),
        F.bool_and(~defect & ~tester).alias("is_healthy"),
        F.max(F.when(defect, ((k % 4) * 24).cast("double"))).alias("anomaly_onset_hour"),
        F.max(
            F.when(tester, "tester_fault")
            .when(~defect, "healthy")
            .when(k % 2 == 0, "gradual_drift")
            .otherwise("sudden_step")
        ).alias("scenario"),
    )
