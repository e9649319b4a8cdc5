"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
written to Spark's no-op sink, so all rows and columns are computed; nothing is
sent to the driver. One untimed run warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import metric_queries, model_queries, registry  # noqa: E402, F401

HEADLINE = [
    "E-01_component_features",
    "F-01_robust_z",
    "F-01_robust_z_spread",
    "F-05_channel_peers",
    "J-20_recommendation",
    "J-22_screening_record",
    "B-01_validate_readings",
    "B-09_eligibility_reasons",
    "E-05_component_summary",
    "E-08_harness_metrics",
    "E-16_grouped_metrics",
    "E-24_stratified_margins",
    "J-03_isolation_forest_score",
    "J-09_absolute_residual_forecast",
    "K-10_ladder_metrics",
    "K-11_parameter_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("J-20_recommendation")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    components = registry.records(spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "screened_histories": components,
                "histories_per_second": round(components / times["J-20_recommendation"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
