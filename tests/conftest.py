import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


SHAPE = "component_id string, batch_id string, component_family string, measurement_name string, hours double, measurement_value double, upper_limit double"


@pytest.fixture(scope="session")
def demo(spark):
    """Twelve parts of one batch; C012 drifts 15 -> 40 -> 60 against a limit of 50."""
    rows = []
    for i in range(1, 12):
        base = 10.0 + 0.1 * i
        for h, v in ((0.0, base), (24.0, base + 0.2), (168.0, base + 1.0)):
            rows.append((f"C{i:03d}", "B01", "IC", "leak", h, v, 50.0))
    rows += [("C012", "B01", "IC", "leak", h, v, 50.0) for h, v in ((0.0, 15.0), (24.0, 40.0), (168.0, 60.0))]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="session")
def drifting(spark):
    """Ten batches x 16 parts, two profiles; every fifth part drifts early and ends far higher."""
    rows, truth = [], []
    for b in range(10):
        limit = 0.25 if b % 2 == 0 else 1.3
        for i in range(16):
            base = limit * (0.2 + 0.01 * i + 0.005 * b)
            bad = i % 5 == 0
            day = base * (1.6 if bad else 1.02)
            final = base * (3.5 if bad else 1.05)
            cid = f"D{b:02d}{i:02d}"
            for h, v in ((0.0, base), (24.0, day), (168.0, final)):
                rows.append((cid, f"B{b:02d}", "MLCC_X7R", "leakage_ua", h, v, limit, f"P{b % 2}", i % 2))
            truth.append((cid, f"B{b:02d}", "MLCC_X7R", "leakage_ua", final, bad, False, not bad, "gradual_drift" if bad else "healthy", 0.0 if bad else None))
    readings = spark.createDataFrame(rows, SHAPE + ", profile_id string, tester_channel int")
    labels = spark.createDataFrame(
        truth,
        "component_id string, batch_id string, component_family string, measurement_name string, final_value double, is_defect boolean, is_tester_fault boolean, is_healthy boolean, scenario string, anomaly_onset_hour double",
    )
    return readings.cache(), labels.cache()
