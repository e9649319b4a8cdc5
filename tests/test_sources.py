import os

import pytest
from pyspark.sql import functions as F

from peerscreen.operators import quality
from peerscreen.sources import csv, export

HEAD = "component_id,batch_id,component_family,hours,measurement_name,measurement_value,upper_limit"


def write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_text_survives_and_lines_are_counted(spark, tmp_path):
    body = "".join(f"{i:04d},NA,f,{h},m,1.5,2\n" for i in range(300) for h in (0, 24))
    path = write(tmp_path / "a", "x.csv", HEAD + "\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = csv.read_text(spark, path, line_numbers=True)
        assert df.rdd.getNumPartitions() > 3
        rows = df.orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == list(range(2, 602))
    assert all(r.component_id == f"{(r.line - 2) // 2:04d}" and r.batch_id == "NA" for r in rows)
    per_file = csv.rows_per_file(df, 500).first()
    assert per_file["rows"] == 600 and per_file.over_cap


@pytest.mark.parametrize(
    "data,status",
    [
        (b"PK\x03\x04abc", "container"),
        (b"\x89PNG\r\n", "container"),
        (b"SQLite format 3", "container"),
        (b"a,b\x00c\n", "nul_bytes"),
        (b"", "empty"),
        (b" \n \n", "empty"),
        (b"component_id,hours\nMZ,1\n", "text"),
        (b"x" * 300, "too_large"),
    ],
)
def test_triage(spark, tmp_path, data, status):
    path = write(tmp_path / "t", "f.csv", data)
    assert csv.triage(spark, path, max_bytes=200).first().status == status


def test_decoding(spark, tmp_path):
    write(tmp_path / "d", "u.csv", "h\nµA\n".encode("utf-8-sig"))
    path = write(tmp_path / "d", "w.csv", "h\nµA\n".encode("cp1252"))
    got = {(r.encoding, r.line_number): r.line for r in csv.decode(spark, path).collect()}
    assert got == {("utf-8", 1): "h", ("utf-8", 2): "µA", ("cp1252", 1): "h", ("cp1252", 2): "µA"}


def test_headers(spark, tmp_path):
    path = write(tmp_path / "h", "a.csv", "component_id, hours ,hours\n1,2,3\n")
    found = {(r.code, r.column_name) for r in csv.check_headers(csv.header_names(spark, path)).collect()}
    assert ("DUPLICATE_HEADER", "hours") in found and ("MISSING_REQUIRED_COLUMNS", "upper_limit") in found
    assert ("MISSING_REQUIRED_COLUMNS", "component_id") not in found


def test_two_phase_gate(spark, tmp_path):
    bad_value = write(tmp_path / "v", "a.csv", HEAD + "\nc,b,f,0,m,oops,2\nc,b,f,0,m,1,2\n")
    errors = csv.ingest(csv.read_text(spark, bad_value, line_numbers=True)).errors.collect()
    assert [(e.line, e.column_name, e.code) for e in errors] == [(2, "measurement_value", "NON_FINITE_VALUE")]
    twice = write(tmp_path / "w", "a.csv", HEAD + "\nc,b,f,0,m,1,2\nc,b,f,0,m,1,2\nc,b2,f,-5,m,1,2\n")
    errors = {(e.code, e.n) for e in csv.ingest(csv.read_text(spark, twice)).errors.collect()}
    assert errors == {("INVALID_HOURS", 1), ("DUPLICATE_MEASUREMENT_IDENTITY", 2), ("AMBIGUOUS_COMPONENT_IDENTITY", 1)}


def test_outcome_limits_are_ignored(spark, tmp_path):
    path = write(tmp_path / "o", "a.csv", HEAD + "\nc,b,f,168,m,9,1\n")
    got = csv.ingest_outcomes(csv.read_text(spark, path))
    assert "upper_limit" not in got.clean.columns and got.warnings.first().code == "OUTCOME_LIMITS_IGNORED"
    assert got.errors.isEmpty()
    early = spark.createDataFrame([("c", "b", "f", "m"), ("d", "b", "f", "m")], "component_id string, batch_id string, component_family string, measurement_name string")
    checks = {r["check"]: r.n for r in quality.check_outcomes(got.clean, early).collect()}
    assert checks == {"at_or_before_cutoff": 0, "repeated_observation": 0, "unknown_identity": 0, "uncovered_history": 1}


def test_promotion_and_booleans(spark):
    df = spark.createDataFrame([("1", "1.5", "x", "TRUE"), ("2", "", "2", "0")], "component_id string, a string, b string, flag string")
    got = csv.promote_numeric(df)
    kinds = dict(got.dtypes)
    assert (kinds["component_id"], kinds["a"], kinds["b"]) == ("string", "double", "string")
    good, bad = csv.boolean_labels(df, ["flag"])
    assert [r.flag for r in good.collect()] == [True, False] and bad.isEmpty()
    assert csv.boolean_labels(df.withColumn("flag", F.lit("yes")), ["flag"])[1].count() == 2


def test_fingerprint_ignores_order(spark, demo):
    a = export.fingerprint(demo).first()
    b = export.fingerprint(demo.orderBy(F.rand(4)).repartition(3)).first()
    c = export.fingerprint(demo.withColumn("hours", F.col("hours") + 1)).first()
    assert a == b and a != c


def test_split_export_and_flat_tables(spark, tmp_path, drifting):
    from peerscreen.operators import splits
    from peerscreen.plans import screening

    readings, labels = drifting
    split = splits.three_way_split(readings)
    parts = export.split_tables(readings, labels, split)
    export.write_split_tables(parts, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "early"))
    assert back.filter("split = 'test'").count() == 2 * 16 * 2
    assert parts["demo_outcomes"].filter("hours <= 24").isEmpty() and parts["demo_labels"].count() == 32
    flat = export.flat_export(screening.screen(readings))
    assert len(flat.columns) == 27 and flat.count() == 160
    flagged = export.flagged_export(screening.screen(readings))
    assert flagged.columns == export.FLAGGED_COLUMNS and flagged.filter("Recommendation = 'ACCEPT'").isEmpty()
    export.write_csv(flagged, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == flagged.count()
    sample = export.sample_slice(readings.filter("hours <= 24"), readings.filter("hours > 24"), components=3)
    assert [r.component_id for r in sample.filter("hours = 168").collect()] == ["D0000", "D0001", "D0002"]


def test_triage_lists_every_file_once(spark, tmp_path):
    for name, data in (("a.csv", b"x,y\n1,2\n"), ("b c.csv", b""), ("blank.csv", b" \n" * 3000), ("big.csv", b"z" * 7000)):
        path = write(tmp_path / "all", name, data)
    got = sorted((r.path.rsplit("/", 1)[-1], r.status) for r in csv.triage(spark, path, max_bytes=6500).collect())
    assert got == [("a.csv", "text"), ("b c.csv", "empty"), ("big.csv", "too_large"), ("blank.csv", "empty")]
    assert {r.encoding for r in csv.decode(spark, path, max_bytes=6500).collect() if r.path.endswith("big.csv")} == {"too_large"}


def test_intake_job(spark, tmp_path):
    row = "c{0},b,f,{1},m,1.5,2\n"
    files = {
        "good.csv": HEAD + "\n" + row.format(1, 0) + "\n" + row.format(1, 24),
        "quoted.csv": HEAD + '\n"c\n2",b,f,0,m,1,2\n"c\n2",b,f,24,m,1,2\n',
        "windows.csv": (HEAD + "\nµ3,b,f,0,m,1,2\n").encode("cp1252"),
        "undecodable.csv": HEAD.encode() + b"\n\x81\x8d,b,f,0,m,1,2\n",
        "header_only.csv": HEAD + "\n",
        "double.csv": HEAD + ",hours\n" + "c,b,f,0,m,1,2,0\n",
        "missing.csv": "component_id,batch_id\nc,b\n",
        "many.csv": HEAD + "\n" + "".join(row.format(9, h) for h in range(6)),
        "open_quote.csv": HEAD + '\n"c,b,f,0,m,1,2\n',
        "wide.csv": HEAD + "\n" + "c,b,f,0,m,1,2,3,4\n",
        "zip.csv": b"PK\x03\x04abc",
        "cells.csv": HEAD + "\nc,b,f,0,m,1,2\nc,b,f,0,m,oops,2\n",
    }
    for name, data in files.items():
        path = write(tmp_path / "intake", name, data)
    got = csv.ingest_files(spark, path, max_rows=5)
    short = lambda p: p.rsplit("/", 1)[-1]
    errors = {(short(r.path), r.line, r.column_name, r.code) for r in got.errors.collect()}
    missing = {("missing.csv", None, c, "MISSING_REQUIRED_COLUMNS") for c in HEAD.split(",")[2:]}
    assert errors == missing | {
        ("undecodable.csv", None, None, "ENCODING_INVALID"),
        ("header_only.csv", None, None, "FILE_EMPTY"),
        ("double.csv", None, "hours", "DUPLICATE_HEADER"),
        ("many.csv", None, None, "TOO_MANY_ROWS"),
        ("open_quote.csv", 2, None, "CSV_PARSE_FAILED"),
        ("wide.csv", 2, None, "CSV_PARSE_FAILED"),
        ("zip.csv", None, None, "UNSUPPORTED_FILE_TYPE"),
        ("cells.csv", 3, "measurement_value", "NON_FINITE_VALUE"),
    }
    assert sorted((short(r.file_path), r.line, r.component_id) for r in got.clean.collect()) == [
        ("good.csv", 2, "c1"), ("good.csv", 4, "c1"), ("quoted.csv", 2, "c\n2"), ("quoted.csv", 4, "c\n2"), ("windows.csv", 2, "µ3")
    ]
    assert [(short(r.path), r.code) for r in got.warnings.collect()] == [("windows.csv", "NON_UTF8_ENCODING")]
    assert {short(r.path) for r in csv.broken_records(spark, path).collect()} == {"quoted.csv", "open_quote.csv"}
