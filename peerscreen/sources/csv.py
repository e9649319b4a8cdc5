"""CSV intake: file checks, text-first scan, typed conversion with explicit findings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from peerscreen import schema as S
from peerscreen.functions.columns import as_number, blank, parse_boolean
from peerscreen.operators import ordering, quality

# --- fixed values: leading bytes (hex) of formats that are not CSV text --------
SIGNATURES = [
    ("504B0304", "ZIP archive or Office/OpenDocument workbook"),
    ("504B0506", "empty ZIP archive"),
    ("D0CF11E0", "legacy Microsoft Office document (.xls/.doc)"),
    ("4D5A", "Windows executable"),
    ("7F454C46", "ELF executable"),
    ("1F8B", "gzip archive"),
    ("25504446", "PDF document"),
    ("89504E47", "PNG image"),
    ("800495", "Python pickle"),
    ("800595", "Python pickle"),
    ("934E554D5059", "NumPy array file"),
    ("425A68", "bzip2 archive"),
    ("FD377A585A", "xz archive"),
    ("53514C69746520666F726D6174", "SQLite database"),
]
MAX_FILE_BYTES = 10 * 1024 * 1024
# --- end of fixed values --------------------------------------------------------


def triage(spark: SparkSession, path: str, *, max_bytes: int = MAX_FILE_BYTES, glob: str = "*.csv") -> DataFrame:
    """(path, length, status, detail): too_large, empty, container, nul_bytes or text.

    Content is read only for files below the cap; the length filter is pushed
    into the file source.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 16))
    found = F.lit(None).cast("string")
    for prefix, label in reversed(SIGNATURES):
        found = F.when(F.startswith(head, F.lit(prefix)), label).otherwise(found)
    small = files.filter(F.col("length") <= max_bytes).select(
        "path",
        "length",
        head.alias("_head"),
        found.alias("_label"),
        (F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s", "")) == "").alias("_blank"),
    )
    small = small.withColumn("_nul", F.col("_head").rlike("^([0-9A-F]{2})*?00"))
    status = (
        F.when(F.col("_blank"), "empty")
        .when(F.col("_label").isNotNull(), "container")
        .when(F.col("_nul"), "nul_bytes")
        .otherwise("text")
    )
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit("too_large").alias("status"), F.lit(None).cast("string").alias("detail")
    )
    seen = small.select("path", "length", status.alias("status"), F.col("_label").alias("detail")).unionByName(large)
    # The file source yields no row for a file of zero bytes; the listing knows it.
    # Listings and rows spell local paths with a different number of slashes.
    spelled = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").withColumn("_spelled", spelled(F.col("path")))
    hollow = listed.join(files.select(spelled(F.col("path")).alias("_spelled")), "_spelled", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"), F.lit("empty").alias("status"), F.lit(None).cast("string").alias("detail")
    )
    return seen.unionByName(hollow)


def decode(spark: SparkSession, path: str, *, max_bytes: int = MAX_FILE_BYTES, glob: str = "*.csv") -> DataFrame:
    """(path, line_number, line, encoding) of small files: UTF-8, or Windows-1252 with a note.

    Spark's CSV reader takes no Windows charset, so files that are not UTF-8 are
    decoded in Arrow batches; each file is bounded by ``max_bytes``. A larger file is one
    row without a line, encoding "too_large": :func:`read_text` takes such files.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = listed.filter(F.col("length") <= max_bytes).select("path", "content")
    large = listed.filter(F.col("length") > max_bytes).select(
        "path", F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("string").alias("line"), F.lit("too_large").alias("encoding")
    )

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    text, name = bytes(row.content).decode("utf-8-sig"), "utf-8"
                except UnicodeDecodeError:
                    try:
                        text, name = bytes(row.content).decode("cp1252"), "cp1252"
                    except UnicodeDecodeError:
                        text, name = "", "invalid"
                # Lines end at CR LF, LF and CR only; other separators are text.
                parts = [part.rstrip("\n") for part in io.StringIO(text, newline=None)] or [""]
                yield pd.DataFrame(
                    {"path": row.path, "line_number": range(1, len(parts) + 1), "line": parts, "encoding": name}
                )

    return files.mapInPandas(lines, "path string, line_number int, line string, encoding string").unionByName(large)


# --- fixed values: codes of refusals and notes -----------------------------------
REFUSALS = {"too_large": "FILE_TOO_LARGE", "empty": "FILE_EMPTY", "container": "UNSUPPORTED_FILE_TYPE", "nul_bytes": "UNSUPPORTED_FILE_TYPE"}
NOT_DECODED, NOT_PARSED, TOO_MANY, OTHER_ENCODING = "ENCODING_INVALID", "CSV_PARSE_FAILED", "TOO_MANY_ROWS", "NON_UTF8_ENCODING"
MAX_ROWS = 100_000
# --- end of fixed values ---------------------------------------------------------

AT_ONCE = 10_000  # records of a file in memory as dicts
PARSED = "path string, line int, cells map<string,string>, code string, column_name string"


def parse_file(raw: bytes, required: Sequence[str], max_rows: int) -> Iterator[tuple]:
    """(line, cells, code, column_name) of one bounded file: its records, or why it is refused, and notes."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        try:
            text = raw.decode("cp1252")
        except UnicodeDecodeError:
            yield None, None, NOT_DECODED, None
            return
        yield None, None, OTHER_ENCODING, None
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    header, records, at = None, [], 0
    try:
        for cells in reader:
            if header is None and any(c.strip() for c in cells):
                header = [c.strip() for c in cells]
            elif header is not None and cells:
                if len(cells) > len(header):
                    raise csv.Error("too many fields")
                records.append((at + 1, cells))
            at = reader.line_num
    except csv.Error:
        yield at + 1, None, NOT_PARSED, None
        return
    header = header or []
    faults = [("DUPLICATE_HEADER", c) for c in dict.fromkeys(header) if c and header.count(c) > 1]
    faults += [("MISSING_REQUIRED_COLUMNS", c) for c in required if c not in header]
    if not header or not (faults or records):
        faults = [("FILE_EMPTY", None)]
    elif len(records) > max_rows:
        faults.append((TOO_MANY, None))
    for code, column in faults:
        yield None, None, code, column
    if not faults:
        for line, cells in records:
            yield line, dict(zip(header, cells + [""] * (len(header) - len(cells)), strict=True)), None, None


def parse_files(
    spark: SparkSession, path: str, *, required: Sequence[str] = tuple(S.REQUIRED_COLUMNS), max_bytes: int = MAX_FILE_BYTES, max_rows: int = MAX_ROWS, glob: str = "*.csv"
) -> DataFrame:
    """Records and refusals of many small files, quoted line breaks included, written once."""
    status = triage(spark, path, max_bytes=max_bytes, glob=glob)
    codes = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])
    empty = F.lit(None).cast("map<string,string>")
    refused = status.filter("status <> 'text'").select(
        "path", F.lit(None).cast("int").alias("line"), empty.alias("cells"), codes[F.col("status")].alias("code"), F.lit(None).cast("string").alias("column_name")
    )
    content = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    texts = content.filter(F.col("length") <= max_bytes).join(status.filter("status = 'text'").select("path"), "path", "left_semi").select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for found in batched(parse_file(bytes(row.content), required, max_rows), AT_ONCE):
                    out = pd.DataFrame(list(found), columns=["line", "cells", "code", "column_name"]).assign(path=row.path)
                    yield out.astype({"line": "Int32"})[["path", "line", "cells", "code", "column_name"]]

    return ordering.stable(texts.mapInPandas(parse, PARSED).unionByName(refused))


def ingest_files(spark: SparkSession, path: str, *, max_bytes: int = MAX_FILE_BYTES, max_rows: int = MAX_ROWS, glob: str = "*.csv") -> Intake:
    """One intake job for uploads: triage, decoding, header, row cap, cells, structure.

    Errors carry the file, the line where known, and the column. A file with an error gives no
    rows; the structure of the rest is checked only where no cell is at fault.
    """
    return _intake(parse_files(spark, path, max_bytes=max_bytes, max_rows=max_rows, glob=glob))


def ingest_bulk(spark: SparkSession, path: str, *, max_rows: int | None = None, glob: str = "*.csv") -> Intake:
    """The intake job for files of any size: files are split, quoted line breaks included, and none is read whole."""
    from peerscreen.sources import records

    return _intake(records.read_records(spark, path, max_rows=max_rows, glob=glob))


def _intake(parsed: DataFrame) -> Intake:
    notes = parsed.filter(F.col("code") == OTHER_ENCODING).select("path", "code")
    errors = parsed.filter(F.col("code").isNotNull() & (F.col("code") != OTHER_ENCODING)).select("path", "line", "column_name", "code")
    known = [*S.REQUIRED_COLUMNS, *S.OPTIONAL_NUMERIC, *S.OPTIONAL_TEXT]
    rows = parsed.filter(F.col("cells").isNotNull())
    text = rows.select(F.col("path").alias("file_path"), "line", *[F.coalesce(F.col("cells")[c], F.lit("")).alias(c) for c in dict.fromkeys(known)])
    cells = cell_errors(text, S.REQUIRED_NUMERIC, S.OPTIONAL_NUMERIC).withColumnRenamed("file_path", "path")
    errors = ordering.stable(errors.unionByName(cells.select("path", "line", "column_name", "code")))
    clean = typed(text.join(errors.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti"))
    if errors.isEmpty():
        nowhere = (F.lit(None).cast("string").alias("path"), F.lit(None).cast(parsed.schema["line"].dataType).alias("line"))
        errors = structural_errors(clean).select(*nowhere, "column_name", "code")
    return Intake(clean, errors, notes)


def broken_records(spark: SparkSession, path: str, *, glob: str = "*.csv") -> DataFrame:
    """(path, code) of files with a line whose quotes don't pair up: a quoted line break.

    :func:`read_text` splits files by line and would cut such a record; send them through
    :func:`parse_files`, or, if they are large, ``records.read_records``.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return lines.filter(odd).select(F.col("_metadata.file_path").alias("path"), F.lit(NOT_PARSED).alias("code")).distinct()


def header_names(spark: SparkSession, path: str, *, glob: str = "*.csv") -> DataFrame:
    """(path, position, name) from the first line of every file."""
    text = spark.read.option("pathGlobFilter", glob).text(path)
    # The first line lives in the split that starts at byte 0; other splits stop at the filter.
    first = text.filter(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("_at")
    )
    lines = first.groupBy("path").agg(F.min_by("value", "_at").alias("line"))
    names = F.split(F.regexp_replace("line", "^﻿", ""), ",")
    return lines.select("path", F.posexplode(names)).select(
        "path",
        (F.col("pos") + 1).alias("position"),
        F.trim(F.regexp_replace(F.trim("col"), '^"|"$', "")).alias("name"),
    )


def check_headers(headers: DataFrame, required: Sequence[str] = tuple(S.REQUIRED_COLUMNS)) -> DataFrame:
    """Findings: (path, code, column_name): empty header, duplicate names, missing columns.

    A header is one line, so the groups here are as long as a header.
    """
    per_name = headers.groupBy("path", "name").agg(F.count(F.lit(1)).alias("c"))
    duplicate = per_name.filter((F.col("c") > 1) & (F.col("name") != "")).select(
        "path", F.lit("DUPLICATE_HEADER").alias("code"), F.col("name").alias("column_name")
    )
    paths = headers.select("path").distinct()
    wanted = paths.withColumn("name", F.explode(F.array(*[F.lit(c) for c in required])))
    missing = wanted.join(headers, ["path", "name"], "left_anti").select(
        "path", F.lit("MISSING_REQUIRED_COLUMNS").alias("code"), F.col("name").alias("column_name")
    )
    empty = headers.groupBy("path").agg(F.bool_and(F.col("name") == "").alias("e")).filter("e").select(
        "path", F.lit("FILE_EMPTY").alias("code"), F.lit(None).cast("string").alias("column_name")
    )
    return duplicate.unionByName(missing).unionByName(empty)


def read_text(spark: SparkSession, path: str, *, line_numbers: bool = False, glob: str = "*.csv") -> DataFrame:
    """Every cell as text: leading zeros and the word NA survive. Header names are trimmed.

    Files whose header differs from the first one are refused by the reader.
    ``line_numbers`` adds file_path and line (1-based, the header is line 1).
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("pathGlobFilter", glob)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.option("enforceSchema", False).schema(schema).csv(path)
    if not line_numbers:
        return df.select(*[F.col(f"`{n}`").alias(n.strip()) for n in names])
    df = df.select(
        *[F.col(f"`{n}`").alias(n.strip()) for n in names],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # Rows of one split stay together and in order, so a line is its place in
    # the split plus the rows of earlier splits (one small row per split).
    blocks = df.groupBy("file_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    line = (F.col("_at") - F.col("_first") + F.col("_before") + 2).cast("bigint")
    return df.join(blocks, ["file_path", "_block"]).withColumn("line", line).drop("_block", "_at", "_first", "_before")


def rows_per_file(df: DataFrame, cap: int) -> DataFrame:
    """(file_path, rows, over_cap); needs the file path of :func:`read_text`."""
    return df.groupBy("file_path").agg(F.count(F.lit(1)).alias("rows")).withColumn("over_cap", F.col("rows") > cap)


@dataclass
class Intake:
    """Typed rows and every finding; a non-empty ``errors`` table refuses the input."""

    clean: DataFrame
    errors: DataFrame
    warnings: DataFrame


def cell_errors(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """One row per bad cell: (line if known, column_name, code)."""
    number_like = lambda c: F.lower(F.trim(F.col(c))).rlike(r"^[+-]?(inf|infinity|nan)$")
    hits = []
    for c in required:
        hits.append(F.when(blank(c) | as_number(c).isNull(), F.struct(F.lit(c).alias("column_name"), F.lit("NON_FINITE_VALUE").alias("code"))))
    for c in optional:
        code = F.when(number_like(c), "NON_FINITE_VALUE").otherwise("INVALID_OPTIONAL_FIELD")
        hits.append(F.when(~blank(c) & as_number(c).isNull(), F.struct(F.lit(c).alias("column_name"), code.alias("code"))))
    for c in S.KEY4:
        hits.append(F.when(blank(c), F.struct(F.lit(c).alias("column_name"), F.lit("AMBIGUOUS_COMPONENT_IDENTITY").alias("code"))))
    where = [c for c in ("file_path", "line") if c in df.columns]
    return df.select(*where, F.explode(F.array_compact(F.array(*hits))).alias("e")).select(*where, "e.*")


def typed(df: DataFrame, *, outcome: bool = False) -> DataFrame:
    """Text rows to typed rows; identity stays text, trimmed."""
    numeric = ["hours", "measurement_value"] + ([] if outcome else ["upper_limit"])
    numeric += [c for c in S.OPTIONAL_NUMERIC if c in df.columns]
    text = S.KEY4 + [c for c in S.OPTIONAL_TEXT if c in df.columns]
    return df.withColumns(
        {c: as_number(c) for c in numeric} | {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in text}
    )


def ingest(text: DataFrame) -> Intake:
    """Early file: value errors first; structural findings only if there are none (two-phase gate)."""
    optional = [c for c in S.OPTIONAL_NUMERIC if c in text.columns]
    errors = cell_errors(text, S.REQUIRED_NUMERIC, optional)
    clean = typed(text)
    if errors.isEmpty():
        errors = structural_errors(clean)
    return Intake(clean, errors, _no_warnings(text))


def structural_errors(clean: DataFrame) -> DataFrame:
    """(column_name, code, n) of the checks that need typed rows."""
    found = lambda df, column, code: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(column).alias("column_name"), F.lit(code).alias("code"), "n"
    )
    out = found(quality.bad_hours(clean), "hours", "INVALID_HOURS")
    if "lower_limit" in clean.columns:
        out = out.unionByName(found(quality.crossed_limits(clean), "lower_limit", "INVALID_LIMIT"))
    out = out.unionByName(found(quality.duplicate_readings(clean), "hours", "DUPLICATE_MEASUREMENT_IDENTITY"))
    moved = quality.moving_limits(clean).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(moved.select(F.col("column").alias("column_name"), F.lit("LIMIT_CHANGED_WITHIN_HISTORY").alias("code"), "n"))
    shared = quality.shared_component_ids(clean).select("component_id").distinct()
    return out.unionByName(found(shared, "component_id", "AMBIGUOUS_COMPONENT_IDENTITY")).filter("n > 0")


def ingest_outcomes(text: DataFrame) -> Intake:
    """Outcome file: no limits required; supplied limits are dropped with a warning."""
    missing = [c for c in S.OUTCOME_REQUIRED_COLUMNS if c not in text.columns]
    if missing:
        raise ValueError("The outcome file is missing required columns: " + ", ".join(missing))
    dropped = [c for c in ("upper_limit", "lower_limit") if c in text.columns]
    slim = text.drop(*dropped)
    optional = [c for c in ("temperature_c", "humidity_pct") if c in slim.columns]
    errors = cell_errors(slim, ["hours", "measurement_value"], optional)
    warnings = _no_warnings(text)
    if dropped:
        warnings = text.sparkSession.createDataFrame([("OUTCOME_LIMITS_IGNORED", len(dropped))], warnings.schema)
    return Intake(typed(slim, outcome=True), errors, warnings)


def _no_warnings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "code string, count int")


def promote_numeric(df: DataFrame, skip: Sequence[str] = tuple(S.KEY4)) -> DataFrame:
    """Text columns whose every non-blank cell is a number become double: one pass decides all."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not text:
        return df
    bad = df.agg(*[F.count_if(~blank(c) & as_number(c).isNull()).alias(c) for c in text]).first()
    return df.withColumns({c: as_number(c) for c in text if bad[c] == 0})


def boolean_labels(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Parsed labels, and the rows with a value that is no boolean."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | parse_boolean(c).isNull()
    return df.withColumns({c: parse_boolean(c) for c in columns}), df.filter(bad)
