"""Records of CSV files of any size, with line breaks inside quotes.

Spark cuts a file into splits at line ends, and a line end may lie inside quotes. A first pass
finds for each split how it would end if it began outside quotes and if it began inside; these
answers, chained along a file, tell where every split truly begins. A second pass parses each
split from there. A record that crosses splits leaves a piece in each, and the pieces meet by the
place where it begins. No file is read as a whole, and one record must fit a task.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import batched, chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from peerscreen import schema as S
from peerscreen.operators import ordering
from peerscreen.sources import csv as intake

FIELD_CHARS = 131_072  # longest field, the csv module's own default
AT_ONCE = 5_000  # records of a split in memory before they leave Python
BROADCAST_BYTES = 64 << 20

CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
OPENING = re.compile(r'[,\r]"')
#: Bytes that Windows-1252 leaves undefined, and those it reads otherwise than ISO-8859-1.
UNDEFINED = [b for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore")]
MOVED = [b for b in range(0x80, 0xA0) if b not in UNDEFINED]

FOUND = "split bigint, line bigint, kind string, cells array<string>, piece string, closes boolean"
FOUND_ARROW = pa.schema(
    [("split", pa.int64()), ("line", pa.int64()), ("kind", pa.string()), ("cells", pa.list_(pa.string())), ("piece", pa.string()), ("closes", pa.bool_())]
)


def ends_inside(line: str, inside: bool) -> tuple[bool, bool]:
    """Does the line end inside quotes, and was a quoted field closed in it?"""
    at, closed = 0, False
    if not inside and line.startswith('"'):
        at, inside = 1, True
    while True:
        if inside:
            closing = CLOSING.match(line, at)
            if closing is None:
                return True, closed
            at, closed = closing.end(), True
        opening = OPENING.search(line, at)
        if opening is None:
            return False, closed
        at, inside = opening.end(), True


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, from_outside, from_inside): the state at the end of a split for either state at its begin."""
    rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("path", "block", "value")), strict=True) for b in batches)
    for (path, block), run in groupby(rows, key=itemgetter(0, 1)):
        outside, inside = False, True
        for _, _, line in run:
            same = outside == inside
            outside = ends_inside(line, outside)[0]
            inside = outside if same else ends_inside(line, inside)[0]
        yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "from_outside": [outside], "from_inside": [inside]})


def _physical(lines: Iterable[str]) -> Iterator[str]:
    """Lines with their ends; a CR alone ends one too."""
    for line in lines:
        if "\r" in line:
            yield from io.StringIO(line + "\n", newline="")
        else:
            yield line + "\n"


class _Since:
    """Hands lines on and remembers those since the last record."""

    def __init__(self, lines: Iterator[str]):
        self.lines, self.kept, self.ended = lines, [], False

    def __iter__(self):
        return self

    def __next__(self) -> str:
        try:
            line = next(self.lines)
        except StopIteration:
            self.ended = True
            raise
        self.kept.append(line)
        return line


def _parsed(lines: Iterator[str], before: int, last: bool) -> Iterator[tuple]:
    """(line, kind, cells, piece, closes) of lines that begin outside quotes.

    Kinds: "first" (the first record with a cell that isn't blank), "record", "error", and, unless these
    are the ``last`` lines of a record's pieces, "begins": lines of a record that goes on in the next split.
    """
    since = _Since(lines)
    reader, at, seen = csv.reader(since, strict=True), 0, False
    while True:
        try:
            cells = next(reader)
        except StopIteration:
            return
        except csv.Error:
            if since.ended and not last:
                yield before + at + 1, "begins", None, "".join(since.kept), False
            else:
                yield before + at + 1, "error", None, None, False
            return
        if cells:
            first = not seen and any(c.strip() for c in cells)
            seen = seen or first
            yield before + at + 1, "first" if first else "record", cells, None, False
        at = reader.line_num
        since.kept.clear()


def _of_split(split: int, run: Iterator[tuple]) -> Iterator[tuple]:
    first = next(run)
    _, inside, before, _ = first
    values = (row[3] for row in chain([first], run))
    if inside:
        piece, field, closes = [], 0, False
        for line in values:
            # A field that is too long already fails, whatever follows in it.
            if field <= FIELD_CHARS:
                piece.append(line + "\n")
            before += sum(1 for _ in _physical([line]))
            inside, closed = ends_inside(line, True)
            closes = closes or closed
            field = len(line) + 1 + (0 if closed else field)
            if not inside:
                break
        yield split, None, "goes on", None, "".join(piece), closes
    if not inside:
        for found in _parsed(_physical(values), before, last=False):
            yield split, *found


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(FIELD_CHARS)
    names = ("split", "inside", "before", "value")
    rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in names), strict=True) for b in batches)
    found = chain.from_iterable(_of_split(split, run) for split, run in groupby(rows, key=itemgetter(0)))
    for part in batched(found, AT_ONCE):
        yield _batch(part)


def _parse_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(FIELD_CHARS)
    for batch in batches:
        for split, line, text in zip(*(batch.column(c).to_pylist() for c in ("split", "line", "piece")), strict=True):
            # The line number is already that of the file.
            found = [(split, *r) for r in _parsed(iter(io.StringIO(text, newline="")), line - 1, last=True)]
            if found:
                yield _batch(found)


@contextmanager
def _same_splits(spark: SparkSession):
    """Both passes must cut the files alike, also if executors come or go between them."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _windows(value: Column) -> Column:
    """The bytes of a string read as Windows-1252."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, MOVED)), bytes(MOVED).decode("cp1252"))


def splits(lines: DataFrame) -> DataFrame:
    """One row per split: (split, path, block, encoding, inside, before), where its records begin and on which line.

    ``encoding`` is that of the whole file: utf-8, cp1252 or invalid.
    """
    value, cr = F.col("value"), F.lit("\r")
    inner = F.when(F.contains(value, cr), F.length(value) - F.length(F.replace(value, cr, F.lit(""))) - F.endswith(value, cr).cast("int")).otherwise(0)
    utf8 = F.is_valid_utf8(value)
    undefined = F.decode(value.cast("binary"), "ISO-8859-1").rlike("[" + "".join(f"\\x{b:02x}" for b in UNDEFINED) + "]")
    facts = lines.groupBy("path", "block").agg(
        F.sum(inner + 1).alias("lines"), F.bool_and(utf8).alias("utf8"), F.bool_or(F.when(utf8, False).otherwise(undefined)).alias("undefined")
    )
    # Bytes that are no UTF-8 don't matter here: quotes, commas and line ends are ASCII.
    quoted = lines.filter(F.contains(value, F.lit('"'))).withColumn("value", F.decode(value.cast("binary"), "ISO-8859-1"))
    turns = quoted.mapInArrow(_turns, "path string, block bigint, from_outside boolean, from_inside boolean")
    along = Window.partitionBy("path").orderBy("block")
    earlier, here, file = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("path")
    # Four kinds of split: one that keeps the state, one that flips it, and two that set it.
    sets = F.col("from_outside") == F.col("from_inside")
    chained = facts.join(turns, ["path", "block"], "left").withColumns(
        {"_sets": F.coalesce(sets, F.lit(False)), "_flips": F.coalesce(F.col("from_outside") & ~F.col("from_inside"), F.lit(False)).cast("int")}
    )
    chained = chained.withColumn("_n", F.sum("_flips").over(here))
    chained = chained.withColumn("_set", F.last(F.when(F.col("_sets"), F.struct(F.col("from_outside").cast("int").alias("to"), F.col("_n").alias("n"))), True).over(earlier))
    flips = F.coalesce(F.sum("_flips").over(earlier), F.lit(0)) - F.coalesce(F.col("_set.n"), F.lit(0))
    encoding = F.when(F.min("utf8").over(file), "utf-8").when(F.max("undefined").over(file), "invalid").otherwise("cp1252")
    return chained.select(
        "path",
        "block",
        encoding.alias("encoding"),
        ((F.coalesce(F.col("_set.to"), F.lit(0)) + flips) % 2 == 1).alias("inside"),
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"),
    ).withColumn("split", F.monotonically_increasing_id())


def _small(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size + 64).alias("bytes")).first()["bytes"] or 0) <= BROADCAST_BYTES


def _attach(rows: DataFrame, facts: DataFrame, keys: list[str], small: bool, how: str = "left") -> DataFrame:
    """Facts of files or splits to their rows: by broadcast within BROADCAST_BYTES, else over salted keys."""
    return rows.join(F.broadcast(facts), keys, how) if small else ordering.salted_join(rows, facts, keys, how)


def _crossing(found: DataFrame, small: bool, places: DataFrame) -> DataFrame:
    """Records whose pieces lie in several splits, parsed."""
    pieces = _attach(found.filter("kind in ('begins', 'goes on', 'error')").drop("cells"), places, ["split"], small)
    rank = F.when(F.col("kind") == "goes on", 0).otherwise(1)
    along = Window.partitionBy("path").orderBy("block", rank).rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("kind") != "goes on", F.struct("split", "line", "kind", "before")), True).over(along)
    pieces = pieces.withColumn("_start", start).filter("_start.kind = 'begins'").select(
        F.col("_start.split").alias("split"), F.col("_start.line").alias("line"), "block", "closes", "piece", "path"
    )
    # Pieces of one field beyond the longest that may be: it fails with those before them.
    record = Window.partitionBy("path", "split").orderBy("block")
    pieces = pieces.withColumn("_run", F.sum(F.col("closes").cast("int")).over(record.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("path", "split", "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_sealed", F.coalesce(F.sum(F.length("piece")).over(run), F.lit(0)))
    kept = pieces.filter(F.col("closes") | (F.col("_sealed") <= 2 * FIELD_CHARS))
    whole = kept.groupBy("split", "line").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("_p"))
    return whole.select("split", "line", F.array_join("_p.piece", "").alias("piece")).mapInArrow(_parse_whole, FOUND)


def read_records(
    spark: SparkSession, path: str, *, required: Sequence[str] = tuple(S.REQUIRED_COLUMNS), max_rows: int | None = None, glob: str = "*.csv"
) -> DataFrame:
    """Records and refusals of files of any size: (path, line, cells, code, column_name), written once.

    The rows are those of :func:`csv.parse_files`, for splittable files and without its bounds: a record
    with its line, or the reason why a file is refused, or a note on its encoding. Rows of refused files
    are left out. A file of zero bytes has no row here (``csv.triage`` lists it); lines that end in CR
    alone don't split a file. A byte order mark is no part of a header.
    """
    with _same_splits(spark):
        lines = _lines(spark, path, glob)
        states = ordering.stable(splits(lines))
        small = _small(states, F.length("path"))
        usable = states.filter("encoding <> 'invalid'")
        if small:
            text = lines.join(F.broadcast(usable), ["path", "block"])
        else:  # the rows move, so that their order has to be found again
            text = lines.withColumn("_at", F.monotonically_increasing_id()).join(usable, ["path", "block"])
            text = text.sortWithinPartitions("split", "_at")
        value = F.when(F.col("encoding") == "utf-8", F.col("value")).otherwise(_windows(F.col("value")))
        found = ordering.stable(text.select("split", "inside", "before", value.alias("value")).mapInArrow(_parse, FOUND))
    places = states.select("split", "path", "block", "before")
    rows = found.filter("kind in ('first', 'record', 'error')").unionByName(_crossing(found, small, places))
    rows = _attach(rows.drop("piece", "closes"), states.select("split", "path"), ["split"], small).drop("split")
    return ordering.stable(_checked(rows, states, required, max_rows))


def _stripped(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _checked(rows: DataFrame, states: DataFrame, required: Sequence[str], max_rows: int | None) -> DataFrame:
    """Headers, widths and counts: what is wrong with a file, and the records of the others by column name."""
    heads = rows.filter("kind = 'first'").groupBy("path").agg(F.min(F.struct("line", "cells")).alias("h"))
    heads = ordering.stable(heads.select("path", F.col("h.line").alias("_head"), F.transform("h.cells", _stripped).alias("_names")))
    small = _small(heads, F.length("path") + F.length(F.array_join("_names", ",")))
    rows = _attach(rows, heads, ["path"], small)
    wide = F.coalesce(F.size("cells") > F.size("_names"), F.lit(False))
    data = (F.col("kind") != "error") & (F.col("line") > F.col("_head"))
    fault = F.when(F.col("kind") == "error", F.col("line")).when(data & wide, F.col("line"))
    per_file = rows.groupBy("path").agg(F.min(fault).alias("fault"), F.count_if(data).alias("records"), F.bool_or(F.col("_head").isNotNull()).alias("headed"))

    files = states.groupBy("path").agg(F.first("encoding").alias("encoding"))
    files = ordering.stable(files.join(per_file, "path", "left"))
    no_line, no_name = F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("string").alias("column_name")
    refusal = lambda df, code, line=no_line, name=no_name: df.select("path", line, F.lit(code).alias("code"), name)
    decoded = files.filter("encoding <> 'invalid'")
    parsed = decoded.filter("fault is null")
    headers = heads.join(parsed, "path", "left_semi").select("path", F.posexplode("_names").alias("position", "name"))
    faults = intake.check_headers(headers, required).select("path", no_line, "code", "column_name")
    hollow = parsed.filter("not coalesce(headed, false) or coalesce(records, 0) = 0").join(faults.select("path").distinct(), "path", "left_anti")
    refused = (
        refusal(files.filter("encoding = 'invalid'"), intake.NOT_DECODED)
        .unionByName(refusal(decoded.filter("fault is not null"), intake.NOT_PARSED, F.col("fault").alias("line")))
        .unionByName(faults)
        .unionByName(refusal(hollow, "FILE_EMPTY"))
    )
    if max_rows is not None:
        refused = refused.unionByName(refusal(parsed.filter(F.col("records") > max_rows), intake.TOO_MANY))
    refused = ordering.stable(refused)
    # Of columns with one name (only blank names get here) the last counts.
    places = F.sequence(F.lit(0), F.size("_names") - 1)
    last = F.filter(places, lambda i: ~F.array_contains(F.slice("_names", i + 2, F.size("_names")), F.get("_names", i)))
    cells = F.map_from_arrays(F.transform(last, lambda i: F.get("_names", i)), F.transform(last, lambda i: F.coalesce(F.get("cells", i), F.lit(""))))
    bad = refused.select("path").distinct()
    good = rows.filter(data).join(F.broadcast(bad) if _small(bad, F.length("path")) else bad, "path", "left_anti")
    notes = refusal(files.filter("encoding = 'cp1252'"), intake.OTHER_ENCODING)
    empty = F.lit(None).cast("map<string,string>").alias("cells")
    told = refused.unionByName(notes).select("path", "line", empty, "code", "column_name")
    return good.select("path", "line", cells.alias("cells"), F.lit(None).cast("string").alias("code"), no_name).unionByName(told)
