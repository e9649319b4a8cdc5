"""Secret scans with a ledger of what has been scanned.

Texts are content-addressed. The ledger holds one row per blob and rule version with the
spans found, so that a run scans each distinct blob that the ledger does not know, once,
however many documents or historical versions carry it; findings are joined back to all
of them.

Edge cases: a null text counts as empty; repeated rows and copies share a blob and get the
same findings, row by row; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peerscreen.llm.common import clear, fresh_path, let, text_or_empty

# Fixed values of the rules: name, quick test, pattern, group with a least length.
RULE_VERSION = "1"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex"]
ASSIGN_LEAST = 6

SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"
MARK = "[SECRET]"
SALTS = 16
MANY = 32


def running(values: Column, join) -> Column:
    """Running totals under `join`, where 0 changes nothing: within parts, then over the parts.

    Parts as long as there are parts keep the copies that appending makes at n * sqrt(n).
    """
    longs = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("at"), longs.alias("out"))
    after = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], join(acc["at"], x)).alias("out"))
    before = lambda acc, x: F.struct(join(acc["at"], F.element_at(x, -1)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def in_parts(v: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(v))).cast("int")
        first = F.sequence(F.lit(1), F.size(v), length)
        return F.transform(first, lambda i: F.aggregate(F.slice(v, i, length), start, after, lambda acc: acc["out"]))

    def over_parts(parts: Column) -> Column:
        heads = F.aggregate(parts, start, before, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, heads, lambda x, h: F.transform(x, lambda e: join(h, e))))

    return F.when(F.size(values) == 0, longs).otherwise(let(values, lambda v: let(in_parts(v), over_parts)))


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Code-point spans of all matches: the pieces between matches give the positions."""

    def positioned(gaps: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda h: F.length(h).cast("long"))
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), lengths, lambda g, h: F.length(g) + h)
        stops = running(steps, lambda a, b: a + b)
        return F.zip_with(stops, lengths, lambda e, h: F.struct((e - h).alias("start"), F.lit(kind).alias("kind"), e.alias("stop")))

    spans = positioned(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    if least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        kept = F.filter(F.arrays_zip(spans.alias("s"), values.alias("v")), lambda x: F.length(x["v"]) >= least)
        spans = F.transform(kept, lambda x: x["s"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed."""
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(F.array().cast(SPAN))
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, ASSIGN_LEAST), access, _spans(text, HEX, 2)))


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"blob string, rule_version string, spans {SPAN}").parquet(path)


def scan(docs: DataFrame, ledger_path: str | None = None, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of `docs` that the ledger lacks for these rules; the ledger afterwards.

    Texts are shuffled once, by blob, with copies merged before the shuffle. A new ledger
    is begun where no path is given. Its rows are only ever appended.
    """
    spark = docs.sparkSession
    body = docs.select(text_or_empty(text).alias("body"))
    blobs = body.groupBy(blob_id(F.col("body")).alias("blob")).agg(F.first("body").alias("body"))
    if ledger_path:
        seen = ledger(spark, ledger_path).where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    path = ledger_path or fresh_path(spark, "secret-ledger")
    found = blobs.select("blob", F.lit(rule_version).alias("rule_version"), spans(F.col("body")).alias("spans"))
    found.write.mode("append").parquet(path)
    return ledger(spark, path).where(F.col("rule_version") == rule_version)


def begin(spark: SparkSession, path: str) -> None:
    """An empty ledger, for a first run against a path of one's own."""
    spark.createDataFrame([], f"blob string, rule_version string, spans {SPAN}").write.parquet(path)


def findings(docs: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: the ledger's findings joined back to every row, by content.

    Only blobs with findings take part, so most rows meet no partner. Runs that were repeated or ran
    at once may have entered a blob twice: it counts once. Copies of one text are dealt over SALTS
    groups by the partition in which they lie.
    """
    df = clear(docs, "_blob", "_salt", "spans").withColumns({"_blob": blob_id(text_or_empty(text)), "_salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    once = entries.where(F.size("spans") > 0).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))
    hits = once.select(F.col("blob").alias("_blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return df.join(hits, ["_blob", "_salt"], "left").drop("_blob", "_salt").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by one mark.

    A substring is found by counting from the text's beginning, so texts of more than MANY spans
    are cut into their characters once instead; the result is the same.
    """
    stops = running(F.transform(found, lambda s: s["stop"]), F.greatest)

    def runs(reached: Column) -> Column:
        """(start, stop) of each run: a span that begins at or beyond all earlier stops opens one."""
        before = lambda i: F.when(i > 0, F.get(reached, i - 1)).otherwise(0)
        opens = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.get(found, i)["start"] >= before(i))

        def closed(o: Column) -> Column:
            last = lambda k: F.coalesce(F.get(o, k + 1), F.size(found)) - 1
            return F.transform(o, lambda i, k: F.struct(F.get(found, i)["start"].cast("int").alias("start"), F.get(reached, last(k)).cast("int").alias("stop")))

        return let(opens, closed)

    def pieces(r: Column, part) -> Column:
        """What lies before each run, and after the last."""
        left = lambda k: F.when(k > 0, F.get(r, k - 1)["stop"]).otherwise(0)
        kept = F.transform(F.sequence(F.lit(0), F.size(r)), lambda k: part(left(k), F.coalesce(F.get(r, k)["start"], F.char_length(text))))
        return F.array_join(kept, MARK)

    def done(r: Column) -> Column:
        few = pieces(r, lambda a, b: F.substring(text, a + 1, b - a))
        many = let(F.split(text, ""), lambda c: pieces(r, lambda a, b: F.array_join(F.slice(c, a + 1, b - a), "")))
        return F.when(F.size(found) > MANY, many).otherwise(few)

    return F.when(F.size(found) == 0, text).otherwise(let(let(stops, runs), done))


def label(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["stop"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
