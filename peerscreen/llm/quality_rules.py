"""Rule-based quality with verdicts on hosts.

Each document gets a few counts and a base verdict. Failures are then added up by host,
the failure rates of small hosts are shrunk to the corpus rate by an empirical beta prior,
and documents of a host whose shrunk rate is too high are rejected with it.

Edge cases: a null or blank text has no words and fails; a null host has no verdict, so
only the base rules count; repeated rows are judged and counted one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from peerscreen.llm.common import clear, let, stored, text_or_empty

# Fixed values of the rules.
SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COUNTS, "base_failed"]
MAX_HOST_RATE = 0.5


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return let(
        F.trim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+", -1)),
    )


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of `size` words that the text has twice or more.

    Windows are compared by hash; only texts with a repeated hash are sorted, and the
    covered words follow from the gaps between the starts of repeated windows.
    """

    def covered(hashes: Column) -> Column:
        numbered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == F.get(s, i)["h"])
        starts = let(
            numbered,
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["i"])),
        )
        return let(
            starts,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.xxhash64(F.slice(tokens, i, size)))
    return F.when(F.size(tokens) < size, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and base_failed; input columns of these names are replaced."""
    t = text_or_empty(text)
    per_text = let(
        words(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    df = clear(docs, *MEASURES, "_per_text")
    df = df.withColumn("_per_text", per_text).withColumns(
        {
            "n_words": F.col("_per_text.n_words"),
            "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
            "n_dup_lines": duplicate_lines(t),
            "n_repeat_words": F.col("_per_text.n_repeat_words"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.drop("_per_text").withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk rate and verdict.

    The beta prior has the corpus rate as its mean; its strength comes from how much the
    hosts' own rates spread around it (method of moments, never under one document).
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    total = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"))
    spread = hosts.crossJoin(F.broadcast(total)).agg(
        F.max("mean").alias("mean"),
        (F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.col("mean"), 2)) / F.sum("n_docs")).alias("var"),
    )
    strength = F.when(F.col("var") > 0, F.greatest(F.lit(1.0), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)).otherwise(F.lit(1.0))
    prior = spread.select("mean", strength.alias("strength"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        hosts.crossJoin(F.broadcast(prior))
        .withColumn("host_rate", rate)
        .select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > max_rate).alias("host_rejected"))
    )


def judge(docs: DataFrame, carry: list[str], text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Columns `carry`, the counts, host_rate and kept, one row per document.

    The counts are computed in one pass and written with the carried columns; the rates
    by host then read two columns of that table, and verdicts return by a join on the host.
    """
    df = clear(docs, "__host").withColumn("__host", F.col(host).cast("string"))
    have = [c for c in carry if c.lower() not in MEASURES]
    rows = stored(measured(df, text).select("__host", *have, *MEASURES), "quality-rules")
    verdicts = host_verdicts(rows, "__host", max_rate).select(F.col("host").alias("__host"), "host_rate", "host_rejected")
    verdicts = stored(verdicts, "host-verdicts")  # its size is known then: rows move only if it is too large to broadcast
    out = clear(rows, "host_rate", "host_rejected", "kept").join(verdicts, "__host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.withColumn("kept", kept).drop("__host", "host_rejected")
