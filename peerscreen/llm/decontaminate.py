"""Benchmark decontamination by winnowing.

Documents and items are cut into k-grams of words. In every window of w consecutive k-gram
hashes the smallest is kept, so two texts that share n = k + w - 1 words keep the same k-gram
of the shared words. Fingerprints of documents meet those of the items in a join, and each hit
is extended word by word to the windows of n item words that really occur. Items shorter than a
window count as one window and are met by a join of their own on all word runs of that length.

Documents are cut and hashed once. Of their fingerprints only those leave the task that an item has
too: as long as the items have at most FILTER fingerprints of FILTER_BYTES in all (checked), their
hashes are tested in place, which costs less than finding minima first, and the few places left are
then held against the minima of their windows; the items' side of the join is broadcast. Beyond that
bound all fingerprints meet in a shuffled join. Both ways give the same hits. A fingerprint carries
the few words around it that an extension can reach. Hits come back to documents by row number.

Edge cases: a null or empty text has no words, no hits; a null id stays null; repeated documents
each get their row; items of equal words are matched once and all reported; an item without words
never occurs; an empty table of documents or items gives no rows or no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from peerscreen.llm.common import let, stored, text_or_empty

# Fixed values of the word rule.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
GRAM = 5
FILTER = 50_000
FILTER_BYTES = 16_000_000
SALTS = 16


def words(text: Column) -> Column:
    """Words after lower-casing A-Z alone; the quick lower() serves where a text is ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def cut(text: Column, body) -> Column:
    """body(words): the pieces of a split are words but for an empty first or last one."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))

    def trimmed(p: Column) -> Column:
        first = (F.get(p, F.lit(0)) == "").cast("int")
        last = ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int")
        return F.slice(p, first + 1, F.size(p) - first - last)

    return let(F.split(low, SEPARATORS, -1), lambda p: let(trimmed(p), body))


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def gram_at(hashes: Column, i: Column, size: int) -> Column:
    """Hash of the `size` words from place i on."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])


def grams(hashes: Column, size: int) -> Column:
    """Hash of each run of `size` words; empty where the text is shorter."""
    return F.transform(places(hashes, size), lambda i: gram_at(hashes, i, size))


def places(hashes: Column, size: int) -> Column:
    """0-based places at which runs of `size` words begin."""
    n = F.size(hashes)
    return F.when(n < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - size))


def fingerprints(tokens: Column, size: int = WINDOW, gram: int = GRAM) -> Column:
    """array<struct<h, at, left, near>>: kept k-grams, 0-based place, and the words within reach.

    near holds up to size - gram words on either side, `left` of them before the k-gram.
    A k-gram is kept if it is the smallest of any window it lies in; equal smallest ones all stay.
    """
    span = size - gram + 1

    def kept(h: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda j: F.array_min(F.slice(h, j, span)))

        def chosen(m: Column) -> Column:
            first = lambda i: F.greatest(i - (span - 2), F.lit(1))
            numbered = F.transform(h, lambda x, i: F.when(x == F.array_max(F.slice(m, first(i), i + 2 - first(i))), i))
            return F.array_compact(numbered)

        return F.transform(let(least, chosen), lambda i: described(tokens, F.get(h, i), i, size, gram))

    return F.when(F.size(tokens) < size, F.array().cast(MARKS)).otherwise(let(let(hashed(tokens), lambda x: grams(x, gram)), kept))


MARKS = "array<struct<h:bigint,at:int,left:int,near:array<string>>>"


def described(tokens: Column, h: Column, i: Column, size: int, gram: int) -> Column:
    reach = size - gram
    left = F.least(i, F.lit(reach))
    return F.struct(h.alias("h"), i.alias("at"), left.alias("left"), F.slice(tokens, i - left + 1, left + gram + reach).alias("near"))


def shared_fingerprints(tokens: Column, hashes: Column, known: list[int], size: int, gram: int) -> Column:
    """Those of fingerprints(tokens) whose hash is known: places are tested first, minima after."""
    span = size - gram + 1

    def is_least(i: Column) -> Column:
        last = F.size(hashes) - gram  # the last place
        around = F.transform(F.sequence(F.greatest(i - (span - 1), F.lit(0)), F.least(i + (span - 1), last)), lambda j: gram_at(hashes, j, gram))
        starts = lambda g: F.sequence(F.lit(1), F.size(g) - (span - 1))
        return let(around, lambda g: F.exists(starts(g), lambda j: F.array_min(F.slice(g, j, span)) == gram_at(hashes, i, gram)))

    met = F.filter(places(hashes, gram), lambda i: gram_at(hashes, i, gram).isin(known))
    marks = F.transform(F.filter(met, is_least), lambda i: described(tokens, gram_at(hashes, i, gram), i, size, gram))
    return F.when(F.size(tokens) < size, F.array().cast(MARKS)).otherwise(marks)


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Items with words, merged by equal words: class, words, item_ids."""
    df = items.select(F.col(item_id).alias("item_id"), words(text_or_empty(text)).alias("words")).where(F.size("words") > 0)
    return df.groupBy("words").agg(F.collect_list("item_id").alias("item_ids")).withColumn("class", F.sha2(F.array_join("words", " "), 256))


@dataclass
class Sought:
    """The items as documents meet them."""

    long: DataFrame  # class, h, item_left, item_near
    short: DataFrame  # class, item_words, h, n
    lengths: list[int]  # of short items, under the window
    known: dict[int, list[int]] | None  # hashes by run length (the k-gram for long items), if few


def sought(classes: DataFrame, size: int, gram: int) -> Sought:
    long = classes.where(F.size("words") >= size).select("class", F.inline(fingerprints(F.col("words"), size, gram)))
    long = stored(long.select("class", "h", F.col("left").alias("item_left"), F.col("near").alias("item_near")).distinct(), "item-fingerprints")
    short = classes.where(F.size("words") < size)
    lengths = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())  # under `size` values
    runs = None
    for n in lengths:
        one = short.where(F.size("words") == n).select("class", F.col("words").alias("item_words"), gram_at(hashed(F.col("words")), F.lit(0), n).alias("h"), F.lit(n).alias("n"))
        runs = one if runs is None else runs.unionByName(one)
    kept = long.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("item_near", " "))), F.lit(0)).alias("bytes")).first()
    few = short.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0)).alias("bytes")).first()
    known = None
    if kept["rows"] + few["rows"] <= FILTER and kept["bytes"] + few["bytes"] <= FILTER_BYTES:
        known = {0: [r["h"] for r in long.select("h").distinct().collect()]}  # at most FILTER hashes
        for n in lengths:
            known[n] = [r["h"] for r in runs.where(F.col("n") == n).select("h").distinct().collect()]
    return Sought(long, runs, lengths, known)


def marked(words_: Column, hashes: Column, items: Sought, size: int, gram: int) -> Column:
    """struct<long, short>: fingerprints of a text that may meet an item, and its runs as long as short items."""
    long = fingerprints(words_, size, gram) if items.known is None else shared_fingerprints(words_, hashes, items.known[0], size, gram)
    runs = F.array().cast("array<struct<h:bigint,at:int,n:int,run:array<string>>>")
    for n in items.lengths:
        at = places(hashes, n)
        if items.known is not None:
            at = F.filter(at, lambda i: gram_at(hashes, i, n).isin(items.known[n]))  # noqa: B023
        run = lambda i: F.struct(gram_at(hashes, i, n).alias("h"), i.alias("at"), F.lit(n).alias("n"), F.slice(words_, i + 1, n).alias("run"))  # noqa: E731, B023
        runs = F.concat(runs, F.transform(at, run))
    return F.struct(F.size(words_).cast("long").alias("n_words"), long.alias("long"), runs.alias("short"))


def read(docs: DataFrame, text: Column, carry: list[Column], items: Sought, size: int, gram: int) -> DataFrame:
    """`carry`, key (the row's number) and marks of every document, written: the only pass over the texts."""
    marks = cut(text, lambda w: let(hashed(w), lambda h: marked(w, h, items, size, gram)))
    return stored(docs.select(*carry, marks.alias("marks")).withColumn("key", F.monotonically_increasing_id()), "marks")


def hits(marks: DataFrame, items: Sought, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(document key, class, windows) of every window that occurs; windows are arrays of start and n."""
    side = F.broadcast if items.known is not None else lambda df: df  # bounded by FILTER and FILTER_BYTES

    def occurs(s: Column) -> Column:
        own, other = F.slice("near", F.col("left") - s + 1, size), F.slice("item_near", F.col("item_left") - s + 1, size)
        return (F.col("left") >= s) & (F.col("item_left") >= s) & (F.size(own) == size) & (own == other)

    printed = marks.select("key", F.inline("marks.long"))
    starts = F.filter(F.sequence(F.lit(0), F.least("left", "item_left")), occurs)
    met = printed.join(side(items.long), "h").select("key", "class", "at", starts.alias("before")).where(F.size("before") > 0)
    found = met.select("key", "class", F.transform("before", lambda s: F.struct((F.col("at") - s).alias("start"), F.lit(size).alias("n"))).alias("windows"))
    if items.lengths:
        runs = marks.select("key", F.inline("marks.short")).join(side(items.short), ["h", "n"]).where(F.col("run") == F.col("item_words"))
        found = found.unionByName(runs.select("key", "class", F.array(F.struct(F.col("at").alias("start"), F.col("n").alias("n"))).alias("windows")))
    return found


def covered(windows: Column) -> Column:
    """Words in the union of windows (start, n), which come sorted."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, w: F.struct(
        F.greatest(acc["end"], w["start"] + w["n"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), w["start"] + w["n"] - F.greatest(acc["end"], w["start"]))).alias("total"),
    )
    return F.aggregate(windows, start, step, lambda acc: acc["total"])


ADDED = ["n_words", "n_hit", "item_ids", "windows", "contaminated"]


def decontaminated(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Columns `carry` with n_words, n_hit, item_ids (sorted), windows (start, n) and contaminated."""
    classes = item_classes(items)
    have = [c for c in carry if c.lower() not in ADDED]
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(have)]
    seek = sought(classes, size, gram)
    marks = read(docs, text_or_empty(text), own, seek, size, gram)
    found = hits(marks, seek, size, gram)
    by_class = found.groupBy("key", "class").agg(F.array_distinct(F.flatten(F.collect_set("windows"))).alias("windows"))
    per_text = by_class.join(classes.select("class", "item_ids"), "class").groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"),
        F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
    )
    base = marks.select("key", F.col("marks.n_words").alias("n_words"), *[f"_c{i}" for i in range(len(have))])
    out = base.join(per_text, "key", "left").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(have)], "n_words", "windows", "item_ids")
    return out.withColumns(
        {
            "n_hit": F.coalesce(covered(F.col("windows")), F.lit(0).cast("long")),
            "item_ids": F.coalesce("item_ids", F.array().cast(classes.schema["item_ids"].dataType)),
            "windows": F.coalesce("windows", F.array().cast("array<struct<start:int,n:int>>")),
        }
    ).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs without those in which a window of an item occurs.

    Documents meet the contaminated texts by 128 bits of content; copies of one text, however many,
    are dealt over SALTS groups by the partition in which they lie.
    """
    t = text_or_empty(text)
    seek = sought(item_classes(items), size, gram)
    marks = read(docs, t, [F.md5(t).alias("content")], seek, size, gram)
    keys = hits(marks, seek, size, gram).select("key").distinct()
    texts = stored(marks.select("key", "content").join(keys, "key", "left_semi").select(F.col("content").alias("__content")).distinct(), "contaminated")
    salted = texts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = docs.withColumns({"__content": F.md5(t), "__salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    return named.join(salted, ["__content", "__salt"], "left_anti").drop("__content", "__salt")
