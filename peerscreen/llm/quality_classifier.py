"""Quality by a document classifier and what its site says.

A logistic regression over a few shape features gives each document's evidence. Sites
are then taken into account by hierarchical empirical Bayes: the evidence is averaged by host
and by path within the host, a host's mean is shrunk towards the corpus mean and a path's
towards its host's, the more the fewer documents it has, with strengths estimated from the
spread between hosts and between paths. A document's own evidence is left out of its site's
mean, and both are combined on the log-odds scale.

Edge cases: null and blank texts have features of zero and are scored; a null host or path is a
site of its own; null labels or ids aren't learnt from, repeated labels count once (good if any
says so); without labels of both kinds the evidence is their share; repeated rows are scored
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from peerscreen.llm.common import clear, let, stored, text_or_empty
from peerscreen.llm.quality_rules import words

FEATURES = ["log_words", "word_length", "distinct", "symbols", "upper", "stops", "repeats"]
CLIP = 0.001
WEIGHT = 0.5  # of the site's log-odds against the document's own


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shapes(text: Column) -> Column:
    """Struct of FEATURES."""
    size = F.greatest(F.length(text), F.lit(1))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / size

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: (a == b).cast("int"))
        return F.struct(
            F.log1p(F.size(w).cast("double")).alias("log_words"),
            (F.length(text) / n).cast("double").alias("word_length"),
            (F.size(F.array_distinct(w)) / n).alias("distinct"),
            (F.size(F.array_remove(pairs, 0)) / n).alias("repeats"),
        )

    def joined(s: Column) -> Column:
        marks = {"symbols": kept(r"[^#*$%&|<>!]+"), "upper": kept(r"[^A-Z]+"), "stops": kept(r"[^.,;:?]+")}
        return F.struct(*[(marks[f] if f in marks else s[f]).cast("double").alias(f) for f in FEATURES])

    return let(let(words(text), of_words), joined)


def evidence(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with p, the classifier's probability of good quality; rows are written once."""
    rows = stored(clear(docs, "p", *FEATURES, "_f").withColumn("_f", shapes(text_or_empty(text))).drop(text), "shapes")
    rows = rows.select("*", "_f.*").drop("_f")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("label"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    sample = ready.join(known, "doc_id").select("_x", "label")
    seen = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < seen[1] < seen[0]:
        return rows.drop(*FEATURES).withColumn("p", F.lit((seen[1] + 0.5) / (seen[0] + 1.0)))
    model = LogisticRegression(featuresCol="_x", labelCol="label", probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r", regParam=1e-4, maxIter=40).fit(sample)
    out = model.transform(ready).withColumn("p", vector_to_array("_p")[1])
    return out.drop("_x", "_p", "_y", "_r", *FEATURES)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, total: Column, n: Column, mean: Column) -> Column:
    """Documents' worth of prior, as a column of an aggregate: within-spread over between-spread, at least one."""
    rate = total / n
    between = F.sum(n * F.pow(rate - mean, 2)) / F.sum(n)
    within = F.sum(n * mean * (1 - mean)) / F.sum(n)
    return F.when(between > 0, F.greatest(F.lit(1.0), within / between - 1)).otherwise(F.lit(1.0))


def site_posteriors(rows: DataFrame) -> DataFrame:
    """Per (host, path): sums, the host's sums, the corpus mean and both prior strengths.

    rows has host, path and p. Only sums by path are shuffled; hosts follow from their paths.
    """
    paths = stored(rows.groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count(F.lit(1)).alias("path_n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    mean = hosts.agg((F.sum("host_sum") / F.sum("host_n")).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(mean))
    strong = hosts.agg(_strength(hosts, F.col("host_sum"), F.col("host_n"), F.col("mean")).alias("host_strength"))
    hosts = stored(hosts.crossJoin(F.broadcast(strong)), "hosts")
    same = paths.host.eqNullSafe(hosts.host)
    sites = paths.join(hosts, same).drop(hosts.host)
    host_mean = (F.col("host_sum") + F.col("mean") * F.col("host_strength")) / (F.col("host_n") + F.col("host_strength"))
    sites = sites.withColumn("host_mean", host_mean)
    weak = sites.agg(_strength(sites, F.col("path_sum"), F.col("path_n"), F.col("host_mean")).alias("path_strength"))
    return sites.drop("host_mean").crossJoin(F.broadcast(weak))


def combined(rows: DataFrame) -> DataFrame:
    """rows (host, path, p, ...) with site and score: own evidence moved by what the rest of the site says."""
    sites = stored(site_posteriors(rows), "sites")
    cols = [c for c in sites.columns if c not in ("host", "path")]
    named = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *cols)
    base = clear(rows, *cols, "site", "score")
    out = base.join(named, base.host.eqNullSafe(F.col("_host")) & base.path.eqNullSafe(F.col("_path")), "left")
    host = (F.col("host_sum") - F.col("p") + F.col("mean") * F.col("host_strength")) / (F.col("host_n") - 1 + F.col("host_strength"))
    path = (F.col("path_sum") - F.col("p") + host * F.col("path_strength")) / (F.col("path_n") - 1 + F.col("path_strength"))
    clipped = lambda p: F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    odds = logit(clipped(F.col("p"))) + WEIGHT * (logit(clipped(F.col("site"))) - logit(clipped(F.col("mean"))))
    return out.withColumn("site", path).withColumn("score", 1 / (1 + F.exp(-odds))).drop(*cols, "_host", "_path")


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `carry` with p (the text's evidence), site (its site's posterior) and score."""
    rows = docs.select(*carry, F.col("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    return combined(evidence(rows, labels)).select(*carry, "p", "site", "score")
