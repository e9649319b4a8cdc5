"""A corpus from raw documents to tokens, one stage after another.

Every stage gets all rows its predecessor kept and, but for the last, returns the columns of
documents. Between stages the rows are written as Parquet and read again. Columns beyond
those of documents are left behind by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from peerscreen.llm import bpe, decontaminate, jaccard, quality_rules, secrets
from peerscreen.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected."""
    return quality_rules.judge(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars with them."""
    found = secrets.findings(docs, secrets.scan(docs)).withColumn("clean", secrets.redacted(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("clean")).cast("long")
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    df = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), VOCABULARY).drop("text")
    return df.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", redaction),
    ("tokens", tokens),
]

#: Signatures and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
