"""A training-corpus pipeline: each stage reads what its predecessor kept.

quality (1) -> near_duplicates (9) -> decontamination (4) -> secrets (2) -> encoding (6)

Rows without a doc_id pass all stages but those that their own text fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garim.llm import bpe, decontaminate, jaccard, quality, secrets
from garim.llm.queries import VOCABULARY
from garim.llm.shared import discard, saved, table

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or that the classifier scores below its threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs.select(*DOCUMENTS), model).where("kept").select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that of the smallest
    doc_id. Operator 9 links those within its radius; MinHash bands those of this similarity beyond it."""
    return jaccard.keep_one(docs).select(*DOCUMENTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold at least the threshold share of a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENTS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. All documents stay."""
    found = secrets.with_secrets(docs.select(*DOCUMENTS))
    found = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets")))
    return found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; an empty text has none."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: A trained classifier, hash fingerprints, tilings and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
