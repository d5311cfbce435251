"""The review loop as tables: queue, verdicts, statistics and what to feed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = ("OK", "FP", "FN")


def enqueue(spans: DataFrame) -> DataFrame:
    """Review items of the spans (doc_id, label, text, start, action) that a person has to see. Ids are
    digests of place and value, so a rerun gives the same ones."""
    key = F.sha2(F.concat_ws("\u0001", "doc_id", "label", "start", "text"), 256)
    return spans.where("action = 'REVIEW'").select(key.alias("id"), "doc_id", "label", "text", "start", F.lit(None).cast("string").alias("verdict"))


def mark(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The queue with newer verdicts (id, verdict) in place; unknown ids and words change nothing."""
    good = verdicts.where(F.col("verdict").isin(*VERDICTS)).groupBy("id").agg(F.max("verdict").alias("newer"))
    return queue.join(good, "id", "left").withColumn("verdict", F.coalesce("newer", "verdict")).drop("newer")


def stats(queue: DataFrame) -> DataFrame:
    """(label, pending, ok, fp, fn)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return queue.groupBy("label").agg(
        F.count_if(F.col("verdict").isNull()).alias("pending"), count("OK").alias("ok"), count("FP").alias("fp"), count("FN").alias("fn")
    )


def feedback(queue: DataFrame, least: int = 2) -> DataFrame:
    """(kind, text): words that were taken for names `least` times or more, and names that were missed."""
    people = queue.where("label = 'PERSON'")
    common = people.where("verdict = 'FP'").groupBy("text").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    missed = people.where("verdict = 'FN'").select("text").distinct()
    return common.select(F.lit("common_word").alias("kind"), "text").union(missed.select(F.lit("name").alias("kind"), "text"))


def agreement(rules_positive, score, threshold: float = 0.5):
    """How rules and a classifier agree on a text."""
    model = score >= threshold
    return (
        F.when(rules_positive & model, "both")
        .when(rules_positive, "rules_only")
        .when(model, "model_only")
        .otherwise("neither")
    )
