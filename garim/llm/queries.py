"""The registered queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from garim.llm import alignment, bpe, decontaminate, html_text, licenses, manifest, quality, secrets, simhash, substrings, token_files, toxicity, warc
from garim.llm.shared import table

#: The vocabulary that op6 and the pipeline encode with.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The two that op13 aligns.
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rate(docs, quality.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op3(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op6(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op7(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op8(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op10(table(spark, sf_dir, "pages"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.op11(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op12(table(spark, sf_dir, "documents"), VOCABULARY)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op13(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def queries() -> dict[str, Query]:
    every = (
        op1_quality, op2_secrets, op3_substrings, op4_decontamination, op5_toxicity, op6_bpe, op7_warc,
        op8_licenses, op9_simhash, op10_html_text, op11_manifest, op12_token_files, op13_alignment,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secrets.oracle(), "op3_substrings": substrings.ORACLE, "op7_warc": warc.ORACLE, "op8_licenses": licenses.oracle(),
        "op11_manifest": manifest.ORACLE,
    }
