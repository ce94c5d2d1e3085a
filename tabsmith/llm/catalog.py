"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import brown_lm, byte_bpe, decontaminate, divergence, fill_middle, html_extract, language_id, line_dedup, packing, secrets, simhash, sketch, toxicity
from tabsmith.llm.common import held_out, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: ~held_out(doc_id, 5, 0))
    return toxicity.scored(spark, docs, model, ["doc_id", "held_out"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by source; lines beyond the boilerplate ratio go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.counted(docs).toDF("doc_id", "source", "text", "n_lines", "n_dropped")


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    model, rest = brown_lm.fit(docs, ~F.col("held_out"))
    return brown_lm.scored(spark, docs, model, rest, ["doc_id", "held_out"])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(spark, table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN,
                           keep=["doc_id"], digests=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = language_id.fit(docs, ~F.col("held_out"))
    return language_id.identified(spark, docs, model, ["doc_id", "held_out"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_report(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(spark, table(spark, sf_dir, "documents"), WORDS)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_brown_lm": op3_brown_lm,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_extract": op5_html_extract,
    "op6_decontaminate": op6_decontaminate,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_fingerprints": op10_fingerprints,
    "op11_divergence": op11_divergence,
    "op12_packing": op12_packing,
    "op13_fill_middle": op13_fill_middle,
}
