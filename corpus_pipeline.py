"""Corpus pipeline: text operators applied one after the other to ``documents``.

Every stage takes all rows that its predecessor kept, and its decisions take
effect. All stages but the last return the columns of ``documents``, whatever
further columns those are.

Stages: language ID drops the documents it rejects (no letter, or a
cross-entropy far beyond that of training texts); line dedup takes boilerplate
lines out of texts, by source; SimHash keeps one document of each group of near
copies (smallest id); decontamination drops contaminated documents and leaves
the others as they are; byte-level BPE adds n_tokens and ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import byte_bpe, decontaminate, language_id, line_dedup, simhash
from tabsmith.llm.catalog import RANKS
from tabsmith.llm.common import held_out, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; the models learn from two thirds of the labelled ones."""
    model = language_id.fit(docs, ~held_out(F.col("doc_id"), 3, 1))
    return language_id.accepted(spark, docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go from the texts; n_chars follows."""
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return decontaminate.filtered(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids."""
    return byte_bpe.encode(spark, docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_copies), ("decontaminate", benchmark),
          ("byte_bpe", tokens)]

#: SQL cannot express language models, SimHash links or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
