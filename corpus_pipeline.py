"""A corpus from documents to packed sequences, stage by stage.

Each stage works on all that the one before it kept. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelink.llm import decontamination, language, packing, similarity, toxicity
from tablelink.llm.queries import tokenizer_text
from tablelink.llm.shared import held_out, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model rejects go: without a letter, or of a score that
    next to none of the rightly known ones has."""
    rows = language.training_rows(docs, ~held_out(F.col("doc_id")), "doc_id", "text", "lang")
    made = language.identify_languages(docs, language.train(rows))
    return made.where(~F.col("language.rejected")).select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of a half or more go."""
    rows, share = toxicity.training_rows(
        docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")), "doc_id", "text", "toxic"
    )
    scored = toxicity.score_toxicity(docs, toxicity.train(rows, share))
    return scored.where(F.col("toxicity") < 0.5).select(docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return similarity.drop_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose the words that benchmark items hit, and go if no word
    is left."""
    matched = decontamination.match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    cut = decontamination.remove_spans(matched.withColumn("_whole", F.length("text")))
    n_chars = F.when(F.length("text") == F.col("_whole"), F.col("n_chars")).otherwise(F.length("text"))
    return cut.withColumn("n_chars", F.coalesce(n_chars, "n_chars").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their token ids."""
    return packing.pack_documents(docs, tokenizer_text())


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", copies_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

# Classifiers, suffix automata and packing are not SQL; the tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
