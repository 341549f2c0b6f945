"""Corpus pipeline: toxicity, language, near-duplicates, packing; each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import lang_id, ngram_join, packing, toxicity
from panelwright.llm.runtime import scratch, table

VOCABULARY = "byte_bpe_50k.json"


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain finds toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or a score below what held-out documents reach."""
    return lang_id.with_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each_group(docs, n=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, with smaller caches: earlier stages' workers may still be there."""
    return packing.pack(docs, VOCABULARY, size=2048, end_id=0, cap=300_000, most_bytes=2 << 20)


STAGES = [
    ("toxicity", toxicity_chain),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, components and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
