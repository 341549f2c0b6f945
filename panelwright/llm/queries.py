"""One query per operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_extract, lang_id, near_embed, ngram_join, packing, pieces_codec, quality_rules, sst, token_count, toxicity
from .runtime import table


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embed.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.languages(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", size=2048, end_id=0)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_shards(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_codec.round_trip(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dup,
        op2_quality_rules,
        op3_html_extraction,
        op4_language_id,
        op5_ngram_jaccard_join,
        op6_best_fit_packing,
        op7_token_shards,
        op8_token_counts,
        op9_toxicity,
        op10_piece_codec,
    )
}

#: Hashing models, tokenizers, trained classifiers and transitive closure have no SQL; tests hold each against brute force.
ORACLE_SQL: dict[str, str] = {}
