"""Queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprints, language_model, media, mixing, ngram_join, packing, quality, substrings, toxicity, warc
from tidemark.runtime import load


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, load(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, load(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, load(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, load(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find(spark, load(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark, load(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(spark, load(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(spark, load(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(spark, load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.fit_on(spark, docs, load(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack_documents": op1_pack_documents,
        "op2_mix_sources": op2_mix_sources,
        "op3_quality": op3_quality,
        "op4_warc": op4_warc,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_ngram_join": op6_ngram_join,
        "op7_language_model": op7_language_model,
        "op8_fingerprints": op8_fingerprints,
        "op9_media": op9_media,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express."""
    return {"op2_mix_sources": mixing.SQL, "op4_warc": warc.SQL}
