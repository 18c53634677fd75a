"""From documents to packed training bins: the stages, each written as Parquet and read again.

Toxic documents go; one document of each group of near copies stays; passages that repeat
stay in one document; the sources are mixed to their target weights; what is left is packed.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, ngram_join, packing, substrings, toxicity
from tidemark.runtime import Scratch, load

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7."""
    return toxicity.keep_clean(spark, docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(spark, docs, k=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that nearly repeat stay in the document of least id."""
    return substrings.remove(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the sources' target weights take them."""
    return mixing.mixed(spark, docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of texts with their bins."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack_bins),
]

#: No stage but the fourth has an SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
