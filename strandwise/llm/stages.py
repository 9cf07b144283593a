"""The pipeline's stages: each applies one operator's decision to the documents it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import language, mixing, packing, simhash
from strandwise.llm.common import packed, small_batches, unpacked
from strandwise.llm.line_dedup import drop_common_lines


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters, or with no language of a fair share, go."""
    small_batches(spark)
    return language.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from the texts, and n_chars follows. A document without other lines stays, with an empty text."""
    small_batches(spark)
    made = drop_common_lines(packed(docs, "doc_id", "text")).select(*unpacked(docs.columns, "doc_id", "text"))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, or up to three times."""
    small_batches(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)
