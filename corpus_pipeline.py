"""A training corpus in five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import stages
from strandwise.session import durable

#: (name, function); a function takes (spark, docs, sf_dir) and its result is the next one's docs.
STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.near_dedup),
    ("source_mixing", stages.mix),
    ("best_fit_packing", stages.pack),
]

#: Language scores, hashes of bits and token ids have no SQL; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
