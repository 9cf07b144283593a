"""A table's other columns come through every stage as they are, whatever their names."""

import pytest
from pyspark.sql import functions as F

from strandwise.llm import passages, stages

NAMES = "doc _id _text _gone fp _fp _least _nth score spans lang_pred _copies _hash _h _copy h size key user_row n_lines n_dropped hi lo keeper component_id root node tokens tree".split() + ["a.b"]
STAGES = {
    "language_id": lambda spark, docs: stages.language_id(spark, docs, ""),
    "line_dedup": lambda spark, docs: stages.line_dedup(spark, docs, ""),
    "near_dedup": lambda spark, docs: stages.near_dedup(spark, docs, ""),
    "mix": lambda spark, docs: stages.mix(spark, docs, ""),
    "without_passages": lambda spark, docs: passages.without_passages(docs),
}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_come_back_equal(spark, corpus, stage):
    docs = corpus.where("doc_id < 60").select("*", *[F.concat_ws(":", F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    made = STAGES[stage](spark, docs)
    assert made.columns == docs.columns
    rows = made.select("doc_id", "source", *[f"`{n}`" for n in NAMES]).collect()
    assert rows
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        assert r.source == source[r.doc_id]
        assert [r[n] for n in NAMES] == [f"{n}:{r.doc_id}" for n in NAMES]
