"""The pipeline on small tables: names, columns and what each stage does."""

import corpus_pipeline
from strandwise.llm import queries


def test_stages_and_run(spark, odd, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    for table in (odd, none):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, "")
            if name != "best_fit_packing":
                assert made.columns == now.columns
                now = corpus_pipeline.durable(made, name)
            else:
                assert made.count() >= (table is odd)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
