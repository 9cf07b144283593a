"""Registered queries of the operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import divergence, kmeans_tree, language, line_dedup, mixing, packing, passages, pii, pivots, secrets, simhash, token_counts, whitening
from strandwise.llm.common import small_batches
from strandwise.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = lambda spark, sf: fn(small_batches(tune(spark)), sf)
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op2_token_counts(spark, sf):
    docs = token_counts.sample_edits(documents(spark, sf).select("doc_id", "text"))
    made = token_counts.recount(token_counts.count(docs).withColumn("tokens_before", F.col("tokens")))
    return made.select("doc_id", "tokens_before", F.col("tokens").alias("tokens_after"), F.length("text").alias("chars_after"), F.size("edits").alias("n_edits"), F.col("encoded").alias("chars_encoded"))


@query
def op3_passage_dedup(spark, sf):
    return passages.repeated_passages(documents(spark, sf))


@query
def op4_best_fit_packing(spark, sf):
    return packing.pack(documents(spark, sf))


@query
def op5_source_mixing(spark, sf):
    return mixing.mix(documents(spark, sf)).drop("h")


@query
def op6_language_id(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    made = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    out = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return made.select("doc_id", out, "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op7_simhash_near_dedup(spark, sf):
    return simhash.simhash_groups(documents(spark, sf))


@query
def op8_line_dedup(spark, sf):
    made = line_dedup.drop_common_lines(documents(spark, sf))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL["op8_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents),
keyed AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT d.doc_id, d.i, d.line, s.k IS NOT NULL AND d.doc_id <> s.keeper AS gone FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_secret_scan(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


@query
def op1_kmeans_tree(spark, sf):
    return kmeans_tree.neighbours(embeddings(spark, sf))


@query
def op10_exact_top_k(spark, sf):
    return pivots.top_k(embeddings(spark, sf))


SQL["op10_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op11_source_divergence(spark, sf):
    return divergence.divergences(documents(spark, sf))


SQL["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM d),
counted AS (SELECT r, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, sum(n) AS n FROM counted SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals t USING (lang, source)),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
listed AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_embedding_whitening(spark, sf):
    return whitening.whiten(embeddings(spark, sf))


@query
def op13_pii_scan(spark, sf):
    found = pii.find_personal(documents(spark, sf))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")
