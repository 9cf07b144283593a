"""Sources, sinks, alignments, validated flags and composed reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from strandwise.functions import coords as co
from strandwise.operators import alignments, concordance, intervals, reports, tracks, transcripts
from strandwise.operators import features as ft
from strandwise.plans import surrogates as sv
from strandwise.plans.q_concordance import UNITS, unit_track, within_sql
from strandwise.plans.q_intervals import gene_table, islands
from strandwise.plans.q_tracks import pooled, region, track
from strandwise.plans.q_transcripts import annotation, dealt, exon_table, txtrack
from strandwise.plans.registry import query
from strandwise.session import durable, shared_folder
from strandwise.sources import tables

R = 6


def scratch(spark, name):
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@query("renamed_projection", "SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS price FROM part")
def _(spark, sf):
    df = tables.read_table(spark, f"{sf}/part.parquet")
    return tables.rename_project(
        df, {"p_partkey": "id", "absent": "gone", "p_brand": "brand", "p_retailprice": "price"}
    )


@query(
    "annotation_from_comma_lists",
    'SELECT tx::VARCHAR AS transcript_id, chrom, count(*) AS n_exons, sum("end" - start)::BIGINT AS length FROM exons GROUP BY tx, chrom',
    "exons",
)
def _(spark, sf):
    a = annotation(spark, sf)
    text = lambda k: F.array_join(F.transform("exons", lambda e: e[k].cast("string")), ",")
    raw = a.select(F.col("tx").alias("Tid"), "chrom", text("start").alias("es"), text("end").alias("ee"), F.lit(1).alias("junk"))
    loaded = tables.load_annotation(
        raw, {"Tid": "transcript_id", "chrom": "chrom", "es": "exon_starts", "ee": "exon_ends"}, ["transcript_id", "exons"][:1]
    )
    return loaded.select(
        "transcript_id", "chrom", F.size("exons").cast("long").alias("n_exons"),
        transcripts.spliced_length(F.col("exons")).alias("length"),
    )


@query(
    "count_text_scan",
    "SELECT condition, gene, sum(count)::BIGINT AS count FROM gene_counts GROUP BY ALL",
    "gene_counts",
)
def _(spark, sf):
    c = sv.gene_counts(spark, sf)
    line = F.concat_ws("\t", F.concat_ws("G", "condition", F.col("gene").cast("string")), F.col("count").cast("string"))
    extra = F.concat_ws("\t", F.lit("__no_feature"), F.col("count").cast("string"))
    text = c.select(F.explode(F.array(line, extra)).alias("text"))
    parsed = tables.gene_counts(text)
    named = F.split("gene_id", "G")
    return parsed.groupBy(named[0].alias("condition"), named[1].cast("long").alias("gene")).agg(F.sum("count").alias("count"))


@query(
    "count_file_resolution",
    """WITH s AS (SELECT DISTINCT 'LIB' || c_custkey || '_L' || (c_custkey % 3) AS sample_id, c_custkey FROM customer),
    f AS (SELECT 'LIB' || c_custkey || '_L' || x AS stem, c_custkey FROM customer, unnest(CASE c_custkey % 4 WHEN 0 THEN [c_custkey % 3, 7] WHEN 1 THEN [8] WHEN 2 THEN [8, 9] ELSE []::BIGINT[] END) u(x)),
    r AS (SELECT s.sample_id, max(CASE WHEN f.stem = s.sample_id THEN f.stem END) AS exact, count(f.stem) AS n, min(f.stem) AS lane FROM s LEFT JOIN f USING (c_custkey) GROUP BY ALL)
    SELECT sample_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'lane' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
      coalesce(CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN lane END || '_htseqcount.txt', '-') AS file FROM r""",
)
def _(spark, sf):
    c = sv.table(spark, sf, "customer")
    k = F.col("c_custkey")
    lib = F.concat(F.lit("LIB"), k.cast("string"), F.lit("_L"))
    samples = c.select(F.concat(lib, (k % 3).cast("string")).alias("sample_id")).distinct()
    lanes = F.when(k % 4 == 0, F.array((k % 3).cast("string"), F.lit("7"))).when(k % 4 == 1, F.array(F.lit("8"))).when(
        k % 4 == 2, F.array(F.lit("8"), F.lit("9"))
    ).otherwise(F.array().cast("array<string>"))
    files = c.select(lib.alias("lib"), F.explode(lanes).alias("x")).select(
        F.concat("lib", "x", F.lit("_htseqcount.txt")).alias("file")
    )
    out = tables.resolve_count_files(samples, files)
    return out.select("sample_id", "status", F.coalesce("file", F.lit("-")).alias("file"))


@query(
    "sample_sheet",
    """SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'RPE1_' || ['Async', 'Que', 'Sen'][c_custkey % 3 + 1] ELSE c_mktsegment END AS condition,
      CASE c_nationkey % 4 WHEN 0 THEN 'tis' WHEN 1 THEN 'chx' WHEN 2 THEN 'rna' END AS library, (c_custkey % 2 + 1)::INTEGER AS rep, c_name AS sample_id,
      CASE WHEN c_custkey % 5 = 0 THEN 'new/' || c_custkey ELSE 'bam/' || c_custkey END AS bam
    FROM customer WHERE c_custkey % 7 <> 0 AND c_nationkey % 4 <> 3""",
)
def _(spark, sf):
    c = sv.table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    state = F.when(k % 3 == 0, "Async").when(k % 3 == 1, "Quiescent").otherwise("Senescent")
    sheet = c.select(
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "RPE1").otherwise(F.col("c_mktsegment")).alias("cell_line"),
        state.alias("condition"),
        F.when(n == 1, "CHX").otherwise("TIS").alias("treatment"),
        F.when(n == 2, "Input").when(n == 3, "Other").otherwise("RPF").alias("type"),
        F.concat((k % 2 + 1).cast("string"), F.lit(".0")).alias("rep"),
        F.col("c_name").alias("sample_id"),
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("bam/"), k.cast("string"))).alias("bam_path"),
    )
    new = c.where("c_custkey % 5 = 0").select(
        F.col("c_name").alias("sample_id"), F.concat(F.lit("new/"), k.cast("string")).alias("bam")
    )
    return tables.load_samples(sheet, new)


@query(
    "track_sink_round_trip",
    "SELECT condition, library, rep, chrom, strand, count(*) AS n, sum(value) AS total, sum(pos)::BIGINT AS pos_sum FROM track GROUP BY ALL",
    "track",
)
def _(spark, sf):
    path = scratch(spark, "track")
    tables.write_track(track(spark, sf), path, ["library", "chrom"])
    back = spark.read.parquet(path)
    return back.groupBy("condition", "library", "rep", "chrom", "strand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("pos").alias("pos_sum")
    )


@query(
    "schema_evolving_append",
    """SELECT r.o_orderpriority AS name, count(*) AS n, NULL::DOUBLE AS price FROM orders r GROUP BY ALL
    UNION ALL SELECT o_orderstatus, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch(spark, "results")
    o = sv.table(spark, sf, "orders")
    count = F.count(F.lit(1)).alias("n")
    tables.append_evolving(spark, path, o.groupBy(F.col("o_orderpriority").alias("name")).agg(count))
    return tables.append_evolving(
        spark, path, o.groupBy(F.col("o_orderstatus").alias("name")).agg(count, F.round(F.avg("o_totalprice"), 4).alias("price"))
    )


@query(
    "calls_sink_round_trip",
    "SELECT split, count(*) AS n, sum(label)::BIGINT AS positives FROM labelled WHERE score >= 0.8 GROUP BY ALL",
    "labelled",
)
def _(spark, sf):
    path = scratch(spark, "calls")
    calls = sv.labelled(spark, sf).where("score >= 0.8")
    tables.write_calls(calls, calls.groupBy("split").count(), path)
    back = tables.read_table(spark, os.path.join(path, "calls.parquet"))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


# Alignments.
READS = """al AS (SELECT l_orderkey * 100 + l_linenumber AS read_id, l_partkey * 3 AS start, l_linestatus = 'F' AS is_reverse, l_linenumber - 1 AS mapq,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 9 END AS nh, l_tax > 0.07 AS is_unmapped, l_discount > 0.09 AS is_secondary,
  ['0A20', '20', '12A0', '5A10', '10T0'][l_suppkey % 5 + 1] AS md, l_suppkey % 2 = 0 AS is_paired, l_suppkey % 4 = 0 AS is_read1,
  [5 + l_quantity::BIGINT % 10, 1 + l_partkey % 2, 6 + l_suppkey % 5, 50 + l_partkey % 100, 4 + l_quantity::BIGINT % 7] AS lens, l_partkey, l_suppkey, l_quantity
  FROM lineitem),
ops AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS i, unnest([0, 1, 0, 3, 0]) AS op, unnest(lens) AS len, lens[1] + lens[2] + lens[3] + lens[5] AS read_length,
   start + lens[1] + lens[3] + lens[4] + lens[5] AS "end" FROM al)"""
PASS = "NOT is_unmapped AND NOT is_secondary AND mapq >= 1 AND (nh IS NULL OR nh <= 5)"


def reads_table(spark, sf):
    li = sv.table(spark, sf, "lineitem")
    q, p, s = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    lens = [5 + q % 10, 1 + p % 2, 6 + s % 5, 50 + p % 100, 4 + q % 7]
    ops = (0, 1, 0, 3, 0)
    md = F.element_at(F.array(*[F.lit(x) for x in ("0A20", "20", "12A0", "5A10", "10T0")]), (s % 5 + 1).cast("int"))
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("read_id"),
        (p * 3).alias("start"),
        (p * 3 + lens[0] + lens[2] + lens[3] + lens[4]).alias("end"),
        (F.col("l_linestatus") == "F").alias("is_reverse"),
        (F.col("l_linenumber") - 1).alias("mapq"),
        F.when(s % 5 != 0, s % 9).alias("nh"),
        (F.col("l_tax") > 0.07).alias("is_unmapped"),
        (F.col("l_discount") > 0.09).alias("is_secondary"),
        md.alias("md"),
        (s % 2 == 0).alias("is_paired"),
        (s % 4 == 0).alias("is_read1"),
        (lens[0] + lens[1] + lens[2] + lens[4]).alias("read_length"),
        F.array(*[F.struct(F.lit(o).alias("op"), n.alias("len")) for o, n in zip(ops, lens, strict=True)]).alias("cigar"),
    )


def offset_table(spark, sf):
    """Offsets by read length, from the reads' own lengths; the second table is for mismatches."""
    n = reads_table(spark, sf).select("read_length").distinct().where("read_length % 8 <> 0")
    rows = F.array(
        F.struct(F.lit("main").alias("table"), (11 + F.col("read_length") % 4).alias("offset")),
        F.struct(F.lit("mismatch").alias("table"), (12 + F.col("read_length") % 3).alias("offset")),
    )
    return n.select(F.col("read_length").alias("length"), F.inline(rows))


@query(
    "p_site_placement",
    f"""WITH {READS}, o AS (SELECT *, CASE WHEN CASE WHEN is_reverse THEN regexp_matches(md, '\\D0$') ELSE regexp_matches(md, '^0') END THEN 12 + read_length % 3 ELSE 11 + read_length % 4 END AS p,
       coalesce(sum(CASE WHEN op IN (0, 1) THEN len ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN (0, 3) THEN len ELSE 0 END) OVER w, 0) AS g
      FROM ops WHERE {PASS} AND read_length % 8 <> 0
      WINDOW w AS (PARTITION BY read_id, start, is_reverse, md, l_suppkey, l_partkey, l_quantity, mapq, is_secondary, is_unmapped ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, CASE WHEN is_reverse THEN read_length - p ELSE p END AS want, CASE WHEN is_reverse THEN 0 ELSE 1 END AS slack FROM o),
    h AS (SELECT read_id, start, l_suppkey, l_partkey, l_quantity, is_reverse, p, max(read_length) AS n, max("end") AS e,
       arg_min(CASE WHEN op = 0 THEN start + g + want - r ELSE start + g END, i) FILTER (op IN (0, 1) AND r + len - want >= slack) AS found FROM q GROUP BY ALL)
    SELECT read_id, is_reverse, sum(CASE WHEN p = n THEN CASE WHEN is_reverse THEN start ELSE e END ELSE coalesce(found, e) END)::BIGINT AS pos, count(*) AS n FROM h WHERE p <= n GROUP BY ALL""",
)
def _(spark, sf):
    placed = alignments.p_sites(reads_table(spark, sf).distinct(), offset_table(spark, sf))
    return placed.groupBy("read_id", "is_reverse").agg(
        F.sum("pos").cast("long").alias("pos"), F.count(F.lit(1)).alias("n")
    )


@query(
    "read_filters",
    f"""WITH {READS} SELECT ({PASS}) AS kept, CASE WHEN is_reverse THEN regexp_matches(md, '\\D0$') ELSE regexp_matches(md, '^0') END AS mismatch, count(*) AS n FROM al GROUP BY ALL""",
)
def _(spark, sf):
    r = reads_table(spark, sf)
    return r.groupBy(alignments.passes_filters().alias("kept"), alignments.five_prime_mismatch().alias("mismatch")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "five_prime_ends",
    f"""WITH {READS} SELECT CASE WHEN is_reverse THEN start + lens[1] + lens[3] + lens[4] + lens[5] - 1 ELSE start END AS pos, is_reverse, count(*) AS n FROM al
    WHERE {PASS} AND (NOT is_paired OR is_read1) GROUP BY ALL""",
)
def _(spark, sf):
    e = alignments.five_prime_ends(reads_table(spark, sf))
    return e.groupBy("pos", "is_reverse").agg(F.count(F.lit(1)).alias("n"))


@query(
    "significant_calls",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_discount / 5 <= 0.01 AND l_tax / 4 <= 0.01 AND l_quantity / 500 <= 0.05 GROUP BY ALL""",
)
def _(spark, sf):
    li = sv.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") / 5).alias("tp"), (F.col("l_tax") / 4).alias("rp"), (F.col("l_quantity") / 500).alias("fq")
    )
    return li.where(alignments.significant("tp", "rp", "fq")).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(
    "call_set_overlap",
    """WITH a AS (SELECT DISTINCT chrom, strand, pos FROM pooled WHERE condition = 'C0'), b AS (SELECT DISTINCT chrom, strand, pos FROM pooled WHERE condition = 'C1'),
    j AS (SELECT a.pos AS x, b.pos AS y FROM a FULL JOIN b USING (chrom, strand, pos))
    SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b,
      round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)::DOUBLE / count(*), 9) AS jaccard FROM j""",
    "pooled",
)
def _(spark, sf):
    p = pooled(spark, sf)
    o = alignments.call_overlap(p.where("condition = 'C0'"), p.where("condition = 'C1'"), ["chrom", "strand", "pos"])
    return o.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "three_state_flags",
    """WITH r AS (SELECT o_orderkey, ['true', 'FALSE', ' 1', '0', '', NULL, 'maybe'][o_orderkey % 7 + 1] AS a, ['1', '', 'True'][o_custkey % 3 + 1] AS b FROM orders),
    f AS (SELECT *, CASE WHEN lower(trim(a)) IN ('true', '1') THEN 1 WHEN lower(trim(a)) IN ('false', '0') THEN 0 ELSE -1 END AS fa,
      CASE WHEN lower(trim(b)) IN ('true', '1') THEN 1 ELSE -1 END AS fb FROM r)
    SELECT o_orderkey, fa, fb, a = 'maybe' AND a IS NOT NULL AS bad, fa = 1 AND fb = 1 AS both FROM f WHERE fa <> 1 OR o_orderkey % 2 = 0""",
)
def _(spark, sf):
    o = sv.table(spark, sf, "orders")
    pick = lambda c, n, v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(c) % n + 1).cast("int"))
    r = o.select("o_orderkey", pick("o_orderkey", 7, ("true", "FALSE", " 1", "0", "", None, "maybe")).alias("a"), pick("o_custkey", 3, ("1", "", "True")).alias("b"))
    fa, fb = co.three_state(F.col("a")), co.three_state(F.col("b"))
    imputed = F.coalesce(fa, F.lit(False)) & (F.col("o_orderkey") % 2 != 0)
    return r.where(~imputed).select(
        "o_orderkey", F.coalesce(fa.cast("int"), F.lit(-1)).alias("fa"), F.coalesce(fb.cast("int"), F.lit(-1)).alias("fb"),
        co.bad_flag(F.col("a")).alias("bad"), co.reproducible(fa, fb).alias("both"),
    )


@query(
    "coordinate_columns",
    """SELECT chrom, strand, gpos, CASE chrom WHEN 'chr7' THEN 'val' WHEN 'chr8' THEN 'test' WHEN 'chr9' THEN 'test' ELSE 'train' END AS split,
      CASE WHEN strand = '-' THEN gpos + 1 ELSE gpos END AS locus, CASE WHEN strand = '-' THEN gpos - 5 + 1 ELSE gpos + 5 END AS centre,
      CASE WHEN split_part(condition, '_', 1) = 'RPE1' THEN 'RPE1' ELSE condition END AS line, region, count(*) AS n FROM cand GROUP BY ALL""",
    "cand",
)
def _(spark, sf):
    c = sv.candidates(spark, sf)
    locus = co.locus_from_gpos(F.col("gpos"), F.col("strand"))
    return c.groupBy(
        "chrom", "strand", "gpos", co.split_of(F.col("chrom")).alias("split"), locus.alias("locus"),
        co.candidate_centre(locus, F.col("strand"), 5).alias("centre"),
        co.line_of(F.col("condition")).alias("line"), "region",
    ).agg(F.count(F.lit(1)).alias("n"))


GENES = "on_genes AS (SELECT * FROM expression WHERE expressed), off_genes AS (SELECT * FROM expression WHERE NOT expressed)"
MASK = """p.library <> 'rna' AND EXISTS (SELECT 1 FROM off_genes g WHERE g.condition = p.condition AND g.chrom = p.chrom AND g.strand = p.strand AND p.pos >= g.start AND p.pos < g."end")
  AND NOT EXISTS (SELECT 1 FROM on_genes g WHERE g.condition = p.condition AND g.chrom = p.chrom AND g.strand = p.strand AND p.pos >= g.start AND p.pos < g."end")"""


@query(
    "channel_metrics",
    f"""WITH {GENES}, wr AS (SELECT p.condition, p.library, p.strand, p.chrom, w.start AS ws, rep1 AS obs, rep2 + 0.1 AS pred FROM (SELECT p.*, {MASK} AS masked FROM pooled p) p
       JOIN windows w ON p.chrom = w.chrom AND p.pos >= w.start AND p.pos < w."end" WHERE NOT masked),
    t AS (SELECT condition, library, strand, chrom, ws, sum(obs) AS T, sum(pred) AS Q FROM wr GROUP BY ALL),
    kl AS (SELECT condition, library, strand, chrom, ws, CASE WHEN max(T) > 0 THEN sum(CASE WHEN obs > 0 THEN obs / T * (ln(obs / T) - ln(greatest(pred / Q, 1e-7))) ELSE 0 END) END AS kl
       FROM wr JOIN t USING (condition, library, strand, chrom, ws) GROUP BY ALL),
    mk AS (SELECT condition, library, strand, avg(kl) AS profile_kl, count(kl) AS kl_windows, (SELECT count(*) FROM windows) - count(kl) AS kl_skipped FROM kl GROUP BY ALL),
    ov AS (SELECT e.condition, e.strand, e.gene, bool_or(e.start >= w.start AND e."end" <= w."end") AS inside FROM on_genes e JOIN windows w ON e.chrom = w.chrom AND e.start < w."end" AND e."end" > w.start GROUP BY ALL),
    gc AS (SELECT condition, strand, count(*) FILTER (inside) AS n_genes, count(*) FILTER (NOT inside) AS genes_excluded FROM ov GROUP BY ALL),
    gt AS (SELECT e.condition, e.strand, l.library, e.gene, coalesce(sum(p.rep1), 0) AS o, coalesce(sum(p.rep2), 0) AS q FROM on_genes e JOIN ov USING (condition, strand, gene)
       CROSS JOIN (SELECT DISTINCT library FROM pooled) l LEFT JOIN pooled p ON p.condition = e.condition AND p.library = l.library AND p.strand = e.strand AND p.chrom = e.chrom AND p.pos >= e.start AND p.pos < e."end"
       WHERE ov.inside GROUP BY ALL),
    lp AS (SELECT condition, strand, library, CASE WHEN count(*) >= 3 THEN corr(ln(1 + o), ln(1 + q)) END AS log_pearson FROM gt GROUP BY ALL)
    SELECT condition, library, strand, round(profile_kl, {R}) AS profile_kl, kl_windows, kl_skipped, round(log_pearson, {R}) AS log_pearson, n_genes, genes_excluded
    FROM mk LEFT JOIN gc USING (condition, strand) LEFT JOIN lp USING (condition, library, strand)""",
    "pooled expression windows",
)
def _(spark, sf):
    p = pooled(spark, sf).withColumn("pred", F.col("rep2") + 0.1)
    out = reports.channel_metrics(p, gene_table(spark, sf), sv.windows(spark, sf), obs="rep1", pred="pred", total="rep2")
    return out.withColumns({c: F.round(c, R) for c in ("profile_kl", "log_pearson")})


@query(
    "track_quality",
    f"""WITH t AS (SELECT g.gene, l.condition, l.library, coalesce(sum(p.rep1), 0) AS a, coalesce(sum(p.rep2), 0) AS b FROM
      (SELECT gene, chrom, min(start) AS start, max("end") AS "end" FROM exons GROUP BY ALL) g CROSS JOIN (SELECT DISTINCT condition, library FROM pooled) l
      LEFT JOIN pooled p ON p.condition = l.condition AND p.library = l.library AND p.chrom = g.chrom AND p.pos >= g.start AND p.pos < g."end" GROUP BY ALL),
    f AS (SELECT k.condition, 'chx' AS library, round(sum(CASE WHEN (k.tx_pos - t.cds_start) % 3 = 0 THEN k.value ELSE 0 END) / sum(k.value), {R}) AS frame_fraction
      FROM txtrack k JOIN tx t USING (tx) WHERE k.library = 'chx' AND k.tx_pos >= t.cds_start AND k.tx_pos < t.cds_end GROUP BY ALL)
    SELECT condition, library, round(corr(ln(1 + a), ln(1 + b)), {R}) AS replicate_r, max(frame_fraction) AS frame_fraction FROM t LEFT JOIN f USING (condition, library) GROUP BY ALL""",
    "txtrack tx",
)
def _(spark, sf):
    from strandwise.operators.expression import gene_spans

    genes = gene_spans(sv.exons(spark, sf)).drop("strand")
    totals = intervals.span_sums(
        pooled(spark, sf).drop("strand"), genes, ["chrom"], {"rep1": "rep1", "rep2": "rep2"}, channels=["condition", "library"]
    )
    a = annotation(spark, sf).select("tx", "cds_start", (F.col("cds_end") - F.col("cds_start")).alias("cds_length"))
    rows = txtrack(spark, sf).where("library = 'chx'").join(a, "tx").withColumn("cds_pos", F.col("tx_pos") - F.col("cds_start"))
    frames = concordance.frame_fraction(rows, "value", ["condition"])
    out = reports.track_quality(totals, frames)
    return out.withColumns({c: F.round(c, R) for c in ("replicate_r", "frame_fraction")})


SCALED = """fs AS (SELECT e.evaluated AS condition, t.library, sum(t.total) / max(r.rna) AS scalar FROM (SELECT unnest(['C0', 'C1', 'C2']) AS evaluated) e JOIN ft t ON t.condition <> e.evaluated
   JOIN (SELECT e.evaluated, sum(t.total * 1e6 / g.genome_total) AS rna FROM (SELECT unnest(['C0', 'C1', 'C2']) AS evaluated) e JOIN ft t ON t.condition <> e.evaluated AND t.library = 'rna' JOIN gt g ON g.condition = t.condition GROUP BY ALL) r
   ON r.evaluated = e.evaluated WHERE t.library <> 'rna' GROUP BY ALL)"""


@query(
    "rna_scaled_scorecard",
    f"""WITH {UNITS}, w3 AS (SELECT * FROM windows WHERE (start // 256) % 3 = 0), region AS ({islands('chrom', 'w3')}),
    ft AS (SELECT condition, library, sum(value) AS total FROM track t WHERE EXISTS (SELECT 1 FROM region r WHERE r.chrom = t.chrom AND t.pos >= r.start AND t.pos < r."end") GROUP BY ALL),
    gt AS (SELECT condition, sum(value) AS genome_total FROM track WHERE library = 'rna' GROUP BY ALL), {SCALED},
    rs AS (SELECT k.condition, f.library, k.tx, k.tx_pos, k.value * 1e6 / g.genome_total * f.scalar AS v FROM txtrack k JOIN fs f ON f.condition = k.condition JOIN gt g ON g.condition = k.condition
      JOIN units u ON u.condition = k.condition AND u.tx = k.tx WHERE k.library = 'rna'),
    k2 AS (SELECT condition, library, tx, tx_pos, coalesce(k.rep1, 0) AS rep1, coalesce(k.rep2, 0) AS rep2, coalesce(rs.v, 0) AS pooled, 0.0 AS mixed FROM k FULL JOIN rs USING (condition, library, tx, tx_pos)),
    {within_sql('codon', 3, '({}cds_start % 3)').replace('k.*, e.nb', 'k.*, u2.cds_start, e.nb').replace('FROM k JOIN elig_codon e USING (condition, library, tx))', 'FROM k2 k JOIN elig_codon e USING (condition, library, tx) JOIN units u2 ON u2.condition = k.condition AND u2.tx = k.tx)').replace('k.cds_start', 'u2.cds_start').replace('FROM k JOIN units', 'FROM k2 k JOIN units')}
    SELECT condition, library, round(v_pooled, 5) AS value, round(yard, 5) AS yardstick, n FROM w_codon""",
    "track txtrack tx expression windows",
)
def _(spark, sf):
    t = track(spark, sf)
    inside = tracks.region_totals(t, region(spark, sf), ["condition", "library"])
    cpm = t.where("library = 'rna'").groupBy("condition").agg(F.sum("value").alias("genome_total"))
    scalars = concordance.fit_scalars(inside.join(cpm, "condition"), ("C0", "C1", "C2"), ("C0", "C1", "C2"))
    both = reports.rna_scaled_in_place(unit_track(spark, sf, ("tis", "chx", "rna")), scalars, cpm)
    per_unit = concordance.unit_correlations(both, ["rna_scaled"], "codon", 2)
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"r_{c}").alias("r")) for c in ("rep1", "rna_scaled")]))
    out = concordance.medians(durable(per_unit, "scaled").select("condition", "library", "scale", each), ["rna_scaled"])
    return out.select("condition", "library", F.round("value", 5).alias("value"), F.round("yardstick", 5).alias("yardstick"), "n")


@query(
    "stored_run_lookup",
    """WITH m AS (SELECT unnest(['mean', 'top']) AS metric, unnest([round(avg(score), 9), max(score)]) AS value FROM labelled),
    c AS (SELECT unnest(['mean', 'top']) AS metric, unnest([0.0, 0.5]) AS ci_low, unnest([1.0, max(score)]) AS ci_high FROM labelled)
    SELECT 'all' AS stratum, metric, value, ci_low::DOUBLE AS ci_low, ci_high::DOUBLE AS ci_high, NULL::VARCHAR AS problem FROM m JOIN c USING (metric)
    UNION ALL SELECT codon_class, 'mean', round(avg(score), 9), NULL, NULL, NULL FROM labelled GROUP BY ALL
    UNION ALL SELECT codon_class, 'top', max(score), NULL, NULL, NULL FROM labelled GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf).withColumn("arm", F.lit("one")).withColumn("seed", F.lit("ensemble"))

    def long(df, low, high):
        mean = F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value"), F.lit(0.0).alias("ci_low"), F.lit(1.0).alias("ci_high"))
        top = F.struct(F.lit("top").alias("metric"), F.col("top").alias("value"), F.lit(low).alias("ci_low"), high.alias("ci_high"))
        return F.inline(F.array(mean, top))

    aggs = [F.round(F.avg("score"), 9).alias("mean"), F.max("score").alias("top")]
    whole = rows.groupBy("arm", "seed").agg(*aggs)
    whole = whole.select("arm", "seed", long(whole, 0.5, F.col("top")))
    strata = rows.groupBy("arm", F.col("codon_class").alias("stratum")).agg(*aggs)
    strata = strata.select("arm", "stratum", long(strata, 0.5, F.col("top")))
    return reports.stored_run(
        whole.select("arm", "seed", "metric", "value"), strata.select("arm", "stratum", "metric", "value"),
        whole.select("arm", "metric", "ci_low", "ci_high"), "one",
    )


@query(
    "calls_alignment_check",
    """SELECT count(*) FILTER (mrna_index % 10 <> 0 AND mrna_index % 7 <> 0) AS n_matched, count(*) FILTER (mrna_index % 10 <> 0 AND mrna_index % 7 = 0) AS only_calls,
      count(*) FILTER (mrna_index % 10 = 0 AND mrna_index % 7 <> 0) AS only_rows, count(*) FILTER (mrna_index % 10 <> 0 AND mrna_index % 7 <> 0 AND mrna_index % 100 = 1) AS label_differs FROM labelled""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf)
    flipped = F.when(F.col("mrna_index") % 100 == 1, 1 - F.col("label")).otherwise(F.col("label"))
    calls = rows.where("mrna_index % 10 <> 0").withColumn("label", flipped)
    return reports.aligned_calls(calls, rows.where("mrna_index % 7 <> 0"), ["transcript_id", "mrna_index"], "label")


@query(
    "shard_offsets",
    "SELECT tx, tx % 16 AS shard, coalesce(sum(length) OVER (PARTITION BY tx % 16 ORDER BY tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM tx",
    "tx",
)
def _(spark, sf):
    a = annotation(spark, sf).select("tx", "length", (F.col("tx") % 16).alias("shard"))
    return reports.shard_offsets(a, "shard", "tx", "length").select("tx", "shard", F.col("offset").alias("offset_"))


@query(
    "example_rows",
    f"""WITH s AS (SELECT condition, 5e7 / sum(value) AS scale FROM track WHERE library = 'rna' GROUP BY ALL),
    b AS (SELECT e.tx, e.gene, e.length, e.chrom, e.strand, p AS pos, e.off + CASE WHEN e.strand = '-' THEN e."end" - 1 - p ELSE p - e.start END AS tx_pos FROM exon_off e, unnest(range(e.start, e."end")) u(p)),
    w AS (SELECT condition, chrom, strand, pos, sum(CASE WHEN library = 'tis' THEN value ELSE 0 END) AS tis, sum(CASE WHEN library = 'chx' THEN value ELSE 0 END) AS chx,
       sum(CASE WHEN library = 'rna' THEN value ELSE 0 END) AS rna FROM pooled GROUP BY ALL)
    SELECT b.tx, x.condition, bool_and(x.expressed) AS expressed, count(*) AS n, coalesce(sum(tis), 0) AS tis, coalesce(sum(chx * b.tx_pos), 0) AS chx_moment, round(coalesce(sum(rna), 0) * max(scale), 3) AS rna,
      round(sum(ln(1 + b.tx_pos) / 10), 4) AS from_start FROM b JOIN expression x USING (gene) JOIN s USING (condition)
      LEFT JOIN w ON w.condition = x.condition AND w.chrom = b.chrom AND w.strand = b.strand AND w.pos = b.pos GROUP BY b.tx, x.condition""",
    "track pooled exon_off expression",
)
def _(spark, sf):
    rna = track(spark, sf).where("library = 'rna'")
    scale = tracks.depth_scale(rna, ["condition"])
    states = gene_table(spark, sf).join(scale.select("condition"), "condition", "left_semi")
    states = states.groupBy("gene").agg(F.collect_list(F.struct("condition", "expressed")).alias("conditions"))
    held = dealt(spark, annotation(spark, sf).select("tx", "gene", "chrom", "strand", "exons").join(states, "gene"))
    b = transcripts.base_table(transcripts.exon_offsets(held, ["tx", "chrom", "conditions"]))
    b = b.withColumns(ft.position_features(F.col("tx_pos"), F.col("length")))
    rows = reports.examples_in_place(b.select("tx", "chrom", "strand", "pos", "tx_pos", "from_start", "conditions"), pooled(spark, sf), scale, ["from_start"])
    return rows.groupBy("tx", "condition").agg(
        F.bool_and("expressed").alias("expressed"), F.count(F.lit(1)).alias("n"), F.sum("tis").alias("tis"),
        F.sum(F.col("chx") * F.col("tx_pos")).alias("chx_moment"), F.round(F.sum("rna"), 3).alias("rna"),
        F.round(F.sum("from_start"), 4).alias("from_start"),
    )


@query(
    "first_row_per_site",
    """SELECT chrom, strand, gpos, transcript_id, score FROM (SELECT *, row_number() OVER (PARTITION BY chrom, strand, gpos ORDER BY transcript_id, score, quantity) AS r FROM cand) WHERE r = 1""",
    "cand",
)
def _(spark, sf):
    c = sv.candidates(spark, sf).select("chrom", "strand", "gpos", "transcript_id", "score", "quantity")
    return reports.first_per_key(c, ["chrom", "strand", "gpos"], ["transcript_id", "score", "quantity"]).drop("quantity")


@query(
    "index_order",
    """SELECT split, chrom, start, tx FROM (SELECT CASE chrom WHEN 'chr7' THEN 'val' WHEN 'chr8' THEN 'test' WHEN 'chr9' THEN 'test' ELSE 'train' END AS split, chrom, start, tx FROM tx) ORDER BY split, chrom, start, tx""",
    "tx",
)
def _(spark, sf):
    a = annotation(spark, sf).select(
        co.split_of(F.col("chrom")).alias("split"), "chrom", F.element_at("exons", 1)["start"].alias("start"), "tx"
    )
    return a.orderBy("split", "chrom", "start", "tx")


@query(
    "unmatched_keys",
    "SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(spark, sf):
    every = sv.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")).distinct()
    known = sv.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return every.join(known, "key", "left_anti")
