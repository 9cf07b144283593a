"""Coverage tracks: pile-up, pooling, windows, candidate scores and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions.coords import gpos_from_locus
from strandwise.operators import intervals, tracks
from strandwise.plans import surrogates as sv
from strandwise.plans.q_intervals import SPARSE, islands, sparse_spans
from strandwise.plans.registry import query

CHANNEL = ["condition", "library", "rep", "chrom", "strand"]
R = 9


def track(spark, sf):
    return tracks.canonical(tracks.pile_up(sv.reads(spark, sf), CHANNEL))


def pooled(spark, sf):
    return tracks.pool_replicates(track(spark, sf))


def region(spark, sf):
    """Union of all windows."""
    return intervals.merge_spans(sv.windows(spark, sf), ["chrom"])


REGION = f"""region AS ({islands('chrom', 'windows')})"""
IN_REGION = "EXISTS (SELECT 1 FROM region r WHERE r.chrom = {t}.chrom AND {t}.{p} >= r.start AND {t}.{p} < r.\"end\")"


@query("track_pileup", "SELECT * FROM track", "track")
def _(spark, sf):
    return track(spark, sf)


@query("track_file_positions",
       """SELECT condition, library, rep, chrom, strand, pos, count(*)::DOUBLE AS value FROM reads GROUP BY ALL""", "reads")
def _(spark, sf):
    return tracks.file_positions(track(spark, sf))


@query("pooled_track", "SELECT condition, library, chrom, strand, pos, rep1, rep2, value FROM pooled", "pooled")
def _(spark, sf):
    return pooled(spark, sf)


@query(
    "target_variants",
    """SELECT condition, library, chrom, strand, pos, value AS pooled, 2 * least(rep1, rep2) AS low,
    round(2 * sqrt(rep1 * rep2), 9) AS geo FROM pooled""",
    "pooled",
)
def _(spark, sf):
    return pooled(spark, sf).select(
        "condition", "library", "chrom", "strand", "pos", F.col("value").alias("pooled"),
        (2 * F.least("rep1", "rep2")).alias("low"),
        F.round(2 * F.sqrt(F.col("rep1") * F.col("rep2")), R).alias("geo"),
    )


@query(
    "expand_runs",
    f"""WITH {SPARSE}, b AS (SELECT chrom, unnest(range(start, "end")) AS pos, span_id % 3 + 1 AS v FROM sparse)
    SELECT chrom, pos, sum(v)::BIGINT AS value FROM b GROUP BY ALL""",
    "spans",
)
def _(spark, sf):
    runs = sparse_spans(spark, sf).withColumn("value", F.col("span_id") % 3 + 1)
    return tracks.expand_runs(runs, ["chrom"])


@query(
    "track_within_region",
    f"WITH {REGION} SELECT t.* FROM track t WHERE {IN_REGION.format(t='t', p='pos')}",
    "track windows",
)
def _(spark, sf):
    return tracks.within_region(track(spark, sf), region(spark, sf))


@query(
    "track_clipped_to_size",
    "SELECT * FROM track WHERE pos >= 0 AND pos < CASE chrom WHEN 'chr7' THEN 5000 WHEN 'chr8' THEN 6000 ELSE 8640 END",
    "track",
)
def _(spark, sf):
    t = track(spark, sf)
    size = F.when(F.col("chrom") == "chr7", 5000).when(F.col("chrom") == "chr8", 6000)
    sizes = t.select("chrom").distinct().withColumn("size", size.otherwise(sv.CHROM_SIZE))
    return tracks.clip_to_size(t, sizes)


@query(
    "region_track_totals",
    f"WITH {REGION} SELECT condition, library, sum(value) AS total FROM track t WHERE {IN_REGION.format(t='t', p='pos')} GROUP BY ALL",
    "track windows",
)
def _(spark, sf):
    return tracks.region_totals(track(spark, sf), region(spark, sf), ["condition", "library"])


@query(
    "depth_scale",
    f"SELECT condition, library, sum(value) AS total, round(5e7 / sum(value), {R}) AS scale FROM track GROUP BY ALL",
    "track",
)
def _(spark, sf):
    d = tracks.depth_scale(track(spark, sf), ["condition", "library"])
    return d.withColumn("scale", F.round("scale", R))


@query(
    "replicate_fractions",
    f"""WITH {REGION}, x AS (SELECT condition, library, rep, sum(value) AS total FROM track t WHERE {IN_REGION.format(t='t', p='pos')} GROUP BY ALL)
    SELECT *, round(total / sum(total) OVER (PARTITION BY condition, library), {R}) AS fraction FROM x""",
    "track windows",
)
def _(spark, sf):
    f = tracks.replicate_fractions(track(spark, sf), region(spark, sf))
    return f.withColumn("fraction", F.round("fraction", R))


@query(
    "channel_layout",
    """WITH c AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS i FROM (SELECT DISTINCT condition FROM reads)),
    x AS (SELECT i * 6 + l * 2 + s AS channel, condition, ['tis', 'chx', 'rna'][l + 1] AS library, ['+', '-'][s + 1] AS strand,
      xor((i * 6 + l * 2 + s), 1) AS other_strand FROM c, range(3) a(l), range(2) b(s))
    SELECT x.channel::INTEGER AS channel, x.condition, x.library, x.strand, x.other_strand::INTEGER AS other_strand, count(r.pos) AS n_reads
    FROM x LEFT JOIN reads r USING (condition, library, strand) GROUP BY ALL""",
    "reads",
)
def _(spark, sf):
    layout = F.inline(tracks.channel_layout(("C0", "C1", "C2")))
    counted = sv.reads(spark, sf).groupBy("condition", "library", "strand").count()
    rows = spark.range(1).select(layout)
    return rows.join(counted, ["condition", "library", "strand"], "left").select(
        "channel", "condition", "library", "strand", "other_strand",
        F.coalesce("count", F.lit(0)).alias("n_reads"),
    )


DENSE = """grid AS (SELECT w.chrom, w.start AS window_start, unnest(range(w.start, w."end")) AS pos FROM windows w),
ch AS (SELECT DISTINCT condition, library, strand FROM pooled WHERE library = 'tis'),
dense AS (SELECT g.*, ch.condition, ch.library, ch.strand, coalesce(p.value, 0) AS value FROM grid g CROSS JOIN ch
  LEFT JOIN pooled p ON p.condition = ch.condition AND p.library = ch.library AND p.strand = ch.strand AND p.chrom = g.chrom AND p.pos = g.pos)"""


@query(
    "dense_window_read",
    f"""WITH {DENSE} SELECT condition, library, strand, chrom, window_start, count(*) AS n_bases, sum(value) AS total,
    sum(value * (pos - window_start)) AS moment FROM dense GROUP BY ALL""",
    "pooled windows",
)
def _(spark, sf):
    p = pooled(spark, sf).where("library = 'tis'")
    d = tracks.dense_windows(
        p, sv.windows(spark, sf), p.select("condition", "library", "strand").distinct()
    )
    return d.groupBy("condition", "library", "strand", "chrom", "window_start").agg(
        F.count(F.lit(1)).alias("n_bases"), F.sum("value").alias("total"),
        F.sum(F.col("value") * (F.col("pos") - F.col("window_start"))).alias("moment"),
    )


@query(
    "window_channel_matrix",
    """SELECT p.condition, w.chrom, w.start, p.pos - w.start AS base,
     sum(CASE WHEN library = 'tis' AND strand = '+' THEN value ELSE 0 END) AS tis_plus,
     sum(CASE WHEN library = 'tis' AND strand = '-' THEN value ELSE 0 END) AS tis_minus,
     sum(CASE WHEN library = 'chx' AND strand = '+' THEN value ELSE 0 END) AS chx_plus,
     sum(CASE WHEN library = 'chx' AND strand = '-' THEN value ELSE 0 END) AS chx_minus
    FROM windows w JOIN pooled p ON p.chrom = w.chrom AND p.pos >= w.start AND p.pos < w."end"
    WHERE library <> 'rna' GROUP BY ALL""",
    "pooled windows",
)
def _(spark, sf):
    p = pooled(spark, sf).where("library <> 'rna'")
    hits = intervals.points_in_spans(p, sv.windows(spark, sf), ["chrom"])
    name = F.concat("library", F.when(F.col("strand") == "+", "_plus").otherwise("_minus"))
    wide = (
        hits.withColumn("channel", name)
        .groupBy("condition", "chrom", "start", (F.col("pos") - F.col("start")).alias("base"))
        .pivot("channel", ["tis_plus", "tis_minus", "chx_plus", "chx_minus"])
        .sum("value")
    )
    return wide.fillna(0.0)


@query(
    "strand_channel_select",
    """SELECT e.tx, p.condition, p.pos, sum(CASE WHEN p.strand = e.strand THEN p.value ELSE 0 END) AS sense,
      sum(CASE WHEN p.strand <> e.strand THEN p.value ELSE 0 END) AS antisense
    FROM exons e JOIN pooled p ON p.chrom = e.chrom AND p.pos >= e.start AND p.pos < e."end" WHERE p.library = 'rna' GROUP BY ALL""",
    "pooled exons",
)
def _(spark, sf):
    p = pooled(spark, sf).where("library = 'rna'").withColumnRenamed("strand", "track_strand")
    hits = intervals.points_in_spans(p, sv.exons(spark, sf), ["chrom"], width=256)
    same = F.col("track_strand") == F.col("strand")
    return hits.groupBy("tx", "condition", "pos").agg(
        F.sum(F.when(same, F.col("value")).otherwise(0.0)).alias("sense"),
        F.sum(F.when(~same, F.col("value")).otherwise(0.0)).alias("antisense"),
    )


# Candidates placed on the track: one per line item key, with a standardized locus.
PLACED = """placed AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS row_idx, tx, chrom, strand, start + l_partkey % 40 AS gstart,
   CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
   FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)
   JOIN exons ON tx = l_orderkey AND start = ((tx // 2) * 37) % 8000 + 7 * (tx % 2) + 60 * (l_linenumber - 1))"""


def placed(spark, sf):
    li = sv.table(spark, sf, "lineitem")
    keyed = li.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).agg(
        F.min("l_partkey").alias("p"), F.max("l_returnflag").alias("flag")
    )
    ex = sv.exons(spark, sf)
    rank = F.expr("(start - ((tx div 2) * 37) % 8000 - 7 * (tx % 2)) div 60 + 1")
    j = keyed.join(ex.withColumn("n", rank).withColumnRenamed("tx", "l_orderkey"), ["l_orderkey", "n"])
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("n")).alias("row_idx"),
        F.col("l_orderkey").alias("tx"), "chrom", "strand",
        (F.col("start") + F.col("p") % 40).alias("gstart"),
        (F.col("flag") == "R").cast("int").alias("label"),
    )


FILES = """files AS (SELECT condition, chrom, strand, pos, count(*)::DOUBLE AS value FROM reads WHERE library = 'tis' GROUP BY ALL),
spot AS (SELECT *, CASE WHEN strand = '-' THEN gstart - 1 - 2 + 1 ELSE gstart + 2 END AS pos FROM placed),
pc AS (SELECT a.row_idx, c.condition, coalesce(sum(f.value) FILTER (abs(f.pos - a.pos) <= 1), 0) AS peak,
   coalesce(sum(f.value), 0) / 61 AS context
  FROM spot a CROSS JOIN (SELECT DISTINCT condition FROM files) c
  LEFT JOIN files f ON f.condition = c.condition AND f.chrom = a.chrom AND f.strand = a.strand AND f.pos BETWEEN a.pos - 30 AND a.pos + 30
  GROUP BY ALL)"""


def files(spark, sf):
    r = sv.reads(spark, sf).where("library = 'tis'")
    return tracks.pile_up(r, ["condition", "chrom", "strand"])


@query(
    "candidate_window_scores",
    f"WITH {PLACED}, {FILES} SELECT row_idx, condition, peak, round(context, {R}) AS context FROM pc",
    "reads exons",
)
def candidate_window_scores(spark, sf):
    s = tracks.candidate_scores(files(spark, sf), placed(spark, sf), "row_idx", 2)
    return s.withColumn("context", F.round("context", R))


@query(
    "candidate_score_variants",
    f"""WITH {PLACED}, {FILES}, {REGION}, tot AS (SELECT condition, sum(value) AS total FROM files GROUP BY ALL),
    v AS (SELECT row_idx, max(peak) AS peak_max, max(peak / total * 1e6) AS peak_norm_max,
      max(peak / (context + 0.001)) AS e1, max(peak / (context + 1)) AS e2, max(peak) FILTER (condition = 'C0') AS ref
      FROM pc JOIN tot USING (condition) GROUP BY ALL)
    SELECT row_idx, CASE WHEN c THEN peak_max ELSE 0 END AS peak_max, round(CASE WHEN c THEN peak_norm_max ELSE 0 END, 6) AS peak_norm_max,
      round(CASE WHEN c THEN e1 ELSE 0 END, 6) AS enrich_max_low, round(CASE WHEN c THEN e2 ELSE 0 END, 6) AS enrich_max_one,
      CASE WHEN c THEN ref ELSE 0 END AS peak_ref
    FROM v JOIN (SELECT row_idx, EXISTS (SELECT 1 FROM region r WHERE r.chrom = p.chrom AND
       CASE WHEN p.strand = '-' THEN p.gstart - 1 ELSE p.gstart END >= r.start AND CASE WHEN p.strand = '-' THEN p.gstart - 1 ELSE p.gstart END < r."end") AS c
       FROM placed p) USING (row_idx)""",
    "reads exons windows",
)
def candidate_score_variants(spark, sf):
    t = files(spark, sf)
    totals = t.groupBy("condition").agg(F.sum("value").alias("total"))
    s = tracks.candidate_score_table(
        placed(spark, sf), t, region(spark, sf), "row_idx", 2, totals, reference="C0"
    )
    return s.select(
        "row_idx", "peak_max", F.round("peak_norm_max", 6).alias("peak_norm_max"),
        F.round(F.col("`enrich_max_eps0.001`"), 6).alias("enrich_max_low"),
        F.round("enrich_max_eps1", 6).alias("enrich_max_one"), F.col("peak_C0").alias("peak_ref"),
    )


@query(
    "candidate_coverage",
    f"""WITH {PLACED}, {REGION}, c AS (SELECT label, EXISTS (SELECT 1 FROM region r WHERE r.chrom = p.chrom AND
       CASE WHEN p.strand = '-' THEN p.gstart - 1 ELSE p.gstart END >= r.start AND CASE WHEN p.strand = '-' THEN p.gstart - 1 ELSE p.gstart END < r."end") AS c FROM placed p)
    SELECT CASE WHEN label = 1 THEN 'positives' ELSE 'negatives' END AS class, count(*) AS n, count(*) FILTER (c) AS covered,
     count(*) FILTER (c)::DOUBLE / count(*) AS fraction FROM c GROUP BY ALL""",
    "exons windows",
)
def _(spark, sf):
    from strandwise.operators.ranking import coverage_table

    rows = placed(spark, sf).withColumn("pos", gpos_from_locus(F.col("gstart"), F.col("strand")))
    return coverage_table(
        intervals.in_region(rows, region(spark, sf), ["chrom"]), "label", "covered"
    )


PROFILE = """prof AS (SELECT f.condition, s.strand, CASE WHEN s.strand = '-' THEN s.pos - f.pos ELSE f.pos - s.pos END AS "offset", sum(f.value) AS total
  FROM (SELECT chrom, strand, CASE WHEN strand = '-' THEN gstart ELSE gstart END AS pos FROM placed WHERE label = 1) s
  JOIN (SELECT condition, chrom, strand, pos, count(*)::DOUBLE AS value FROM reads WHERE library = 'tis' GROUP BY ALL) f
   ON f.chrom = s.chrom AND f.strand = s.strand AND f.pos BETWEEN s.pos - 30 AND s.pos + 30 GROUP BY ALL)"""


def profile(spark, sf):
    sites = placed(spark, sf).where("label = 1").withColumn("pos", F.col("gstart"))
    return tracks.offset_profile(files(spark, sf), sites, 30, by=["condition"])


@query("offset_profile", f'WITH {PLACED}, {PROFILE} SELECT condition, strand, "offset", total FROM prof', "reads exons")
def _(spark, sf):
    return profile(spark, sf)


@query(
    "estimated_offset",
    f"""WITH {PLACED}, {PROFILE}, s AS (SELECT condition, "offset", sum(total) AS total FROM prof GROUP BY ALL)
    SELECT condition, "offset", total FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY total DESC, "offset") AS r FROM s) WHERE r = 1""",
    "reads exons",
)
def _(spark, sf):
    return tracks.estimate_offset(profile(spark, sf), ["condition"])


CONVENTION = """pk AS (SELECT strand, "offset", row_number() OVER (PARTITION BY strand ORDER BY total DESC, "offset") AS r
   FROM (SELECT strand, "offset", sum(total) AS total FROM prof GROUP BY ALL)),
one AS (SELECT max("offset") FILTER (strand = '+') AS plus, max("offset") FILTER (strand = '-') AS minus FROM pk WHERE r = 1),
cnt AS (SELECT count(*) FILTER (strand = '+') AS n_plus, count(*) FILTER (strand = '-') AS n_minus FROM placed WHERE label = 1)"""


@query(
    "coordinate_convention",
    f"""WITH {PLACED}, {PROFILE}, {CONVENTION} SELECT plus, minus, n_plus, n_minus,
    CASE WHEN n_plus < 20 OR n_minus < 20 THEN 'too_few_starts' WHEN plus IS NULL OR minus IS NULL THEN 'no_signal'
     WHEN plus - minus = 1 THEN 'minus_strand_shift' WHEN plus <> minus THEN 'strands_disagree'
     WHEN plus <> 0 THEN 'unexpected_offset' ELSE 'ok' END AS verdict FROM one, cnt""",
    "reads exons",
)
def convention(spark, sf):
    sites = placed(spark, sf).where("label = 1")
    return tracks.psite_convention(profile(spark, sf), sites)


@query(
    "same_convention",
    f"""WITH {PLACED}, {PROFILE}, {CONVENTION}, p2 AS (SELECT strand, "offset", row_number() OVER (PARTITION BY strand ORDER BY total DESC, "offset") AS r
      FROM (SELECT strand, "offset", sum(total) AS total FROM prof WHERE condition = 'C1' GROUP BY ALL)),
    two AS (SELECT max("offset") FILTER (strand = '+') AS other_plus, max("offset") FILTER (strand = '-') AS other_minus FROM p2 WHERE r = 1)
    SELECT plus, minus, other_plus, other_minus, plus = other_plus AND minus = other_minus AS same FROM one, two""",
    "reads exons",
)
def _(spark, sf):
    sites = placed(spark, sf).where("label = 1")
    p = profile(spark, sf)
    a = tracks.psite_convention(p, sites)
    b = tracks.psite_convention(p.where("condition = 'C1'"), sites)
    return tracks.same_convention(a, b)
