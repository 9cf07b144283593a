"""Interval operators over order spans, genes and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import expression, intervals, scans
from strandwise.plans import surrogates as sv
from strandwise.plans.registry import query

ISLANDS = """SELECT {k}, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(is_new) OVER (PARTITION BY {k} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT {k}, start, "end", CASE WHEN start <= max("end") OVER (PARTITION BY {k} ORDER BY start, "end"
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM {t}))
  GROUP BY {k}, island"""
GENES_ON = "on_genes AS (SELECT * FROM expression WHERE expressed)"
REGION = f"region AS ({ISLANDS.format(k='chrom', t='windows')})"


def islands(keys: str, source: str) -> str:
    return ISLANDS.format(k=keys, t=source)


def gene_table(spark, sf):
    return expression.expression_table(
        sv.gene_counts(spark, sf), expression.gene_spans(sv.exons(spark, sf))
    )


def sparse_spans(spark, sf):
    """All orders, moved to every seventh day and shortened, so that merging leaves islands."""
    s = sv.spans(spark, sf).withColumn("start", F.col("start") - F.col("start") % 7)
    return s.withColumn("end", F.col("start") + F.col("span_id") % 6 + 1)


SPARSE = """sparse AS (SELECT span_id, chrom, start - start % 7 AS start, start - start % 7 + span_id % 6 + 1 AS "end" FROM spans)"""


@query("merge_spans", f"WITH {SPARSE} {islands('chrom', 'sparse')}", "spans")
def _(spark, sf):
    return intervals.merge_spans(sparse_spans(spark, sf), ["chrom"])


@query("merge_window_union", islands("chrom", "windows"), "windows")
def _(spark, sf):
    return intervals.merge_spans(sv.windows(spark, sf), ["chrom"])


@query(
    "tile_windows",
    f"""WITH {GENES_ON}, m AS ({islands('chrom', 'on_genes')}),
    s AS (SELECT chrom, start, greatest(0, ceil(("end" - start - 600) / 300.0))::BIGINT AS steps FROM m),
    t AS (SELECT chrom, start, unnest(range(steps + 1)) AS i FROM s)
    SELECT DISTINCT chrom, least(start + i * 300, 8040) AS start, least(start + i * 300, 8040) + 600 AS "end" FROM t""",
    "expression",
)
def tiles(spark, sf):
    genes = gene_table(spark, sf).where("expressed")
    sizes = genes.select("chrom").distinct().withColumn("size", F.lit(sv.CHROM_SIZE).cast("long"))
    return intervals.tile_spans(genes, sizes, 600, 300)


OWNED = """owned AS (SELECT chrom, start, "end",
  greatest(start, coalesce(floor((pe + ps + start + "end" - 2) / 4.0)::BIGINT + 1, start)) AS lo,
  least("end", coalesce(floor((ne + ns + start + "end" - 2) / 4.0)::BIGINT + 1, "end")) AS hi
  FROM (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe, lead(start) OVER w AS ns, lead("end") OVER w AS ne
        FROM windows WINDOW w AS (PARTITION BY chrom ORDER BY start)))"""


@query("owned_spans", f'WITH {OWNED} SELECT chrom, start, "end", lo, greatest(lo, hi) AS hi FROM owned', "windows")
def _(spark, sf):
    return intervals.owned_spans(sv.windows(spark, sf))


@query(
    "position_owner",
    f"""WITH {OWNED} SELECT p.library, o.chrom, o.start, count(*) AS n_positions, sum(p.value) AS total
    FROM pooled p JOIN owned o ON p.chrom = o.chrom AND p.pos >= o.lo AND p.pos < o.hi GROUP BY ALL""",
    "pooled windows",
)
def _(spark, sf):
    from strandwise.plans.q_tracks import pooled

    own = intervals.owned_spans(sv.windows(spark, sf)).select(
        "chrom", F.col("start").alias("window"), F.col("lo").alias("start"), F.col("hi").alias("end")
    )
    hits = intervals.points_in_spans(pooled(spark, sf), own, ["chrom"])
    return hits.groupBy("library", "chrom", F.col("window").alias("start")).agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum("value").alias("total")
    )


@query(
    "assign_windows",
    """WITH o AS (SELECT e.gene, e.condition, w.start AS ws, w."end" AS we, e.start >= w.start AND e."end" <= w."end" AS inside,
       abs(e.start + e."end" - w.start - w."end") AS d
       FROM expression e JOIN windows w ON e.chrom = w.chrom AND e.start < w."end" AND e."end" > w.start),
    b AS (SELECT *, row_number() OVER (PARTITION BY gene, condition ORDER BY inside DESC, d, ws) AS r FROM o)
    SELECT e.condition, e.gene, CASE WHEN b.inside THEN 'inside' WHEN b.gene IS NOT NULL THEN 'excluded' ELSE 'outside' END AS place,
      coalesce(CASE WHEN b.inside THEN b.ws END, -1) AS window_start
    FROM expression e LEFT JOIN b ON b.gene = e.gene AND b.condition = e.condition AND b.r = 1""",
    "expression windows",
)
def _(spark, sf):
    out = intervals.assign_windows(
        gene_table(spark, sf), sv.windows(spark, sf), ["chrom"], ["condition", "gene"]
    )
    return out.select(
        "condition", "gene", "place", F.coalesce("window_start", F.lit(-1)).alias("window_start")
    )


@query(
    "spans_in_region",
    f"""WITH {SPARSE}, region AS ({islands('chrom', 'sparse')})
    SELECT s.span_id, s.chrom, s.start, s."end" FROM spans s WHERE EXISTS (
      SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.start >= r.start AND s."end" <= r."end")""",
    "spans",
)
def _(spark, sf):
    region = intervals.merge_spans(sparse_spans(spark, sf), ["chrom"])
    return intervals.contained_in_region(sv.spans(spark, sf), region, ["chrom"], width=64)


@query(
    "points_in_region",
    f"""WITH {SPARSE}, region AS ({islands('chrom', 'sparse')})
    SELECT p.span_id, EXISTS (SELECT 1 FROM region r WHERE r.chrom = p.chrom AND p.start >= r.start AND p.start < r."end") AS covered
    FROM spans p""",
    "spans",
)
def _(spark, sf):
    region = intervals.merge_spans(sparse_spans(spark, sf), ["chrom"])
    points = sv.spans(spark, sf).select("span_id", "chrom", F.col("start").alias("pos"))
    return intervals.in_region(points, region, ["chrom"], width=64).select("span_id", "covered")


@query(
    "span_overlap_counts",
    f"""WITH {SPARSE} SELECT s.span_id, count(*) AS n, sum(least(s."end", r."end") - greatest(s.start, r.start))::BIGINT AS shared
    FROM sparse s JOIN spans r ON s.chrom = r.chrom AND s.start < r."end" AND s."end" > r.start GROUP BY ALL""",
    "spans",
)
def _(spark, sf):
    counted = intervals.overlap_totals(sparse_spans(spark, sf), sv.spans(spark, sf), ["chrom"])
    return counted.groupBy("span_id").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"))


@query(
    "gene_track_totals",
    """SELECT g.gene, p.condition, p.library, sum(p.value) AS total, sum(p.rep1) AS rep1, sum(p.rep2) AS rep2
    FROM (SELECT gene, chrom, strand, min(start) AS start, max("end") AS "end" FROM exons GROUP BY ALL) g
    JOIN pooled p ON p.chrom = g.chrom AND p.strand = g.strand AND p.pos >= g.start AND p.pos < g."end" GROUP BY ALL""",
    "pooled exons",
)
def gene_track_totals(spark, sf):
    from strandwise.plans.q_tracks import pooled

    genes = expression.gene_spans(sv.exons(spark, sf))
    sums = intervals.span_sums(
        pooled(spark, sf), genes, ["chrom", "strand"],
        {"total": "value", "rep1": "rep1", "rep2": "rep2"}, channels=["condition", "library"],
    )
    return sums.where("total > 0").select("gene", "condition", "library", "total", "rep1", "rep2")


@query(
    "region_totals_per_replicate",
    """SELECT c.condition, c.library, g.gene, coalesce(sum(p.rep1), 0) AS rep1, coalesce(sum(p.rep2), 0) AS rep2
    FROM (SELECT gene, chrom, min(start) AS start, max("end") AS "end" FROM exons GROUP BY ALL) g CROSS JOIN (SELECT DISTINCT condition, library FROM pooled) c
    LEFT JOIN pooled p ON p.condition = c.condition AND p.library = c.library AND p.chrom = g.chrom AND p.pos >= g.start AND p.pos < g."end" GROUP BY ALL""",
    "pooled exons",
)
def region_replicates(spark, sf):
    from strandwise.plans.q_tracks import pooled

    genes = expression.gene_spans(sv.exons(spark, sf)).drop("strand")
    sums = intervals.span_sums(
        pooled(spark, sf), genes, ["chrom"], {"rep1": "rep1", "rep2": "rep2"}, channels=["condition", "library"]
    )
    return sums.select("condition", "library", "gene", "rep1", "rep2")


@query(
    "expression_table",
    'SELECT condition, gene, chrom, strand, start, "end", rna_count, expressed FROM expression',
    "expression",
)
def _(spark, sf):
    return gene_table(spark, sf)


@query(
    "genes_expressed_somewhere",
    "SELECT DISTINCT x.tx FROM exons x WHERE EXISTS (SELECT 1 FROM expression e WHERE e.gene = x.gene AND e.expressed)",
    "expression",
)
def _(spark, sf):
    on = gene_table(spark, sf).where("expressed")
    return sv.exons(spark, sf).join(on, "gene", "left_semi").select("tx").distinct()


@query(
    "expression_mask",
    f"""WITH off_genes AS (SELECT * FROM expression WHERE NOT expressed), {GENES_ON},
    f AS (SELECT p.condition, p.library, p.chrom, p.strand, p.pos, p.library <> 'rna'
       AND EXISTS (SELECT 1 FROM off_genes g WHERE g.condition = p.condition AND g.chrom = p.chrom AND g.strand = p.strand AND p.pos >= g.start AND p.pos < g."end")
       AND NOT EXISTS (SELECT 1 FROM on_genes g WHERE g.condition = p.condition AND g.chrom = p.chrom AND g.strand = p.strand AND p.pos >= g.start AND p.pos < g."end") AS masked
      FROM pooled p)
    SELECT * FROM f""",
    "pooled expression",
)
def _(spark, sf):
    from strandwise.operators import tracks
    from strandwise.plans.q_tracks import pooled

    out = tracks.mask_unexpressed(pooled(spark, sf), gene_table(spark, sf))
    return out.select("condition", "library", "chrom", "strand", "pos", "masked")


@query(
    "example_genes",
    """SELECT gene, rna_count FROM expression WHERE condition = 'C0' AND expressed ORDER BY rna_count DESC, gene LIMIT 4""",
    "expression",
)
def _(spark, sf):
    on = gene_table(spark, sf).where("condition = 'C0' AND expressed")
    return on.orderBy(F.col("rna_count").desc(), "gene").limit(4).select("gene", "rna_count")


@query(
    "first_windows",
    """SELECT chrom, start, "end" FROM windows ORDER BY CASE chrom WHEN 'chr1' THEN 0 WHEN 'chr2' THEN 1 WHEN 'chr7' THEN 2
       WHEN 'chr8' THEN 3 ELSE 4 END, start LIMIT 12""",
    "windows",
)
def _(spark, sf):
    order = F.lit(4)
    for i, c in enumerate(("chr1", "chr2", "chr7", "chr8")):
        order = F.when(F.col("chrom") == c, i).otherwise(order)
    return sv.windows(spark, sf).orderBy(order, "start").limit(12)


@query(
    "evenly_spaced_windows",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY start, chrom) - 1 AS ordinal, count(*) OVER () AS n FROM windows)
    SELECT ordinal, chrom, start, "end" FROM r
    WHERE ordinal IN (SELECT round_even(i * ((n - 1)::DOUBLE / 24), 0)::BIGINT FROM range(25) t(i), (SELECT max(n) AS n FROM r))""",
    "windows",
)
def _(spark, sf):
    from strandwise.operators.sampling import evenly_spaced

    numbered = scans.number_rows(sv.windows(spark, sf), "start", ["chrom"])
    return evenly_spaced(numbered, 25)


@query(
    "numbered_rows",
    "SELECT span_id, row_number() OVER (ORDER BY start, span_id) - 1 AS ordinal FROM spans",
    "spans",
)
def _(spark, sf):
    return scans.number_rows(sv.spans(spark, sf), "start", ["span_id"]).select("span_id", "ordinal")


@query(
    "exact_quantiles",
    """SELECT chrom, count(*) AS n, round(median("end" - start + span_id / 7.0), 6) AS middle,
    round(quantile_cont("end" - start + span_id / 7.0, 0.9), 6) AS high FROM spans GROUP BY ALL""",
    "spans",
)
def _(spark, sf):
    rows = sv.spans(spark, sf).withColumn("x", F.col("end") - F.col("start") + F.col("span_id") / 7.0)
    out = scans.exact_quantiles(rows, ["chrom"], "x", {"middle": 0.5, "high": 0.9})
    return out.withColumns({c: F.round(c, 6) for c in ("middle", "high")})
