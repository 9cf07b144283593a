"""Truth tables, top-k calls and differential usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions.coords import reproducible
from strandwise.operators import quality, start_metrics, truth
from strandwise.plans import surrogates as sv
from strandwise.plans.registry import query

REPRO = "coalesce(r1 = 1, false) AND coalesce(r2 = 1, false)"
CONDITIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

TOPK = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY condition, transcript_id
             ORDER BY score DESC, gpos, chrom, strand, codon_class, region) AS rank FROM cand),
ks AS (SELECT unnest([1, 2, 3]) AS k),
calls AS (SELECT * FROM (SELECT r.*, k, row_number() OVER (PARTITION BY k, condition, chrom, strand, gpos
             ORDER BY score DESC, transcript_id, rank, codon_class, region) AS site_rank
          FROM ranked r JOIN ks ON rank <= k) WHERE site_rank = 1)
"""


def truth_table(spark, sf):
    t = sv.truth(spark, sf)
    return t.withColumn("reproducible", reproducible(F.col("rep1"), F.col("rep2")))


@query(
    "top_k_calls",
    f"WITH {TOPK} SELECT condition, chrom, strand, gpos, transcript_id, codon_class, region, score "
    "FROM calls WHERE k = 2",
    "cand",
)
def _(spark, sf):
    c = sv.candidates(spark, sf).drop("quantity", "discount", "tax")
    return start_metrics.top_k_calls(c, 2)


@query(
    "start_precision_recall",
    f"""WITH {TOPK},
    known AS (SELECT DISTINCT condition, chrom, strand, gpos, codon_class, region FROM truth
              WHERE {REPRO} AND condition IN (SELECT condition FROM cand)),
    tc AS (SELECT k, condition, s AS stratum, count(*) AS n_calls, count(*) FILTER (hit) AS n_tp FROM (
        SELECT k, unnest([condition, 'all']) AS condition, codon_class, region, hit FROM (
          SELECT c.k, c.condition, c.codon_class, c.region, t.gpos IS NOT NULL AS hit FROM calls c LEFT JOIN known t
          USING (condition, chrom, strand, gpos))) x,
        unnest(['all', 'codon_class:' || codon_class,
                CASE WHEN region LIKE 'cds_%' THEN 'cds:in' ELSE 'cds:out' END]) u(s) GROUP BY ALL),
    tt AS (SELECT k, condition, s AS stratum, count(*) FILTER (covered) AS n_truth,
             count(*) FILTER (covered AND recalled) AS n_recalled, count(*) FILTER (NOT covered) AS n_truth_unscored FROM (
        SELECT k, unnest([condition, 'all']) AS condition, codon_class, region, covered, recalled FROM (
          SELECT ks.k, t.condition, t.codon_class, t.region, s.gpos IS NOT NULL AS covered, c.gpos IS NOT NULL AS recalled
          FROM known t CROSS JOIN ks
          LEFT JOIN (SELECT DISTINCT condition, chrom, strand, gpos FROM cand) s USING (condition, chrom, strand, gpos)
          LEFT JOIN (SELECT DISTINCT k, condition, chrom, strand, gpos FROM calls) c
            ON c.k = ks.k AND c.condition = t.condition AND c.chrom = t.chrom AND c.strand = t.strand AND c.gpos = t.gpos)) x,
        unnest(['all', 'codon_class:' || codon_class,
                CASE WHEN region LIKE 'cds_%' THEN 'cds:in' ELSE 'cds:out' END]) u(s) GROUP BY ALL),
    scaffold AS (SELECT k, condition, stratum FROM ks, (SELECT DISTINCT unnest([condition, 'all']) AS condition FROM cand),
        (SELECT unnest(['all','codon_class:AUG','codon_class:AAG','codon_class:AGG','codon_class:other_near_cognate',
                        'codon_class:non_cognate','cds:in','cds:out']) AS stratum))
    SELECT k, condition, stratum, coalesce(n_calls, 0) AS n_calls, coalesce(n_tp, 0) AS n_tp,
      n_tp::DOUBLE / nullif(n_calls, 0) AS precision, coalesce(n_truth, 0) AS n_truth, coalesce(n_recalled, 0) AS n_recalled,
      n_recalled::DOUBLE / nullif(n_truth, 0) AS recall, coalesce(n_truth_unscored, 0) AS n_truth_unscored
    FROM scaffold LEFT JOIN tc USING (k, condition, stratum) LEFT JOIN tt USING (k, condition, stratum)""",
    "cand truth",
)
def start_precision_recall(spark, sf):
    return start_metrics.start_metrics(sv.candidates(spark, sf), truth_table(spark, sf), (1, 2, 3))


@query(
    "truth_site_flags",
    f"""WITH {TOPK}
    SELECT t.condition, t.chrom, t.strand, t.gpos, s.gpos IS NOT NULL AS covered, c.gpos IS NOT NULL AS recalled
    FROM (SELECT * FROM truth WHERE {REPRO}) t
    LEFT JOIN (SELECT DISTINCT condition, chrom, strand, gpos FROM cand) s USING (condition, chrom, strand, gpos)
    LEFT JOIN (SELECT condition, chrom, strand, gpos FROM calls WHERE k = 1) c USING (condition, chrom, strand, gpos)""",
    "cand truth",
)
def _(spark, sf):
    c = start_metrics.truth_coverage(sv.candidates(spark, sf), truth_table(spark, sf), 1)
    return c.select(
        "condition", "chrom", "strand", "gpos", "covered",
        F.col("called_rank").isNotNull().alias("recalled"),
    )


@query(
    "truth_count_cube",
    f"""SELECT condition, codon_class, region, reproducible, coalesce(n, 0) AS n FROM
    (SELECT DISTINCT condition FROM truth)
    CROSS JOIN (SELECT unnest(['AUG','AAG','AGG','other_near_cognate','non_cognate']) AS codon_class)
    CROSS JOIN (SELECT unnest(['utr5','annotated','cds_inframe','cds_outframe','other']) AS region)
    CROSS JOIN (SELECT unnest([true, false]) AS reproducible)
    LEFT JOIN (SELECT condition, codon_class, region, {REPRO} AS reproducible, count(*) AS n FROM truth GROUP BY ALL)
    USING (condition, codon_class, region, reproducible)""",
    "truth",
)
def _(spark, sf):
    return truth.count_cube(truth_table(spark, sf))


@query(
    "start_usage_shares",
    "SELECT condition, rep, gene, chrom, strand, gpos, count, round(share, 9) AS share FROM shares",
    "shares",
)
def _(spark, sf):
    s = truth.usage_shares(sv.shares_counts(spark, sf))
    return s.withColumn("share", F.round("share", 9))


WIDE = "wide AS (SELECT chrom, strand, gpos, " + ", ".join(
    f"max(CASE WHEN condition = '{c}' AND rep = {r} THEN share END) AS s{i}_{r}"
    for i, c in enumerate(CONDITIONS)
    for r in (1, 2)
) + " FROM shares GROUP BY ALL)"
DELTAS = "deltas AS (" + " UNION ALL ".join(
    f"SELECT '{CONDITIONS[i]}' AS condition_a, '{CONDITIONS[j]}' AS condition_b, chrom, strand, gpos, "
    f"s{i}_1 - s{j}_1 AS delta_1_1, s{i}_2 - s{j}_2 AS delta_2_2 FROM wide"
    for i in range(5)
    for j in range(i + 1, 5)
) + ")"
UP = "delta_1_1 >= 0.1 AND delta_2_2 >= 0.1"
DOWN = "delta_1_1 <= -0.1 AND delta_2_2 <= -0.1"


@query(
    "share_matrix",
    f"WITH {WIDE} SELECT chrom, strand, gpos, "
    + ", ".join(
        f'round(s{i}_{r}, 9) AS "{c}_{r}"' for i, c in enumerate(CONDITIONS) for r in (1, 2)
    )
    + " FROM wide",
    "shares",
)
def _(spark, sf):
    m = truth.share_matrix(truth.usage_shares(sv.shares_counts(spark, sf)), CONDITIONS, (1, 2))
    return m.select(
        "chrom", "strand", "gpos",
        *[F.round(F.col(f"`{c}_{r}`"), 9).alias(f"{c}_{r}") for c in CONDITIONS for r in (1, 2)],
    )


@query(
    "differential_starts",
    f"""WITH {WIDE}, {DELTAS} SELECT condition_a, condition_b, chrom, strand, gpos, round(delta_1_1, 9) AS delta_1_1,
    round(delta_2_2, 9) AS delta_2_2, round((delta_1_1 + delta_2_2) / 2, 9) AS delta,
    CASE WHEN {UP} THEN 1 ELSE -1 END AS direction FROM deltas WHERE ({UP}) OR ({DOWN})""",
    "shares",
)
def _(spark, sf):
    d = truth.differential_starts(truth.usage_shares(sv.shares_counts(spark, sf)), CONDITIONS)
    return d.withColumns({c: F.round(c, 9) for c in ("delta_1_1", "delta_2_2", "delta")})


@query(
    "differential_counts",
    f"""WITH {WIDE}, {DELTAS} SELECT condition_a, condition_b,
    count(*) FILTER (delta_1_1 IS NOT NULL AND delta_2_2 IS NOT NULL) AS n_tested,
    count(*) FILTER ({UP}) AS n_a_higher, count(*) FILTER ({DOWN}) AS n_b_higher,
    count(*) FILTER (({UP}) OR ({DOWN})) AS n_differential FROM deltas GROUP BY ALL""",
    "shares",
)
def _(spark, sf):
    return truth.count_differential(truth.usage_shares(sv.shares_counts(spark, sf)), CONDITIONS)


@query(
    "condition_pairs",
    """SELECT a.condition AS condition_a, b.condition AS condition_b FROM (SELECT DISTINCT condition FROM counts) a,
    (SELECT DISTINCT condition FROM counts) b WHERE a.condition < b.condition""",
    "counts",
)
def _(spark, sf):
    return truth.condition_pairs(sv.shares_counts(spark, sf))


@query(
    "direction_accuracy",
    f"""WITH {WIDE}, {DELTAS},
    diff AS (SELECT *, CASE WHEN {UP} THEN 1 ELSE -1 END AS direction FROM deltas WHERE ({UP}) OR ({DOWN})),
    pred AS (SELECT condition, chrom, strand, gpos, sum(count)::BIGINT % 3 AS score FROM counts
             WHERE gpos % 4 <> 0 GROUP BY ALL),
    j AS (SELECT d.*, a.score AS sa, b.score AS sb FROM diff d
      LEFT JOIN pred a ON a.condition = d.condition_a AND a.gpos = d.gpos AND a.chrom = d.chrom AND a.strand = d.strand
      LEFT JOIN pred b ON b.condition = d.condition_b AND b.gpos = d.gpos AND b.chrom = d.chrom AND b.strand = d.strand)
    SELECT coalesce(condition_a, 'all') AS condition_a, coalesce(condition_b, 'all') AS condition_b,
      count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL) AS n_starts, count(*) AS n_differential,
      count(*) FILTER (sign(sa - sb) = direction) AS n_correct,
      count(*) FILTER (sign(sa - sb) = direction)::DOUBLE / nullif(count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL), 0) AS accuracy
    FROM j GROUP BY GROUPING SETS ((condition_a, condition_b), ())""",
    "shares",
)
def _(spark, sf):
    counts = sv.shares_counts(spark, sf)
    diff = truth.differential_starts(truth.usage_shares(counts), CONDITIONS)
    pred = (
        counts.where("gpos % 4 <> 0")
        .groupBy("condition", "chrom", "strand", "gpos")
        .agg((F.sum("count") % 3).alias("score"))
    )
    return start_metrics.direction_accuracy(diff, pred)


@query(
    "truth_violations",
    f"""SELECT rule, violations FROM (
      SELECT count(*) FILTER (condition IS NULL) AS null_condition, count(*) FILTER (chrom IS NULL) AS null_chrom,
        count(*) FILTER (gpos IS NULL) AS null_gpos, count(*) FILTER (strand NOT IN ('+', '-')) AS unknown_strand,
        count(*) FILTER (gpos < 0) AS negative_gpos,
        count(*) FILTER (codon_class NOT IN ('AUG','AAG','AGG','other_near_cognate','non_cognate')) AS unknown_codon_class,
        count(*) FILTER (region NOT IN ('utr5','annotated','cds_inframe','cds_outframe','other')) AS unknown_region,
        count(*) FILTER (coalesce(r1 = 1 AND r2 = 1, false) <> ({REPRO})) AS reproducible_differs,
        (SELECT count(*) FROM (SELECT 1 FROM truth GROUP BY condition, chrom, strand, gpos HAVING count(*) > 1)) AS repeated_start
      FROM truth)
    UNPIVOT (violations FOR rule IN (null_condition, null_chrom, null_gpos, unknown_strand, negative_gpos,
      unknown_codon_class, unknown_region, reproducible_differs, repeated_start))""",
    "truth",
)
def _(spark, sf):
    return quality.truth_violations(
        truth_table(spark, sf).select(
            "condition", "chrom", "gpos", "strand", "codon_class", "region", "rep1", "rep2",
            "reproducible",
        ),
        ("condition", "chrom", "gpos"),
    )


@query(
    "candidate_violations",
    """SELECT rule, violations FROM (
      SELECT count(*) FILTER (codon_class NOT IN ('AUG','AAG','AGG','other_near_cognate','non_cognate')) AS unknown_codon_class,
        count(*) FILTER (region NOT IN ('utr5','annotated','cds_inframe','cds_outframe','other')) AS unknown_region,
        count(*) FILTER (score IS NULL) AS missing_score
      FROM (SELECT CASE WHEN quantity > 45 THEN 'mystery' ELSE codon_class END AS codon_class, region,
                   CASE WHEN discount > 0.09 THEN NULL ELSE score END AS score FROM cand))
    UNPIVOT (violations FOR rule IN (unknown_codon_class, unknown_region, missing_score))""",
    "cand",
)
def _(spark, sf):
    c = sv.candidates(spark, sf)
    c = c.withColumn(
        "codon_class", F.when(F.col("quantity") > 45, "mystery").otherwise(F.col("codon_class"))
    ).withColumn("score", F.when(F.col("discount") > 0.09, None).otherwise(F.col("score")))
    return quality.candidate_violations(c)


@query(
    "share_violations",
    """SELECT 'repeated_share' AS rule, count(*) AS violations FROM (
    SELECT 1 FROM cand GROUP BY condition, quantity, chrom, strand, gpos HAVING count(*) > 1)""",
    "cand",
)
def _(spark, sf):
    return truth.share_violations(
        sv.candidates(spark, sf).withColumn("rep", F.col("quantity"))
    )
