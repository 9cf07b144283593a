"""Ranking metrics, calibration and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.operators import bootstrap, ranking
from strandwise.plans import surrogates as sv
from strandwise.plans.registry import query
from strandwise.session import durable

THRESHOLD = 0.8
SEED = 20260909
R = 9


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


CURVE = """
sc AS (SELECT split, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
       FROM labelled GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS all_pos, sum(neg) OVER t AS all_neg
          FROM sc WINDOW w AS (PARTITION BY split ORDER BY score DESC), t AS (PARTITION BY split)),
groups AS (SELECT split, count(DISTINCT transcript_id) AS n_groups FROM labelled GROUP BY ALL)
"""


def curve(spark, sf, strata=("split",), score="score"):
    counts = ranking.score_counts(sv.labelled(spark, sf), score, "label", strata)
    return ranking.rank_curve(counts, strata)


@query(
    "rank_curve",
    f"WITH {CURVE} SELECT split, score, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM curve",
    "labelled",
)
def _(spark, sf):
    return curve(spark, sf).select("split", "score", "pos", "neg", "tp", "fp")


@query(
    "recall_at_fp_budget",
    f"""WITH {CURVE}, f AS (SELECT *, row_number() OVER (PARTITION BY split, budget ORDER BY tp DESC, score DESC) AS r
      FROM curve JOIN groups USING (split), (SELECT unnest([1.0, 5.0, 20.0]) AS budget)
      WHERE fp::DOUBLE / n_groups <= budget)
    SELECT split, budget::DOUBLE AS budget, tp::DOUBLE / all_pos AS recall, score AS threshold,
      fp::DOUBLE / n_groups AS fp_per_group FROM f WHERE r = 1""",
    "labelled",
)
def recall_budgets(spark, sf):
    rows = sv.labelled(spark, sf)
    c, g = curve(spark, sf), ranking.group_counts(rows, "transcript_id", ["split"])
    return ranking.recall_at_budget(c, g, (1.0, 5.0, 20.0), ["split"])


@query(
    "rank_areas",
    f"""WITH {CURVE} SELECT split,
      round(sum(pos::DOUBLE / all_pos * tp / (tp + fp)), 9) AS auprc,
      round(sum(neg::DOUBLE * (tp - pos + pos / 2.0::DOUBLE) / all_pos / all_neg), 9) AS auroc FROM curve GROUP BY ALL""",
    "labelled",
)
def rank_areas(spark, sf):
    return rounded(ranking.area_metrics(curve(spark, sf), ["split"]), "auprc", "auroc")


@query(
    "threshold_metrics",
    f"""SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(DISTINCT transcript_id) AS n_groups,
      count(*) FILTER (label = 1 AND score >= {THRESHOLD}) AS true_positives,
      count(*) FILTER (label = 0 AND score >= {THRESHOLD}) AS false_positives,
      count(*) FILTER (label = 1 AND score >= {THRESHOLD})::DOUBLE / greatest(1, count(*) FILTER (label = 1)) AS recall,
      count(*) FILTER (label = 0 AND score >= {THRESHOLD})::DOUBLE / count(DISTINCT transcript_id) AS fp_per_group,
      count(*) FILTER (label = 1 AND score >= {THRESHOLD})::DOUBLE / greatest(1, count(*) FILTER (score >= {THRESHOLD})) AS precision
    FROM labelled GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf)
    return ranking.threshold_metrics(rows, "score", "label", "transcript_id", THRESHOLD, ["split"])


@query(
    "metric_set_by_class",
    f"""WITH sc AS (SELECT codon_class, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
       FROM labelled WHERE split = 'test' AND codon_class IN ('AUG', 'near_cognate') GROUP BY ALL),
    curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS all_pos, sum(neg) OVER t AS all_neg
          FROM sc WINDOW w AS (PARTITION BY codon_class ORDER BY score DESC), t AS (PARTITION BY codon_class)),
    a AS (SELECT codon_class, round(sum(pos::DOUBLE / all_pos * tp / (tp + fp)), 9) AS auprc,
      round(sum(neg::DOUBLE * (tp - pos + pos / 2.0::DOUBLE) / all_pos / all_neg), 9) AS auroc FROM curve GROUP BY ALL)
    SELECT codon_class, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(DISTINCT transcript_id) AS n_groups,
      count(*) FILTER (label = 1 AND score >= {THRESHOLD}) AS true_positives,
      count(*) FILTER (label = 0 AND score >= {THRESHOLD}) AS false_positives,
      count(*) FILTER (label = 1 AND score >= {THRESHOLD})::DOUBLE / greatest(1, count(*) FILTER (label = 1)) AS recall,
      count(*) FILTER (label = 0 AND score >= {THRESHOLD})::DOUBLE / count(DISTINCT transcript_id) AS fp_per_group,
      count(*) FILTER (label = 1 AND score >= {THRESHOLD})::DOUBLE / greatest(1, count(*) FILTER (score >= {THRESHOLD})) AS precision,
      max(auprc) AS auprc, max(auroc) AS auroc
    FROM labelled JOIN a USING (codon_class) WHERE split = 'test' GROUP BY codon_class""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf).where("split = 'test'")
    rows = rows.where(F.col("codon_class").isin("AUG", "near_cognate"))
    m = ranking.metric_set(rows, "score", "label", "transcript_id", THRESHOLD, ["codon_class"])
    return rounded(m, "auprc", "auroc")


BINS = """bins AS (SELECT b AS bin, coalesce(n, 0) AS n, confidence, accuracy, squared_error FROM range(10) t(b) LEFT JOIN (
    SELECT len(list_filter([1 * 0.1::DOUBLE, 2 * 0.1::DOUBLE, 3 * 0.1::DOUBLE, 4 * 0.1::DOUBLE, 5 * 0.1::DOUBLE, 6 * 0.1::DOUBLE,
       7 * 0.1::DOUBLE, 8 * 0.1::DOUBLE, 9 * 0.1::DOUBLE], lambda e: e <= score)) AS bin, count(*) AS n, avg(score) AS confidence,
       avg(label) AS accuracy, sum((score - label) * (score - label)) AS squared_error FROM labelled GROUP BY 1) x ON x.bin = t.b)"""


@query(
    "reliability_bins",
    f"WITH {BINS} SELECT bin, n, round(confidence, {R}) AS confidence, round(accuracy, {R}) AS accuracy FROM bins",
    "labelled",
)
def _(spark, sf):
    b = ranking.reliability(sv.labelled(spark, sf), "score", "label")
    return rounded(b.drop("squared_error"), "confidence", "accuracy")


@query(
    "calibration_summary",
    f"WITH {BINS} SELECT round(sum(squared_error) / sum(n), {R}) AS brier, round(max(abs(confidence - accuracy)), {R}) AS max_gap FROM bins",
    "labelled",
)
def _(spark, sf):
    b = ranking.reliability(sv.labelled(spark, sf), "score", "label")
    return rounded(ranking.calibration_summary(b), "brier", "max_gap")


PAIRS = """pairs AS (SELECT p.transcript_id, p.row_idx AS pos_row_idx, n.row_idx AS neg_row_idx, p.split, p.codon_class AS pc,
   n.codon_class AS nc, p.score AS pos_score, n.score AS neg_score, p.score_b AS pos_score_b, n.score_b AS neg_score_b
  FROM labelled p JOIN labelled n ON p.transcript_id = n.transcript_id AND p.label = 1 AND n.label = 0
   AND abs(p.mrna_index - n.mrna_index) <= 64)"""


def pairs(spark, sf):
    keep = ["row_idx", "score", "score_b", "codon_class", "split"]
    return ranking.near_pairs(sv.labelled(spark, sf), keep)


@query("near_neighbour_pairs", f"WITH {PAIRS} SELECT pos_row_idx, neg_row_idx FROM pairs", "labelled")
def _(spark, sf):
    return pairs(spark, sf).select("pos_row_idx", "neg_row_idx")


@query(
    "near_neighbour_win_rate",
    f"""WITH {PAIRS} SELECT pc AS stratum, count(*) AS n_pairs, count(*) FILTER (pos_score > neg_score) AS n_wins,
    count(*) FILTER (pos_score > neg_score)::DOUBLE / count(*) AS win_rate FROM pairs WHERE pc = nc GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    same = pairs(spark, sf).where("pos_codon_class = neg_codon_class")
    return ranking.win_rate(same.withColumnRenamed("pos_codon_class", "stratum"), strata=["stratum"])


@query(
    "label_coverage",
    """SELECT CASE WHEN label = 1 THEN 'positives' ELSE 'negatives' END AS class, count(*) AS n,
    count(*) FILTER (mrna_index % 3 <> 0) AS covered, count(*) FILTER (mrna_index % 3 <> 0)::DOUBLE / count(*) AS fraction
    FROM labelled GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf).withColumn("covered", F.col("mrna_index") % 3 != 0)
    return ranking.coverage_table(rows, "label", "covered")


@query(
    "call_summary",
    f"""WITH c AS (SELECT *, score >= {THRESHOLD} AS called FROM labelled WHERE split = 'test'),
    x AS (SELECT unnest(['all', codon_class]) AS codon_class, label, called FROM c)
    SELECT codon_class, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (called) AS n_called,
     count(*) FILTER (called AND label = 1) AS true_positives, count(*) FILTER (called AND label = 0) AS false_positives,
     count(*) FILTER (called AND label = 1)::DOUBLE / nullif(count(*) FILTER (label = 1), 0) AS recall,
     count(*) FILTER (called AND label = 1)::DOUBLE / nullif(count(*) FILTER (called), 0) AS precision,
     count(*) FILTER (called AND label = 0)::DOUBLE / (SELECT count(DISTINCT transcript_id) FROM c) AS fp_per_group
    FROM x GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    rows = sv.labelled(spark, sf).where("split = 'test'")
    calls = rows.withColumn("called", F.col("score") >= THRESHOLD)
    return ranking.call_summary(calls, "label", "transcript_id", "codon_class")


VARIANTS = """
v AS (SELECT split, transcript_id, label, codon_class, row_idx, unnest(['mean', 'score', 'score_b']) AS variant,
        unnest([(score + score_b) / 2, score, score_b]) AS s FROM labelled),
vc AS (SELECT variant, s AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM v
       WHERE split = 'val' GROUP BY ALL),
vcurve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS all_pos
           FROM vc WINDOW w AS (PARTITION BY variant ORDER BY score DESC), t AS (PARTITION BY variant)),
vg AS (SELECT count(DISTINCT transcript_id) AS n_groups FROM labelled WHERE split = 'val'),
vbest AS (SELECT variant, tp::DOUBLE / all_pos AS recall, score AS threshold FROM (
   SELECT *, row_number() OVER (PARTITION BY variant ORDER BY tp DESC, score DESC) AS r FROM vcurve, vg
   WHERE fp::DOUBLE / n_groups <= 5) WHERE r = 1),
varea AS (SELECT variant, sum(pos::DOUBLE / all_pos * tp / (tp + fp)) AS auprc FROM vcurve GROUP BY ALL),
vtable AS (SELECT variant, recall, auprc, threshold FROM vbest JOIN varea USING (variant)),
vsel AS (SELECT * FROM vtable ORDER BY recall DESC, auprc DESC,
   CASE variant WHEN 'score' THEN 0 WHEN 'score_b' THEN 1 ELSE 2 END LIMIT 1)
"""
VARIANT_ORDER = ("score", "score_b", "mean")


def variant_rows(spark, sf):
    rows = sv.labelled(spark, sf)
    pair = lambda n, c: F.struct(F.lit(n).alias("variant"), c.alias("s"))
    mean = (F.col("score") + F.col("score_b")) / 2
    return rows.select(
        "split", "transcript_id", "label", "codon_class",
        F.inline(F.array(pair("mean", mean), pair("score", F.col("score")), pair("score_b", F.col("score_b")))),
    )


def variant_table(spark, sf):
    val = variant_rows(spark, sf).where("split = 'val'")
    c = ranking.rank_curve(ranking.score_counts(val, "s", "label", ["variant"]), ["variant"])
    g = ranking.group_counts(val, "transcript_id", ["variant"])
    best = ranking.recall_at_budget(c, g, 5.0, ["variant"])
    return best.join(ranking.area_metrics(c, ["variant"]), "variant").select(
        "variant", "recall", "auprc", "threshold"
    )


@query("variant_selection", f"WITH {VARIANTS} SELECT variant, recall, round(auprc, {R}) AS auprc, threshold FROM vsel", "labelled")
def _(spark, sf):
    return rounded(ranking.select_variant(variant_table(spark, sf), VARIANT_ORDER), "auprc")


@query(
    "protocol_run",
    f"""WITH {VARIANTS},
    x AS (SELECT variant, unnest(['all', codon_class]) AS stratum, label, s, threshold, transcript_id FROM v JOIN vtable USING (variant)
          WHERE split = 'test')
    SELECT variant, stratum, variant = (SELECT variant FROM vsel) AS selected, count(*) AS n, count(*) FILTER (label = 1) AS positives,
     count(*) FILTER (label = 1 AND s >= threshold)::DOUBLE / greatest(1, count(*) FILTER (label = 1)) AS recall,
     count(*) FILTER (label = 0 AND s >= threshold)::DOUBLE / count(DISTINCT transcript_id) AS fp_per_group
    FROM x GROUP BY variant, stratum""",
    "labelled",
)
def _(spark, sf):
    table = variant_table(spark, sf)
    chosen = ranking.select_variant(table, VARIANT_ORDER).select("variant").scalar()
    test = variant_rows(spark, sf).where("split = 'test'").join(
        table.select("variant", "threshold"), "variant"
    )
    test = test.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("codon_class"))))
    m = ranking.threshold_metrics(
        test, "s", "label", "transcript_id", F.col("threshold"), ["variant", "stratum"]
    )
    return m.select(
        "variant", "stratum", (F.col("variant") == chosen).alias("selected"), "n", "positives",
        "recall", "fp_per_group",
    )


@query(
    "metric_agreement",
    """WITH a AS (SELECT split, codon_class, avg(score) AS value FROM labelled GROUP BY ALL),
    b AS (SELECT split, codon_class, sum(score) / count(*) + 0.002 AS value FROM labelled GROUP BY ALL)
    SELECT count(*) AS n_compared, round(max(abs(a.value - b.value)), 9) AS max_abs_diff,
      max(abs(a.value - b.value)) <= 0.005 AS ok FROM a JOIN b USING (split, codon_class)""",
    "labelled",
)
def _(spark, sf):
    g = sv.labelled(spark, sf).groupBy("split", "codon_class")
    stored = g.agg(F.avg("score").alias("value"))
    again = g.agg((F.sum("score") / F.count(F.lit(1)) + 0.002).alias("value"))
    out = ranking.agreement(stored, again, ["split", "codon_class"], 0.005)
    return rounded(out, "max_abs_diff")


DRAWS = """
g AS (SELECT transcript_id, row_number() OVER (ORDER BY substr(md5(transcript_id::VARCHAR), 1, 3), transcript_id) - 1 AS ordinal
      FROM (SELECT DISTINCT transcript_id FROM labelled WHERE split = 'test')),
n AS (SELECT count(*) AS n FROM g),
draws AS (SELECT b, ('0x' || substr(md5('{seed}:' || b || ':' || i), 1, 8))::BIGINT % n AS ordinal
   FROM n, range({b}) r(b), range((SELECT n FROM n)) s(i)),
weights AS (SELECT b, transcript_id, count(*) AS weight FROM draws JOIN g USING (ordinal) GROUP BY ALL)
"""


def test_rows(spark, sf):
    return sv.labelled(spark, sf).where("split = 'test'")


REPLICATES = 1000


def draws(spark, sf):
    return bootstrap.draw_arrays(test_rows(spark, sf), "transcript_id", REPLICATES, SEED)


@query(
    "bootstrap_draws",
    f"WITH {DRAWS.format(seed=SEED, b=REPLICATES)} SELECT b, transcript_id, weight FROM weights",
    "labelled",
)
def _(spark, sf):
    return bootstrap.draw_weights(test_rows(spark, sf), "transcript_id", REPLICATES, SEED)


ARMS = """
arms AS (SELECT transcript_id, label, unnest(['score', 'score_b']) AS arm, unnest([score, score_b]) AS s,
   unnest([0.8, 0.9]) AS threshold FROM labelled WHERE split = 'test'),
rep AS (SELECT arm, b,
   sum(weight) FILTER (label = 1 AND s >= threshold)::DOUBLE / greatest(1, sum(weight) FILTER (label = 1)) AS recall,
   sum(weight) FILTER (label = 1 AND s >= threshold)::DOUBLE / greatest(1, sum(weight) FILTER (s >= threshold)) AS precision,
   sum(weight) FILTER (label = 0 AND s >= threshold)::DOUBLE / (SELECT n FROM n) AS fp_per_group
   FROM arms JOIN weights USING (transcript_id) GROUP BY ALL)
"""


def arms(spark, sf):
    arm = lambda n, t: F.struct(F.lit(n).alias("arm"), F.col(n).alias("s"), F.lit(t).alias("threshold"))
    return test_rows(spark, sf).select(
        "transcript_id", "label", F.inline(F.array(arm("score", 0.8), arm("score_b", 0.9)))
    )


def additive(spark, sf):
    stats = bootstrap.group_counts_at(
        arms(spark, sf), "s", "label", "transcript_id", F.col("threshold"), ["arm"]
    )
    return bootstrap.additive_replicates(stats, draws(spark, sf), "transcript_id", ["arm"])


LONG = "unnest(['recall', 'precision', 'fp_per_group']) AS metric, unnest([recall, precision, fp_per_group]) AS value"
QUANT = "round(quantile_cont(value, 0.025), 9) AS ci_low, round(quantile_cont(value, 0.975), 9) AS ci_high"


@query(
    "bootstrap_intervals",
    f"WITH {DRAWS.format(seed=SEED, b=REPLICATES)}, {ARMS} SELECT arm, metric, {QUANT} FROM (SELECT arm, {LONG} FROM rep) GROUP BY ALL",
    "labelled",
)
def bootstrap_intervals(spark, sf):
    reps = additive(spark, sf)
    out = bootstrap.intervals(reps, ["recall", "precision", "fp_per_group"], ["arm"])
    return rounded(out, "ci_low", "ci_high")


@query(
    "paired_bootstrap",
    f"""WITH {DRAWS.format(seed=SEED, b=REPLICATES)}, {ARMS},
    d AS (SELECT x.arm || '-score' AS comparison, x.recall - y.recall AS recall, x.precision - y.precision AS precision,
          x.fp_per_group - y.fp_per_group AS fp_per_group FROM rep x JOIN rep y ON x.b = y.b AND y.arm = 'score' AND x.arm <> 'score')
    SELECT comparison, metric, {QUANT} FROM (SELECT comparison, {LONG} FROM d) GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    metrics = ["recall", "precision", "fp_per_group"]
    d = bootstrap.paired_differences(additive(spark, sf), metrics, "arm", "score")
    return rounded(bootstrap.intervals(d, metrics, ["comparison"]), "ci_low", "ci_high")


@query(
    "bootstrap_rank_metrics",
    f"""WITH {DRAWS.format(seed=SEED, b=REPLICATES)},
    sc AS (SELECT b, score, coalesce(sum(weight) FILTER (label = 1), 0) AS pos, coalesce(sum(weight) FILTER (label = 0), 0) AS neg
       FROM labelled JOIN weights USING (transcript_id) WHERE split = 'test' GROUP BY ALL),
    curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS all_pos, sum(neg) OVER t AS all_neg
          FROM sc WINDOW w AS (PARTITION BY b ORDER BY score DESC), t AS (PARTITION BY b))
    SELECT b, round(sum(pos::DOUBLE / all_pos * tp / (tp + fp)), 9) AS auprc,
      round(sum(neg::DOUBLE * (tp - pos + pos / 2.0::DOUBLE) / all_pos / all_neg), 9) AS auroc FROM curve GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    rows = durable(test_rows(spark, sf).select("transcript_id", "score", "label"), "test")
    drawn = bootstrap.draw_vectors(rows, "transcript_id", REPLICATES, SEED)
    out = bootstrap.rank_replicates(rows, "score", "label", "transcript_id", drawn)
    return rounded(out, "auprc", "auroc")


@query(
    "bootstrap_win_rate",
    f"""WITH {DRAWS.format(seed=SEED, b=REPLICATES)}, {PAIRS}
    SELECT b, round(sum(weight) FILTER (pos_score > neg_score)::DOUBLE / sum(weight), 9) AS win_rate
    FROM pairs JOIN weights USING (transcript_id) WHERE split = 'test' GROUP BY ALL""",
    "labelled",
)
def _(spark, sf):
    test = ranking.near_pairs(test_rows(spark, sf), ["score"])
    out = bootstrap.win_replicates(test, draws(spark, sf), "transcript_id")
    return rounded(out, "win_rate")
