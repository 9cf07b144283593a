"""Ranking metrics over scored, labelled rows, without sorting a group in one task.

Rows are first counted per distinct score (a map-side combined aggregate, so ties and hot scores
shrink), then cumulated over quantile buckets of the score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.numeric import count_if, safe_ratio
from strandwise.operators.scans import block_running, quantile_edges, with_bucket

NEAR = 64


def _positive(label: str) -> Column:
    return F.col(label).cast("boolean")


def score_counts(
    df: DataFrame, score: str, label: str, strata: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``(strata, score, pos, neg)``: weighted positives and negatives per distinct score."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    y = _positive(label)
    zero = F.lit(0).cast("long")
    return df.groupBy(*strata, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y, w).otherwise(zero)).alias("pos"),
        F.sum(F.when(y, zero).otherwise(w)).alias("neg"),
    )


def rank_curve(
    counts: DataFrame, strata: Sequence[str] = (), *, edges: Sequence[float] | None = None
) -> DataFrame:
    """Cumulative ``tp`` and ``fp`` at every distinct score, highest first, and the totals.

    ``edges`` balance the buckets only; pass them to skip the quantile job.
    """
    edges = quantile_edges(counts, "score") if edges is None else edges
    cut = with_bucket(counts, "score", edges, "_bucket")
    return block_running(
        cut,
        strata,
        "_bucket",
        [F.col("score").desc()],
        {"tp": "pos", "fp": "neg"},
        descending_blocks=True,
        totals={"all_pos": "pos", "all_neg": "neg"},
    ).drop("_bucket")


def area_metrics(curve: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """``auprc`` (average precision) and ``auroc`` (tied ranks halved) per stratum."""
    step = F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    above = (F.col("tp") - F.col("pos")) + F.col("pos") / 2.0
    area = F.col("neg") * above / F.col("all_pos").cast("double") / F.col("all_neg")
    has_pos, has_both = F.col("all_pos") > 0, (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    return curve.groupBy(*strata).agg(
        F.sum(F.when(has_pos & (F.col("pos") > 0), step).when(has_pos, 0.0)).alias("auprc"),
        F.sum(F.when(has_both, area)).alias("auroc"),
    )


def group_counts(df: DataFrame, group: str, strata: Sequence[str] = ()) -> DataFrame:
    """Number of distinct groups per stratum (each group is reduced before it is counted)."""
    return df.select(*strata, group).distinct().groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n_groups")
    )


def recall_at_budget(
    curve: DataFrame,
    groups: DataFrame,
    budget: float | Sequence[float],
    strata: Sequence[str] = (),
) -> DataFrame:
    """Largest recall whose false positives per group stay within each budget, in one pass.

    The threshold is the highest one that reaches it. Without positives or a feasible threshold:
    recall 0 at an infinite threshold.
    """
    budgets = [budget] if isinstance(budget, (int, float)) else list(budget)
    if min(budgets) < 0:
        raise ValueError("budget must be non-negative")
    infinite = F.raise_error(F.lit("scores must be below infinity"))
    curve = curve.withColumn("score", F.when(F.col("score") == float("inf"), infinite.cast("double")).otherwise(F.col("score")))
    joined = curve.join(groups, list(strata)) if strata else curve.withColumn(
        "n_groups", groups.select("n_groups").scalar()
    )
    n = F.greatest(F.col("n_groups"), F.lit(1))
    row = F.struct("tp", "score", "fp", "all_pos", "n_groups")
    found = F.col("all_pos") > 0
    picks = [
        F.max(F.when(found & (F.col("fp") / n <= b), row)).alias(f"_{i}")
        for i, b in enumerate(budgets)
    ]
    pairs = [
        F.struct(F.lit(float(b)).alias("budget"), F.col(f"_{i}").alias("b"))
        for i, b in enumerate(budgets)
    ]
    best = joined.groupBy(*strata).agg(*picks).select(*strata, F.inline(F.array(*pairs)))
    return best.select(
        *strata,
        F.coalesce(F.col("b.tp") / F.col("b.all_pos"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("b.score"), F.lit(float("inf"))).alias("threshold"),
        F.coalesce(
            F.col("b.fp") / F.greatest(F.col("b.n_groups"), F.lit(1)), F.lit(0.0)
        ).alias("fp_per_group"),
        "budget",
    )


def threshold_metrics(
    df: DataFrame,
    score: str,
    label: str,
    group: str,
    threshold: Column | float,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Recall, false positives per distinct group and precision at a fixed threshold.

    Rows are reduced to one per (stratum, group) first, so the distinct count needs no expand.
    """
    cut = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    y = _positive(label)
    called = F.col(score) >= cut
    per_group = df.groupBy(*strata, group).agg(
        F.count(F.lit(1)).alias("_n"),
        count_if(y).alias("_p"),
        count_if(called & y).alias("_tp"),
        count_if(called & ~y).alias("_fp"),
    )
    return threshold_summary(per_group, strata)


def threshold_summary(per_group: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Fold per-group counts ``_n, _p, _tp, _fp`` into the threshold metrics."""
    one = F.lit(1).cast("long")
    s = per_group.groupBy(*strata).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"),
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("_tp"), F.lit(0)).alias("true_positives"),
        F.coalesce(F.sum("_fp"), F.lit(0)).alias("false_positives"),
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return s.select(
        "*",
        (tp / F.greatest(F.col("positives"), one)).alias("recall"),
        (fp / F.greatest(F.col("n_groups"), one)).alias("fp_per_group"),
        (tp / F.greatest(tp + fp, one)).alias("precision"),
    )


def reliability(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Mean probability and mean label per equal-width bin; empty bins are NULL.

    Edges are literals built as ``i * (1 / bins)``, so a probability that equals an edge falls in
    the upper bin.
    """
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    p, y = F.col(prob).cast("double"), F.col(label).cast("double")
    filled = df.select(p.alias("p"), y.alias("y")).withColumn(
        "bin", F.size(F.filter(edges, lambda e: e <= F.col("p"))).cast("long")
    )
    per_bin = filled.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("p").alias("confidence"),
        F.avg("y").alias("accuracy"),
        F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("squared_error"),
    )
    scaffold = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return scaffold.join(per_bin, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_summary(bins: DataFrame) -> DataFrame:
    """Brier score and largest gap over the bins that hold rows."""
    return bins.agg(
        safe_ratio(F.sum("squared_error"), F.sum("n")).alias("brier"),
        F.max(F.abs(F.col("confidence") - F.col("accuracy"))).alias("max_gap"),
    )


def near_pairs(
    sites: DataFrame,
    keep: Sequence[str],
    *,
    group: str = "transcript_id",
    pos: str = "mrna_index",
    label: str = "label",
    distance: int = NEAR,
) -> DataFrame:
    """Positives joined to the negatives of their group within ``distance``.

    ``sites`` is unique by (group, pos), so a positive meets at most ``2 * distance`` negatives.
    The join key includes the position bin, so a hot group is spread over its bins.
    """
    cell = F.floor(F.col(pos) / F.lit(float(distance))).cast("long")
    y = _positive(label)
    left = sites.where(y).select(
        group, *[F.col(c).alias(f"pos_{c}") for c in (pos, *keep)], cell.alias("_c")
    )
    left = left.withColumn(
        "_cell", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1))
    ).drop("_c")
    right = sites.where(~y).select(
        group, *[F.col(c).alias(f"neg_{c}") for c in (pos, *keep)], cell.alias("_cell")
    )
    near = F.abs(F.col(f"pos_{pos}") - F.col(f"neg_{pos}")) <= distance
    return left.join(right, [group, "_cell"]).where(near).drop("_cell")


def win_rate(pairs: DataFrame, score: str = "score", strata: Sequence[str] = ()) -> DataFrame:
    """Share of pairs whose positive scores strictly higher."""
    win = F.col(f"pos_{score}") > F.col(f"neg_{score}")
    return pairs.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        count_if(win).alias("n_wins"),
        safe_ratio(count_if(win), F.count(F.lit(1))).alias("win_rate"),
    )


def metric_set(
    df: DataFrame,
    score: str,
    label: str,
    group: str,
    threshold: Column | float,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Threshold metrics with AUPRC and AUROC; AUROC is NULL with one class only."""
    fixed = threshold_metrics(df, score, label, group, threshold, strata)
    areas = area_metrics(rank_curve(score_counts(df, score, label, strata), strata), strata)
    if strata:
        return fixed.join(areas, list(strata))
    return fixed.withColumns({c: areas.select(c).scalar() for c in ("auprc", "auroc")})


def select_variant(table: DataFrame, variants: Sequence[str]) -> DataFrame:
    """The variant with the highest recall, then AUPRC, then first in ``variants``."""
    rank = F.lit(len(variants))
    for i, v in enumerate(variants):
        rank = F.when(F.col("variant") == v, F.lit(i)).otherwise(rank)
    order = F.struct("recall", F.coalesce("auprc", F.lit(-1.0)), -rank)
    return table.where(F.col("variant").isin(*variants)).agg(
        F.max_by(F.struct("variant", "recall", "auprc", "threshold"), order).alias("_v")
    ).select("_v.*")


def coverage_table(df: DataFrame, label: str, covered: str) -> DataFrame:
    """Covered counts and fractions of positives and negatives."""
    name = F.when(_positive(label), "positives").otherwise("negatives")
    return df.groupBy(name.alias("class")).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col(covered)).alias("covered"),
        safe_ratio(count_if(F.col(covered)), F.count(F.lit(1))).alias("fraction"),
    )


def call_summary(calls: DataFrame, label: str, group: str, by: str) -> DataFrame:
    """Counts overall and per ``by`` value; false positives are divided by all groups."""
    y = _positive(label)
    counted = calls.withColumn(by, F.explode(F.array(F.lit("all"), F.col(by)))).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(y).alias("positives"),
        count_if(F.col("called")).alias("n_called"),
        count_if(F.col("called") & y).alias("true_positives"),
        count_if(F.col("called") & ~y).alias("false_positives"),
    )
    n = group_counts(calls, group).select("n_groups").scalar()
    return counted.select(
        "*",
        safe_ratio("true_positives", "positives").alias("recall"),
        safe_ratio("true_positives", "n_called").alias("precision"),
        (F.col("false_positives") / F.greatest(n, F.lit(1))).alias("fp_per_group"),
    )


def agreement(stored: DataFrame, again: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Largest difference between stored and recomputed values of a long metric table."""
    a = stored.select(*keys, F.col("value").alias("_a"))
    b = again.select(*keys, F.col("value").alias("_b"))
    gap = F.max(F.abs(F.col("_b") - F.col("_a")))
    return a.join(b, list(keys)).agg(
        count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_compared"),
        F.coalesce(gap, F.lit(0.0)).alias("max_abs_diff"),
        (F.coalesce(gap, F.lit(0.0)) <= tolerance).alias("ok"),
    )

