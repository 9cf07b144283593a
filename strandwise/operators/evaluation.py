"""Multi-seed evaluation of feature sets: fit, choose thresholds, apply them once on test rows.

All heads of all arms and seeds are fitted together and scored in one pass. What follows reads a narrow table of
probabilities; metrics of all heads come from one plan, by arm and seed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.arrays import sigmoid
from strandwise.operators import bootstrap, isotonic, multifit, ranking, sampling, scoring
from strandwise.operators.quality import QualityError
from strandwise.session import durable

HEAD = ["arm", "seed"]


def split_operating(rows: DataFrame, group: str, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Calibration and operating rows; a group is never on both sides."""
    first = sampling.group_split(F.col(group), fraction, seed)
    return rows.where(first), rows.where(~first)


@dataclass(frozen=True)
class Run:
    """What one evaluation made: the fits, calibrated heads by arm, thresholds, and test probabilities (long by arm and seed)."""

    fits: Mapping[str, Sequence[multifit.Fit]]
    heads: Mapping[str, Sequence[scoring.Head]]
    thresholds: Mapping[tuple[str, str], float]
    metrics: DataFrame
    scored: DataFrame


def calibrated(logits: Column, heads: Sequence[scoring.Head]) -> Column:
    """Calibrated probability of each head's logit, and their mean as the last entry."""
    knots = [(np.asarray(h.isotonic_x, float), np.asarray(h.isotonic_y, float)) for h in heads]

    @F.pandas_udf("array<double>")
    def values(block: pd.Series) -> pd.Series:
        if not len(block):
            return pd.Series([], dtype="object")
        z = np.vstack(block.to_numpy()).astype(np.float64)
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, 1.0, e) / (1.0 + e)
        out = np.stack([np.interp(p[:, i], x, y) for i, (x, y) in enumerate(knots)], axis=1)
        return pd.Series(list(np.column_stack([out, out.mean(axis=1)])))

    return values(logits)


def _named(arm: str) -> Callable[[Column, Column], Column]:
    return lambda p, seed: F.struct(F.lit(arm).alias("arm"), seed.alias("seed"), p.alias("p"))


def evaluation_run(
    rows: DataFrame,
    arms: Mapping[str, str],
    *,
    seeds: Sequence[int],
    row_id: str = "row_idx",
    label: str = "label",
    group: str = "transcript_id",
    position: str | None = None,
    negative_cap: int = 100_000,
    c: float = 1.0,
    budget: float = 1.0,
) -> Run:
    """Fit, calibrate and test every arm and seed, and the mean of an arm's seeds (``ensemble``).

    ``rows`` has ``split`` (train, val, test) and the feature columns that ``arms`` names. Half of the groups of val
    calibrate, the others choose the threshold: most recall within ``budget`` false positives per group. It is applied
    once to the test rows. With ``position``, ``win_rate`` is the share of near pairs of a group that the positive wins.
    A part without rows, or training rows of one class, raise.
    """
    first = sampling.group_split(F.col(group), 0.5, 0)
    part = F.when(F.col("split") != "val", F.col("split")).when(first, "calibration").otherwise("operating")
    rows = rows.withColumn("part", part).where(F.col("split").isin("train", "val", "test"))
    own = list(dict.fromkeys([row_id, label, group, *([position] if position else [])]))
    train = sampling.cap_members(rows.where("split = 'train'").select(row_id, label, *set(arms.values())), row_id, label, negative_cap, seeds)
    train = durable(train.where(F.exists("members", lambda m: m)), "train")
    if not sampling.both_classes(train, label).first()["has_both"]:
        raise QualityError("training rows must contain both classes")
    fits = multifit.fit_heads(train, arms, "members", label, c=c)
    logits = [
        F.zip_with(scoring.block_logits(F.col(col), [f.coefficients for f in fits[a]]), F.array(*[F.lit(f.intercept) for f in fits[a]]), lambda z, b: z + b).alias(f"z{i}")
        for i, (a, col) in enumerate(arms.items())
    ]
    scored = durable(rows.where("split <> 'train'").select(*own, "part", *logits), "logits")
    sizes = {r["part"]: r["count"] for r in scored.groupBy("part").count().collect()}
    if len(sizes) < 3:
        raise QualityError(f"calibration, operating and test rows are needed, found {sorted(sizes)}")
    heads = {}
    for i, (a, col) in enumerate(arms.items()):
        heads[a] = []
        for k, f in enumerate(fits[a]):
            points = scored.where("part = 'calibration'").select(sigmoid(F.col(f"z{i}")[k]).alias("r"), F.col(label).cast("double").alias("y"))
            heads[a].append(scoring.Head({col: f.coefficients}, f.intercept, *isotonic.knots(isotonic.isotonic_pools(points, "r", "y"))))
    names = [*map(str, seeds), "ensemble"]
    seed_names = F.array(*map(F.lit, names))
    every = F.flatten(F.array(*[
        F.zip_with(calibrated(F.col(f"z{i}"), heads[a]), seed_names, _named(a)) for i, a in enumerate(arms)
    ]))
    wide = durable(scored.where("part <> 'calibration'").select(*own, "part", every.alias("ps")), "scored")
    long = wide.select(*own, "part", F.inline("ps"))
    operating = long.where("part = 'operating'")
    curve = ranking.rank_curve(ranking.score_counts(operating, "p", label, HEAD), HEAD)
    best = ranking.recall_at_budget(curve, ranking.group_counts(operating, group, HEAD), budget, HEAD).collect()  # one row per head
    thresholds = {(r["arm"], r["seed"]): r["threshold"] for r in best}
    cut = F.element_at(F.create_map(*[F.lit(v) for (a, s), t in thresholds.items() for v in (f"{a}\t{s}", float(t))]), F.concat_ws("\t", "arm", "seed"))
    test = long.where("part = 'test'").drop("part").withColumn("threshold", cut)
    metrics = ranking.metric_set(test, "p", label, group, F.col("threshold"), HEAD)
    if position:
        pairs = ranking.near_pairs(wide.where("part = 'test'"), ["ps"], group=group, pos=position, label=label)
        both = pairs.select(F.inline(F.zip_with("pos_ps", "neg_ps", lambda a, b: F.struct(a["arm"].alias("arm"), a["seed"].alias("seed"), a["p"].alias("pos_score"), b["p"].alias("neg_score")))))
        metrics = metrics.join(ranking.win_rate(both, strata=HEAD), HEAD, "left")
    metrics = metrics.withColumn("threshold", cut)
    return Run(fits, heads, thresholds, metrics, test)


def evaluate_arms(rows: DataFrame, arms: Mapping[str, str], **options) -> DataFrame:
    """Test metrics per arm and seed and of the seed ensemble, long by arm (see ``evaluation_run``)."""
    return evaluation_run(rows, arms, **options).metrics


def metric_intervals(
    scored: DataFrame,
    arms: DataFrame,
    *,
    label: str = "label",
    group: str = "transcript_id",
    replicates: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap intervals of threshold metrics per arm; ``arms`` has ``arm, threshold``.

    ``scored`` is long: ``arm, p`` and the label and group of each row.
    """
    weights = bootstrap.draw_arrays(scored, group, replicates, seed)
    stats = bootstrap.group_counts_at(
        scored.join(arms, "arm"), "p", label, group, F.col("threshold"), ["arm"]
    )
    reps = bootstrap.additive_replicates(stats, weights, group, ["arm"])
    return bootstrap.intervals(reps, ["recall", "precision", "fp_per_group"], ["arm"])
