"""Top-k calls per transcript and their agreement with known starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.codons import CODON_CLASSES
from strandwise.functions.coords import IN_CDS, START_KEY
from strandwise.functions.numeric import count_if, safe_ratio

ALL = "all"
COUNTS = ("n_calls", "n_tp", "n_truth", "n_recalled", "n_truth_unscored")
STRATA = (ALL, *[f"codon_class:{c}" for c in CODON_CLASSES], "cds:in", "cds:out")


def ranked_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """Candidates with their rank per (condition, transcript), ranks up to ``k`` only.

    The rank filter lets Spark keep the best ``k`` per group before the shuffle.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    ties = [c for c in ("chrom", "strand", "codon_class", "region") if c in candidates.columns]
    w = Window.partitionBy("condition", "transcript_id").orderBy(
        F.col("score").desc(), F.col("gpos").asc(), *ties
    )
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_site(calls: DataFrame, keys: Sequence[str] = START_KEY) -> DataFrame:
    """One row per site: the highest score, then the first transcript."""
    rest = [c for c in calls.columns if c not in keys]
    order = F.struct(-F.col("score"), F.col("transcript_id"), *[
        F.col(c) for c in ("rank", "codon_class", "region") if c in rest
    ])
    picked = calls.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def top_k_calls(candidates: DataFrame, k: int) -> DataFrame:
    """The top ``k`` codons per (condition, transcript), one row per called site."""
    return best_per_site(ranked_candidates(candidates, k)).drop("rank")


def _strata(row: Sequence[str] = ("codon_class", "region")) -> Column:
    codon, region = row
    cds = F.when(F.col(region).isin(*IN_CDS), "cds:in").otherwise("cds:out")
    return F.array(F.lit(ALL), F.concat(F.lit("codon_class:"), F.col(codon)), cds)


def _by_stratum(df: DataFrame) -> DataFrame:
    """Three strata x (own condition, pooled) rows per row; aggregated before any shuffle."""
    own = df.withColumn("stratum", F.explode(_strata()))
    return own.withColumn(
        "condition", F.explode(F.array(F.col("condition"), F.lit(ALL)))
    )


def start_hits(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Calls with a flag: the site is a reproducible truth start."""
    known = truth.where("reproducible").select(*START_KEY).distinct()
    return calls.join(known.withColumn("_known", F.lit(True)), list(START_KEY), "left").withColumn(
        "hit", F.coalesce("_known", F.lit(False))
    ).drop("_known")


def truth_coverage(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Reproducible truth of the scored conditions, with ``covered`` and ``called_rank``.

    ``called_rank`` is the smallest rank up to ``k`` at which any transcript calls the site.
    """
    sites = candidates.select(*START_KEY).distinct().withColumn("_covered", F.lit(True))
    called = ranked_candidates(candidates, k).groupBy(*START_KEY).agg(
        F.min("rank").alias("called_rank")
    )
    conditions = candidates.select("condition").distinct()
    wanted = truth.where("reproducible").join(conditions, "condition", "left_semi")
    return (
        wanted.join(sites, list(START_KEY), "left")
        .join(called, list(START_KEY), "left")
        .withColumn("covered", F.coalesce("_covered", F.lit(False)))
        .drop("_covered")
    )


def start_metrics(candidates: DataFrame, truth: DataFrame, ks: Sequence[int] = (1,)) -> DataFrame:
    """Precision and recall of the top ``k`` calls by condition and stratum.

    Precision strata use the call's tags and recall strata the truth's. Recall counts truth that
    is among the candidates; the rest is ``n_truth_unscored``. Candidates are ranked once: a called
    site is one row with its best call at each ``k``, and meets the truth of the site once.
    """
    ks = sorted(set(ks))
    used = candidates.select("transcript_id", *START_KEY, "codon_class", "region", "score")
    order = F.struct(-F.col("score"), "transcript_id", "rank", "codon_class", "region")
    called = ranked_candidates(used, max(ks)).groupBy(*START_KEY).agg(
        F.min("rank").alias("called_rank"),
        *[F.min(F.when(F.col("rank") <= k, order)).alias(f"_best{k}") for k in ks],
    )
    names = candidates.select("condition").distinct()
    known = truth.where("reproducible").join(names, "condition", "left_semi").groupBy(*START_KEY)
    known = known.agg(F.collect_list(F.struct("codon_class", "region")).alias("_known"))
    sites = used.select(*START_KEY).distinct().withColumn("_covered", F.lit(True))
    met = known.join(sites, list(START_KEY), "left").join(called, list(START_KEY), "full")
    covered = F.coalesce("_covered", F.lit(False))
    hit = F.col("_known").isNotNull()

    def entry(k: int, of: Column, *flags: Column) -> Column:
        tags = [of["codon_class"].alias("codon_class"), of["region"].alias("region")]
        named = [f.cast("int").alias(c) for c, f in zip(COUNTS, flags, strict=True)]
        return F.struct(F.lit(k).alias("k"), *tags, *named)

    no, yes = F.lit(False), F.lit(True)
    each = []
    for k in ks:
        best = F.col(f"_best{k}")
        each.append(F.when(best.isNotNull(), F.array(entry(k, best, yes, hit, no, no, no))))
        recalled = covered & F.coalesce(F.col("called_rank") <= k, no)
        each.append(F.transform("_known", lambda t: entry(k, t, no, no, covered, recalled, ~covered)))  # noqa: B023
    rows = met.select("condition", F.inline(F.flatten(F.array_compact(F.array(*each)))))
    sums = _by_stratum(rows).groupBy("k", "condition", "stratum").agg(*[F.sum(c).alias(c) for c in COUNTS])
    conditions = (
        candidates.select("condition")
        .distinct()
        .select(F.explode(F.array(F.col("condition"), F.lit(ALL))).alias("condition"))
        .distinct()
    )
    scaffold = conditions.withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in ks]))
    ).withColumn("stratum", F.explode(F.array(*[F.lit(s) for s in STRATA])))
    keys = ["k", "condition", "stratum"]
    joined = scaffold.join(sums, keys, "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS})
    return filled.select(
        *keys,
        "n_calls",
        "n_tp",
        safe_ratio("n_tp", "n_calls").alias("precision"),
        "n_truth",
        "n_recalled",
        safe_ratio("n_recalled", "n_truth").alias("recall"),
        "n_truth_unscored",
    )


def direction_accuracy(differential: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of differential starts whose predicted change has the right sign, by pair and total.

    ``predictions`` is unique by START_KEY. A predicted change of 0 is wrong.
    """
    site = ["chrom", "strand", "gpos"]
    p = predictions.select("condition", *site, "score")
    a = p.withColumnsRenamed({"condition": "condition_a", "score": "_a"})
    b = p.withColumnsRenamed({"condition": "condition_b", "score": "_b"})
    joined = differential.join(a, ["condition_a", *site], "left").join(
        b, ["condition_b", *site], "left"
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    right = both & (F.signum(F.col("_a") - F.col("_b")) == F.col("direction"))
    counted = joined.groupBy("condition_a", "condition_b").agg(
        count_if(both).alias("n_starts"),
        F.count(F.lit(1)).alias("n_differential"),
        count_if(right).alias("n_correct"),
    )
    total = counted.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("n_starts", "n_differential", "n_correct")
        ]
    ).select(F.lit(ALL).alias("condition_a"), F.lit(ALL).alias("condition_b"), "*")
    return counted.unionByName(total).withColumn(
        "accuracy", safe_ratio("n_correct", "n_starts")
    )
