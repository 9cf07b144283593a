"""Known starts: annotation tagging, count cubes and usage differences between conditions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.codons import CODON_CLASSES, codon_class, normalize_codon
from strandwise.functions.coords import (
    REGIONS,
    SITE_KEY,
    bad_flag,
    gpos_from_locus,
    line_of,
    region_of,
    reproducible,
    split_of,
    three_state,
)
from strandwise.functions.numeric import count_if, safe_ratio
from strandwise.operators.quality import count_violations, require_clean
from strandwise.operators.transcripts import cds_bounds, genome_to_tx

MIN_DELTA = 0.1
PAIRINGS = ((1, 1), (2, 2))


def tag_starts(starts: DataFrame, annotation: DataFrame) -> DataFrame:
    """Starts with ``tx_pos`` and ``region`` from their transcript, and what is wrong with them.

    ``annotation`` has one row per ``transcript_id``: ``chrom, strand, exons, cds_start,
    cds_end`` (genomic CDS, half-open). Adds ``problem``, NULL for a good row.
    """
    one = annotation.groupBy("transcript_id").agg(
        F.min_by(
            F.struct("chrom", "strand", "exons", "cds_start", "cds_end"), F.struct("chrom", "cds_start")
        ).alias("_t")
    )
    j = starts.join(one, "transcript_id", "left")
    tx_pos = genome_to_tx(F.col("gpos"), F.col("_t.exons"), F.col("_t.strand"))
    lo, hi = cds_bounds(
        F.col("_t.cds_start"), F.col("_t.cds_end"), F.col("_t.exons"), F.col("_t.strand")
    )
    found = j.withColumn("_pos", tx_pos).withColumn("_lo", lo).withColumn("_hi", hi)
    stated = F.col("tx_pos") if "tx_pos" in starts.columns else F.lit(None).cast("long")
    problem = (
        F.when(F.col("_t").isNull(), "unknown_transcript")
        .when(
            (F.col("chrom") != F.col("_t.chrom")) | (F.col("strand") != F.col("_t.strand")),
            "chrom_or_strand_differs",
        )
        .when(F.col("_pos").isNull(), "not_exonic")
        .when(stated.isNotNull() & (stated != F.col("_pos")), "stated_tx_pos_differs")
        .when(F.col("_t.cds_start").isNotNull() & F.col("_lo").isNull(), "cds_not_exonic")
    )
    return (
        found.withColumn("problem", problem)
        .withColumn("region", region_of(F.col("_pos"), F.col("_lo"), F.col("_hi")))
        .withColumn("tx_pos", F.col("_pos"))
        .drop("_t", "_pos", "_lo", "_hi")
    )


def load_truth(raw: DataFrame, annotation: DataFrame) -> DataFrame:
    """Canonical truth table from raw starts; raises on rows that break a rule.

    ``raw``: ``condition, transcript_id, gene, chrom, strand, locus, codon, rep1, rep2`` and
    optionally ``imputed``, ``pause``, ``tx_pos``. Only rows marked imputed are dropped.
    """
    rows = raw
    if "imputed" in raw.columns:
        rows = rows.where(~F.coalesce(three_state(F.col("imputed")), F.lit(False)))
    flags = [c for c in ("rep1", "rep2", "pause") if c in raw.columns]
    bad = {f"bad_{c}": bad_flag(F.col(c)) for c in flags}
    bad["bad_codon"] = normalize_codon(F.col("codon")).isNull()
    require_clean(count_violations(rows, bad), "truth input")
    if "pause" not in raw.columns:
        rows = rows.withColumn("pause", F.lit(None).cast("boolean"))
    rows = rows.withColumns({c: three_state(F.col(c)) for c in flags})
    rows = (
        rows.withColumn("gpos", gpos_from_locus(F.col("locus"), F.col("strand")))
        .withColumn("codon", normalize_codon(F.col("codon")))
        .withColumn("codon_class", codon_class(F.col("codon")))
    )
    tagged = tag_starts(rows, annotation)
    problems = {
        p: F.col("problem") == p
        for p in (
            "unknown_transcript",
            "chrom_or_strand_differs",
            "not_exonic",
            "stated_tx_pos_differs",
            "cds_not_exonic",
        )
    }
    require_clean(count_violations(tagged, problems), "truth and annotation")
    return tagged.select(
        "condition",
        line_of(F.col("condition")).alias("line"),
        "transcript_id",
        "gene",
        "chrom",
        "strand",
        "gpos",
        "tx_pos",
        "codon",
        "codon_class",
        "region",
        "pause",
        "rep1",
        "rep2",
        reproducible(F.col("rep1"), F.col("rep2")).alias("reproducible"),
        split_of(F.col("chrom")).alias("split"),
    )


def count_cube(truth: DataFrame) -> DataFrame:
    """Counts by condition x codon class x region x reproducible, zeros included."""
    counted = truth.groupBy("condition", "codon_class", "region", "reproducible").agg(
        F.count(F.lit(1)).alias("n")
    )
    scaffold = (
        truth.select("condition")
        .distinct()
        .withColumn("codon_class", F.explode(F.array(*[F.lit(c) for c in CODON_CLASSES])))
        .withColumn("region", F.explode(F.array(*[F.lit(r) for r in REGIONS])))
        .withColumn("reproducible", F.explode(F.array(F.lit(True), F.lit(False))))
    )
    keys = ["condition", "codon_class", "region", "reproducible"]
    return scaffold.join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def usage_shares(counts: DataFrame, group: str = "gene") -> DataFrame:
    """Share of each count in its (condition, replicate, group) total; NULL where that is 0.

    Totals are aggregated and joined back, so a hot group is never gathered in one task.
    """
    keys = ["condition", "rep", group]
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total"))
    return (
        counts.join(totals, keys)
        .withColumn("share", safe_ratio("count", "_total"))
        .drop("_total")
    )


def share_matrix(shares: DataFrame, conditions: Sequence[str], reps: Sequence[int]) -> DataFrame:
    """One row per site with a column ``<condition>_<rep>``; repeated rows are counted."""
    cols = []
    for c in conditions:
        for r in reps:
            mine = (F.col("condition") == c) & (F.col("rep") == r)
            cols.append(F.max(F.when(mine, F.col("share"))).alias(f"{c}_{r}"))
    return shares.groupBy(*SITE_KEY).agg(*cols)


def condition_pairs(conditions: DataFrame, order: str = "condition") -> DataFrame:
    """All unordered pairs (a before b in ``order``) of the condition dimension.

    The distinct conditions are a dimension of a handful of names, held as one array.
    """
    names = conditions.select(F.col(order).alias("o"), "condition").distinct()
    listed = names.agg(F.array_sort(F.collect_list(F.struct("o", "condition"))).alias("c"))
    first = listed.select("c", F.posexplode("c").alias("i", "a"))
    later = F.explode(F.slice(F.col("c"), F.col("i") + 2, F.size("c")))
    return first.select(F.col("a.condition").alias("condition_a"), later.alias("b")).select(
        "condition_a", F.col("b.condition").alias("condition_b")
    )


def pair_deltas(
    shares: DataFrame,
    conditions: Sequence[str],
    pairings: Sequence[tuple[int, int]] = PAIRINGS,
) -> DataFrame:
    """Per site and condition pair: one delta per replicate pairing (NULL where missing).

    The site's shares are first reduced to a map keyed by condition and replicate; pairs are then
    generated inside the row from the fixed condition list, so no self join is needed.
    """
    reps = sorted({r for p in pairings for r in p})
    wide = share_matrix(shares, conditions, reps)
    pairs = [
        F.struct(
            F.lit(a).alias("condition_a"),
            F.lit(b).alias("condition_b"),
            *[
                (F.col(f"`{a}_{ra}`") - F.col(f"`{b}_{rb}`")).alias(f"delta_{ra}_{rb}")
                for ra, rb in pairings
            ],
        )
        for i, a in enumerate(conditions)
        for b in conditions[i + 1 :]
    ]
    return wide.select(*SITE_KEY, F.inline(F.array(*pairs)))


def _verdict(pairings: Sequence[tuple[int, int]], min_delta: float) -> tuple[Column, Column, Column]:
    cols = [F.col(f"delta_{a}_{b}") for a, b in pairings]
    tested = reduce(lambda x, y: x & y, [c.isNotNull() for c in cols])
    low = cols[0] if len(cols) == 1 else F.least(*cols)
    high = cols[0] if len(cols) == 1 else F.greatest(*cols)
    return tested, tested & (low >= min_delta), tested & (high <= -min_delta)


def differential_starts(
    shares: DataFrame,
    conditions: Sequence[str],
    min_delta: float = MIN_DELTA,
    pairings: Sequence[tuple[int, int]] = PAIRINGS,
) -> DataFrame:
    """Starts whose share differs by ``min_delta`` the same way in every pairing, per pair."""
    deltas = pair_deltas(shares, conditions, pairings)
    _, up, down = _verdict(pairings, min_delta)
    names = [f"delta_{a}_{b}" for a, b in pairings]
    mean = reduce(lambda x, y: x + y, [F.col(n) for n in names]) / float(len(names))
    return deltas.where(up | down).select(
        "condition_a",
        "condition_b",
        *SITE_KEY,
        *names,
        mean.alias("delta"),
        F.when(up, 1).otherwise(-1).alias("direction"),
    )


def count_differential(
    shares: DataFrame,
    conditions: Sequence[str],
    min_delta: float = MIN_DELTA,
    pairings: Sequence[tuple[int, int]] = PAIRINGS,
) -> DataFrame:
    """Tested, a-higher, b-higher and differential counts per pair; pairs without hits stay."""
    tested, up, down = _verdict(pairings, min_delta)
    return (
        pair_deltas(shares, conditions, pairings)
        .groupBy("condition_a", "condition_b")
        .agg(
            count_if(tested).alias("n_tested"),
            count_if(up).alias("n_a_higher"),
            count_if(down).alias("n_b_higher"),
            count_if(up | down).alias("n_differential"),
        )
    )


def share_violations(shares: DataFrame) -> DataFrame:
    """Repeated (condition, replicate, site) rows."""
    repeated = shares.groupBy("condition", "rep", *SITE_KEY).count().where("count > 1")
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("repeated_share").alias("rule"), "violations"
    )
