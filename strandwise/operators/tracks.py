"""Sparse coverage tracks: one row per (channel, chrom, strand, pos), zeros absent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.coords import (
    SHIFTED_LIBRARIES,
    candidate_centre,
    downstream,
    strand_shift,
)
from strandwise.functions.numeric import safe_ratio
from strandwise.operators.intervals import in_region, merge_spans, points_in_spans
from strandwise.operators.scans import rolling_sums

# Depth target, score windows and the grid of enrichment offsets.
DEPTH_TARGET = 5e7
PEAK_HALF = 1
CONTEXT_HALF = 30
EPS_GRID = (1e-3, 1 / 61, 0.1, 1.0, 3.0, 10.0, 30.0)
PER_MILLION = 1e6

CHANNEL = ("condition", "library", "strand")


def pile_up(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads per position; counted map-side before the shuffle."""
    return reads.groupBy(*keys, "pos").agg(F.count(F.lit(1)).cast("double").alias("value"))


def canonical(track: DataFrame) -> DataFrame:
    """File positions to canonical positions: the minus strand of TIS and CHX moves back by one."""
    shift = strand_shift(F.col("strand"), F.col("library"))
    return track.withColumn("pos", F.col("pos") - shift)


def file_positions(track: DataFrame) -> DataFrame:
    """Inverse of :func:`canonical`."""
    shift = strand_shift(F.col("strand"), F.col("library"))
    return track.withColumn("pos", F.col("pos") + shift)


def pool_replicates(track: DataFrame) -> DataFrame:
    """Replicates side by side and summed: ``rep1, rep2, value`` per channel and position."""
    rep = lambda r: F.sum(F.when(F.col("rep") == r, F.col("value")).otherwise(0.0))
    return track.groupBy("condition", "library", "chrom", "strand", "pos").agg(
        rep(1).alias("rep1"), rep(2).alias("rep2"), F.sum("value").alias("value")
    )


def expand_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run-length intervals ``(start, end, value)`` to one row per base, summed per base."""
    bases = runs.where(F.col("end") > F.col("start")).select(
        *keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value"
    )
    return bases.groupBy(*keys, "pos").agg(F.sum("value").alias("value"))


def clip_to_size(track: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows inside their chromosome (``sizes``: ``chrom, size``)."""
    return track.join(sizes, "chrom").where(
        (F.col("pos") >= 0) & (F.col("pos") < F.col("size"))
    ).drop("size")


def within_region(track: DataFrame, region: DataFrame) -> DataFrame:
    """Track rows inside a disjoint region (``chrom, start, end``)."""
    return points_in_spans(track, region, ["chrom"], how="left_semi")


def region_totals(track: DataFrame, region: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of the track over a region, both strands."""
    return within_region(track, region).groupBy(*by).agg(F.sum("value").alias("total"))


def depth_scale(track: DataFrame, by: Sequence[str], target: float = DEPTH_TARGET) -> DataFrame:
    """Genome-wide total per ``by`` and the factor that scales it to ``target``."""
    totals = track.groupBy(*by).agg(F.sum("value").alias("total"))
    return totals.withColumn("scale", safe_ratio(F.lit(target), "total"))


def replicate_fractions(track: DataFrame, region: DataFrame) -> DataFrame:
    """Per condition and library: each replicate's total in the region and its share."""
    totals = region_totals(track, region, ["condition", "library", "rep"])
    return totals.withColumn(
        "fraction",
        safe_ratio("total", F.sum("total").over(Window.partitionBy("condition", "library"))),
    )


def dense_windows(
    track: DataFrame, windows: DataFrame, channels: DataFrame, value: str = "value"
) -> DataFrame:
    """Every base of every window and channel, 0 where the track is absent.

    Only for callers that need dense rows; ``channels`` is a small table of channel columns that
    include ``strand``. Output size is windows x length x channels by definition.
    """
    names = channels.columns
    listed = channels.distinct().agg(F.collect_list(F.struct(*names)).alias("_ch"))
    grid = windows.select(
        "chrom",
        F.col("start").alias("window_start"),
        F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"),
    ).withColumn("_ch", F.explode(listed.scalar()))
    grid = grid.select("chrom", "window_start", "pos", "_ch.*")
    values = track.groupBy(*names, "chrom", "pos").agg(F.sum(value).alias(value))
    return grid.join(values, [*names, "chrom", "pos"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def channel_layout(conditions: Sequence[str], libraries: Sequence[str] = ("tis", "chx", "rna")) -> Column:
    """Channels in fixed order (condition, library, strand) as an array of structs."""
    if len(set(libraries)) != len(libraries) or not set(libraries) <= {"tis", "chx", "rna"}:
        raise ValueError(f"unknown or repeated libraries {libraries}")
    rows = [(c, lib, s) for c in conditions for lib in libraries for s in "+-"]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("channel"),
                F.lit(c).alias("condition"),
                F.lit(lib).alias("library"),
                F.lit(s).alias("strand"),
                F.lit(i ^ 1).alias("other_strand"),
            )
            for i, (c, lib, s) in enumerate(rows)
        ]
    )


def expression_spans(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Disjoint unions of expressed and of silent gene spans per condition, chrom and strand."""
    keys = ["condition", "chrom", "strand"]
    on = merge_spans(genes.where(F.col("expressed")), keys)
    off = merge_spans(genes.where(~F.col("expressed")), keys)
    return on, off


def mask_unexpressed(track: DataFrame, genes: DataFrame, name: str = "masked") -> DataFrame:
    """Flag bases covered by a silent gene and by no expressed gene of their condition and strand.

    RNA is never masked. Spans are merged first, so a base meets at most one span of each kind.
    """
    keys = ["condition", "chrom", "strand"]
    on, off = expression_spans(genes)
    flagged = in_region(track, off, keys, name="_silent")
    flagged = in_region(flagged, on, keys, name="_expressed")
    masked = F.col("_silent") & ~F.col("_expressed")
    if "library" in track.columns:
        masked = masked & F.col("library").isin(*SHIFTED_LIBRARIES)
    return flagged.withColumn(name, masked).drop("_silent", "_expressed")


def window_sums_at(
    track: DataFrame,
    points: DataFrame,
    windows: Mapping[str, tuple[int, int]],
    *,
    channel: str = "condition",
    keys: Sequence[str] = ("chrom", "strand"),
) -> DataFrame:
    """Track sums over ``[pos + lo, pos + hi]`` at the distinct positions of ``points``.

    Every channel of the track gets a row per position. Positions and track rows share one
    blocked window, so the cost does not grow with the window width.
    """
    keys = list(keys)
    names = track.select(channel).distinct()
    listed = names.agg(F.collect_list(channel).alias("_ch"))
    asked = points.select(*keys, "pos").distinct().select(
        *keys, "pos", F.explode(listed.scalar()).alias(channel)
    )
    both = (
        track.select(*keys, channel, "pos", F.col("value").alias("_v"), F.lit(0).alias("_q"))
        .unionByName(asked.select(*keys, channel, "pos", F.lit(0.0).alias("_v"), F.lit(1).alias("_q")))
        .groupBy(*keys, channel, "pos")
        .agg(F.sum("_v").alias("_v"), F.max("_q").alias("_q"))
    )
    spec = {n: ("_v", lo, hi) for n, (lo, hi) in windows.items()}
    out = rolling_sums(both, [*keys, channel], "pos", spec)
    return out.where("_q = 1").drop("_v", "_q")


def candidate_scores(
    track: DataFrame, candidates: DataFrame, row_id: str, offset: int
) -> DataFrame:
    """Per candidate and condition: ``peak`` (offset +-1) and ``context`` (mean over +-30).

    ``track`` holds file positions of one library; ``candidates`` has ``gstart``.
    """
    placed = candidates.withColumn(
        "pos", candidate_centre(F.col("gstart"), F.col("strand"), offset)
    )
    sums = window_sums_at(
        track,
        placed,
        {"peak": (-PEAK_HALF, PEAK_HALF), "_context": (-CONTEXT_HALF, CONTEXT_HALF)},
    )
    width = 2 * CONTEXT_HALF + 1
    return placed.select(row_id, "chrom", "strand", "pos").join(
        sums, ["chrom", "strand", "pos"]
    ).select(row_id, "condition", "peak", (F.col("_context") / width).alias("context"))


def score_variants(
    scores: DataFrame,
    row_id: str,
    totals: DataFrame | None = None,
    *,
    eps_grid: Sequence[float] = EPS_GRID,
    reference: str | None = None,
) -> DataFrame:
    """Score variants per candidate: maxima over conditions, and one reference condition alone.

    ``totals`` (``condition, total``) adds the depth-normalised peak.
    """
    rows = scores if totals is None else scores.join(totals, "condition")
    aggs = [F.max("peak").alias("peak_max")]
    if totals is not None:
        norm = F.col("peak") / F.col("total") * PER_MILLION
        aggs.append(F.max(norm).alias("peak_norm_max"))
    enrich = lambda e: F.col("peak") / (F.col("context") + F.lit(float(e)))
    for e in eps_grid:
        aggs.append(F.max(enrich(e)).alias(f"enrich_max_eps{e:g}"))
    if reference is not None:
        mine = F.col("condition") == reference
        aggs.append(F.max(F.when(mine, F.col("peak"))).alias(f"peak_{reference}"))
        for e in eps_grid:
            aggs.append(F.max(F.when(mine, enrich(e))).alias(f"enrich_{reference}_eps{e:g}"))
    return rows.groupBy(row_id).agg(*aggs)


def candidate_score_table(
    candidates: DataFrame,
    track: DataFrame,
    region: DataFrame,
    row_id: str,
    offset: int,
    totals: DataFrame | None = None,
    reference: str | None = None,
) -> DataFrame:
    """All variants per candidate, exactly 0 for candidates outside the region."""
    located = candidates.withColumn(
        "pos", candidate_centre(F.col("gstart"), F.col("strand"), 0)
        - F.when(F.col("strand") == "-", 1).otherwise(0)
    )
    flags = in_region(located.select(row_id, "chrom", "pos"), region, ["chrom"]).select(
        row_id, "covered"
    )
    variants = score_variants(
        candidate_scores(track, candidates, row_id, offset), row_id, totals, reference=reference
    )
    names = [c for c in variants.columns if c != row_id]
    kept = {c: F.when(F.col("covered"), F.col(f"`{c}`")).otherwise(0.0) for c in names}
    return variants.join(flags, row_id).withColumns(kept)


def offset_profile(
    track: DataFrame,
    sites: DataFrame,
    half: int,
    *,
    keys: Sequence[str] = ("chrom", "strand"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Track summed over sites at each offset ``-half..half``, 5' to 3', per ``by`` and strand.

    Sites are first counted per position, so repeated sites cost one join row. Offsets that no
    track row meets are absent.
    """
    counted = sites.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("_n"))
    spans = counted.select(
        *keys,
        F.col("pos").alias("_site"),
        "_n",
        (F.col("pos") - half).alias("start"),
        (F.col("pos") + half + 1).alias("end"),
    )
    hits = points_in_spans(track, spans, list(keys), width=max(64, 4 * half))
    step = F.when(F.col("strand") == "-", F.col("_site") - F.col("pos")).otherwise(
        F.col("pos") - F.col("_site")
    )
    return hits.groupBy(*by, "strand", step.alias("offset")).agg(
        F.sum(F.col("value") * F.col("_n")).alias("total")
    )


def estimate_offset(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Offset with the largest sum; ties go to the most 5' offset."""
    summed = profile.groupBy(*by, "offset").agg(F.sum("total").alias("total"))
    return summed.groupBy(*by).agg(
        F.max_by("offset", F.struct("total", -F.col("offset"))).alias("offset"),
        F.max("total").alias("total"),
    )


def psite_convention(
    profile: DataFrame, starts: DataFrame, expected: int = 0, least: int = 20
) -> DataFrame:
    """One row: peak offset per strand and the verdict on the coordinate convention."""
    peaks = estimate_offset(profile.where("total > 0"), ["strand"])
    counts = starts.groupBy("strand").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c, s: F.max(F.when(F.col("strand") == s, F.col(c)))
    row = counts.join(peaks, "strand", "left").agg(
        one("offset", "+").alias("plus"),
        one("offset", "-").alias("minus"),
        F.coalesce(one("n", "+"), F.lit(0)).alias("n_plus"),
        F.coalesce(one("n", "-"), F.lit(0)).alias("n_minus"),
    )
    shift = F.col("plus") - F.col("minus")
    verdict = (
        F.when((F.col("n_plus") < least) | (F.col("n_minus") < least), "too_few_starts")
        .when(F.col("plus").isNull() | F.col("minus").isNull(), "no_signal")
        .when(shift == 1, "minus_strand_shift")
        .when(shift != 0, "strands_disagree")
        .when(F.col("plus") != expected, "unexpected_offset")
        .otherwise("ok")
    )
    return row.withColumn("verdict", verdict)


def same_convention(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two convention rows place both strands alike."""
    left = a.select("plus", "minus")
    other = b.select(F.struct("plus", "minus").alias("o")).scalar()
    return left.withColumn("other_plus", other["plus"]).withColumn(
        "other_minus", other["minus"]
    ).withColumn(
        "same",
        (F.col("plus") == F.col("other_plus")) & (F.col("minus") == F.col("other_minus")),
    )


def placed_sites(starts: DataFrame, offset: int = 0) -> DataFrame:
    """Sites of starts, moved ``offset`` bases 3'."""
    return starts.withColumn("pos", downstream(F.col("gpos"), F.col("strand"), offset))
