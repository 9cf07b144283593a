"""Half-open interval operators.

A range predicate alone plans a nested-loop join. Joins here add a bin column so that Catalyst
plans a hash or sort-merge join, which adaptive execution can split when a bin is hot. Sums over
spans use two prefix lookups per span instead of a join, so their cost does not depend on how
long or how many the overlapping spans are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.scans import BLOCK, block_of, block_running

BIN = 1024


def _prefixed(df: DataFrame, prefix: str, skip: Sequence[str]) -> DataFrame:
    return df.select(
        [F.col(c) if c in skip else F.col(c).alias(f"{prefix}{c}") for c in df.columns]
    )


def span_bins(start: Column, end: Column, width: int) -> Column:
    """Bins touched by ``[start, end)``."""
    return F.sequence(block_of(start, width), block_of(end - 1, width))


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    *,
    pos: str = "pos",
    start: str = "start",
    end: str = "end",
    width: int = BIN,
    how: str = "inner",
) -> DataFrame:
    """Join points to the spans that contain them (``how`` inner, left, left_semi, left_anti)."""
    left = points.withColumn("_bin", block_of(pos, width))
    right = _prefixed(spans, "_r_", [*keys, start, end]).where(F.col(end) > F.col(start))
    right = right.withColumn("_bin", F.explode(span_bins(F.col(start), F.col(end), width)))
    right = right.withColumnRenamed(start, "_rs").withColumnRenamed(end, "_re")
    for k in keys:
        right = right.withColumnRenamed(k, f"_k_{k}")
    right = right.withColumnRenamed("_bin", "_rbin")
    on = (F.col("_bin") == F.col("_rbin")) & (F.col(pos) >= F.col("_rs")) & (
        F.col(pos) < F.col("_re")
    )
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    out = left.join(right, on, how).drop("_bin")
    if how in ("left_semi", "left_anti"):
        return out
    out = out.drop("_rbin", *[f"_k_{k}" for k in keys])
    renames = {"_rs": start, "_re": end}
    for c in spans.columns:
        if c not in (*keys, start, end):
            renames[f"_r_{c}"] = c
    return out.withColumnsRenamed(renames)


def overlaps(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    start: str = "start",
    end: str = "end",
    width: int = BIN,
    prefix: str = "r_",
) -> DataFrame:
    """Every overlapping pair once; right columns other than ``keys`` get ``prefix``.

    A pair that shares several bins is kept only in the later of its two first bins.
    """
    a = left.where(F.col(end) > F.col(start)).withColumn(
        "_bin", F.explode(span_bins(F.col(start), F.col(end), width))
    )
    b = _prefixed(right, prefix, keys).where(F.col(f"{prefix}{end}") > F.col(f"{prefix}{start}"))
    rs, re = F.col(f"{prefix}{start}"), F.col(f"{prefix}{end}")
    b = b.withColumn("_bin", F.explode(span_bins(rs, re, width)))
    first = F.greatest(block_of(F.col(start), width), block_of(rs, width))
    pairs = a.join(b, [*keys, "_bin"])
    kept = (F.col(start) < re) & (F.col(end) > rs) & (F.col("_bin") == first)
    return pairs.where(kept).drop("_bin")


def overlap_totals(
    spans: DataFrame, others: DataFrame, keys: Sequence[str], *, start: str = "start", end: str = "end", width: int = BLOCK
) -> DataFrame:
    """Add to each span how many of ``others`` it overlaps (``n``) and the bases shared with all of them (``shared``).

    No pair is made: others that begin before a span's end, less those that end by its start, and the difference of
    two running depths, both read from sums over positions. Empty spans and spans that meet none are left out.
    """
    mine, theirs = (df.where(F.col(end) > F.col(start)) for df in (spans, others))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    # At one position ends come first, then lookups, then starts: a lookup sees starts before it and ends up to it.
    sides = F.array(
        F.struct(F.col(start).cast("long").alias("_pos"), F.lit(2).alias("_at"), one.alias("_a"), zero.alias("_b")),
        F.struct(F.col(end).cast("long").alias("_pos"), F.lit(0).alias("_at"), zero.alias("_a"), one.alias("_b")),
    )
    met = theirs.select(*keys, F.inline(sides)).groupBy(*keys, "_pos", "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    looked = mine.select(*keys, F.explode(F.array(F.col(start).cast("long"), F.col(end).cast("long"))).alias("_pos")).distinct()
    looked = looked.select(*keys, "_pos", F.lit(1).alias("_at"), zero.alias("_a"), zero.alias("_b"))
    both = met.unionByName(looked).withColumns({"_pd": F.col("_pos") * (F.col("_a") - F.col("_b")), "_blk": block_of("_pos", width)})
    run = block_running(both, keys, "_blk", [F.col("_pos"), F.col("_at")], {"_begun": "_a", "_ended": "_b", "_moved": "_pd"}).where("_at = 1")
    depth = F.col("_pos") * (F.col("_begun") - F.col("_ended")) - F.col("_moved")
    before = run.select(*keys, F.col("_pos").alias(start), F.col("_ended").alias("_e0"), depth.alias("_d0"))
    upto = run.select(*keys, F.col("_pos").alias(end), F.col("_begun").alias("_b1"), depth.alias("_d1"))
    out = mine.join(before, [*keys, start]).join(upto, [*keys, end])
    out = out.withColumns({"n": F.col("_b1") - F.col("_e0"), "shared": F.col("_d1") - F.col("_d0")})
    return out.where("n > 0").select(*spans.columns, "n", "shared")


def merge_spans(
    spans: DataFrame, keys: Sequence[str], *, start: str = "start", end: str = "end"
) -> DataFrame:
    """Union of overlapping or touching spans per key, as disjoint spans.

    Ends are first reduced to the furthest end per start. The running furthest end is carried
    over blocks of starts, so a key is never sorted in one task.
    """
    reach = (
        spans.where(F.col(end) > F.col(start))
        .groupBy(*keys, start)
        .agg(F.max(end).alias(end))
        .withColumn("_blk", block_of(start))
    )
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    carry = (
        reach.groupBy(*keys, "_blk")
        .agg(F.max(end).alias("_end"))
        .select(
            *keys,
            "_blk",
            F.max("_end")
            .over(by_block.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry"),
        )
    )
    within = Window.partitionBy(*keys, "_blk").orderBy(start)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        reach.withColumn("_local", F.max(end).over(earlier))
        .join(carry, [*keys, "_blk"])
        .withColumn("_seen", F.greatest("_local", "_carry"))
        .withColumn(
            "_new",
            F.when(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")), 1)
            .otherwise(0)
            .cast("long"),
        )
        .select(*keys, start, end, "_blk", "_new")
    )
    island = block_running(marked, keys, "_blk", [F.col(start)], {"_island": "_new"})
    return (
        island.groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def in_region(
    points: DataFrame,
    region: DataFrame,
    keys: Sequence[str],
    *,
    pos: str = "pos",
    name: str = "covered",
    width: int = BIN,
) -> DataFrame:
    """Add a flag: the point lies in one of the disjoint spans of ``region``."""
    marks = region.select(*keys, "start", "end", F.lit(True).alias("_hit"))
    out = points_in_spans(points, marks, keys, pos=pos, width=width, how="left")
    return out.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit", "start", "end")


def contained_in_region(
    spans: DataFrame, region: DataFrame, keys: Sequence[str], *, width: int = BIN
) -> DataFrame:
    """Spans that lie inside one span of a disjoint ``region`` (semi join by their start)."""
    hulls = region.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("start").alias("_rs"),
        F.col("end").alias("_re"),
        F.explode(span_bins(F.col("start"), F.col("end"), width)).alias("_rbin"),
    )
    on = (
        (block_of("start", width) == F.col("_rbin"))
        & (F.col("start") >= F.col("_rs"))
        & (F.col("end") <= F.col("_re"))
    )
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return spans.join(hulls, on, "left_semi")


def assign_windows(
    spans: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    span_id: Sequence[str],
    *,
    width: int = BIN,
) -> DataFrame:
    """Each span's containing window with the nearest centre.

    Adds ``window_start``, ``window_end`` and ``place``: ``inside``, ``excluded`` (overlaps a
    window but is inside none) or ``outside``. Ties go to the window that starts first.
    """
    thin = spans.select(*span_id, *keys, "start", "end")
    pairs = overlaps(thin, windows.select(*keys, "start", "end").distinct(), keys, width=width)
    inside = (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    distance = F.abs((F.col("start") + F.col("end")) - (F.col("r_start") + F.col("r_end")))
    best = pairs.groupBy(*span_id).agg(
        F.min(F.when(inside, F.struct(distance, F.col("r_start"), F.col("r_end")))).alias("_best"),
        F.lit(True).alias("_met"),
    )
    return (
        spans.join(best, list(span_id), "left")
        .withColumn("window_start", F.col("_best.r_start"))
        .withColumn("window_end", F.col("_best.r_end"))
        .withColumn(
            "place",
            F.when(F.col("_best").isNotNull(), "inside")
            .when(F.col("_met"), "excluded")
            .otherwise("outside"),
        )
        .drop("_best", "_met")
    )


def owned_spans(windows: DataFrame, key: str = "chrom") -> DataFrame:
    """``[lo, hi)`` of each equal-length window: positions nearest to its own centre.

    Neighbours are looked up through blocks of starts, so no chromosome is sorted in one task.
    """
    rows = windows.select(key, "start", "end").distinct().withColumn("_blk", block_of("start"))
    pair = F.struct(F.col("start"), F.col("end"))
    by_block = Window.partitionBy(key).orderBy("_blk")
    edges = (
        rows.groupBy(key, "_blk")
        .agg(F.min(pair).alias("_first"), F.max(pair).alias("_last"))
        .select(
            key,
            "_blk",
            F.lag("_last").over(by_block).alias("_before"),
            F.lead("_first").over(by_block).alias("_after"),
        )
    )
    w = Window.partitionBy(key, "_blk").orderBy("start", "end")
    near = (
        rows.withColumn("_prev", F.lag(pair).over(w))
        .withColumn("_next", F.lead(pair).over(w))
        .join(edges, [key, "_blk"])
        .withColumn("_prev", F.coalesce("_prev", "_before"))
        .withColumn("_next", F.coalesce("_next", "_after"))
    )

    def boundary(other: str) -> Column:
        total = F.col("start") + F.col("end") + F.col(f"{other}.start") + F.col(f"{other}.end")
        return F.floor((total - 2) / F.lit(4.0)).cast("long") + 1

    lo = F.greatest(F.col("start"), boundary("_prev"))
    hi = F.least(F.col("end"), boundary("_next"))
    return near.select(key, "start", "end", lo.alias("lo"), F.greatest(lo, hi).alias("hi"))


def tile_spans(
    spans: DataFrame, sizes: DataFrame, length: int, stride: int, key: str = "chrom"
) -> DataFrame:
    """Windows of ``length`` every ``stride`` that cover each merged span, kept in bounds.

    ``sizes`` has ``key`` and ``size``. The last window of a span is the first to reach its end.
    """
    merged = merge_spans(spans.select(key, "start", "end"), [key]).join(sizes, key)
    last = F.greatest(F.col("size") - length, F.lit(0).cast("long"))
    steps = F.greatest(
        F.ceil((F.col("end") - F.col("start") - length) / F.lit(float(stride))).cast("long"),
        F.lit(0).cast("long"),
    )
    starts = F.explode(F.sequence(F.lit(0).cast("long"), steps))
    placed = merged.select(key, last.alias("_last"), "start", starts.alias("_i")).select(
        key,
        F.least(
            F.greatest(F.col("start") + F.col("_i") * stride, F.lit(0).cast("long")), "_last"
        ).alias("start"),
    )
    return placed.distinct().withColumn("end", F.col("start") + length)


def span_sums(
    track: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    *,
    channels: Sequence[str] = (),
    pos: str = "pos",
    width: int = BLOCK,
) -> DataFrame:
    """Sum track columns over each span by two prefix lookups.

    ``values`` maps output names to track columns. ``channels`` are track columns that are not
    on the spans: the result then has one row per span and channel. Sums are 0 where no track is.
    """
    per = track.groupBy(*keys, *channels, pos).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"_v_{o}") for o, c in values.items()]
    )
    ends = spans.select(*keys, F.explode(F.array("start", "end")).alias(pos)).distinct()
    if channels:
        # Channels are a dimension of a few names: attached inside each row, not by a join on
        # the few keys, which would put a chromosome in one task.
        listed = track.select(*channels).distinct().agg(F.collect_list(F.struct(*channels)))
        ends = ends.withColumn("_ch", F.explode(listed.scalar())).select(*keys, pos, "_ch.*")
    zero = [F.lit(0.0).alias(f"_v_{o}") for o in values]
    # A lookup row at p comes before the track row at p: the prefix is over positions < p.
    both = per.withColumn("_at", F.lit(1)).unionByName(
        ends.select(*keys, *channels, pos, *zero, F.lit(0).alias("_at"))
    )
    both = both.withColumn("_blk", block_of(pos, width))
    run = block_running(
        both,
        [*keys, *channels],
        "_blk",
        [F.col(pos), F.col("_at")],
        {f"_p_{o}": f"_v_{o}" for o in values},
    ).where("_at = 0")
    look = run.select(*keys, *channels, pos, *[f"_p_{o}" for o in values])

    def side(tag: str, column: str) -> DataFrame:
        names = {f"_p_{o}": f"_{tag}_{o}" for o in values}
        return look.withColumnsRenamed({**names, pos: column})

    out = spans.join(side("a", "start"), [*keys, "start"], "inner" if channels else "left")
    out = out.join(side("b", "end"), [*keys, *channels, "end"], "left")
    sums = {
        o: F.coalesce(F.col(f"_b_{o}") - F.col(f"_a_{o}"), F.lit(0.0)) for o in values
    }
    return out.withColumns(sums).drop(*[f"_{t}_{o}" for t in "ab" for o in values])
