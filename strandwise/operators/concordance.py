"""Agreement of tracks and predictions with a replicate, gene by gene and base by base.

Transcript rows are sparse: ``condition, library, tx, tx_pos, rep1, rep2`` and one column per
source. Every mean and correlation divides by the transcript's length, not by its row count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.numeric import (
    corr_agg,
    count_if,
    pearson_or_null,
    pearson_or_zero,
    percent_of,
    safe_ratio,
)
from strandwise.operators.scans import exact_quantiles
from strandwise.session import bucketed, durable

# Bins and read limits of the scorecard.
BIN = 30
MIN_READS = 50
MIN_FRAME_READS = 5
SCALES = ("gene", "gene_mrna", "bin30", "codon", "nt", "frame")
GROUP = ("condition", "library")
UNIT = [*GROUP, "tx"]


def replicate_concordance(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pearson of ``log1p`` region totals of two replicates; regions without reads count."""
    n, r, varies = corr_agg(F.log1p("rep1"), F.log1p("rep2"))
    return totals.groupBy(*by).agg(
        pearson_or_null(n, r, varies, least=2).alias("replicate_r"), n.cast("long").alias("n")
    )


def log_pearson(totals: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Pearson of ``log1p`` totals; NULL with fewer than three rows or a constant side."""
    n, r, varies = corr_agg(F.log1p(x), F.log1p(y))
    return totals.groupBy(*by).agg(
        pearson_or_null(n, r, varies).alias("log_pearson"), n.cast("long").alias("n")
    )


def frame_fraction(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """In-frame share of the values inside the CDS (``cds_pos`` = offset from the CDS start)."""
    inside = rows.where("cds_pos >= 0 AND cds_pos < cds_length")
    first = F.sum(F.when(F.col("cds_pos") % 3 == 0, F.col(value)).otherwise(0.0))
    return inside.groupBy(*by).agg(
        first.alias("in_frame"),
        F.sum(value).alias("total"),
        safe_ratio(first, F.sum(value)).alias("frame_fraction"),
    )


def unpivot(stats: DataFrame, keys: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """One row per source of columns ``v_source`` with the yardstick ``yard``."""
    rows = [
        F.struct(F.lit(s).alias("source"), F.col(f"v_{s}").alias("value"), F.col("yard").alias("yardstick"))
        for s in sources
    ]
    return stats.select(*keys, "n", F.inline(F.array(*rows)))


def unit_pearson(
    rows: DataFrame,
    units: DataFrame,
    sources: Sequence[str],
    scales: Sequence[str],
    min_reads: float,
) -> DataFrame:
    """Per unit and scale: Pearson of each source and of replicate 1 with replicate 2.

    Scales are ``nt``, ``codon`` (grid on the CDS frame) and ``bin30``. Rows are unique by
    position, so ``nt`` needs no binning; the other grids are binned in one pass. Only units with
    enough replicate-2 reads and two bins are kept.
    """
    columns = ["rep1", "rep2", *sources]
    keys = [*GROUP, "tx"]
    grids = []
    for scale in scales:
        size = {"nt": 1, "codon": 3, "bin30": BIN}[scale]
        offset = F.col("cds_start") % 3 if scale == "codon" else F.lit(0)
        bins = F.floor((F.col("length") - offset) / float(size)).cast("long")
        grids.append(
            F.struct(
                F.lit(scale).alias("scale"),
                bins.alias("_bins"),
                F.lit(size).alias("_size"),
                offset.cast("long").alias("_off"),
            )
        )
    shaped = units.select("condition", "tx", F.explode(F.array(*grids)).alias("_g")).select(
        "condition", "tx", "_g.*"
    )
    enough = rows.groupBy(*keys).agg(F.sum("rep2").alias("_reads")).where(
        F.col("_reads") >= min_reads
    )
    eligible = enough.select(*keys).join(shaped.where("_bins >= 2"), ["condition", "tx"])
    aggs = []
    for c in ["rep1", *sources]:
        m, r, varies = corr_agg(F.col(c), F.col("rep2"), F.max("_bins"))
        aggs.append(pearson_or_zero(m, r, varies).alias(f"r_{c}"))
    parts = []
    if "nt" in scales:
        exact = rows.join(eligible.where("scale = 'nt'"), keys)
        parts.append(exact.groupBy(*keys, "scale").agg(*aggs))
    if set(scales) - {"nt"}:
        bin_ = F.floor((F.col("tx_pos") - F.col("_off")) / F.col("_size")).cast("long")
        binned = (
            rows.join(eligible.where("scale <> 'nt'"), keys)
            .withColumn("_bin", bin_)
            .where((F.col("_bin") >= 0) & (F.col("_bin") < F.col("_bins")))
            .groupBy(*keys, "scale", "_bins", "_bin")
            .agg(*[F.sum(c).alias(c) for c in columns])
        )
        parts.append(binned.groupBy(*keys, "scale").agg(*aggs))
    per_unit = reduce(lambda a, b: a.unionByName(b), parts)
    full = eligible.select(*keys, "scale").join(per_unit, [*keys, "scale"], "left")
    return full.fillna(0.0, [f"r_{c}" for c in ["rep1", *sources]])


def unit_correlations(rows: DataFrame, sources: Sequence[str], scale: str, min_reads: float) -> DataFrame:
    """:func:`unit_pearson` of one scale, from rows of units that hold ``length`` and ``cds_start`` themselves.

    Two aggregates that begin with ``condition, library, tx``: rows that are dealt by transcript stay where they are.
    Several rows of a position add up.
    """
    size = {"nt": 1, "codon": 3, "bin30": BIN}[scale]
    off = F.col("cds_start") % 3 if scale == "codon" else F.lit(0)
    columns = ["rep1", "rep2", *sources]
    bins = rows.groupBy(*UNIT, F.floor((F.col("tx_pos") - off) / float(size)).cast("long").alias("_bin")).agg(
        F.max(F.floor((F.col("length") - off) / float(size)).cast("long")).alias("_bins"), *[F.sum(c).alias(c) for c in columns]
    )
    held = (F.col("_bin") >= 0) & (F.col("_bin") < F.col("_bins"))
    aggs = []
    for c in ["rep1", *sources]:
        m, r, varies = corr_agg(F.when(held, F.col(c)), F.when(held, F.col("rep2")), F.max("_bins"))
        aggs.append(F.coalesce(pearson_or_zero(m, r, varies), F.lit(0.0)).alias(f"r_{c}"))
    stats = bins.groupBy(*UNIT).agg(F.sum("rep2").alias("_reads"), F.max("_bins").alias("_cells"), *aggs)
    enough = (F.col("_reads") >= min_reads) & (F.col("_cells") >= 2)
    return stats.where(enough).select(*UNIT, F.lit(scale).alias("scale"), *[f"r_{c}" for c in ["rep1", *sources]])


def within_rows(
    rows: DataFrame,
    units: DataFrame,
    sources: Sequence[str],
    scales: Sequence[str],
    min_reads: float = MIN_READS,
) -> DataFrame:
    """Exact medians over units of :func:`unit_pearson`, one row per scale and source."""
    per_unit = unit_pearson(rows, units, sources, scales, min_reads)
    names = ["rep1", *sources]
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"r_{c}").alias("r")) for c in names]))
    return medians(per_unit.select(*GROUP, "scale", each), sources)


def medians(long: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Exact medians of the unit correlations ``r`` of each vector ``_c``, one row per scale and source."""
    keys = [*GROUP, "scale"]
    edges = [-1.0 + 2.0 * i / 200 for i in range(1, 200)]  # correlations lie in [-1, 1]
    middle = exact_quantiles(long, [*keys, "_c"], "r", {"m": 0.5}, edges=edges)
    pick = lambda c: F.max(F.when(F.col("_c") == c, F.col("m")))
    stats = middle.groupBy(*keys).agg(
        F.max("n").alias("n"), pick("rep1").alias("yard"), *[pick(s).alias(f"v_{s}") for s in sources]
    )
    return unpivot(stats, keys, sources)


def dominant_phase(a: Column, b: Column, c: Column, least: float) -> Column:
    """Phase with the largest sum; -1 on a tie, without mass or below ``least``."""
    top = F.greatest(a, b, c)
    ties = (a == top).cast("int") + (b == top).cast("int") + (c == top).cast("int")
    good = (ties == 1) & (top > 0) & (a + b + c >= least)
    return F.when(good, F.when(a == top, 0).when(b == top, 1).otherwise(2)).otherwise(-1)


def codon_phases(
    rows: DataFrame, units: DataFrame, columns: Sequence[str], minimum: dict[str, float]
) -> DataFrame:
    """Dominant phase of each column per CDS codon that has any value."""
    j = rows.join(units, ["condition", "tx"])
    p = F.col("tx_pos") - F.col("cds_start")
    whole = F.floor((F.col("cds_end") - F.col("cds_start")) / 3.0) * 3
    j = j.withColumn("_p", p).where((F.col("_p") >= 0) & (F.col("_p") < whole))
    codon = F.floor(F.col("_p") / 3.0).cast("long").alias("codon")
    sums = j.groupBy(*GROUP, "tx", codon).agg(
        *[
            F.sum(F.when(F.col("_p") % 3 == i, F.col(c)).otherwise(0.0)).alias(f"_{c}{i}")
            for c in columns
            for i in range(3)
        ]
    )
    phases = {
        f"phase_{c}": dominant_phase(*[F.col(f"_{c}{i}") for i in range(3)], minimum.get(c, 0.0))
        for c in columns
    }
    return sums.select(*GROUP, "tx", "codon", *[e.alias(n) for n, e in phases.items()])


def spliced_fact(rows: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """The rows of the units with their length and CDS, bucketed by (condition, tx).

    Without ``units`` the rows are those of the units and have length and CDS already, and are not joined.
    """
    own = ["length", "cds_start", "cds_end"]
    joined = rows if units is None else rows.drop(*own).join(units.select("condition", "tx", *own), ["condition", "tx"])
    return bucketed(joined, ["condition", "tx"], "spliced")


def unit_stats(fact: DataFrame, sources: Sequence[str], min_frame_reads: float = MIN_FRAME_READS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per (condition, library, tx): totals and base correlations; codon correlations and phases; bin correlations.

    Three aggregates inside the buckets of ``fact``. Each row says how many replicate-2 reads and grid cells its unit
    has, so whether it counts is decided later. Absent positions and cells count as zeros.
    """
    columns = ["rep1", "rep2", *sources]
    against = [c for c in columns if c != "rep2"]

    def correlations(value: dict[str, Column], cells: Column) -> list[Column]:
        out = []
        for c in against:
            m, r, varies = corr_agg(value[c], value["rep2"], cells)
            out.append(pearson_or_zero(m, r, varies).alias(f"r_{c}"))
        return out

    cds = (F.col("tx_pos") >= F.col("cds_start")) & (F.col("tx_pos") < F.col("cds_end"))
    plain = {c: F.col(c) for c in columns}
    whole = fact.groupBy(*UNIT).agg(
        F.sum("rep2").alias("reads"), F.max("length").alias("cells"), *correlations(plain, F.max("length")),
        *[F.sum(c).alias(f"all_{c}") for c in columns], *[F.sum(F.when(cds, F.col(c))).alias(f"cds_{c}") for c in columns],
    )

    off = F.col("cds_start") % 3
    phase = F.pmod(F.col("tx_pos") - F.col("cds_start"), F.lit(3))
    shape = [F.max(c).alias(c) for c in ("length", "cds_start", "cds_end")]
    codons = fact.groupBy(*UNIT, F.floor((F.col("tx_pos") - off) / 3.0).cast("long").alias("_bin")).agg(
        *shape, *[F.sum(F.when(phase == i, F.col(c)).otherwise(0.0)).alias(f"_{c}{i}") for c in columns for i in range(3)]
    )
    cells = F.floor((F.col("length") - off) / 3.0).cast("long")
    at = F.col("_bin")
    summed = {c: F.col(f"_{c}0") + F.col(f"_{c}1") + F.col(f"_{c}2") for c in columns}
    held = {c: F.when((at >= 0) & (at < cells), v) for c, v in summed.items()}
    first = F.floor((F.col("cds_start") - off) / 3.0)
    coding = (at >= first) & (at < first + F.floor((F.col("cds_end") - F.col("cds_start")) / 3.0)) & (F.col("library") == "chx")
    codons = codons.withColumns({f"_p_{c}": dominant_phase(*[F.col(f"_{c}{i}") for i in range(3)], min_frame_reads if c == "rep2" else 0.0) for c in columns})
    base = coding & (F.col("_p_rep2") >= 0) & (F.col("_p_rep1") >= 0)
    frames = []
    for s in sources:
        ok = base & (F.col(f"_p_{s}") >= 0)
        same = lambda c: F.col(f"_p_{c}") == F.col("_p_rep2")
        frames += [count_if(ok).alias(f"frame_n_{s}"), count_if(ok & same(s)).alias(f"frame_{s}"), count_if(ok & same("rep1")).alias(f"frame_ref_{s}")]
    codon = codons.groupBy(*UNIT).agg(F.sum(summed["rep2"]).alias("reads"), F.max(cells).alias("cells"), *correlations(held, F.max(cells)), *frames)

    bins = fact.groupBy(*UNIT, F.floor(F.col("tx_pos") / float(BIN)).cast("long").alias("_bin")).agg(F.max("length").alias("length"), *[F.sum(c).alias(c) for c in columns])
    cells = F.floor(F.col("length") / float(BIN)).cast("long")
    inside = {c: F.when(F.col("_bin") < cells, F.col(c)) for c in columns}
    binned = bins.groupBy(*UNIT).agg(F.sum("rep2").alias("reads"), F.max(cells).alias("cells"), *correlations(inside, F.max(cells)))
    return durable(whole, "unit_totals"), durable(codon, "unit_codons"), durable(binned, "unit_bins")


def scorecard_of(fact: DataFrame, units: DataFrame, sources: Sequence[str], *, min_reads: float = MIN_READS, min_frame_reads: float = MIN_FRAME_READS) -> DataFrame:
    """Scorecard rows (condition, library, source, scale, value, yardstick, percent, n) of a spliced fact."""
    whole, codon, binned = unit_stats(fact, sources, min_frame_reads)
    names = ["rep1", *sources]
    counts = units.groupBy("condition").agg(F.count(F.lit(1)).alias("_units"))
    parts = []
    for scale, prefix in (("gene", "cds"), ("gene_mrna", "all")):
        totals = whole.where(F.col(f"{prefix}_rep2").isNotNull()).join(counts, "condition")
        n = F.max("_units")
        aggs = []
        for c in names:
            m, r, varies = corr_agg(F.log1p(f"{prefix}_{c}"), F.log1p(f"{prefix}_rep2"), n)
            aggs.append(pearson_or_zero(m, r, varies).alias("yard" if c == "rep1" else f"v_{c}"))
        stats = totals.groupBy(*GROUP).agg(n.alias("n"), *aggs)
        parts.append(unpivot(stats, GROUP, sources).withColumn("scale", F.lit(scale)))
    long = []
    for scale, stats in (("nt", whole), ("codon", codon), ("bin30", binned)):
        enough = stats.where((F.col("reads") >= min_reads) & (F.col("cells") >= 2))
        each = F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"r_{c}").alias("r")) for c in names]))
        long.append(enough.select(*GROUP, F.lit(scale).alias("scale"), each))
    parts.append(medians(reduce(lambda a, b: a.unionByName(b), long), sources))
    frames = F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"frame_n_{s}").alias("_n"), F.col(f"frame_{s}").alias("_same"), F.col(f"frame_ref_{s}").alias("_ref")) for s in sources]))
    frame = codon.select(*GROUP, frames).groupBy(*GROUP, "source").agg(F.sum("_n").alias("n"), safe_ratio(F.sum("_same"), F.sum("_n")).alias("value"), safe_ratio(F.sum("_ref"), F.sum("_n")).alias("yardstick"))
    parts.append(frame.where("n > 0").withColumn("scale", F.lit("frame")))
    columns = ["condition", "library", "source", "scale", "value", "yardstick", "n"]
    card = reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts])
    return card.withColumn("percent", percent_of(F.col("value"), F.col("yardstick")))


def scorecard(
    rows: DataFrame,
    units: DataFrame,
    sources: Sequence[str],
    *,
    min_reads: float = MIN_READS,
    min_frame_reads: float = MIN_FRAME_READS,
) -> DataFrame:
    """All scorecard rows: condition, library, source, scale, value, yardstick, percent, n.

    ``units``: ``condition, tx, length, cds_start, cds_end`` of the transcripts to score.
    """
    units = durable(units, "units")
    return scorecard_of(spliced_fact(rows, units), units, sources, min_reads=min_reads, min_frame_reads=min_frame_reads)


def fit_scalars(totals: DataFrame, conditions: Sequence[str], evaluated: Sequence[str]) -> DataFrame:
    """Pooled signal total over pooled RNA CPM total, per evaluated condition and library.

    ``totals``: ``condition, library, total`` in the training region and ``genome_total`` of the
    RNA library. The evaluated condition never takes part in its own fit.
    """
    pairs = [
        F.struct(F.lit(e).alias("evaluated"), F.lit(c).alias("condition"))
        for e in evaluated
        for c in conditions
        if c != e
    ]
    if not pairs:
        raise ValueError("no fit conditions left")
    picks = totals.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    j = totals.join(picks, "condition")
    cpm = F.col("total") * 1e6 / F.col("genome_total")
    rna = F.sum(F.when(F.col("library") == "rna", cpm))
    by_library = j.groupBy("evaluated", "library").agg(F.sum("total").alias("_sum"))
    base = j.groupBy("evaluated").agg(rna.alias("_rna"))
    return by_library.where("library <> 'rna'").join(base, "evaluated").select(
        "evaluated", "library", safe_ratio("_sum", "_rna").alias("scalar")
    )


def wide_results(
    scores: DataFrame, keys: Sequence[str], conditions: Sequence[str], libraries: Sequence[str], scales: Sequence[str]
) -> DataFrame:
    """One row per ``keys`` with a column per condition x library x scale (percent; frame as value)."""
    names = [f"{c}_{lib}_{s}" for c in conditions for lib in libraries for s in scales]
    names += [f"{c}_chx_frame" for c in conditions]
    cell = F.when(F.col("scale") == "frame", F.col("value")).otherwise(F.col("percent"))
    name = F.concat_ws("_", "condition", "library", "scale")
    return scores.select(*keys, name.alias("_name"), cell.alias("_v")).groupBy(*keys).pivot(
        "_name", names
    ).agg(F.max("_v"))


def primary_scores(wide: DataFrame, condition: str) -> DataFrame:
    """Add ``primary``: the mean of the condition's TIS codon and base percents."""
    return wide.withColumn(
        "primary", (F.col(f"{condition}_tis_codon") + F.col(f"{condition}_tis_nt")) / 2.0
    )


def capped_percent(hit: Column, reference: Column) -> Column:
    """``100 * min(1, hit / reference)``; NULL without a reference."""
    ratio = safe_ratio(hit, reference)
    return F.when(ratio.isNotNull(), 100.0 * F.least(F.lit(1.0), ratio))


def paired_primary(nt_percent: Column, hit: Column, reference: Column) -> Column:
    """Mean of a base percent and a capped peak percent: the primary of a peak criterion."""
    return (nt_percent + capped_percent(hit, reference)) / 2.0
