"""Composed tables: channel metrics, track quality, scorecard runs and stored runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.numeric import count_if
from strandwise.operators import concordance, intervals, profiles, tracks
from strandwise.operators.scans import block_running, quantile_edges, with_bucket
from strandwise.session import durable

CHANNEL = ["condition", "library", "strand"]


def channel_metrics(
    pooled: DataFrame, genes: DataFrame, windows: DataFrame, *, obs: str, pred: str, total: str
) -> DataFrame:
    """Per channel: mean masked profile KL over windows and gene-level log Pearson.

    ``obs`` and ``pred`` are the profile columns; ``total`` is the predicted column gene totals
    are taken from. Genes count where they lie inside a window; ``genes_excluded`` overlap windows
    but fit in none.
    """
    pooled, genes = durable(pooled, "pooled"), durable(genes, "genes")
    masked = tracks.mask_unexpressed(pooled, genes)
    hits = intervals.points_in_spans(masked, windows, ["chrom"])
    rows = hits.select(
        *CHANNEL, "chrom", F.col("start").alias("window_start"),
        F.col(obs).alias("obs"), F.col(pred).alias("pred"), "masked",
    )
    keys = [*CHANNEL, "chrom", "window_start"]
    kl = profiles.mean_kl(profiles.profile_kl(rows, keys, "masked"), CHANNEL, windows)

    on = genes.where("expressed").select("condition", "gene", "chrom", "strand", "start", "end")
    placed = intervals.assign_windows(on, windows, ["chrom"], ["condition", "gene"])
    counts = placed.groupBy("condition", "strand").agg(
        count_if(F.col("place") == "inside").alias("n_genes"),
        count_if(F.col("place") == "excluded").alias("genes_excluded"),
    )
    inside = placed.where("place = 'inside'").select("condition", "gene", "chrom", "strand", "start", "end")
    sums = intervals.span_sums(
        pooled, inside, ["condition", "chrom", "strand"], {"obs_total": obs, "pred_total": total},
        channels=["library"],
    )
    # Genes without track rows have log1p totals of 0: they enter through the count.
    n = F.max("n_genes").cast("double")
    joined = sums.join(counts, ["condition", "strand"])
    m, r, varies = concordance.corr_agg(F.log1p("pred_total"), F.log1p("obs_total"), n)
    pearson = joined.groupBy(*CHANNEL).agg(
        concordance.pearson_or_null(m, r, varies).alias("log_pearson")
    )
    return (
        kl.join(counts, ["condition", "strand"], "left")
        .join(pearson, CHANNEL, "left")
        .select(*CHANNEL, "profile_kl", "kl_windows", "kl_skipped", "log_pearson", "n_genes", "genes_excluded")
    )


def track_quality(totals: DataFrame, frames: DataFrame) -> DataFrame:
    """Replicate concordance per condition and library; the frame fraction for CHX only.

    ``totals``: ``condition, library, rep1, rep2`` per region; ``frames`` from
    :func:`concordance.frame_fraction` by condition.
    """
    r = concordance.replicate_concordance(totals, ["condition", "library"]).drop("n")
    f = frames.select("condition", "frame_fraction").withColumn("library", F.lit("chx"))
    return r.join(f, ["condition", "library"], "left")


def rna_scaled(rows: DataFrame, rna: DataFrame, scalars: DataFrame, cpm: DataFrame) -> DataFrame:
    """Add the RNA comparator ``rna_scaled`` to spliced rows of each library.

    Its value at a base is the RNA value in counts per million times the fitted scalar. Bases with
    RNA only get a row. ``rows`` and ``rna``: ``condition, library?, tx, tx_pos``.
    """
    known = scalars.withColumnRenamed("evaluated", "condition").join(cpm, "condition")
    scaled = rna.join(known, "condition").select(
        "condition", "library", "tx", "tx_pos",
        (F.col("value") * 1e6 / F.col("genome_total") * F.col("scalar")).alias("rna_scaled"),
    )
    keys = ["condition", "library", "tx", "tx_pos"]
    both = rows.join(scaled, keys, "full_outer")
    numeric = [c for c in both.columns if c not in keys]
    return both.fillna(0.0, numeric)


def stored_run(metrics: DataFrame, strata: DataFrame, cis: DataFrame, arm: str) -> DataFrame:
    """The ensemble row of an arm with its strata and intervals, long by metric.

    ``problem`` is set unless the arm has exactly one ensemble value of each of its metrics.
    """
    own = metrics.where(F.col("arm") == arm)
    mine = own.where(F.col("seed") == "ensemble")
    times = own.groupBy("metric").agg(count_if(F.col("seed") == "ensemble").alias("n"))
    good = times.agg(F.min("n").alias("least"), F.max("n").alias("most")).select(F.expr("least = 1 AND most = 1")).scalar()
    whole = mine.select(F.lit("all").alias("stratum"), "metric", "value")
    parts = strata.where(F.col("arm") == arm).select("stratum", "metric", "value")
    ci = cis.where(F.col("arm") == arm).select(F.lit("all").alias("stratum"), "metric", "ci_low", "ci_high")
    return (
        whole.unionByName(parts)
        .join(ci, ["stratum", "metric"], "left")
        .withColumn("problem", F.when(~F.coalesce(good, F.lit(False)), "not_one_ensemble_row"))
    )


def aligned_calls(calls: DataFrame, rows: DataFrame, row_id: str | Sequence[str], label: str) -> DataFrame:
    """How well a stored call table matches the wanted rows: both sides must agree exactly.

    ``row_id`` is the column, or columns, by which a row is unique on either side.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    a = calls.select(*ids, F.col(label).alias("_a"), F.lit(1).alias("_ia"))
    b = rows.select(*ids, F.col(label).alias("_b"), F.lit(1).alias("_ib"))
    j = a.join(b, ids, "full_outer")
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    return j.agg(
        count_if(both).alias("n_matched"),
        count_if(F.col("_ib").isNull()).alias("only_calls"),
        count_if(F.col("_ia").isNull()).alias("only_rows"),
        count_if(both & (F.col("_a") != F.col("_b"))).alias("label_differs"),
    )


def shard_offsets(index: DataFrame, shard: str, order: str, length: str) -> DataFrame:
    """Offset of each row inside its shard: the lengths before it in ``order`` (numeric).

    Shards are cut into order buckets, so a large shard is not summed in one task.
    """
    cut = with_bucket(index, order, quantile_edges(index, order), "_bucket")
    run = block_running(cut, [shard], "_bucket", [F.col(order)], {"_upto": length})
    return run.withColumn("offset", F.col("_upto") - F.col(length)).drop("_upto", "_bucket")


def examples(
    bases: DataFrame, pooled: DataFrame, expressed: DataFrame, rna_scale: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Model rows per (transcript, condition, base): targets, scaled RNA, expression flag, features.

    ``bases`` is the dense base table with ``gene`` and feature columns; ``expressed`` has one row
    per gene and condition. Library columns are pivoted by conditional sums, not by a join each.
    """
    lib = lambda n: F.sum(F.when(F.col("library") == n, F.col("value")).otherwise(0.0))
    wide = pooled.groupBy("condition", "chrom", "strand", "pos").agg(
        lib("tis").alias("tis"), lib("chx").alias("chx"), lib("rna").alias("rna")
    )
    scaffold = bases.join(expressed.select("gene", "condition", "expressed"), "gene")
    joined = scaffold.join(wide, ["condition", "chrom", "strand", "pos"], "left").join(
        rna_scale.select("condition", "scale"), "condition"
    )
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        "tx", "condition", "tx_pos", "expressed",
        value("tis").alias("tis"), value("chx").alias("chx"),
        (value("rna") * F.col("scale")).alias("rna"), *features,
    )


def examples_in_place(
    bases: DataFrame, pooled: DataFrame, rna_scale: DataFrame, features: Sequence[str]
) -> DataFrame:
    """:func:`examples` of bases that hold their gene's ``conditions``, a list of ``condition, expressed``.

    A position's values travel as one map by condition. They are written first: where they turn out small, the bases are
    not moved, and only then do the conditions multiply them.
    """
    lib = lambda n: F.sum(F.when(F.col("library") == n, F.col("value")).otherwise(0.0))
    wide = pooled.groupBy("condition", "chrom", "strand", "pos").agg(lib("tis").alias("tis"), lib("chx").alias("chx"), lib("rna").alias("_rna"))
    wide = wide.join(rna_scale.select("condition", "scale"), "condition")
    entry = F.struct("condition", F.struct("tis", "chx", (F.col("_rna") * F.col("scale")).alias("rna")))
    at = wide.groupBy("chrom", "strand", "pos").agg(F.map_from_entries(F.collect_list(entry)).alias("_at"))
    each = bases.join(durable(at, "positions"), ["chrom", "strand", "pos"], "left").select("tx", "tx_pos", *features, "_at", F.inline("conditions"))
    held = each.withColumn("_v", F.try_element_at("_at", F.col("condition")))
    value = [F.coalesce(F.col(f"_v.{c}"), F.lit(0.0)).alias(c) for c in ("tis", "chx", "rna")]
    return held.select("tx", "condition", "tx_pos", "expressed", *value, *features)


def rna_scaled_in_place(rows: DataFrame, scalars: DataFrame, cpm: DataFrame) -> DataFrame:
    """Rows of all libraries to rows of the evaluated ones with ``rna_scaled``, as in :func:`rna_scaled` but without a join.

    A row of the RNA library becomes one of each evaluated library, without reads; several rows of a base add up.
    """
    known = scalars.withColumnRenamed("evaluated", "condition").join(cpm, "condition")
    known = known.groupBy("condition").agg(F.collect_list(F.struct("library", "genome_total", "scalar")).alias("_known"))
    zero = F.lit(0.0)
    of = lambda k: F.struct(k["library"].alias("library"), zero.alias("rep1"), zero.alias("rep2"), (F.col("value") * 1e6 / k["genome_total"] * k["scalar"]).alias("rna_scaled"))
    own = F.array(F.struct("library", "rep1", "rep2", zero.alias("rna_scaled")))
    each = F.when(F.col("library") != "rna", own).otherwise(F.transform("_known", of))
    rest = [c for c in rows.columns if c not in ("library", "rep1", "rep2", "value")]
    return rows.join(durable(known, "scalars"), "condition", "left").select(*rest, F.inline(each))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, by a partial aggregate instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")

