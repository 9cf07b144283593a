"""Divergence between observed and predicted profiles, in sparse long form.

Rows hold ``obs`` and ``pred`` per key and position; absent rows are zeros in both. Totals are
aggregated and joined back, so no key is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.numeric import EPS, safe_ratio, xlogy


def _share(value: str, total: str):
    return F.col(value) / F.greatest(F.col(total), F.lit(EPS))


def _kl_term(p, q):
    return F.when(p > 0, p * (F.log(p) - F.log(F.greatest(q, F.lit(EPS))))).otherwise(0.0)


def profile_kl(rows: DataFrame, keys: Sequence[str], mask: str | None = None) -> DataFrame:
    """KL of the observed against the predicted profile per key; NULL without observed mass.

    ``mask`` names a flag of rows to leave out of both profiles.
    """
    kept = rows if mask is None else rows.where(~F.col(mask))
    totals = kept.groupBy(*keys).agg(F.sum("obs").alias("_t"), F.sum("pred").alias("_q"))
    terms = _kl_term(_share("obs", "_t"), _share("pred", "_q"))
    return kept.join(totals, list(keys)).groupBy(*keys).agg(
        F.when(F.max("_t") > 0, F.sum(terms)).alias("kl"), F.max("_t").alias("n_obs")
    )


def mean_kl(kls: DataFrame, keys: Sequence[str], windows: DataFrame | None = None) -> DataFrame:
    """Mean over the windows that have a KL, and how many have and have not.

    Sparse tracks have no rows in silent windows: with ``windows``, one row each, those count as skipped too.
    """
    n = F.count(F.lit(1)) if windows is None else F.lit(windows.agg(F.count(F.lit(1))).scalar())
    return kls.groupBy(*keys).agg(
        F.avg("kl").alias("profile_kl"),
        F.count("kl").alias("kl_windows"),
        (n - F.count("kl")).alias("kl_skipped"),
    )


def phase_kl(
    rows: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    *,
    pos: str = "pos",
    block: int = 10,
    length: str = "length",
    mask: str | None = None,
    masked: DataFrame | None = None,
) -> DataFrame:
    """Counts-weighted KL of the three-phase composition per block of codons, per ``by``.

    Blocks lie on the key's own grid; a partial tail, a block with a masked base and a block
    without observations do not count. ``by`` is a subset of ``keys``. ``mask`` flags rows; a masked
    base without reads has no row, so ``masked`` gives the spans themselves: ``start``, ``end``
    on the key's grid, with some or all of ``keys``.
    """
    size = 3 * block
    inside = rows.where(F.col(pos) < F.col(length) - F.col(length) % size)
    b = F.floor(F.col(pos) / float(size)).cast("long")
    hidden = F.max(F.col(mask).cast("int")) if mask else F.lit(0)
    phased = inside.groupBy(*keys, b.alias("_b")).agg(
        *[
            F.sum(F.when(F.col(pos) % 3 == i, F.greatest(F.col(c), F.lit(0.0))).otherwise(0.0)).alias(f"_{c}{i}")
            for c in ("obs", "pred")
            for i in range(3)
        ],
        hidden.alias("_m"),
    )
    n = F.col("_obs0") + F.col("_obs1") + F.col("_obs2")
    q = F.col("_pred0") + F.col("_pred1") + F.col("_pred2")
    kl = F.lit(0.0)
    for i in range(3):
        kl = kl + _kl_term(
            F.col(f"_obs{i}") / F.greatest(n, F.lit(EPS)), F.col(f"_pred{i}") / F.greatest(q, F.lit(EPS))
        )
    if masked is not None:
        own = [k for k in keys if k in masked.columns]
        first, last = (F.floor(F.col(c) / float(size)) for c in ("start", "_last"))
        spans = masked.where("end > start").withColumn("_last", F.col("end") - 1)
        gone = spans.select(*own, F.explode(F.sequence(first, last)).alias("_b")).distinct()
        phased = phased.join(gone, [*own, "_b"], "left_anti")
    counted = phased.where((F.col("_m") == 0) & (n > 0)).select(*by, n.alias("_n"), kl.alias("_kl"))
    return counted.groupBy(*by).agg(
        safe_ratio(F.sum(F.col("_n") * F.col("_kl")), F.sum("_n")).alias("phase_kl"),
        F.sum("_n").alias("n_obs"),
    )


def local_kl(
    rows: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    *,
    pos: str = "pos",
    block: int = 1024,
    length: str = "length",
    count_power: float = 1.0,
    target_power: float = 1.0,
    mask: str | None = None,
) -> DataFrame:
    """Profile KL inside fixed blocks, weighted by a power of the block's observed counts.

    ``target_power`` tempers the observed profile; both powers 1 give the plain weighted form.
    Rows flagged by ``mask`` are zeros in both profiles.
    """
    rows = rows if mask is None else rows.where(~F.col(mask))
    inside = rows.where(F.col(pos) < F.col(length) - F.col(length) % block)
    b = F.floor(F.col(pos) / float(block)).cast("long").alias("_b")
    t = F.when(F.col("obs") > 0, F.pow(F.col("obs"), F.lit(float(target_power)))).otherwise(0.0)
    cut = inside.select(*keys, b, "obs", "pred", t.alias("_t"))
    totals = cut.groupBy(*keys, "_b").agg(
        F.sum("obs").alias("_n"), F.sum("_t").alias("_all_t"), F.sum("pred").alias("_all_q")
    )
    terms = _kl_term(_share("_t", "_all_t"), _share("pred", "_all_q"))
    per_block = cut.join(totals, [*keys, "_b"]).groupBy(*keys, "_b").agg(
        F.sum(terms).alias("_kl"), F.max("_n").alias("_n")
    )
    w = F.pow(F.col("_n"), F.lit(float(count_power)))
    return per_block.where("_n > 0").groupBy(*by).agg(
        safe_ratio(F.sum(w * F.col("_kl")), F.sum(w)).alias("local_kl"),
        F.count(F.lit(1)).alias("n_blocks"),
    )


def poisson_deviance(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean Poisson deviance of the totals per key, and the per-base deviance over the counts."""
    p, t = F.col("pred"), F.col("obs")
    base = 2.0 * (p - t + xlogy(t, t) - xlogy(t, p))
    totals = rows.groupBy(*keys).agg(
        F.sum("pred").alias("pred"), F.sum("obs").alias("obs"), F.sum(base).alias("_base")
    )
    return totals.groupBy(*by).agg(
        F.avg(base).alias("deviance"),
        safe_ratio(F.sum("_base"), F.sum("obs")).alias("deviance_per_count"),
    )


def uniform_kl(rows: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """KL of the observed profile against a flat one over ``length`` bases."""
    totals = rows.groupBy(*keys).agg(F.sum("obs").alias("_t"))
    p = _share("obs", "_t")
    term = F.when(p > 0, p * (F.log(p) - F.log(F.lit(1.0 / length)))).otherwise(0.0)
    return rows.join(totals, list(keys)).groupBy(*keys).agg(
        F.when(F.max("_t") > 0, F.sum(term)).alias("kl"), F.max("_t").alias("n_obs")
    )
