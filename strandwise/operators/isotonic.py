"""Isotonic calibration, exact: violators are pooled inside blocks of scores, then across the blocks that still violate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators.scans import quantile_edges, with_bucket
from strandwise.session import durable

POOL = "block long, lo double, hi double, total double, weight double"


def pool_adjacent(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbours whose means do not rise are joined, until all rise. Points come in ascending order."""
    out: list[list[float]] = []
    for a, b, t, w in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist(), strict=True):
        now = [a, b, t, w]
        while out and out[-1][2] * now[3] >= now[2] * out[-1][3]:
            last = out.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        out.append(now)
    return tuple(np.array(c, float) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 4


def _pooled(pools: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        made = pool_adjacent(*(rows[c].to_numpy(float) for c in ("lo", "hi", "total", "weight")))
        return pd.DataFrame({"block": np.full(len(made[0]), rows["block"].iloc[0]), **dict(zip(("lo", "hi", "total", "weight"), made, strict=True))})

    return durable(pools.groupBy("block").applyInPandas(run, POOL), "pools")


def _chains(ends: list) -> dict[int, int] | None:
    """Block to the first block of its chain, where a chain's neighbours violate; None if no neighbours do."""
    heads, head, broken = {}, None, False
    for before, row in zip([None, *ends], ends):  # noqa: B905
        if before is not None and before["last"] >= row["first"]:
            broken = True
        else:
            head = row["block"]
        heads[row["block"]] = head
    return heads if broken else None


def isotonic_pools(points: DataFrame, x: str, y: str, weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """(lo, hi, value, weight) of the pools of the rising least-squares fit of ``y`` on ``x``.

    Equal ``x`` are counted first. Every block of scores is pooled by itself; the driver sees one first and one last
    mean a block, and only chains of blocks whose means fall from one to the next are pooled again, from their pools.
    Rows with a null score or label take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    counted = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("lo")).agg(
        F.sum(F.col(y).cast("double") * w).alias("total"), F.sum(w).alias("weight")
    )
    counted = durable(counted.where("weight > 0"), "points")
    pools = with_bucket(counted, "lo", quantile_edges(counted, "lo", buckets), "block")
    pools = _pooled(pools.select("block", "lo", F.col("lo").alias("hi"), "total", "weight"))
    while True:
        mean = F.col("total") / F.col("weight")
        ends = pools.groupBy("block").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).orderBy("block").collect()
        chains = _chains(ends)
        if chains is None:
            return pools.select("lo", "hi", mean.alias("value"), "weight")
        moved = {b: h for b, h in chains.items() if sum(v == h for v in chains.values()) > 1}
        head = F.coalesce(F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in moved.items() for v in kv]), F.col("block")), F.col("block"))
        pools = _pooled(pools.withColumn("block", head))


def knots(pools: DataFrame) -> tuple[list[float], list[float]]:
    """Knots of the fit, ascending: both ends of every pool. They are the calibration, so a head holds them."""
    ends = pools.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), "value").orderBy("x").collect()
    return [r["x"] for r in ends], [r["value"] for r in ends]


def interpolated(value: Column, xs: list[float], ys: list[float]) -> Column:
    """The fit at ``value``, linear between knots and level beyond them."""
    at, to = np.asarray(xs, float), np.asarray(ys, float)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v.to_numpy(float), at, to)).where(v.notna())

    return run(value)
