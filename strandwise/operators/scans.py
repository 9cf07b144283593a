"""Ordered computations that never put a whole group into one task.

A window over ``PARTITION BY key ORDER BY x`` sends every row of a key to one task. The helpers
here split a key into blocks of bounded size, compute inside blocks, and carry one total per
block. Positional columns use fixed-width blocks; other orders use quantile buckets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096


def block_of(pos: Column | str, width: int = BLOCK) -> Column:
    """Fixed-width block of a position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(float(width))).cast("long")


def bucket_count(df: DataFrame) -> int:
    """How many order buckets to cut: a few per shuffle partition of this session."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, 4 * partitions)


def quantile_edges(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """At most ``buckets`` cut points of ``column`` (one small eager job, column-pruned).

    The edges only balance the work. Results never depend on where they fall.
    """
    n = buckets or bucket_count(df)
    probs = [i / n for i in range(1, n)]
    found = df.approxQuantile(column, probs, 1.0 / (2 * n)) if probs else []
    return sorted(set(found))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Add the order bucket of ``column`` (NULL and NaN are not allowed)."""
    if not edges:
        return df.withColumn(name, F.lit(0).cast("long"))
    splits = [float("-inf"), *edges, float("inf")]
    cast = df.withColumn("_x", F.col(column).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(cast)
    return out.withColumn(name, F.col("_b").cast("long")).drop("_x", "_b")


def block_running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[Column],
    values: Mapping[str, str],
    *,
    descending_blocks: bool = False,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums within ``keys`` in the order of ``block`` then ``order``.

    ``values`` maps an output name to the summed column; ``totals`` maps output names to columns
    whose whole sum per key is wanted too. ``order`` must be total within a block.
    """
    totals = totals or {}
    summed = sorted({*values.values(), *totals.values()})
    per_block = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"_s_{c}") for c in summed])
    key_window = Window.partitionBy(*keys)
    by = F.col(block).desc() if descending_blocks else F.col(block).asc()
    before = key_window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys,
        block,
        *[
            F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_c_{out}")
            for out, c in values.items()
        ],
        *[F.sum(f"_s_{c}").over(key_window).alias(out) for out, c in totals.items()],
    )
    within = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.select("*", *[F.sum(c).over(within).alias(f"_w_{out}") for out, c in values.items()])
    joined = local.join(carry, [*keys, block])
    added = {out: F.col(f"_w_{out}") + F.col(f"_c_{out}") for out in values}
    drop = [f"_w_{o}" for o in values] + [f"_c_{o}" for o in values]
    return joined.withColumns(added).drop(*drop)


def _hot_edges(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Cut points of ``column`` and the values that fill whole buckets by themselves.

    A hot value gets a bucket of its own.
    """
    n = bucket_count(df)
    found = df.approxQuantile(column, [i / n for i in range(1, n)], 1.0 / (2 * n))
    hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    return sorted({*found, *[math.nextafter(v, math.inf) for v in hot]}), hot


def number_rows(
    df: DataFrame,
    column: str,
    ties: Sequence[str] = (),
    *,
    keys: Sequence[str] = (),
    name: str = "ordinal",
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """0-based position of each row in the order of a numeric ``column`` then ``ties``.

    ``keys`` numbers within groups. The order must be total for a reproducible result. Rows that
    share one hot value of ``column`` are cut further by the first tie column if it is numeric.
    """
    hot: list[float] = []
    if edges is None:
        edges, hot = _hot_edges(df, column)
    cut = with_bucket(df, column, edges, "_bucket").withColumn("_one", F.lit(1).cast("long"))
    if hot and ties and isinstance(df.schema[ties[0]].dataType, T.NumericType):
        at = F.col(column).cast("double").isin(hot)
        inner = quantile_edges(cut.where(at), ties[0])
        sub = with_bucket(cut, ties[0], inner, "_sub")
        rank = F.when(at, F.col("_sub")).otherwise(0)
        cut = sub.withColumn("_bucket", F.col("_bucket") * (len(inner) + 2) + rank).drop("_sub")
    out = block_running(
        cut, keys, "_bucket", [F.col(column), *map(F.col, ties)], {name: "_one"}
    )
    return out.withColumn(name, F.col(name) - 1).drop("_bucket", "_one")


def number_keys(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """A bijection of the distinct values of ``key`` to 0..n-1, spread by an md5 prefix."""
    distinct = df.select(key).distinct()
    hashed = distinct.select(
        key,
        F.substring(F.md5(F.col(key).cast("string")), 1, 3).alias("_block"),
        F.lit(1).cast("long").alias("_one"),
    )
    out = block_running(hashed, (), "_block", [F.col(key)], {name: "_one"})
    return out.select(key, (F.col(name) - 1).alias(name))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probs: Mapping[str, float],
    *,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles of the non-NULL values of ``column`` per key.

    Equal values are counted first, and only the buckets that hold a wanted rank are sorted.
    """
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    edges = quantile_edges(counted, "_v") if edges is None else edges
    cut = with_bucket(counted, "_v", edges, "_bucket")
    key_window = Window.partitionBy(*keys)
    earlier = key_window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = [
        f((F.col("_n") - 1) * F.lit(float(p))).cast("long")
        for p in probs.values()
        for f in (F.floor, F.ceil)
    ]
    held = F.lit(False)
    for r in ranks:
        held = held | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))
    wanted = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.sum("_k").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .withColumn("_n", F.sum("_size").over(key_window))
        .where(held)
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.sum("_k").over(within) + F.col("_before")
    ranked = cut.join(wanted, [*keys, "_bucket"]).withColumn("_upto", upto)
    holds = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_k"))
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        low = F.max(F.when(holds(ranks[2 * i]), F.col("_v")))
        high = F.max(F.when(holds(ranks[2 * i + 1]), F.col("_v")))
        at = F.max((F.col("_n") - 1) * F.lit(float(p)))
        aggs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)


def halo(df: DataFrame, pos: str, reach_down: int, reach_up: int, width: int, first: int | None = None) -> DataFrame:
    """Copy each row into every block with a position ``q`` whose window covers it.

    A window is ``[q - reach_down, q + reach_up]``. Adds ``_blk`` and ``_home``. No position lies below ``first``, so
    blocks before it get no copies.
    """
    p = F.col(pos)
    low = p - reach_up if first is None else F.greatest(p - reach_up, F.lit(first))
    blocks = F.sequence(block_of(low, width), block_of(p + reach_down, width))
    return df.withColumn("_blk", F.explode(blocks)).withColumn(
        "_home", F.col("_blk") == block_of(p, width)
    )


def rolling_sums(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    windows: Mapping[str, tuple[str, int, int]],
    *,
    width: int = BLOCK,
    first: int | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Sums over ``[pos + lo, pos + hi]`` of sparse rows, absent positions counting as 0.

    ``windows`` maps an output name to ``(column, lo, hi)``. A window sum is the difference of two
    sums from the block's begin: those frames grow row by row, while a sliding frame would be
    summed afresh for every row. A (key, block) partition holds at most one row per position and
    channel: ``width`` plus the reach. ``first`` is a place below which no row lies, if there is one.
    ``in_place``: see :func:`previous_marked`.
    """
    down = max(0, *[-lo for _, lo, _ in windows.values()])
    up = max(0, *[hi for _, _, hi in windows.values()])
    if in_place:
        spread = df.withColumns({"_blk": F.lit(0), "_home": F.lit(True)})
        w = Window.partitionBy(*keys).orderBy(pos)
    else:
        spread = halo(df, pos, down, up, width, first)
        w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    bounds = {(c, b) for c, lo, hi in windows.values() for b in (lo - 1, hi)}
    named = {f"_to_{i}": cb for i, cb in enumerate(sorted(bounds))}
    upto = {
        n: F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, b)), F.lit(0.0))
        for n, (c, b) in named.items()
    }
    at = {cb: F.col(n) for n, cb in named.items()}
    out = {n: at[(c, hi)] - at[(c, lo - 1)] for n, (c, lo, hi) in windows.items()}
    return spread.withColumns(upto).where("_home").withColumns(out).drop("_blk", "_home", *named)


def previous_marked(
    df: DataFrame, keys: Sequence[str], pos: str, mark: Column, name: str, *, width: int = BLOCK, in_place: bool = False
) -> DataFrame:
    """Last position ``<= pos`` of the key where ``mark`` holds (NULL if none), by blocks.

    With ``in_place`` the rows of a key lie in one partition already, as ``dense_vectors`` leaves them: one running
    window a key, and neither rows nor totals move.
    """
    if in_place:
        upto = Window.partitionBy(*keys).orderBy(pos).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.max(F.when(mark, F.col(pos))).over(upto))
    marked = df.withColumn("_mark", F.when(mark, F.col(pos))).withColumn(
        "_blk", block_of(pos, width)
    )
    key_blocks = Window.partitionBy(*keys).orderBy("_blk")
    carry = (
        marked.groupBy(*keys, "_blk")
        .agg(F.max("_mark").alias("_last"))
        .withColumn(
            "_carry",
            F.max("_last").over(key_blocks.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(*keys, "_blk", "_carry")
    )
    within = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(pos)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = marked.withColumn("_local", F.max("_mark").over(within))
    return (
        local.join(carry, [*keys, "_blk"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_mark", "_blk", "_local", "_carry")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Arrow batches sorted by ``keys`` as ``(key, its slices)``; a run may pass over the ends of batches."""

    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0)) if len(batch) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                yield tuple(batch.column(k)[lo].as_py() for k in keys), batch.slice(lo, hi - lo)

    for key, group in itertools.groupby(slices(), lambda x: x[0]):
        yield key, (part for _, part in group)
