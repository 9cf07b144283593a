"""Counting noise: expected counts, depth matching and seeded draws.

Every draw is seeded by the key of its own block or transcript, so neither partitioning nor a lost
task changes the numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandwise.functions.numeric import safe_ratio
from strandwise.operators.scans import block_of


def expected_counts(pooled: DataFrame, fractions: DataFrame) -> DataFrame:
    """Each replicate's share of a pooled expectation, rounded half to even.

    ``fractions``: ``condition, library, rep, fraction`` (a few rows per condition).
    """
    j = pooled.join(fractions.select("condition", "library", "rep", "fraction"), ["condition", "library"])
    return j.withColumn("expected", F.rint(F.col("value") * F.col("fraction")))


def depth_factors(predicted: DataFrame, real: DataFrame) -> DataFrame:
    """Real over predicted total per condition and library."""
    p = predicted.groupBy("condition", "library").agg(F.sum("value").alias("predicted_total"))
    r = real.groupBy("condition", "library").agg(F.sum("value").alias("real_total"))
    return r.join(p, ["condition", "library"]).withColumn(
        "factor", safe_ratio("real_total", "predicted_total")
    )


def generator(seed: int, *key: object) -> np.random.Generator:
    """A generator that follows from the seed and all 128 bits of the key's digest."""
    digest = hashlib.md5(":".join(map(str, key)).encode()).digest()
    return np.random.default_rng([seed, *np.frombuffer(digest, dtype="<u4")])


def _drawn(rows: DataFrame, keys: list[str], order: list[str], schema: str, draw: Callable[[tuple, pd.DataFrame], np.ndarray]) -> DataFrame:
    """``rows`` with ``value`` replaced by what ``draw`` gives for each group of ``keys``, zeros left out.

    Groups stand together in sorted partitions and pass by in batches: a task holds one batch and one group.
    """
    names = [part.split(":")[0].split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finish() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True)
            parts = [draw(key, part) for key, part in whole.groupby(keys, sort=False)]
            whole["value"] = np.concatenate(parts)
            held.clear()
            return whole.loc[whole["value"] > 0, names]

        for batch in batches:
            if not len(batch):
                continue
            last = (batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut or (held and (held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any()):
                held.append(batch.iloc[:cut])
                yield finish()
            held.append(batch.iloc[cut:])
        if held:
            yield finish()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def draw_counts(expectations: DataFrame, seed: int, copies: int = 1) -> DataFrame:
    """Poisson counts per row: ``copies * Poisson(value / copies)``.

    A channel's block of positions has one generator and is drawn in one call, in the order of its positions.
    """
    channel = ["condition", "library", "rep", "chrom", "strand"]
    keys = [*channel, "pos"]
    schema = expectations.select(*keys).schema.simpleString()[7:-1] + ",value:double"

    def draw(key: tuple, rows: pd.DataFrame) -> np.ndarray:
        rates = np.maximum(rows["value"].to_numpy(float), 0.0) / copies
        return copies * generator(seed, *key).poisson(rates).astype(float)

    blocked = expectations.select(*keys, F.col("value").cast("double").alias("value"), block_of("pos").alias("_blk"))
    return _drawn(blocked, [*channel, "_blk"], ["pos", "value"], schema, draw)


def draw_to_depth(rows: DataFrame, depth: DataFrame | str, seed: int) -> DataFrame:
    """Redistribute each transcript's read count over its positions, in proportion to ``value``.

    One multinomial draw for each transcript, whose work is in proportion to its positions, not to its reads. Its
    positions are one list, and Arrow batches hold many transcripts. ``depth``: ``condition, tx, reads``, or a column of
    ``rows`` whose sum over a transcript is its reads; they are rounded, half to even. ``expected`` is the ``value`` drawn from.
    """
    keys = ["condition", "tx"]
    schema = rows.select(*keys, "tx_pos").schema.simpleString()[7:-1] + ",value:double,expected:double"
    shape = to_arrow_schema(_parse_datatype_string(schema))
    row = F.when(F.col("value") > 0, F.struct("tx_pos", F.col("value").cast("double").alias("value")))
    reads = F.sum(depth) if isinstance(depth, str) else F.lit(None)
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"), reads.alias("reads"))
    if not isinstance(depth, str):
        held = held.drop("reads").join(depth.select(*keys, "reads"), keys)
    held = held.select(*keys, "_rows", F.rint("reads").cast("long").alias("_n")).where("_n > 0 AND size(_rows) > 0")

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("_rows")).to_numpy(zero_copy_only=False)
            pos, value = batch.column("_rows").flatten().flatten()
            share = value.to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            drawn = np.empty(len(share))
            of = zip(batch.column("condition").to_pylist(), batch.column("tx").to_pylist(), batch.column("_n").to_pylist(), ends - sizes, ends, strict=True)
            for condition, tx, n, lo, hi in of:
                part = share[lo:hi]
                drawn[lo:hi] = generator(seed, condition, tx).multinomial(n, part / part.sum())
            at = np.flatnonzero(drawn > 0)
            whose = pa.array(np.repeat(np.arange(len(sizes)), sizes)[at])
            own = [batch.column(c).take(whose) for c in keys]
            columns = [*own, pos.take(pa.array(at)), pa.array(drawn[at]), pa.array(share[at])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return held.mapInArrow(many, schema)
