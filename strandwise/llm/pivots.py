"""Exact top-k by inner product: vectors keyed by nearest pivot and distance, searched in widening annuli."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandwise.llm.vectors import HIT, answers, best, distinct_vectors, hits, matrix, pack, prefixed, unpack, usable
from strandwise.session import durable


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Points of a sample, each the farthest from those before: they lie in different groups of the data."""
    chosen = [0]
    far = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate gives all vectors the same norm; the order by distance is then that by inner product.

    For candidates x' = (x, sqrt(top - |x|^2)) and a query q' = (q, 0): |q' - x'|^2 = |q|^2 + top - 2 q.x.
    """
    return np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]])


def flat(v: np.ndarray) -> np.ndarray:
    return np.hstack([v, np.zeros((len(v), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles while all partial sums stay below 2^53, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _keyed(points: np.ndarray, top: float | None):
    """Arrow batches of (h1, h2, v, ids) to those with the nearest pivot (cell) and the distance to it (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                d = distances(flat(v) if top is None else lifted(v, top), points)
                cell = d.argmin(axis=1)
                columns = {f: batch.column(f) for f in batch.schema.names}
                yield pa.RecordBatch.from_pydict(columns | {"cell": pa.array(cell, pa.int32()), "key": pa.array(d[np.arange(len(v)), cell])})

    return run


def _search(points: np.ndarray, top: float, keep: int):
    """Pairs of a query block and an index block to hits. With floors, queries whose annulus misses the block are left out.

    The floor of a query is its keep-th best score so far; whatever can still enter its list lies within the
    radius r of that score, so its distance to a pivot p is within d(q, p) - r and d(q, p) + r.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q, marks, _, _ = unpack(pair, "q_")
                x, _, ids, counts = unpack(pair)
                floor = None
                if pair["q_floor"] is not None:
                    floor = np.frombuffer(pair["q_floor"], dtype="<i8")
                    d = distances(flat(q), points[pair["cell"]][None])[:, 0]
                    r = radius(q, floor, top)
                    near = np.flatnonzero((d - r <= pair["hi"]) & (d + r >= pair["lo"]))
                    q, marks, floor = q[near], marks[near], floor[near]
                if len(q):
                    yield hits(marks, *best(products(q, x), ids, counts, keep, floor), pa.int64())

    return run


def radius(q: np.ndarray, floor: np.ndarray, top: float) -> np.ndarray:
    """How far a candidate of at least the score ``floor`` can be, with room for the rounding of distances."""
    square = (q * q).sum(axis=1) + top - 2 * floor.astype(np.float64)
    return np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(top))


def _annuli(points: np.ndarray, top: float, wide: float):
    """Query blocks with floors to (cell, step) of the rings that some query's annulus meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                q = unpack(block, "q_")[0]
                d = distances(flat(q), points)
                r = radius(q, np.frombuffer(block["q_floor"], dtype="<i8"), top)[:, None]
                lo, hi = np.floor(np.maximum(d - r, 0) / wide).min(axis=0), np.floor((d + r) / wide).max(axis=0)
                steps = [np.arange(a, min(b, 2 * np.sqrt(top) / wide) + 1, dtype=np.int64) for a, b in zip(lo, hi, strict=True)]
                n = sum(map(len, steps))
                columns = [pa.array([block["q"]] * n, pa.int64()), pa.array(np.repeat(np.arange(len(points)), list(map(len, steps))), pa.int32()), pa.array(np.concatenate(steps) if n else np.zeros(0, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["q", "cell", "step"])

    return run


def _with_floors(schema: pa.Schema):
    """Query blocks with a list ``floors`` of (h1, h2, floor) to those with q_floor, the floors in the order of the block's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                floors = {(f["h1"], f["h2"]): f["floor"] for f in block["floors"]}
                marks = unpack(block, "q_")[1]
                block["q_floor"] = np.array([floors.get((int(a), int(b)), -(2**62)) for a, b in marks], dtype="<i8").tobytes()
                yield pa.RecordBatch.from_pylist([block], schema)

    return run


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, pivots: int = 64, sample: int = 8192, rows: int = 1024, asked: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query, ties to smaller vec_id.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``; each
    faces all other rows. Distinct vectors are keyed by their nearest pivot and the distance to it, and stand
    in blocks of the same pivot and neighbouring distances. First, each block of queries searches its own
    pivot's annulus at its own distance. The k-th score found is a floor, and the triangle inequality then
    names the annuli of all pivots that can hold anything as good; just those are searched. What
    is left out cannot be among the best, so the result is exact.

    Pivots come from a bounded ``sample`` and only steer the work. Edge cases: vectors that are null or hold
    null or non-finite components, and rows without vec_id, take no part; a zero vector does, and an empty one counts as
    zeros, as do the missing components of shorter vectors; equal vectors are searched once; rows that
    repeat a vec_id are one candidate by their best score, and never their own query's; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    prepared = durable(usable(embeddings.select("vec_id", "embedding"), lambda x: F.floor(F.lit(scale) * x).cast("double")), "vectors")
    asking = prepared.where(F.col("vec_id") % every == 0)
    whole = durable(distinct_vectors(prepared, k + 1).withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "distinct")
    size = whole.agg(F.max("square").alias("top"), F.count("*").alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = float(size["top"])
    part = whole if size["n"] <= sample else whole.where(F.pmod("h1", F.lit(1 << 40)) < int((1 << 40) * sample / size["n"]))
    points = choose_pivots(lifted(np.array([r["v"] for r in part.select("v").orderBy("h1", "h2").limit(2 * sample).collect()]).reshape(-1, len(whole.first()["v"])), top), pivots)
    keyed = "h1 long, h2 long, v array<double>, ids array<long>, cell int, key double"
    index = durable(pack(whole.select("h1", "h2", "v", "ids").mapInArrow(_keyed(points, top), keyed), rows), "index")
    wanted = whole.join(asking.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    blocks = durable(pack(wanted.select("h1", "h2", "v", "ids").mapInArrow(_keyed(points, None), keyed), asked), "query_blocks")
    named = prefixed(blocks, "q_").withColumn("q", F.xxhash64("q_marks"))
    meta = index.select("cell", "lo", "hi", F.xxhash64("marks").alias("b"))
    # first: in the pivot's own cell, the block nearest to the queries' distance; a cell without vectors leaves its queries to the second round
    apart = F.greatest(F.col("lo") - F.col("q_hi"), F.col("q_lo") - F.col("hi"), F.lit(0.0))
    first = named.select("q", "q_cell", "q_lo", "q_hi").join(meta, F.col("q_cell") == F.col("cell")).groupBy("q").agg(F.min_by("b", F.struct(apart, "b")).alias("b"))
    body = index.withColumn("b", F.xxhash64("marks"))
    shape = HIT.format("long")
    no_floor = named.withColumn("q_floor", F.lit(None).cast("binary"))
    found = durable(no_floor.join(first, "q").join(body, "b").mapInArrow(_search(points, top, k + 1), shape), "first_hits")
    nth = F.row_number().over(_by_mark())
    floors = found.withColumn("nth", nth).where(F.col("nth") == k + 1).select("h1", "h2", F.col("score").alias("floor"))
    marks = whole.select("h1", "h2").join(floors, ["h1", "h2"], "left_semi").join(floors, ["h1", "h2"])
    placed = _marks_of(named).join(marks, ["h1", "h2"]).groupBy("q").agg(F.collect_list(F.struct("h1", "h2", "floor")).alias("floors"))
    ready = named.join(placed, "q", "left").withColumn("floors", F.coalesce("floors", F.array().cast("array<struct<h1:bigint,h2:bigint,floor:bigint>>")))
    ready = durable(ready.mapInArrow(_with_floors(to_arrow_schema(no_floor.schema)), no_floor.schema), "floors")
    wide = max(2 * np.sqrt(top), 1.0) / 256
    rings = meta.withColumn("step", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide)))).select("cell", "step", "b")
    meets = ready.mapInArrow(_annuli(points, top, wide), "q long, cell int, step long").join(rings, ["cell", "step"]).select("q", "b").distinct()
    second = ready.join(meets.join(first, ["q", "b"], "left_anti"), "q").join(body, "b").mapInArrow(_search(points, top, k + 1), shape)
    return answers(found.unionByName(durable(second, "second_hits")), asking, k)


def _by_mark() -> WindowSpec:
    return Window.partitionBy("h1", "h2").orderBy(F.col("score").desc(), "vec_id")


def _marks_of(named: DataFrame) -> DataFrame:
    """(q, h1, h2) of the vectors of each query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                marks = np.frombuffer(block["q_marks"], dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([block["q"]] * len(marks), pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1])], ["q", "h1", "h2"])

    return named.select("q", "q_marks").mapInArrow(run, "q long, h1 long, h2 long")
