"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.vectors import HIT, answers, best, distinct_vectors, hits, matrix, pack, prefixed, unpack, usable
from strandwise.session import durable


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class Tree:
    """Centres of all nodes, the children of each inner node, the number of each leaf; node 0 is the root."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, points: np.ndarray, branches: int, most: int, rng: np.random.Generator) -> int:
        """Split ``points`` by k-means until ``most`` or fewer are left; returns the new node's number."""
        node = len(self.centres)
        self.centres.append(points.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        group = kmeans(points, branches, rng) if len(points) > most else None
        if group is None or not group.any():
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self.grow(points[group == g], branches, most, rng) for g in np.unique(group)]
        return node

    def route(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest child at each level."""
        out = np.empty(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = self.children[node]
            near = nearest(v[rows], np.array([self.centres[c] for c in own]))
            todo.extend((c, rows[near == i]) for i, c in enumerate(own))
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search: the nearest open node of the whole tree comes next."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for c in self.children[node]:
                d = q - self.centres[c]
                heapq.heappush(queue, (float(d @ d), c))


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The group of each point after some rounds of Lloyd's method."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    group = nearest(points, centres)
    for _ in range(rounds):
        centres = np.array([points[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(len(centres))])
        now = nearest(points, centres)
        if (now == group).all():
            break
        group = now
    return group


def _routed(tree: Tree):
    """Arrow batches of (h1, h2, v, ids) to those with their leaf (cell); the key keeps a leaf's order free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = tree.route(unit(matrix(batch.column("v"))))
                columns = {f: batch.column(f) for f in batch.schema.names}
                yield pa.RecordBatch.from_pydict(columns | {"cell": pa.array(cell, pa.int32()), "key": pa.array(np.zeros(len(cell)))})

    return run


def _leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index blocks to (leaf, id)."""
    for batch in batches:
        for cell, ids in zip(batch.column("cell").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            found = np.frombuffer(ids, dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cell), pa.int32()), pa.array(found)], ["cell", "id"])


def _asked(tree: Tree, most: int, held: dict[int, int], keep: int):
    """Each query vector to the leaves it visits: ``most``, and more until these hold ``keep`` candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for i, q in enumerate(unit(matrix(batch.column("v"))) if batch.num_rows else []):
                found = 0
                for n, leaf in enumerate(tree.visits(q)):
                    if n >= most and found >= keep:
                        break
                    found += held.get(leaf, 0)
                    rows.append(i)
                    cells.append(leaf)
            columns = {f: batch.column(f).take(pa.array(rows, pa.int64())) for f in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"cell": pa.array(cells, pa.int32()), "key": pa.array(np.zeros(len(cells)))})

    return run


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))


def _search(keep: int):
    """Pairs of a query block and an index block to the best hits of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q, marks, _, _ = unpack(pair, "q_")
                x, _, ids, counts = unpack(pair)
                yield hits(marks, *best(cosines(q, x), ids, counts, keep), pa.float64())

    return run


def _brute(queries: np.ndarray, keep: int):
    """Index blocks to (query, id, leaf, score) of their best vectors, each under its least id, for a bounded set of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                x, _, ids, counts = unpack(block)
                row, found, score = best(cosines(queries, x), ids[np.cumsum(counts) - counts], np.ones(len(x), np.int64), keep)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(found), pa.array(np.full(len(row), block["cell"]), pa.int32()), pa.array(score)], ["q", "id", "cell", "score"])

    return run


def calibrate(tree: Tree, index: DataFrame, queries: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaf visits with which ``recall`` of the true ``k`` best of ``queries`` are reached.

    Truth is brute force over the whole index. The queries and their k best are bounded, so they may meet
    on the driver. Visits are widened leaf by leaf. The nearest one is the query itself and not counted.
    """

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "cell"))
    found = index.mapInArrow(_brute(queries, k + 1), "q long, id long, cell int, score double")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"), F.min_by("cell", F.struct(-F.col("score"), "cell")).alias("cell")).withColumn("nth", nth)
    true = found.where((F.col("nth") > 1) & (F.col("nth") <= k + 1)).select("q", "cell").toPandas()
    orders = [{leaf: n for n, leaf in enumerate(tree.visits(q))} for q in unit(queries)]
    needed = np.sort([orders[q][c] + 1 for q, c in zip(true["q"], true["cell"], strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def neighbours(embeddings: DataFrame, k: int = 5, every: int = 50, recall: float = 0.97, branches: int = 8, leaf: int = 128, sample: int = 16_384, tests: int = 256, rows: int = 1024, asked: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by cosine of each query, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all other rows. The tree is
    grown on a bounded ``sample`` of distinct vectors, and every row is routed to a leaf. A query takes leaves
    from a priority queue of centre distances; how many is calibrated by brute force over all rows for
    ``tests`` other vectors, so that ``recall`` of their true neighbours are met. Queries meet the blocks of
    their leaves in packed pairs. Scores are cosines of the original vectors in doubles.

    Edge cases: vectors that are null, zero or empty or hold null or non-finite components, and rows without
    vec_id, take no part; shorter vectors count as filled with zeros; equal vectors are searched once;
    a repeated vec_id is one candidate by its best score; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    prepared = usable(embeddings.select("vec_id", "embedding"), lambda x: x)
    prepared = durable(prepared.where(F.exists("v", lambda x: x != 0)), "vectors")
    asking = prepared.where(F.col("vec_id") % every == 0)
    whole = durable(distinct_vectors(prepared, k + 1), "distinct")
    n = whole.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = F.pmod("h1", F.lit(1 << 40))
    some = whole if n <= sample else whole.where(drawn < int((1 << 40) * sample / n))
    points = np.array([r["v"] for r in some.select("v").orderBy("h1", "h2").limit(2 * sample).collect()])
    tree = Tree()
    tree.grow(unit(points), branches, leaf, np.random.default_rng(7))
    keyed = "h1 long, h2 long, v array<double>, ids array<long>, cell int, key double"
    index = durable(pack(whole.select("h1", "h2", "v", "ids").mapInArrow(_routed(tree), keyed), rows), "index")
    # by leaf, the ids that stand in no other: as many rows as leaves
    own = index.mapInArrow(_leaf_ids, "cell int, id long").groupBy("id").agg(F.min("cell").alias("cell"), F.max("cell").alias("last")).where("cell = last")
    held = {r["cell"]: r["n"] for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod("h2", F.lit(1 << 40))
    test = whole if n <= tests else whole.where(drawn < int((1 << 40) * tests / n))
    test = np.array([r["v"] for r in test.select("v").limit(2 * tests).collect()]).reshape(-1, points.shape[1])
    most = calibrate(tree, index, test, k, recall)
    wanted = whole.join(asking.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    blocks = pack(wanted.select("h1", "h2", "v", "ids").mapInArrow(_asked(tree, most, held, k + 1), keyed), asked)
    pairs = prefixed(durable(blocks, "query_blocks"), "q_").join(index, F.col("q_cell") == F.col("cell"))
    return answers(durable(pairs.mapInArrow(_search(k + 1), HIT.format("double")), "hits"), asking, k)
