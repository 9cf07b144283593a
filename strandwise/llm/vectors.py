"""Vectors in packed blocks: one row for each distinct vector, a thousand of them in a row of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A packed block: its cell, the least and largest key in it, and columns of numbers as bytes.
BLOCK = "cell int, lo double, hi double, n int, vecs binary, marks binary, ids binary, counts binary"
FIELDS = [x.split()[0] for x in BLOCK.split(", ")]
#: A hit: the query's 128-bit mark, the candidate and its score.
HIT = "h1 long, h2 long, vec_id long, score {}"


def usable(df: DataFrame, component: Callable[[Column], Column]) -> DataFrame:
    """(vec_id, v) of the rows that have an id and a vector of finite components, ``component`` applied to each as a double.

    Shorter vectors are filled with zeros to the longest one's length.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), component).alias("v"))
    size = rows.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if size[0] != size[1]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size[0]) - F.size("v"))))
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, v, ids): each distinct vector with its ``keep`` smallest ids.

    Of equal vectors only the smallest ids can be among a query's best, so the others need no search; their
    own queries are joined to the vector's result afterwards. Numbering keeps ``keep`` rows before it shuffles.
    """
    nth = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = rows.dropDuplicates(["h1", "h2", "vec_id"]) if keep > 1 else rows
    least = least.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= keep)
    return least.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive rows of the same cell, ``most`` at a time."""
    held: list[pa.RecordBatch] = []
    cell = None
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and held and cell != cells[a]:
                yield pa.Table.from_batches(held)
                held = []
            while a < b:
                cell = cells[a]
                room = most - sum(x.num_rows for x in held)
                held.append(batch.slice(a, min(room, b - a)))
                a += room
                if sum(x.num_rows for x in held) >= most:
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


def pack(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of up to ``most`` rows (cell, key, h1, h2, v, ids) that stand together in the order of cell and key.

    Rows are dealt by ranges of (cell, key, mark), so a cell of any size spreads over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _rows(batches, most):
            part = table.combine_chunks()
            ids = part.column("ids").combine_chunks()
            key = part.column("key").to_numpy()
            marks = np.stack([part.column("h1").to_numpy(), part.column("h2").to_numpy()], axis=1)
            values = [part.column("cell")[0].as_py(), key.min(), key.max(), len(key), matrix(part.column("v").combine_chunks()).astype("<f8").tobytes(), marks.astype("<i8").tobytes(), ids.flatten().to_numpy().astype("<i8").tobytes(), ids.value_lengths().to_numpy().astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], FIELDS)

    dealt = rows.repartitionByRange("cell", "key", "h1").sortWithinPartitions("cell", "key", "h1")
    return dealt.select("cell", "key", "h1", "h2", "v", "ids").mapInArrow(run, BLOCK)


def unpack(block: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """vectors, marks, ids and the number of ids of each vector."""
    n = block[prefix + "n"]
    read = lambda name, kind: np.frombuffer(block[prefix + name], dtype=kind)
    return read("vecs", "<f8").reshape(n, -1), read("marks", "<i8").reshape(n, 2), read("ids", "<i8"), read("counts", "<i8")


def prefixed(blocks: DataFrame, prefix: str, *more: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(prefix + c) for c in [*FIELDS, *more]])


def best(scores: np.ndarray, ids: np.ndarray, counts: np.ndarray, keep: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``keep`` best ids of each row of scores, ties to smaller ids; none below the row's floor.

    Column j of ``scores`` stands for the next counts[j] of ``ids``; an id under several columns counts once, by
    its best score. Columns below the row's keep-th best cannot matter then, since each has an id of its own at least.
    """
    names, place = np.unique(ids, return_inverse=True)
    if len(names) < len(ids) and len(scores):
        by_id = np.argsort(place, kind="stable")
        scores = np.maximum.reduceat(scores[:, np.repeat(np.arange(len(counts)), counts)[by_id]], np.searchsorted(place[by_id], np.arange(len(names))), axis=1)
        ids, counts = names, np.ones(len(names), np.int64)
    if scores.shape[1] > keep:
        least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, -keep]
        floor = least if floor is None else np.maximum(floor, least)
    row, col = np.nonzero(scores >= floor[:, None]) if floor is not None else np.nonzero(np.ones(scores.shape, bool))
    ends = np.cumsum(counts)
    times = counts[col]
    row, score = np.repeat(row, times), np.repeat(scores[row, col], times)
    at = np.repeat(ends[col] - times, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    found = ids[at]
    order = np.lexsort((found, -score, row))
    row, found, score = row[order], found[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    stay = nth < keep
    return row[stay], found[stay], score[stay]


def hits(marks: np.ndarray, row: np.ndarray, found: np.ndarray, score: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(marks[row, 0]), pa.array(marks[row, 1]), pa.array(found), pa.array(score.astype(kind.to_pandas_dtype()), kind)], ["h1", "h2", "vec_id", "score"])


def answers(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best hits of each query's vector without the query itself."""
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("h1"), F.col("h2")).distinct()
    order = [F.col("score").desc(), F.col("vec_id")]
    top = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    top = top.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(F.col("nth") <= k + 1).drop("nth")
    own = asked.join(top, ["h1", "h2"]).where("vec_id <> query_id")
    own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
