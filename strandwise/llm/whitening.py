"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.session import durable

#: The largest sum of exact integers that stays in 64 bits.
LONG = (1 << 63) - 1


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows whose vector is there and holds finite numbers only: x is floor(scale * c) as longs.

    Shorter vectors are filled with zeros to the longest one's length. Beyond 64 bits x is the nearest long.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(F.col("embedding").isNotNull() & ~bad)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * scale)).alias("x"))
    short, long = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if short != long:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(long) - F.size("x"))))
    return rows


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L': the largest remaining diagonal entry is the next pivot.

    L has as many columns as ``a`` has rank: it ends where no diagonal entry is left above rounding.
    """
    a = a.copy()
    d = len(a)
    order = np.arange(d)
    least = d * np.finfo(float).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    low = np.zeros((d, d))
    for k in range(d):
        p = k + int(a.diagonal()[k:].argmax())
        if a[p, p] <= least:
            return low[:, :k], order
        if p != k:
            order[[k, p]] = order[[p, k]]
            low[[k, p]] = low[[p, k]]
            a[[k, p]] = a[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def _pairings(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each two of ``n`` columns meet once."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1 : -1], strict=True) if a < n and b < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns of ``low`` rotated in pairs until all are at right angles, longest first."""
    m = low.copy()
    rounds = list(_pairings(m.shape[1]))
    small = max(m.shape[0], 1) * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds:
            a, b = m[:, i], m[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            lean = np.abs(ab) / np.sqrt(np.maximum(aa * bb, np.finfo(float).tiny))
            worst = max(worst, float(lean.max(initial=0.0)))
            turn = lean > small / 4
            zeta = np.where(turn, (bb - aa) / np.where(turn, 2 * ab, 1.0), 0.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            m[:, i], m[:, j] = c * a - c * t * b, c * t * a + c * b
        if worst <= small:
            break
    return m[:, np.argsort(-(m * m).sum(axis=0), kind="stable")]


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: norms and directions of the rotated triangular factor.

    A vector's largest entry is positive, the first of them if several are as large.
    """
    low, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(low)
    values = (turned * turned).sum(axis=0)
    vectors = np.empty_like(turned)
    vectors[order] = turned / np.sqrt(values)
    if vectors.shape[1]:
        top = np.abs(vectors)
        top = (top >= top.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
        vectors *= np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


@dataclass
class Whitening:
    """What is fitted: number and exact sums of the distinct vectors, eigenvalues over their trace, and components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x - sums / n as doubles, and the exact sum over dimensions of (n * x - sums) ** 2, None beyond 64 bits."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        reach = self.n * most + max(map(abs, self.sums), default=0)
        if reach * reach * max(len(self.sums), 1) <= LONG:
            far = self.n * x - np.array(self.sums, np.int64)
            return far / self.n, (far * far).sum(axis=1).tolist()
        far = self.n * x.astype(object) - np.array(self.sums, object)
        exact = [int(v) for v in (far * far).sum(axis=1)]
        return (far / self.n).astype(float), [v if v <= LONG else None for v in exact]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def _summed(parts: DataFrame, *keys: str) -> list:
    """Entries summed by place. Each task gives every place once, so sums are spread by place and none meets them all."""
    return parts.groupBy(*keys).agg(F.sum("v").alias("v")).collect()


def fit(rows: DataFrame, components: int = 4) -> Whitening:
    """The whitening of the distinct vectors of ``rows`` (x array<long>, all of one length).

    Three passes over the distinct vectors, which are written once: exact sums, the scatter of centred vectors as
    one matrix product a batch, and the covariance of the whitened vectors, which gives ``identity_error``. The
    driver holds matrices of the vectors' dimension only.
    """
    distinct = durable(rows.select("x").dropDuplicates(["x"]), "whitening")
    first = distinct.select(F.size("x")).first()
    if not first:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    d = first[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            x = rows_of(batch.column(0), d)
            n += len(x)
            most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            part = (x if most * max(len(x), 1) <= LONG else x.astype(object)).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(list(map(Decimal, [*total, n])), pa.decimal128(38, 0))], ["i", "v"])

    got = {r["i"]: int(r["v"]) for r in _summed(distinct.mapInArrow(sums, "i int, v decimal(38,0)"), "i")}
    n, total = got[d], [got[i] for i in range(d)]
    plain = Whitening(n, total, np.zeros(0), np.zeros((d, 0)), 0.0)

    def products(whitening: Whitening, of) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = 0.0
            for batch in batches:
                y = of(whitening, whitening.deviations(rows_of(batch.column(0), d))[0])
                acc = acc + y.T @ y
            if isinstance(acc, np.ndarray):
                w = len(acc)
                i, j = np.divmod(np.arange(w * w), w)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(acc.ravel())], ["i", "j", "v"])

        cells = _summed(distinct.mapInArrow(run, "i int, j int, v double"), "i", "j")
        w = 1 + max((r["i"] for r in cells), default=-1)
        out = np.zeros((w, w))
        for r in cells:
            out[r["i"], r["j"]] = r["v"]
        return out / n

    cov = products(plain, lambda _, y: y) if d else np.zeros((0, 0))
    values, vectors = principal((cov + cov.T) / 2)
    k = min(components, len(values))
    made = Whitening(n, total, values[:k], vectors[:, :k], float(np.trace(cov)))
    white = products(made, lambda w, y: w.project(y)) if k else np.zeros((0, 0))
    made.identity_error = float(np.abs(white - np.eye(k)).max(initial=0.0))
    return made


def whiten(df: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Components are numbered from 1 by falling eigenvalue of the covariance (divisor n) of the distinct quantised
    vectors; a component's largest entry is positive. There are fewer than ``components`` where the vectors have a
    smaller rank, and no rows where all vectors are equal.

    Edge cases: vectors that are null or hold a null or non-finite entry take no part; null and repeated vec_ids stay,
    one set of rows each; shorter vectors are filled with zeros; repeated vectors count once in the fit; an empty table
    gives no rows; a deviation beyond 64 bits is null; other columns are not read.
    """
    rows = quantised(df, scale)
    fitted = fit(rows, components)
    k, d = len(fitted.values), len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            centred, exact = fitted.deviations(rows_of(batch.column(1), d))
            at = pa.array(np.repeat(np.arange(m), k))
            same = lambda v, kind: pa.array(np.full(m * k, v), kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), same(fitted.n, pa.int64()), pa.array(exact, pa.int64()).take(at), pa.array(fitted.project(centred).ravel()), pa.array(np.tile(fitted.values / (fitted.trace or 1.0), m)), same(fitted.identity_error, pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, shape)
