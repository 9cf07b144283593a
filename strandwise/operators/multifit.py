"""Logistic heads of several feature sets and training draws, fitted together.

Every pass over the rows serves all heads: one matrix product per feature set and Arrow batch, whose sums (one
number per head and feature) are added up by Spark. The driver holds coefficients only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps whose curvature the search keeps.
MEMORY = 12


@dataclass
class Fit:
    """Coefficients on raw features, and how the fit ended."""

    coefficients: np.ndarray
    intercept: float
    rows: int
    positives: int
    slope: float


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if column.null_count or (column.value_lengths().to_numpy() != width).any():
        raise ValueError(f"expected {width} features in every row")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _summed(rows: DataFrame, widths: list[int], sums: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """``sums(arm, x, y, members)`` added over all rows, for every arm. Columns: label, members, one per arm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None] * len(widths)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(y), -1)
            for a, width in enumerate(widths):
                part = sums(a, _matrix(batch.column(2 + a), width), y, m)
                total[a] = part if total[a] is None else total[a] + part
        have = [a for a, t in enumerate(total) if t is not None]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([total[a] for a in have], pa.list_(pa.float64()))], ["arm", "v"])

    cells = rows.mapInArrow(run, "arm int, v array<double>").select("arm", F.posexplode("v").alias("i", "v"))
    out: list[list[float]] = [[] for _ in widths]
    for r in cells.groupBy("arm", "i").agg(F.sum("v").alias("v")).orderBy("arm", "i").collect():  # one row per head and feature
        out[r["arm"]].append(r["v"])
    return [np.array(v) for v in out]


@dataclass
class _Search:
    """One head's descent by stored curvature, halving a step that does not lower the loss."""

    at: np.ndarray
    loss: float = np.inf
    grad: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    done: bool = False
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def trial(self) -> np.ndarray:
        return self.at if self.done or self.way is None else self.at + self.step * self.way

    def take(self, loss: float, grad: np.ndarray, tol: float) -> None:
        if self.done:
            return
        if self.way is not None and loss > self.loss + 1e-4 * self.step * float(self.grad @ self.way) + 1e-13 * abs(self.loss):
            self.step /= 2
            self.done = self.step < 1e-12
            return
        new = self.trial()
        if self.way is not None and (new - self.at) @ (grad - self.grad) > 0:
            self.past = [*self.past, (new - self.at, grad - self.grad)][-MEMORY:]
        self.at, self.loss, self.grad, self.step = new, loss, grad, 1.0
        self.done = bool(np.abs(grad).max() <= tol)
        way, back = -grad, []
        for s, d in reversed(self.past):
            k = (s @ way) / (s @ d)
            way = way - k * d
            back.append((s, d, k))
        if self.past:
            s, d = self.past[-1]
            way = way * (s @ d) / (d @ d)
        for s, d, k in reversed(back):
            way = way + s * (k - (d @ way) / (s @ d))
        self.way = way


def fit_heads(train: DataFrame, arms: Mapping[str, str], members: str, label: str, *, c: float = 1.0, max_passes: int = 400, tol: float = 1e-9) -> dict[str, list[Fit]]:
    """The heads of every arm (name to feature column) and every entry of ``members``.

    ``members`` is an array of flags, the same length in every row: the draws of which a row is part. Each head
    minimises ``sum of losses + |beta|^2 / (2 c)`` with features scaled by the mean and population deviation of its
    own draw, and is folded back to raw features. ``slope`` is the largest slope per row at the end. A draw without
    both classes raises, as do rows whose features are missing or of another width. Rows of no draw change nothing.
    """
    names = list(arms)
    rows = train.select(F.col(label).cast("double").alias("y"), F.col(members).alias("m"), *[F.col(arms[a]).alias(f"x{i}") for i, a in enumerate(names)])
    first = rows.select(F.size("m").alias("m"), *[F.size(f"x{i}").alias(f"x{i}") for i in range(len(names))]).first()
    if first is None:
        raise ValueError("training rows must contain both classes")
    draws, widths = first["m"], [first[f"x{i}"] for i in range(len(names))]
    sums = _summed(rows, widths, lambda a, x, y, m: np.concatenate([m.sum(0), y @ m, (x.T @ m).ravel()]))
    n, p = sums[0][:draws], sums[0][draws : 2 * draws]
    if not ((p > 0) & (p < n)).all():
        raise ValueError("training rows must contain both classes")
    mean = [s[2 * draws :].reshape(-1, draws) / n for s in sums]
    spread = _summed(rows, widths, lambda a, x, y, m: np.stack([m[:, k] @ (x - mean[a][:, k]) ** 2 for k in range(draws)], axis=1).ravel())
    std = [np.sqrt(s.reshape(-1, draws) / n) for s in spread]
    inverse = [np.divide(1.0, s, out=np.zeros_like(s), where=s > 0) for s in std]
    heads = [[_Search(np.zeros(w + 1)) for _ in range(draws)] for w in widths]

    def raw(a: int, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        beta = np.stack([t[:-1] for t in points], axis=1) * inverse[a]
        return beta, np.array([t[-1] for t in points]) - (mean[a] * beta).sum(0)

    for _ in range(max_passes):
        if all(h.done for arm in heads for h in arm):
            break
        trials = [[h.trial() for h in arm] for arm in heads]
        points = [raw(a, t) for a, t in enumerate(trials)]

        def slopes(a: int, x: np.ndarray, y: np.ndarray, m: np.ndarray, points: list = points) -> np.ndarray:
            z = x @ points[a][0] + points[a][1]
            e = np.exp(-np.abs(z))
            off = m * (np.where(z >= 0, 1.0, e) / (1.0 + e) - y[:, None])
            loss = m * (np.log1p(e) + np.maximum(z, 0) - z * y[:, None])
            return np.concatenate([loss.sum(0), off.sum(0), (x.T @ off).ravel()])

        for a, s in enumerate(_summed(rows, widths, slopes)):
            pull = (s[2 * draws :].reshape(-1, draws) - mean[a] * s[draws : 2 * draws]) * inverse[a]
            for k, h in enumerate(heads[a]):
                beta = trials[a][k][:-1]
                grad = np.append(pull[:, k] + beta / c, s[draws + k]) / n[k]
                h.take((s[k] + beta @ beta / (2 * c)) / n[k], grad, tol)
    out = {}
    for a, name in enumerate(names):
        beta, intercept = raw(a, [h.at for h in heads[a]])
        out[name] = [Fit(beta[:, k], float(intercept[k]), int(n[k]), int(p[k]), float(np.abs(heads[a][k].grad).max())) for k in range(draws)]
    return out
