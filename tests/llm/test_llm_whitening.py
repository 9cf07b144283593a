"""Whitening against plain linear algebra over all rows, and odd rows."""

import math

import numpy as np
import pytest

from strandwise.llm.whitening import fit, one_sided_jacobi, pivoted_cholesky, principal, quantised, whiten

SHAPE = "vec_id long, embedding array<float>, n long, x string, component string, v string"


def brute(rows):
    """Per vec_id the exact deviation and whitened values, from the definition and a library's eigenvectors."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    centred = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {i: (sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - np.array(sums) / n) @ vectors[:, :4] / np.sqrt(values[:4])) for i, x in kept}
    return n, values / values.sum(), out


def test_equals_the_definition(spark, vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.where("vec_id <> 100 OR embedding IS NOT NULL").collect()]
    n, share, want = brute(rows)
    got = whiten(vectors).collect()
    usable = sum(e is not None and all(c is not None and math.isfinite(c) for c in e) for _, e in rows)
    assert len(got) == 4 * usable
    assert {r.n for r in got} == {n}
    signs = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert r.deviation == deviation
        assert abs(r.explained - share[r.component - 1]) <= 1e-10 * share[r.component - 1]
        assert r.identity_error < 1e-9
        if abs(white[r.component - 1]) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(white[r.component - 1] * r.whitened))
        assert abs(abs(r.whitened) - abs(white[r.component - 1])) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("rank", [1, 3, 8])
def test_factors(rank):
    x = np.random.default_rng(rank).normal(size=(50, rank)) @ np.random.default_rng(9).normal(size=(rank, 8))
    a = x.T @ x
    low, order = pivoted_cholesky(a)
    assert low.shape == (8, rank)
    assert np.allclose(low @ low.T, a[np.ix_(order, order)])
    assert np.allclose(np.triu(low, 1), 0)
    turned = one_sided_jacobi(low)
    apart = turned.T @ turned
    assert np.allclose(apart, np.diag(apart.diagonal()), atol=1e-9)
    values, vectors = principal(a)
    assert np.allclose(vectors * values @ vectors.T, a)
    assert (np.diff(values) <= 0).all()


def test_equal_eigenvalues_and_low_rank(spark):
    square = [(i, [float(a), float(b)], 1, "", "", "") for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])]
    got = whiten(spark.createDataFrame(square, SHAPE)).collect()
    assert len(got) == 8 and all(abs(r.explained - 0.5) < 1e-12 for r in got)
    line = [(i, [float(i), 2.0 * i, 0.0], 1, "", "", "") for i in range(5)]
    got = whiten(spark.createDataFrame(line, SHAPE)).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5]), (3, []), (None, [3.0, -1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [-0.001, 0.0])]
    got = whiten(spark.createDataFrame([(*r, 1, "", "", "") for r in rows], SHAPE)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted([(False, 1)] * 4 + [(False, i) for i in (2, 2, 3, 3, 8, 8)] + [(True, 0)] * 2)
    assert {r.n for r in got} == {5}
    one = [r.whitened for r in got if r.vec_id == 1]
    assert sorted(one)[0] == sorted(one)[1] and sorted(one)[2] == sorted(one)[3]
    for empty in ([], [(1, None, 1, "", "", "")], [(1, [2.0, 2.0], 1, "", "", ""), (2, [2.0, 2.0], 1, "", "", "")]):
        assert whiten(spark.createDataFrame(empty, SHAPE)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**40 * i), float(i % 3)], 1, "", "", "") for i in range(6)]
    frame = spark.createDataFrame(rows, SHAPE)
    fitted = fit(quantised(frame).select("x"))
    xs = [[256 * 2**40 * i, 256 * (i % 3)] for i in range(6)]
    assert fitted.sums == [sum(x[j] for x in xs) for j in range(2)]
    far, exact = fitted.deviations(np.array(xs, np.int64))
    want = [sum((6 * a - s) ** 2 for a, s in zip(x, fitted.sums, strict=True)) for x in xs]
    assert exact == [w if w < 1 << 63 else None for w in want]
    assert np.allclose(far[:, 1], np.array([x[1] for x in xs]) - 256)
