"""Exact isotonic fits against sequential pooling, with ties, weights and many blocks."""

import numpy as np
import pytest

from strandwise.operators import isotonic


def by_definition(x, y, w):
    """The fit at each distinct x: max over starts of the least mean over ends."""
    xs = np.unique(x)
    total = np.array([(y * w)[x == v].sum() for v in xs])
    weight = np.array([w[x == v].sum() for v in xs])
    t, s = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(weight)]
    n = len(xs)
    return xs, np.array([max(min((t[k + 1] - t[j]) / (s[k + 1] - s[j]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])


CASES = {
    "noisy": lambda rng, n: (rng.integers(0, 60, n) / 7.0, (rng.random(n) < 0.5).astype(float)),
    "rising": lambda rng, n: (np.arange(n, dtype=float), np.arange(n, dtype=float) ** 2),
    "falling": lambda rng, n: (np.arange(n, dtype=float), -np.arange(n, dtype=float)),
    "step": lambda rng, n: (np.arange(n, dtype=float), (np.arange(n) > n // 2).astype(float)),
    "level": lambda rng, n: (np.arange(n, dtype=float) % 9, np.ones(n)),
    "late fall": lambda rng, n: (np.arange(n, dtype=float), np.where(np.arange(n) < n - 3, np.arange(n), -1e6)),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("buckets", [1, 12])
def test_equals_the_definition(frame, case, buckets):
    rng = np.random.default_rng(6)
    x, y = CASES[case](rng, 120)
    w = rng.integers(1, 4, len(x)).astype(float)
    rows = frame("x double, y double, w double", *zip(x.tolist(), y.tolist(), w.tolist(), strict=True), (None, 1.0, 1.0), (1.0, None, 1.0))
    pools = isotonic.isotonic_pools(rows, "x", "y", "w", buckets)
    xs, ys = isotonic.knots(pools)
    want_x, want = by_definition(x, y, w)
    assert np.allclose(np.interp(want_x, xs, ys), want)
    assert (np.diff(xs) > 0).all() and (np.diff(ys) >= 0).all()
    assert sum(r.weight for r in pools.collect()) == pytest.approx(w.sum())


def test_empty_and_single(frame):
    assert isotonic.knots(isotonic.isotonic_pools(frame("x double, y double"), "x", "y")) == ([], [])
    assert isotonic.knots(isotonic.isotonic_pools(frame("x double, y double", (2.0, 1.0), (2.0, 0.0)), "x", "y")) == ([2.0], [0.5])


def test_violating_blocks_are_chained():
    ends = [{"block": b, "first": f, "last": last} for b, f, last in ((0, 0.1, 0.2), (1, 0.2, 0.4), (3, 0.3, 0.5), (4, 0.6, 0.7))]
    assert isotonic._chains(ends) == {0: 0, 1: 0, 3: 0, 4: 4}
    assert isotonic._chains(ends[3:]) is None
