"""Dense vectors held in array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_array(values: Sequence[float]) -> Column:
    """A double array literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def sigmoid(x: Column) -> Column:
    """Logistic link that does not overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through knots ``(xs, ys)``, ``xs`` ascending, clamped at both ends."""
    n = F.size(xs)
    below = F.size(F.filter(xs, lambda k: k <= x))
    i = F.least(F.greatest(below, F.lit(1)), n - 1)
    x0, x1 = F.element_at(xs, i), F.element_at(xs, i + 1)
    y0, y1 = F.element_at(ys, i), F.element_at(ys, i + 1)
    between = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return (
        F.when(n == 1, F.element_at(ys, 1))
        .when(x <= F.element_at(xs, 1), F.element_at(ys, 1))
        .when(x >= F.element_at(xs, -1), F.element_at(ys, -1))
        .otherwise(between)
    )


def stable_hash(*parts: Column) -> Column:
    """Non-negative 32-bit number from the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
