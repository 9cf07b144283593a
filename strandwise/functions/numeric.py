"""Ratios, logarithms and correlations with one policy for missing values: NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor for predicted shares, and the smallest yardstick a percent is given for.
EPS = 1e-7
PERCENT_MIN_YARDSTICK = 0.1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, NULL where the denominator is 0 or NULL."""
    d = _col(den).cast("double")
    return F.when(d != 0.0, _col(num).cast("double") / d)


def xlogy(x: Column, y: Column) -> Column:
    """``x * ln(max(y, EPS))``, 0 where ``x`` is not positive."""
    return F.when(x > 0, x * F.log(F.greatest(y, F.lit(EPS)))).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (NULL counts as false), as a long."""
    return F.count(F.when(cond, F.lit(1)))


def avg_if(cond: Column, value: Column) -> Column:
    """Mean of ``value`` over rows where ``cond`` is true; NULL without such rows."""
    return F.avg(F.when(cond, value.cast("double")))


def percent_of(value: Column, yardstick: Column) -> Column:
    """``100 * value / yardstick``; NULL if either is missing or the yardstick is below 0.1."""
    finite = ~F.isnan(value) & ~F.isnan(yardstick)
    return F.when(finite & (yardstick >= PERCENT_MIN_YARDSTICK), 100.0 * value / yardstick)


def corr_agg(x: Column, y: Column, n: Column | None = None) -> tuple[Column, Column, Column]:
    """Aggregate expressions ``(n, r, varies)`` of a guarded Pearson correlation.

    ``n`` may exceed the number of rows: rows that are absent count as zeros. A side is constant only if its
    least and largest value are the same. Moments are centred as they are summed, so a small
    spread about a large mean keeps its digits; the zeros join by the rule for merging two groups.
    """
    x, y = x.cast("double"), y.cast("double")
    m = F.count(x + y).cast("double")
    n = F.count(F.lit(1)).cast("double") if n is None else n.cast("double")
    absent = F.when(m < n, F.lit(0.0))
    spread = lambda v: F.greatest(F.max(v), absent) > F.least(F.min(v), absent)
    varies = F.coalesce(spread(x) & spread(y), F.lit(False))
    joined = m * (n - m) / F.greatest(n, F.lit(1.0))
    mx, my = F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.avg(y), F.lit(0.0))
    vx = F.var_pop(x) * m + mx * mx * joined
    vy = F.var_pop(y) * m + my * my * joined
    r = F.when(varies & (vx > 0) & (vy > 0), (F.covar_pop(x, y) * m + mx * my * joined) / F.sqrt(vx) / F.sqrt(vy))
    return n, r, varies


def pearson_or_zero(n: Column, r: Column, varies: Column) -> Column:
    """0 where a side is constant, NULL with fewer than two points."""
    return F.when(n >= 2, F.when(varies, r).otherwise(F.lit(0.0)))


def pearson_or_null(n: Column, r: Column, varies: Column, least: int = 3) -> Column:
    """NULL where a side is constant or there are fewer than ``least`` points."""
    return F.when((n >= least) & varies, r)
