"""Guarded statistics as aggregate expressions (NULL pairs are skipped)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STD_EPS = 1e-12


def both(x: Column, y: Column) -> tuple[Column, Column]:
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def pearson(x: Column, y: Column, min_n: int = 3, eps: float = STD_EPS) -> Column:
    """Pearson r; 0 when fewer than ``min_n`` pairs or a side is constant."""
    x, y = both(x, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when(
        (F.count(x) >= min_n) & (sx >= eps) & (sy >= eps),
        F.try_divide(F.covar_pop(x, y), sx * sy),
    ).otherwise(F.lit(0.0))


def slope(x: Column, y: Column) -> Column:
    """Least-squares factor of ``y = slope*x + intercept``; 0 if x is constant."""
    x, y = both(x, y)
    return F.when(
        (F.count(x) >= 3) & (F.stddev_pop(x) >= STD_EPS),
        F.try_divide(F.covar_pop(x, y), F.var_pop(x)),
    ).otherwise(F.lit(0.0))


def intercept(x: Column, y: Column) -> Column:
    x2, y2 = both(x, y)
    return F.when(
        (F.count(x2) >= 3) & (F.stddev_pop(x2) >= STD_EPS), F.avg(y2) - slope(x, y) * F.avg(x2)
    ).otherwise(F.lit(0.0))


def entropy_of_counts(n: Column) -> Column:
    """Shannon entropy in bits from one row per distinct value with its count.

    H = log2(N) - sum(n*log2 n)/N, so one pass over the counts is enough.
    """
    total = F.sum(n)
    return F.log2(total) - F.sum(n * F.log2(n)) / total
