"""Binomial tails as column expressions, in constant memory for any n.

A tail is the regularised incomplete beta function: the probability of its first value, in Loader's saddle-point form (1999), times
a continued fraction, taken from the side on which it converges. Its terms grow with n to the power of a third, about."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln n! less its leading terms (Stirling), for n from 0 to 15; beyond, a series.
STIRLING = tuple(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0 for n in range(16))
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _let(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of values, each of which is computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def stirling_error(n: Column) -> Column:
    y = 1 / (n * n)
    series = F.lit(0.0)
    for c in reversed(SERIES):
        series = series * y + c
    return F.when(n > 15, series / n).otherwise(F.get(F.array(*map(F.lit, STIRLING)), n.cast("int")))


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, by a series where x is near mean."""
    v = (x - mean) / (x + mean)
    series = F.lit(0.0)
    for j in range(9, 0, -1):
        series = (series + 1 / (2 * j + 1)) * v * v
    return F.when(F.abs(v) < 0.1, (x - mean) * v + 2 * x * v * series).otherwise(x * F.ln(x / mean) + mean - x)


def probability(k: Column, n: Column, p: Column) -> Column:
    """P[X = k] for 1 <= k <= n and 0 < p < 1, as doubles."""
    q = 1 - p
    log = stirling_error(n) - stirling_error(k) - stirling_error(n - k) - deviance(k, n * p) - deviance(n - k, n * q)
    return F.when(k == n, F.exp(n * F.ln(p))).otherwise(F.exp(log) * F.sqrt(n / (2 * math.pi * k * (n - k))))


def fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function for x < (a + 1) / (a + b + 2), from its last term backwards."""
    spread = F.sqrt((a + b) * x * (1 - x)) + 1
    terms = (F.lit(24.0) * F.pow(spread, F.lit(0.65)) + 20).cast("int")

    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 1, odd).otherwise(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))

    return 1 / F.aggregate(F.sequence(terms, F.lit(1)), F.lit(1.0), lambda f, j: 1 + term(j) / f)


def upper(k: Column, n: Column, p: Column) -> Column:
    """P[X >= k] for 1 <= k <= n and 0 < p < 1."""
    direct = p < (k + 1) / (n + 3)
    side = _let(lambda r: probability(r.k, r.n, r.p) * (1 - r.p) * fraction(r.k, r.n - r.k + 1, r.p), k=F.when(direct, k).otherwise(n - k + 1), n=n, p=F.when(direct, p).otherwise(1 - p))
    return F.when(direct, F.least(side, F.lit(1.0))).otherwise(F.greatest(1 - side, F.lit(0.0)))


def tails(k: Column, n: Column, p: Column) -> tuple[Column, Column]:
    """P[X >= k] and P[X <= k]. Where p is 0 or 1 all is certain; NaN for n < 1, or p outside of 0 to 1, or nulls."""
    k, n, p = k.cast("long"), n.cast("long"), p.cast("double")
    valid = F.coalesce((n >= 1) & (p >= 0) & (p <= 1) & ~F.isnan(p) & k.isNotNull(), F.lit(False))
    one, zero, nan = F.lit(1.0), F.lit(0.0), F.lit(float("nan"))
    inner = valid & (p > 0) & (p < 1)
    # Values for which all is certain are kept out of the sums, which then need no care for them.
    above = _let(lambda r: upper(r.k, r.n, r.p), k=F.when(inner & (k >= 1) & (k <= n), k.cast("double")), n=n.cast("double"), p=p)
    below = _let(lambda r: upper(r.k, r.n, r.p), k=F.when(inner & (k >= 0) & (k < n), (n - k).cast("double")), n=n.cast("double"), p=1 - p)
    excess = F.when(~valid, nan).when(k <= 0, one).when(p == 0, zero).when(p == 1, F.when(k <= n, one).otherwise(zero)).when(k > n, zero).otherwise(above)
    depletion = F.when(~valid, nan).when(k >= n, one).when(p == 0, F.when(k >= 0, one).otherwise(zero)).when(p == 1, zero).when(k < 0, zero).otherwise(below)
    return excess, depletion
