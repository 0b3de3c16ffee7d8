"""Tails against exact sums: fractions for small n, decimals of fifty digits for large."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import functions as F

from strandloom.functions.binomial import tails


def exact(k, n, p):
    q = Fraction(p)
    terms = [math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(n + 1)]
    return float(sum(terms[max(k, 0) :])), float(sum(terms[: max(k + 1, 0)]))


def log_factorial(n):
    n, pi = Decimal(n), Decimal("3.14159265358979323846264338327950288419716939937510582")
    if n < 40:
        return Decimal(math.factorial(int(n))).ln()
    return (n + Decimal("0.5")) * n.ln() - n + (2 * pi).ln() / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5) - 1 / (1680 * n**7) + 1 / (1188 * n**9)


def upper_decimal(k, n, p):
    """P[X >= k] above the mean, term by term until terms vanish."""
    with localcontext() as c:
        c.prec = 50
        q, x = 1 - Decimal(p), Decimal(p)
        term = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * x.ln() + (n - k) * q.ln()).exp()
        total, i = Decimal(0), k
        while term > total * Decimal("1e-25"):
            total += term
            term *= Decimal(n - i) / (i + 1) * x / q
            i += 1
        return float(total)


def got(spark, rows):
    df = spark.createDataFrame(rows, "k long, n long, p double")
    return df.select(*[c.alias(n) for c, n in zip(tails(F.col("k"), F.col("n"), F.col("p")), ("a", "b"))]).collect()


def test_small(spark):
    rows = [(k, n, p) for n in (1, 2, 7, 16, 40, 300) for p in (0.001, 0.03, 0.5, 0.77, 0.999) for k in {-1, 0, 1, n // 3, int(n * p), int(n * p) + 1, n - 1, n, n + 1}]
    for (k, n, p), r in zip(rows, got(spark, rows)):
        a, b = exact(k, n, p)
        assert math.isclose(r.a, a, rel_tol=1e-12, abs_tol=1e-300) and math.isclose(r.b, b, rel_tol=1e-12, abs_tol=1e-300), (k, n, p, r, a, b)


def test_large(spark):
    rows = [(int(n * p + z * math.sqrt(n * p * (1 - p))) + 1, n, p) for n in (10**5, 10**8) for p in (0.5, 0.02, 1e-6) for z in (0, 1, 6)]
    for (k, n, p), r in zip(rows, got(spark, rows)):
        assert math.isclose(r.a, upper_decimal(k, n, p), rel_tol=1e-12 if n < 10**8 else 5e-12), (k, n, p)
    mirrored = [(n - k, n, 1 - p) for k, n, p in rows if p != 1e-6]
    for (k, n, p), r in zip(mirrored, got(spark, mirrored)):
        assert math.isclose(r.b, upper_decimal(n - k, n, 1 - p), rel_tol=1e-11), (k, n, p)


def test_certain_and_undefined(spark):
    nan = float("nan")
    rows = [(0, 5, 0.0), (1, 5, 0.0), (5, 5, 1.0), (4, 5, 1.0), (6, 5, 0.3), (1, 0, 0.5), (1, 5, nan), (1, 5, 1.5), (None, 5, 0.5), (1, None, 0.5), (1, 5, None)]
    want = [(1, 1), (0, 1), (1, 1), (1, 0), (0, 1)] + [(nan, nan)] * 6
    for (a, b), r in zip(want, got(spark, rows)):
        assert (r.a == a or math.isnan(a) and math.isnan(r.a)) and (r.b == b or math.isnan(b) and math.isnan(r.b))
