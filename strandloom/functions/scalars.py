"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chrom_with(c: Column) -> Column:
    """Chromosome name with chr before it."""
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def chrom_without(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, and empty where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def log2_ratio(a: Column, b: Column, pseudo: float = 1e-9) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def whole_count(share: Column, n: Column) -> Column:
    """share * n to the nearest whole number, halves to even, within 0 and n."""
    return F.greatest(F.lit(0), F.least(F.rint(share * n).cast("long"), n))


def minus_log10(p: Column) -> Column:
    return 0.0 - F.log10(F.greatest(p, F.lit(5e-324)))


def length_bin(n: Column, edges: list[int]) -> Column:
    """Number of the bin of n, each from its edge to below the next, the last open; null below the first."""
    out = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        out = F.when(n >= edge, F.lit(i)).otherwise(out)
    return out


def rule_text(name: str, relation: str, value: Column) -> Column:
    return F.format_string(f"{name} {relation} %.6f", value)


def fraction_bin(x: Column, bins: int) -> Column:
    """Equal bins of [0, 1], the last closed, by comparison with the edges as they are written."""
    out = F.lit(0)
    for i in range(1, bins):
        out = F.when(x >= F.lit(i / bins), F.lit(i)).otherwise(out)
    return out
