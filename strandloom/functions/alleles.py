"""Alleles and genotypes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allele_set(c: Column) -> Column:
    """'{A,G}' as an array; null for '', '{}' and '.'."""
    return F.when(~F.trim(c).isin("", "{}", "."), F.split(F.regexp_replace(F.trim(c), "[{}]", ""), ","))


def set_text(c: Column) -> Column:
    """An array as '{A,G}', sorted; '.' for none."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("{"), F.array_join(F.array_sort(c), ","), F.lit("}"))).otherwise(F.lit("."))


def usable_ancestral(c: Column) -> Column:
    """Upper-case letters alone count."""
    return F.coalesce(c.rlike("[A-Z]") & (c == F.upper(c)), F.lit(False))


def derived(allele: Column, ancestral: Column) -> Column:
    return F.coalesce((allele != ".") & (F.upper(allele) != ancestral), F.lit(False))


def absent(panel: Column, allele: Column) -> Column:
    """Whether the panel is known and lacks the allele."""
    return F.coalesce(~F.array_contains(panel, allele), F.lit(False))


def single_base(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & ~F.exists(F.split(alt, ","), lambda a: F.length(a) > 1)


def genotype_alleles(genotypes: Column) -> Column:
    """Distinct single-base alleles of an array of genotypes such as A|G or A/A."""
    parts = F.flatten(F.transform(genotypes, lambda g: F.split(g, "[|/]")))
    return F.array_distinct(F.filter(parts, lambda a: (a != ".") & (F.length(a) == 1)))


def haplotypes(genotype: Column) -> Column:
    """Struct h1, h2 of a genotype; . where it is missing, and as second of a single one."""
    parts = F.split(F.coalesce(genotype, F.lit(".")), "[|/]")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("."))
    return F.struct(at(0).alias("h1"), at(1).alias("h2"))


def keep_site(ingroup: Column, panels: list[Column]) -> Column:
    """Whether the ingroup has an allele, and one that some panel lacks; an empty panel lacks all."""
    none = F.array().cast("array<string>")
    mine = F.coalesce(ingroup, none)
    lacks = F.lit(False)
    for p in panels:
        lacks = lacks | (F.size(F.array_except(mine, F.coalesce(p, none))) > 0)
    return (F.size(mine) > 0) & lacks


def varies(counts: Column, n: Column) -> Column:
    """Whether both values 0 and 1 occur among n haplotypes of which counts carry 1."""
    return (counts > 0) & (counts < n)


def clean_header(c: Column) -> Column:
    """'[12]NAME:GT' as NAME."""
    return F.regexp_replace(F.regexp_replace(c, r"^#?\s*\[\d+\]", ""), ":GT$", "")


def sample_name(c: Column) -> Column:
    return F.when(c.startswith("MX_"), c).otherwise(F.concat(F.lit("MX_"), c))


def node_name(c: Column) -> Column:
    """'tsk_3.hap1' as MX_3_1."""
    return F.concat(F.lit("MX_"), F.regexp_extract(c, r"tsk_(\d+)", 1), F.lit("_"), F.regexp_extract(c, r"hap(\d+)", 1))
