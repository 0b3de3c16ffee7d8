"""Calls with all samples in one column: chrom, pos, ref, alts (array), gt, an array with an array of allele numbers for each
sample (0 for ref, k for the k-th of alts, -1 for missing). Operations renumber alleles and keep who has what; thousands of
samples are one column, and one exchange by place joins any number of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_GT = "array<array<int>>"


def numbers(genotype: Column) -> Column:
    """'0|1:...' as [0, 1]; what is no number is -1."""
    return F.transform(F.split(F.get(F.split(genotype, ":"), F.lit(0)), "[|/]"), lambda g: F.coalesce(g.try_cast("int"), F.lit(-1)))


def of_samples(calls: DataFrame, at: Sequence[int]) -> DataFrame:
    """calls of the samples in places at, in that order."""
    places = F.array(*[F.lit(i) for i in at]).cast("array<int>")
    return calls.withColumn("gt", F.transform(places, lambda i: F.get("gt", i)))


def renumbered(gt: Column, new: Column) -> Column:
    """gt with allele k as the k-th of new."""
    return F.transform(gt, lambda g: F.transform(g, lambda a: F.when(a < 0, a).otherwise(F.coalesce(F.get(new, a), F.lit(-1)))))


def keep_alts(calls: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """calls with those of alts for which keep(number, alt) holds; who has another one counts as ref there."""
    chosen = F.filter(F.transform("alts", lambda a, i: F.struct(a.alias("a"), (i + 1).alias("i"))), lambda x: keep(x.i, x.a))
    held = calls.withColumn("_chosen", chosen)
    # The place of a number among the chosen, from 1, is its new number; 0 for those that go.
    new = F.transform(F.sequence(F.lit(0), F.size("alts")), lambda i: F.array_position("_chosen.i", i).cast("int"))
    return held.withColumn("gt", renumbered(F.col("gt"), new)).withColumn("alts", F.col("_chosen.a")).drop("_chosen")


def trim_alts(calls: DataFrame) -> DataFrame:
    """Alternatives that some sample has."""
    held = calls.withColumn("_used", F.array_distinct(F.flatten("gt")))
    return keep_alts(held, lambda i, a: F.array_contains("_used", i)).drop("_used")


def snps(calls: DataFrame) -> DataFrame:
    """Alternatives of one base where ref is one; a site that has none goes."""
    kept = keep_alts(calls.where(F.length("ref") == 1), lambda i, a: (F.length(a) == 1) & a.rlike("[A-Za-z]"))
    return kept.where(F.size("alts") > 0)


def both(a: Column, b: Column) -> Column:
    """One genotype of two of a sample: in each place the first that is not ref, ref before missing; what found no place
    is appended, so that no allele is lost."""
    slots = F.zip_with(a, b, lambda x, y: F.when(x > 0, x).when(y > 0, y).otherwise(F.greatest(x, y)))
    return F.concat(slots, F.array_except(F.filter(F.concat(a, b), lambda x: x > 0), slots))


def folded(rows: Column, alleles: Column, none: Column) -> Column:
    """The genotypes of rows (ref, alts, gt) in numbers of alleles, put together sample by sample; none without rows."""
    number = lambda r: F.transform(F.concat(F.array(r.ref), r.alts), lambda a: (F.array_position(alleles, a) - 1).cast("int"))
    known = F.transform(rows, lambda r: renumbered(r.gt, number(r)))
    first = F.coalesce(F.get(known, F.lit(0)), none)
    return F.aggregate(F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(0))), first, lambda acc, g: F.zip_with(acc, g, both))


def rejoin(calls: DataFrame) -> DataFrame:
    """Rows of one place and ref as one, with the alternatives of all, in the order of their texts."""
    rows = calls.groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_list(F.struct("alts", "gt", "ref"))).alias("rows"))
    held = rows.withColumn("alts", F.array_sort(F.array_distinct(F.flatten("rows.alts"))))
    return held.select("chrom", "pos", "ref", "alts", folded(F.col("rows"), F.concat(F.array("ref"), F.col("alts")), F.array().cast(NO_GT)).alias("gt"))


def restricted(calls: DataFrame, at: Sequence[int]) -> DataFrame:
    """The calls of some samples: alternatives that they have, single bases alone, joined by place, two to four alleles."""
    return rejoin(snps(trim_alts(of_samples(calls, at)))).where(F.size("alts").between(1, 3))


def merged(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> tuple[DataFrame, list[str]]:
    """Calls of any number of files with the names of their samples as one, by place, in one exchange. Samples of a file that
    lacks the place are missing there; a name that an earlier file has gets the file's number before it. Of several refs at
    a place the shortest is ref and the others count as alternatives; alternatives are in the order of their texts."""
    names: list[str] = []
    for i, (_, own) in enumerate(tables, 1):
        names += [f"{i}:{n}" if n in names else n for n in own]
    each = [t.select("chrom", "pos", F.lit(i).alias("file"), "alts", "ref", "gt") for i, (t, _) in enumerate(tables)]
    rows = reduce(DataFrame.union, each).groupBy("chrom", "pos").agg(F.sort_array(F.collect_list(F.struct("file", "alts", "ref", "gt"))).alias("rows"))
    ref = F.array_min(F.transform("rows.ref", lambda r: F.struct(F.length(r).alias("n"), r.alias("ref")))).ref
    held = rows.withColumn("ref", ref)
    every = F.array_distinct(F.concat(F.flatten("rows.alts"), F.col("rows.ref")))
    held = held.withColumn("alts", F.array_sort(F.filter(every, lambda a: (a != F.col("ref")) & (a != ".") & (a != ""))))
    alleles = F.concat(F.array("ref"), F.col("alts"))

    def of(i: int) -> Column:
        none = F.array_repeat(F.array(F.lit(-1)), len(tables[i][1]))
        return folded(F.filter("rows", lambda r: r.file == i), alleles, none)

    return held.select("chrom", "pos", "ref", "alts", F.concat(*[of(i) for i in range(len(tables))]).alias("gt")), names


def bases(calls: DataFrame) -> DataFrame:
    """calls with alts as text and gt as an array of bases such as A|G for each sample; '.' where missing."""
    alleles = F.concat(F.array("ref"), F.col("alts"))
    text = F.transform("gt", lambda g: F.array_join(F.transform(g, lambda a: F.coalesce(F.when(a >= 0, F.get(alleles, a)), F.lit("."))), "|"))
    return calls.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), text.alias("gt"))
