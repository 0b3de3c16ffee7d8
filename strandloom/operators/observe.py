"""Counts of derived alleles that panels lack, by haplotype and window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.alleles import absent, allele_set, derived, usable_ancestral
from strandloom.operators import intervals

#: Panels, in the order of the counts.
PANELS = ("EU", "NA", "AF", "ND")


def to_long(wide: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """A row for each site and haplotype: every column that is not fixed is a haplotype."""
    haps = [c for c in wide.columns if c not in fixed]
    pairs = F.array(*[F.struct(F.lit(h).alias("hap"), F.col(f"`{h}`").alias("allele")) for h in haps])
    return wide.select(*[F.col(f"`{c}`") for c in fixed], F.explode(pairs).alias("_x")).select(*[f"`{c}`" for c in fixed], "_x.hap", "_x.allele")


def assign_windows(sites: DataFrame, windows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """sites (keys, pos) with win, s, e of the window (keys, win, s, e; disjoint) that holds them; others go. The order of
    sites makes no difference."""
    bins = windows.where("s < e").withColumn("_bin", F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")))
    return sites.withColumn("_bin", F.expr(f"pos div {width}")).join(bins, [*keys, "_bin"]).where("pos >= s and pos < e").drop("_bin")


def assign_equal_windows(sites: DataFrame, width: int) -> DataFrame:
    """The same for windows of one width from 0: arithmetic, no join."""
    return sites.where("pos >= 0").withColumn("win", F.expr(f"pos div {width}"))


def differences(sites: DataFrame) -> DataFrame:
    """Usable rows of sites (anc, allele, and the panels as text sets) with d_eu, d_na, d_af, d_nd."""
    rows = sites.where(usable_ancestral(F.col("anc")) & derived(F.col("allele"), F.col("anc")))
    return rows.withColumns({f"d_{p.lower()}": absent(allele_set(F.col(p)), F.col("allele")) for p in PANELS})


def dense_counts(diffs: DataFrame, haps: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts (keys, hap, win, o_eu, o_na, o_af, o_nd) of all haps (keys, hap) and windows (keys, win, ...), zeros too."""
    sums = diffs.groupBy(*keys, "hap", "win").agg(*[F.count_if(f"d_{p.lower()}").alias(f"o_{p.lower()}") for p in PANELS])
    return haps.join(windows, list(keys)).join(sums, [*keys, "hap", "win"], "left").fillna(0, [f"o_{p.lower()}" for p in PANELS])


def observations(wide: DataFrame, windows: DataFrame, width: int, fixed: Sequence[str] = ("chrom", "pos", "anc", *PANELS)) -> DataFrame:
    """The dense counts of a wide site table; sites are filtered and placed before they are spread by haplotype."""
    usable = wide.where(usable_ancestral(F.col("anc")))
    placed = assign_windows(usable, windows.select("chrom", "win", "s", "e"), ["chrom"], width).drop("s", "e")
    names = [*fixed, "win"]
    haps = [c for c in wide.columns if c not in fixed]
    grid = windows.select("chrom").distinct().withColumn("hap", F.explode(F.array(*[F.lit(h) for h in haps])))
    return dense_counts(differences(to_long(placed, names)), grid, windows, ["chrom"])


def masked_counts(diffs: DataFrame, haps: DataFrame, windows: DataFrame, keys: Sequence[str], modern: DataFrame, archaic: DataFrame, width: int) -> DataFrame:
    """Dense counts of diffs (keys, pos, hap, win, d_*) where EU, NA and AF count within modern alone and ND within
    archaic alone (keys, s, e)."""
    parts = [(intervals.points_in(diffs, mask, keys, width), names) for mask, names in ((modern, PANELS[:3]), (archaic, PANELS[3:]))]
    both = None
    for rows, names in parts:
        flags = rows.select(*keys, "hap", "win", *[(F.col(f"d_{p.lower()}") if p in names else F.lit(False)).alias(f"d_{p.lower()}") for p in PANELS])
        both = flags if both is None else both.unionByName(flags)
    return dense_counts(both, haps, windows, keys)


def split_multiallelic(calls: DataFrame) -> DataFrame:
    """(chrom, pos, alleles) of calls (chrom, pos, ref, alt): alternatives are split, single bases kept and joined again,
    and sites of two to four alleles stay."""
    alts = calls.select("chrom", "pos", "ref", F.explode(F.array_distinct(F.split("alt", ","))).alias("a")).where("length(ref) = 1 and length(a) = 1")
    sets = alts.groupBy("chrom", "pos").agg(F.array_sort(F.array_union(F.collect_set("ref"), F.collect_set("a"))).alias("alleles"))
    return sets.where(F.size("alleles").between(2, 4))


def limit_panel(rows: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """Those rows whose value of by is among the first n of their keys: the panel's first n samples with all they have."""
    return rows.withColumn("_rank", F.dense_rank().over(W.partitionBy(*keys).orderBy(by))).where(F.col("_rank") <= n).drop("_rank")


def merge_calls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two call tables (chrom, pos, gt) with gt_a and gt_b; a missing side is '.'."""
    both = a.withColumnRenamed("gt", "gt_a").join(b.withColumnRenamed("gt", "gt_b"), ["chrom", "pos"], "full_outer")
    return both.fillna(".", ["gt_a", "gt_b"])
