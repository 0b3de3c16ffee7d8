"""From variant and mask files to a run's inputs: the site table, and the callability of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alleles as al
from strandloom.functions.scalars import chrom_with
from strandloom.operators import genotypes, intervals
from strandloom.sources import readers, writers

#: Groups of a configuration's samples by panel, and that of the ingroup; samples that no group lists are archaic. Fixed values.
GROUPS = {"EU": "Europeans", "NA": "Americans", "AF": "Africans"}
INGROUP = "Mexicans"


def placed(cfg: dict, path: str | None) -> str | None:
    """A bare file name lies in the configuration's prefix."""
    base = cfg.get("prefix", "").rstrip("/")
    return path if not path or "/" in path or not base else f"{base}/{path}"


def site_rows(calls: DataFrame, names: Sequence[str], panels: dict[str, Sequence[str]], ingroup: Sequence[str], blocks: DataFrame) -> DataFrame:
    """Sites chrom, pos, ref, alt, anc, ND, EU, NA, AF (arrays) and two haplotypes NAME_1 and NAME_2 of each of ingroup, from
    calls (chrom, pos, ref, alt and gt, an array of bases for each of names). Indels go, and sites at which every panel has
    all alleles of the ingroup, or the ingroup none. blocks: see readers.ancestral."""
    none = F.array().cast("array<string>")
    at = {n: i for i, n in enumerate(names)}
    picked = lambda group: F.transform(F.array(*[F.lit(at[n]) for n in group]), lambda i: F.get("gt", i))
    sets = {p: al.genotype_alleles(picked(group)) if group else none for p, group in panels.items()}
    halves = [al.haplotypes(F.get("gt", F.lit(at[n]))).alias(f"_h{i}") for i, n in enumerate(ingroup)]
    rows = calls.where(al.single_base(F.col("ref"), F.col("alt"))).select("chrom", "pos", "ref", "alt", *[c.alias(p) for p, c in sets.items()], *halves)
    haps = [F.col(f"_h{i}.{h}").alias(f"{n}_{k}") for i, n in enumerate(ingroup) for k, h in ((1, "h1"), (2, "h2"))]
    rows = rows.select("chrom", "pos", "ref", "alt", *panels, *haps)
    own_names = [f"{n}_{k}" for n in ingroup for k in (1, 2)]
    own = F.filter(F.array(*[F.col(f"`{n}`") for n in own_names]), lambda a: (a != ".") & (F.length(a) == 1)) if own_names else none
    kept = rows.where(al.keep_site(F.array_distinct(own), [F.col(p) for p in panels]))
    return readers.ancestral(kept, blocks).select("chrom", "pos", "ref", "alt", "anc", *panels, *[f"`{n}`" for n in own_names])


def modern_calls(cfg: dict) -> str:
    """Where a configuration's restricted modern call file lies: CHROMOSOME in its name stands for the chromosome."""
    bare = str(cfg["CHROM"]).removeprefix("chr")
    return placed(cfg, cfg["files"]["1000GP_files"]["vcf"].replace("CHROMOSOME", f"chr{bare}"))


def prepared(spark: SparkSession, cfg: dict) -> tuple[DataFrame, list[str]]:
    """site_rows of a configuration, and the names of its haplotypes: its modern call file and its archaic ones, each within
    its mask where that is there, merged by place, of its chromosome, with the ancestral base of its FASTA. Listed samples
    that no file has are left out."""
    files, samples = cfg["files"], cfg["samples"]
    chrom = str(cfg["CHROM"])
    named = chrom if chrom.startswith("chr") else f"chr{chrom}"
    mask = lambda p: readers.bed(spark, at) if (at := readers.other_name(spark, p)) else None
    archaic = [readers.vcf_arrays(spark, x["vcf"], chrom=named, region=mask(x.get("bed"))) for x in files["neand_files"].values()]
    calls, names = genotypes.merged([readers.vcf_arrays(spark, modern_calls(cfg), chrom=named), *archaic])
    header = ["CHROM", "POS", "REF", "ALT", *names]
    plan, _ = readers.column_plan(header, {g: samples.get(g, []) for g in (*GROUPS.values(), INGROUP)})
    cols = {g: [header[i] for i in at] for g, at in plan.items()}
    fasta = files["ancestral"]["fasta"]
    own_name = readers.contig_of(readers.contig_names(spark, fasta), chrom)
    own = readers.fasta_blocks(spark, fasta).where(F.col("contig") == own_name).withColumn("contig", F.lit(named))
    rows = site_rows(genotypes.bases(calls), names, {"ND": cols["neand"], **{p: cols[g] for p, g in GROUPS.items()}}, cols[INGROUP], own)
    return rows, [f"{n}_{k}" for n in cols[INGROUP] for k in (1, 2)]


def restricted(spark: SparkSession, cfg: dict) -> tuple[DataFrame, list[str]]:
    """Calls of a configuration's own samples within its strict mask, from the initial modern call file, and the names: see
    genotypes.restricted. Listed samples that the file lacks are left out."""
    own = cfg["files"]["1000GP_files"]
    listed = [n for g in (INGROUP, GROUPS["AF"], GROUPS["NA"], GROUPS["EU"]) for n in cfg["samples"].get(g, [])]
    calls, names = readers.vcf_arrays(spark, own["vcf_initial"], region=readers.bed(spark, own["bed"]))
    at = [names.index(n) for n in dict.fromkeys(listed) if n in names]
    if not at:
        raise ValueError("no listed sample is in the call file")
    return genotypes.restricted(calls, at), [names[i] for i in at]


def write_restricted(spark: SparkSession, cfg: dict) -> None:
    calls, names = restricted(spark, cfg)
    writers.vcf(calls, names, modern_calls(cfg))


def write_sites(spark: SparkSession, cfg: dict) -> None:
    rows, haps = prepared(spark, cfg)
    writers.sites(rows, placed(cfg, cfg["data"]), haps)


def callability(strict: DataFrame, archaic: Sequence[DataFrame], lengths: DataFrame, width: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Covered share of each window (chrom, win, s, e, frac): by the strict mask, and by what it has in common with the union
    of the archaic masks. Masks are disjoint rows (chrom, s, e); they are cut to lengths (chrom, length)."""
    cut = lambda x: intervals.clip(x.join(lengths, "chrom"), 0, F.col("length")).drop("length")
    modern = cut(strict)
    both = intervals.intersect(modern, cut(intervals.union_many(archaic, ["chrom"])), ["chrom"], 100 * width)
    return tuple(intervals.coverage(x, lengths, ["chrom"], width) for x in (modern, both))


def callability_of(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    files = cfg["files"]
    own = spark.range(1).select(chrom_with(F.lit(str(cfg["CHROM"]))).alias("chrom"))
    lengths = readers.chrom_lengths(spark, files["chr_lengths"]).join(own, "chrom", "left_semi")
    if lengths.isEmpty():
        raise ValueError(f"no length of chromosome {cfg['CHROM']}")
    masks = [readers.bed(spark, x["bed"]) for x in files["neand_files"].values()]
    return callability(readers.bed(spark, files["1000GP_files"]["bed"]), masks, lengths)


def write_callability(spark: SparkSession, cfg: dict) -> None:
    modern, both = callability_of(spark, cfg)
    names = cfg["window_callability"]
    writers.windows_bed(modern, placed(cfg, names["Thousand_genomes"]))
    writers.windows_bed(both, placed(cfg, names["Nd_1k_genomes"]))
