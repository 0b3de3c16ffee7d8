"""Writers of the engine's text formats, all by Spark's own committers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alleles import set_text
from strandloom.operators import intervals


def segments(df: DataFrame, path: str, by_chrom: bool = False) -> None:
    """Tab-separated with a header; with by_chrom a folder for each CHROM."""
    out = df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "")
    (out.partitionBy("CHROM") if by_chrom else out).csv(path)


def decoded(rows: DataFrame, path: str) -> None:
    """Decoded segments, tab-separated with a header, the files of many haplotypes put together: one column of rows names the
    file that each line is of. There are as many files as tasks, not one for each haplotype in each task."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def sites(df: DataFrame, path: str, haps: Sequence[str]) -> None:
    """Site rows (chrom, pos from 0, ref, alt, anc, ND, EU, NA, AF as arrays, haps) as the wide table, positions from 1."""
    panels = [set_text(F.col(p)).alias(p) for p in ("ND", "EU", "NA", "AF")]
    rows = df.select(F.col("chrom").alias("#CHROM"), (F.col("pos") + 1).alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("anc").alias("Ancestral"), *panels, *haps)
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def windows_bed(df: DataFrame, path: str) -> None:
    """chrom, s, e, frac without a header, in order within each chromosome."""
    df.select("chrom", "s", "e", "frac").repartition("chrom").sortWithinPartitions("chrom", "s").write.mode("overwrite").option("sep", "\t").csv(path)


def constant_mask(lengths: DataFrame, width: int, value: float) -> DataFrame:
    """Whole windows of each chromosome with one value."""
    return intervals.make_windows(lengths, width, last=False).withColumn("frac", F.lit(float(value)))


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def report(overall: dict, per_state: DataFrame, path: str) -> None:
    """One JSON document of a report: scalars and, of a few rows, the metrics by state."""
    states = {r["state"]: {k: v for k, v in r.asDict().items() if k != "state"} for r in per_state.collect()}
    per_state.sparkSession.createDataFrame([(json.dumps({**overall, "per_state": states}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def reports(rows: DataFrame, run: str, path: str) -> None:
    """A JSON document for each value of run, in a folder of its own, of evaluate.report rows with run: one job for any number."""
    metrics = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    docs = rows.groupBy(run).agg(F.first("accuracy").alias("accuracy"), F.first("total_bp").alias("total_bp"), F.map_from_entries(F.collect_list(F.struct("state", F.struct(*metrics, "support_bp")))).alias("per_state"))
    docs.select(run, F.to_json(F.struct("accuracy", "total_bp", "per_state")).alias("value")).repartition(run).write.mode("overwrite").partitionBy(run).text(path)


def confusion_text(conf: DataFrame, states: Sequence[str], path: str) -> None:
    """The matrix, a row for each true state, tab-separated."""
    rows = conf.groupBy("truth_state").pivot("pred_state", list(states)).agg(F.sum("bp")).fillna(0)
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def latex_rows(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """value: each row as cells of a table, numbers with fixed digits."""
    kinds = dict(df.dtypes)
    cells = [F.format_number(c, digits) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("value"))


def fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """contig, seq as lines of so many characters."""
    lines = F.array_join(F.regexp_extract_all("seq", F.lit(f"(.{{1,{width}}})")), "\n")
    df.select(F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def vcf_rows(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """value: a VCF line for each site (chrom, pos from 0, ref, alt, and genotypes by sample)."""
    fixed = [F.col("chrom"), (F.col("pos") + 1).cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT")]
    return df.select(F.concat_ws("\t", *fixed, *[F.col(s) for s in samples]).alias("value"))


def vcf(calls: DataFrame, names: Sequence[str], path: str) -> None:
    """Calls with all samples in one column (see operators.genotypes) as VCF lines, sorted by place; the header is a file of its own."""
    spark = calls.sparkSession
    head = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    gt = F.transform("gt", lambda g: F.array_join(F.transform(g, lambda a: F.when(a < 0, F.lit(".")).otherwise(a.cast("string"))), "|"))
    fixed = [F.col("chrom"), (F.col("pos") + 1).cast("string"), F.lit("."), F.col("ref"), F.coalesce(F.nullif(F.array_join("alts", ","), F.lit("")), F.lit(".")), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT")]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(path)
    calls.orderBy("chrom", "pos").select(F.concat_ws("\t", *fixed, gt).alias("value")).write.mode("append").text(path)


def genetic_map(lengths: DataFrame, rate: float, step: int) -> DataFrame:
    """chrom, pos, cm: equal steps at one rate, and the end."""
    at = lengths.withColumn("pos", F.explode(F.expr(f"array_distinct(concat(sequence(cast(0 as bigint), length, {step}), array(length)))")))
    return at.select("chrom", "pos", (F.col("pos") * rate * 100).alias("cm"))


def sample_map(rows: DataFrame, path: str) -> None:
    """Lines of sample and population of rows (sample, population), in their order."""
    rows.select("sample", "population").write.mode("overwrite").option("sep", "\t").csv(path)
