"""Tables laid out for what reads them: calls by chromosome and place, sequences by the keys that they are worked on by."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import intervals

#: Units of the stretches by which a region's bounds are told to the scan, and how many stretches are told at most.
TOLD, MOST = 1 << 24, 256


def write_calls(calls: DataFrame, names: Sequence[str], path: str) -> None:
    """Calls with all samples in one column (see operators.genotypes), a folder for each chromosome, files and row groups
    in order of places, and the samples' names beside them. A hot chromosome is as many files as its share of rows."""
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = calls.select("chrom", "pos", "ref", "alts", "gt").repartitionByRange(parts, "chrom", "pos").sortWithinPartitions("chrom", "pos")
    rows.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/calls")
    calls.sparkSession.createDataFrame(list(enumerate(names)), "at int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/samples")


def read_calls(spark: SparkSession, path: str, chrom: str | None = None, region: DataFrame | None = None, width: int = 100_000) -> tuple[DataFrame, list[str]]:
    """The calls and names of write_calls, of one chromosome and of the sites within region (chrom, s, e) where given. The scan
    opens that chromosome's folder alone, and of files those row groups that reach into the region's bounds."""
    rows = spark.read.option("basePath", f"{path}/calls").parquet(f"{path}/calls").select("chrom", "pos", "ref", "alts", "gt")
    names = [r.name for r in spark.read.parquet(f"{path}/samples").orderBy("at").collect()]
    if chrom is not None:
        rows = rows.where(F.col("chrom") == chrom)
    if region is not None:
        rows = rows.where(bounds(region))
        rows = intervals.points_in(rows, region, ["chrom"], width)
    return rows, names


def bounds(region: DataFrame, told: int = TOLD, most: int = MOST) -> Column:
    """A condition on chrom and pos that holds wherever region does, of plain comparisons that a scan can use: the first and last
    place of each stretch of a chromosome, or of each chromosome where stretches are more than most, or none at all."""
    cut = region.where("s < e").withColumn("_part", F.explode(F.expr(f"sequence(s div {told}, (e - 1) div {told})")))
    within = cut.groupBy("chrom", "_part").agg(F.min(F.greatest("s", F.col("_part") * told)).alias("s"), F.max(F.least("e", (F.col("_part") + 1) * told)).alias("e"))
    for rows in (within, region.where("s < e").groupBy("chrom").agg(F.min("s").alias("s"), F.max("e").alias("e"))):
        found = rows.limit(most + 1).collect()
        if len(found) <= most:
            return reduce(Column.__or__, [(F.col("chrom") == r.chrom) & (F.col("pos") >= r.s) & (F.col("pos") < r.e) for r in sorted(found)], F.lit(False))
    return F.lit(True)


def bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, order: Sequence[str] = ()) -> DataFrame:
    """df as table name at path, dealt to buckets by keys and sorted by keys and order within each: what groups, windows or
    joins it on these keys needs no exchange. Joins on further keys use the same dealing, where both sides have as many buckets."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
    rows.bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name)
    return spark.table(name)
