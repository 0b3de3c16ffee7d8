"""Readers of the engine's text formats. All give half-open intervals in columns chrom, s, e unless they say otherwise.

Names of chromosomes get chr before them where they lack it. A missing optional file gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alleles import node_name, sample_name
from strandloom.functions.scalars import chrom_with
from strandloom.operators import genotypes, intervals

#: Columns of a site table that are not haplotypes, in the names that files use; fixed values.
SITE_COLUMNS = ("#CHROM", "CHROM", "chr", "POS", "REF", "ALT", "Ancestral", "ND", "EU", "NA", "AF", "Outgroup", "Neand")


def expand(path: str) -> str:
    return os.path.expanduser(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path, in any store that Spark reads, has a file; wildcards are allowed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def config(spark: SparkSession, path: str) -> dict:
    """A run's configuration, one JSON document of a size for the driver, with ~ expanded in its paths."""
    path = expand(path)
    if not exists(spark, path):
        raise FileNotFoundError(f"no configuration at {path}")
    return _expanded(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def _expanded(x):
    if isinstance(x, dict):
        return {k: _expanded(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_expanded(v) for v in x]
    return expand(x) if isinstance(x, str) and x.startswith("~") else x


def fields(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text (gzip is read as well) that are neither blank nor comments, as f, the array of their fields."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v"))
    return lines.where((F.col("v") != "") & ~F.col("v").startswith("#")).select(F.split("v", " ").alias("f"))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def windows_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, win, s, e, frac: lines of at least three fields; frac is the last field as a number, win the place of the
    window by s within its chromosome."""
    from pyspark.sql import Window as W

    rows = fields(spark, path).where((F.size("f") >= 3) & (F.lower(F.get("f", F.lit(0))) != "chrom"))
    rows = rows.select(chrom_with(F.get("f", F.lit(0))).alias("chrom"), F.get("f", F.lit(1)).try_cast("bigint").alias("s"), F.get("f", F.lit(2)).try_cast("bigint").alias("e"), F.element_at("f", -1).try_cast("double").alias("frac"))
    return rows.where("s is not null and e is not null").withColumn("win", F.row_number().over(W.partitionBy("chrom").orderBy("s", "e")).cast("long") - 1).select("chrom", "win", "s", "e", "frac")


def exposures(spark: SparkSession, modern: str | None, ancient: str | None, missing: str = "zero", windows: DataFrame | None = None) -> DataFrame:
    """chrom, win, s, e, l_mod, l_anc from two window files, cut to the windows that both have. Without the ancient file
    l_anc is 0 (missing="zero"); with missing="ones" any missing file makes both 1, over the windows of the other file, or
    over windows (chrom, win, s, e) where there is neither."""
    there = [p is not None and exists(spark, p) for p in (modern, ancient)]
    if not there[0]:
        if missing != "ones":
            raise FileNotFoundError(f"no windows at {modern}")
        rows = windows_bed(spark, ancient).drop("frac") if there[1] else windows
        if rows is None:
            raise FileNotFoundError(f"no windows at {modern} or {ancient}")
        return rows.select("chrom", "win", "s", "e", F.lit(1.0).alias("l_mod"), F.lit(1.0).alias("l_anc"))
    mod = windows_bed(spark, modern).withColumnRenamed("frac", "l_mod")
    if not there[1]:
        one = missing == "ones"
        return mod.withColumns({"l_mod": F.lit(1.0), "l_anc": F.lit(1.0)} if one else {"l_anc": F.lit(0.0)})
    return mod.join(windows_bed(spark, ancient).select("chrom", "win", F.col("frac").alias("l_anc")), ["chrom", "win"])


def other_name(spark: SparkSession, path: str | None) -> str | None:
    """path if it is there, or the file of its folder whose name lacks the chr before it; else None, with a warning: what a
    mask would have taken out stays in."""
    if not path:
        return None
    folder, _, name = path.rpartition("/")
    for at in (path, f"{folder}/{name[3:]}" if folder else name[3:]):
        if (at == path or name.startswith("chr")) and exists(spark, at):
            return at
    warnings.warn(f"no mask at {path}: its sites are not masked", stacklevel=2)
    return None


def bed(spark: SparkSession, path: str | Sequence[str], lengths: DataFrame | None = None) -> DataFrame:
    """Merged intervals of a plain or gzipped BED, cut to lengths (chrom, length) where given."""
    f = fields(spark, path).where(F.size("f") >= 3)
    rows = f.select(chrom_with(F.get("f", F.lit(0))).alias("chrom"), F.get("f", F.lit(1)).try_cast("bigint").alias("s"), F.get("f", F.lit(2)).try_cast("bigint").alias("e")).where("s is not null and e is not null")
    if lengths is not None:
        rows = intervals.clip(rows.join(lengths, "chrom"), 0, F.col("length")).drop("length")
    return intervals.merge(rows, ["chrom"])


def gaps(spark: SparkSession, path: str | None) -> DataFrame:
    """Gaps as 'chrom s e' or 'bin chrom s e', told apart line by line; none without the file."""
    if path is None or not exists(spark, path):
        return _empty(spark, "chrom string, s bigint, e bigint")
    f = fields(spark, path).where(F.size("f") >= 3)
    binned = F.get("f", F.lit(0)).rlike(r"^\d+$") & F.get("f", F.lit(1)).startswith("chr")
    at = lambda i: F.when(binned, F.get("f", F.lit(i + 1))).otherwise(F.get("f", F.lit(i)))
    return f.select(chrom_with(at(0)).alias("chrom"), at(1).try_cast("bigint").alias("s"), at(2).try_cast("bigint").alias("e")).where("s < e")


def chrom_lengths(spark: SparkSession, path: str) -> DataFrame:
    f = fields(spark, path).where(F.size("f") >= 2)
    return f.select(chrom_with(F.get("f", F.lit(0))).alias("chrom"), F.get("f", F.lit(1)).try_cast("bigint").alias("length")).where("length is not null")


def sites(spark: SparkSession, path: str) -> DataFrame:
    """Wide site table: chrom, pos (from 0), ref, alt, anc, ND, EU, NA, AF and a column for each haplotype. Lines whose
    position is no number are left out; missing panels are null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    chrom = next(c for c in raw.columns if c in ("#CHROM", "CHROM", "chr"))
    haps = [c for c in raw.columns if c not in SITE_COLUMNS]
    panel = lambda n, old: (F.col(n) if n in raw.columns else F.col(old) if old in raw.columns else F.lit(None).cast("string")).alias(n)
    cols = [chrom_with(F.col(f"`{chrom}`")).alias("chrom"), (F.col("POS").try_cast("bigint") - 1).alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), F.col("Ancestral").alias("anc")]
    rows = raw.select(*cols, panel("ND", "Neand"), panel("EU", "Outgroup"), panel("NA", "Outgroup"), panel("AF", "Outgroup"), *[F.coalesce(F.col(f"`{h}`"), F.lit(".")).alias(h) for h in haps])
    return rows.where("pos is not null")


def segments(spark: SparkSession, path: str | Sequence[str], end_inclusive: bool) -> DataFrame:
    """chrom, sample, s, e, state of true (exclusive End) or predicted (inclusive End) segments; the state NA stays text."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="\x00", emptyValue="")
    names = {"CHR": "CHROM", "#CHROM": "CHROM"}
    raw = raw.withColumnsRenamed({a: b for a, b in names.items() if a in raw.columns})
    lacking = {"CHROM", "Sample", "Start", "End", "State"} - set(raw.columns)
    if lacking:
        raise ValueError(f"{path} lacks columns {sorted(lacking)}")
    end = F.col("End").cast("bigint") + (1 if end_inclusive else 0)
    return raw.select(chrom_with(F.col("CHROM")).alias("chrom"), sample_name(F.col("Sample")).alias("sample"), F.col("Start").cast("bigint").alias("s"), end.alias("e"), F.col("State").alias("state"))


def msp(spark: SparkSession, path: str, population_states: dict[str, str] | None = None) -> DataFrame:
    """Local-ancestry calls, chrom, hap, spos, epos, code, state: of the lines with # one tells 'POP=code', the other the
    columns, of which those from the seventh on are haplotypes such as tsk_3.0. Lines may lie in any number of files."""
    head = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).distinct().limit(100).collect()]
    codes = {int(c): p for line in head if "\t" not in line or "=" in line.split("\t")[0] for p, c in re.findall(r"(\w+)=(\d+)", line)}
    names = next(line for line in head if "spos" in line.split("\t")).lstrip("#").split("\t")
    at = {n: i for i, n in enumerate(names)}
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    haps = F.array(*[F.struct(F.lit(n).alias("hap"), F.get("f", F.lit(i)).cast("int").alias("code")) for i, n in enumerate(names) if i >= 6])
    state = F.create_map(*[F.lit(x) for c, p in codes.items() for x in (c, (population_states or {}).get(p, p))])
    name = F.concat(F.lit("MX_"), F.regexp_extract("x.hap", r"(\d+)\.\d+$", 1), F.lit("_"), (F.regexp_extract("x.hap", r"\.(\d+)$", 1).cast("int") + 1).cast("string"))
    long = rows.select(chrom_with(F.get("f", F.lit(0))).alias("chrom"), F.get("f", F.lit(at["spos"])).cast("bigint").alias("spos"), F.get("f", F.lit(at["epos"])).cast("bigint").alias("epos"), F.explode(haps).alias("x"))
    return long.select("chrom", name.alias("hap"), "spos", "epos", F.col("x.code").alias("code"), F.try_element_at(state, F.col("x.code")).alias("state"))


def decoded(spark: SparkSession, paths: str | Sequence[str], least: float | None = None, state: str = "Archaic", file: str | None = None) -> DataFrame:
    """Decoded segments, chrom, sample, s, e, mean_prob, of the wanted state and at least so probable (those without a
    probability are); the sample's name comes from the file's name, or from its folder's where the file's has none. file: the
    column that holds that name where files were put together (see writers.decoded), so that many haplotypes are few files."""
    raw = spark.read.option("recursiveFileLookup", True).csv(paths, sep="\t", header=True)
    raw = raw.withColumn("_file", F.regexp_extract(F.col(file or "_metadata.file_path"), r".*(tsk_\d+[^/]*hap\d+)", 1))
    rows = raw.where(F.col("state") == state).select(chrom_with(F.col("chrom")).alias("chrom"), node_name(F.col("_file")).alias("sample"), F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"), (F.col("mean_prob").cast("double") if "mean_prob" in raw.columns else F.lit(None).cast("double")).alias("mean_prob"))
    return rows if least is None else rows.where(F.col("mean_prob").isNull() | (F.col("mean_prob") >= least))


def vcf(spark: SparkSession, path: str, chrom: str | None = None, region: DataFrame | None = None, width: int = 100_000) -> DataFrame:
    """Calls of a text VCF, chrom, pos (from 0), ref, alt and a column of bases such as A|G for each sample; of one
    chromosome, and of the sites within region (chrom, s, e), where given."""
    header = spark.read.text(path).where("value like '#CHROM%'").first()[0].lstrip("#").split("\t")
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    alleles = F.split(F.concat_ws(",", F.get("f", F.lit(3)), F.get("f", F.lit(4))), ",")
    base = f.select(chrom_with(F.get("f", F.lit(0))).alias("chrom"), (F.get("f", F.lit(1)).try_cast("bigint") - 1).alias("pos"), F.get("f", F.lit(3)).alias("ref"), F.get("f", F.lit(4)).alias("alt"), alleles.alias("_a"), "f").where("pos is not null")

    def bases(i: int):
        gt = F.get(F.split(F.get("f", F.lit(i)), ":"), F.lit(0))
        return F.array_join(F.transform(F.split(gt, "[|/]"), lambda g: F.coalesce(F.get("_a", g.try_cast("int")), F.lit("."))), "|")

    rows = base.select("chrom", "pos", "ref", "alt", *[bases(i).alias(n) for i, n in enumerate(header) if i >= 9])
    rows = rows if chrom is None else rows.where(F.col("chrom") == chrom)
    return rows if region is None else intervals.points_in(rows, region, ["chrom"], width)


def vcf_arrays(spark: SparkSession, path: str, chrom: str | None = None, region: DataFrame | None = None, width: int = 100_000) -> tuple[DataFrame, list[str]]:
    """Calls of a text VCF with all samples in one column (see operators.genotypes), and the samples' names."""
    header = spark.read.text(path).where("value like '#CHROM%'").first()[0].lstrip("#").split("\t")
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    alts = F.filter(F.split(at(4), ","), lambda a: (a != ".") & (a != ""))
    gt = F.transform(F.slice("f", 10, max(len(header) - 9, 0)), genotypes.numbers) if len(header) > 9 else F.array().cast(genotypes.NO_GT)
    rows = f.select(chrom_with(at(0)).alias("chrom"), (at(1).try_cast("bigint") - 1).alias("pos"), at(3).alias("ref"), alts.alias("alts"), gt.alias("gt")).where("pos is not null")
    rows = rows if chrom is None else rows.where(F.col("chrom") == chrom)
    return (rows if region is None else intervals.points_in(rows, region, ["chrom"], width)), header[9:]


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, seq of a FASTA file of short contigs; a contig's name is the first word of its line."""
    parts = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", "(^|\n)>"), lambda x: F.trim(x) != "")).alias("x"))
    return parts.select(F.regexp_extract("x", r"^(\S+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace("x", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


#: Bases of a contig in one row, and in one where sites look them up: finding a base takes time with its place in a row.
BASES, PIECE = 1 << 16, 1 << 9


def fasta_blocks(spark: SparkSession, path: str | Sequence[str], bases: int = BASES) -> DataFrame:
    """contig, block, part: the bases of each contig of FASTA files from block * bases on, in rows of so many. Lines are
    placed by sums over each split of a file and then over the splits, so no contig is ever one value; a line is."""
    from pyspark.sql import Window as W

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\s+$", "").alias("v"))
    head = F.col("v").startswith(">")
    lines = lines.withColumn("name", F.when(head, F.regexp_extract("v", r"^>\s*(\S*)", 1))).withColumn("n", F.when(head, 0).otherwise(F.length("v")).cast("long"))
    # Runs are the stretches between headers within a split; the first goes on from the split before.
    order = W.partitionBy("file", "split").orderBy("at")
    lines = lines.withColumn("run", F.count("name").over(order))
    lines = lines.withColumn("upto", F.sum("n").over(W.partitionBy("file", "split", "run").orderBy("at")))
    runs = lines.groupBy("file", "split", "run").agg(F.max("name").alias("name"), F.sum("n").alias("n"))
    over = W.partitionBy("file").orderBy("split", "run")
    runs = runs.withColumn("contig_no", F.count("name").over(over))
    same = W.partitionBy("file", "contig_no").orderBy("split", "run")
    runs = runs.select("file", "split", "run", F.first("name").over(same).alias("contig"), (F.sum("n").over(same) - F.col("n")).alias("before")).where("contig is not null")
    placed = lines.where("n > 0").join(runs, ["file", "split", "run"]).withColumn("s", F.col("before") + F.col("upto") - F.col("n"))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(s div {bases}, (s + n - 1) div {bases})")))
    from_, to = F.greatest(F.col("s"), F.col("block") * bases), F.least(F.col("s") + F.col("n"), (F.col("block") + 1) * bases)
    pieces = cut.select("contig", "block", F.struct(from_.alias("s"), F.col("v").substr((from_ - F.col("s") + 1).cast("int"), (to - from_).cast("int")).alias("v")).alias("x"))
    return pieces.groupBy("contig", "block").agg(F.array_join(F.sort_array(F.collect_list("x")).v, "").alias("part"))


def contig_names(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Names of the contigs of FASTA files, which are few beside their bases."""
    heads = spark.read.text(path).where(F.col("value").startswith(">")).select(F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"))
    return sorted(r.name for r in heads.distinct().collect())


def blocks_of(contigs: DataFrame, bases: int = BASES) -> DataFrame:
    """fasta_blocks of contigs (contig, seq)."""
    return contigs.select("contig", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{bases}}}"), F.lit(0))).alias("block", "part")).withColumn("block", F.col("block").cast("long"))


def contig_of(names: Sequence[str], chrom: str) -> str:
    """The contig of a chromosome: the only one; else the one of exactly its name, with chr or without; else the first that
    has it between colons; else the only one that has it, or chr or chromosome before it, as a word of its name."""
    bare = re.sub("^chr", "", chrom, flags=re.IGNORECASE)
    if len(names) == 1:
        return names[0]
    for fits in (lambda n: n in (chrom, bare) or n.lower() == f"chr{bare}".lower(), lambda n: f":{bare}:" in n):
        found = [n for n in names if fits(n)]
        if found:
            return found[0]
    word = re.compile(rf"(?<![0-9a-z])(chr|chromosome)?[ ._-]?{re.escape(bare)}(?![0-9a-z])", re.IGNORECASE)
    found = [n for n in names if word.search(n)]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} contig for {chrom} among {sorted(found or names)[:20]}")
    return found[0]


def ancestral(sites: DataFrame, blocks: DataFrame, bases: int = BASES) -> DataFrame:
    """sites (chrom, pos) with anc from blocks (contig, block, part: see fasta_blocks) of the same name, chr or not; '.'
    beyond an end. Sites meet a piece of their block by place, so neither a chromosome nor a block is copied to them."""
    small = F.posexplode(F.regexp_extract_all("part", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_piece", "_part")
    cut = blocks.select(chrom_with(F.col("contig")).alias("chrom"), F.col("block").alias("_block"), small)
    placed = sites.withColumns({"_block": F.expr(f"pos div {bases}"), "_piece": F.expr(f"cast(pos % {bases} div {PIECE} as int)")})
    at = F.expr(f"pos % {bases} % {PIECE}")
    base = F.when((F.col("pos") >= 0) & (at < F.length("_part")), F.substring("_part", (at + 1).cast("int"), 1))
    return placed.join(cut, ["chrom", "_block", "_piece"], "left").withColumn("anc", F.coalesce(base, F.lit("."))).drop("_part", "_block", "_piece")


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, name, seed of files under root whose name fits pattern; seed is the number in the path behind seed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"seed[._]?(\d+)", 1).try_cast("int").alias("seed"))


def summaries(spark: SparkSession, paths: str | Sequence[str], tags: dict[str, str]) -> DataFrame:
    """Long table of report documents: file, the tags that patterns with one group find in its path, accuracy, total_bp,
    and state, precision, recall, f1, support_bp; what a document lacks is null."""
    metrics = "struct<precision: double, recall: double, f1: double, support_bp: bigint>"
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"accuracy double, total_bp bigint, per_state map<string, {metrics}>").alias("x"))
    found = [F.regexp_extract("file", p, 1).alias(n) for n, p in tags.items()]
    rows = docs.select("file", *found, "x.accuracy", "x.total_bp", F.explode_outer("x.per_state").alias("state", "m"))
    return rows.select("file", *tags, "accuracy", "total_bp", "state", "m.precision", "m.recall", "m.f1", "m.support_bp")


def column_plan(header: Sequence[str], samples: dict[str, Sequence[str]]) -> tuple[dict[str, list[int]], list[str]]:
    """Columns of each group of samples in the order of the configuration, those behind ALT that no group lists as neand,
    and the listed samples that the header lacks."""
    at = {n: i for i, n in enumerate(header)}
    plan = {g: [at[n] for n in names if n in at] for g, names in samples.items()}
    first = header.index("ALT") + 1 if "ALT" in header else 0
    listed = {i for v in plan.values() for i in v}
    plan["neand"] = plan.get("neand", []) + [i for i in range(first, len(header)) if i not in listed]
    return plan, [n for names in samples.values() for n in names if n not in at]

