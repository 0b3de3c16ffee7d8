"""Queries that write a format under the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import evaluate
from strandloom.operators.shared import scratch
from strandloom.operators.tracts import STATES
from strandloom.plans.domain import CONFUSION, EVENTS, EXPOSURE, HOUR, days, days_sql, exposure, lengths, pred, table, truth
from strandloom.plans.interval_queries import A, R
from strandloom.plans.site_queries import SETS, SITES, sites
from strandloom.sources import readers, writers


def segments_file(s, d):
    """Predicted segments with inclusive ends; the state NA has to stay text."""
    at = scratch(s, "segments")
    rows = pred(s, d).select(F.concat(F.lit("MX_"), F.col("hap").cast("string")).alias("Sample"), F.col("chrom").alias("CHROM"), F.col("s").alias("Start"), (F.col("e") - 1).alias("End"), (F.col("e") - F.col("s")).alias("Length"), F.col("state").alias("State"))
    writers.segments(rows, at)
    return readers.segments(s, at, end_inclusive=True)


def windows_file(s, d):
    at = scratch(s, "windows")
    writers.windows_bed(exposure(s, d).withColumn("frac", F.col("l_mod")), at)
    return readers.windows_bed(s, at)


def exposure_files(s, d):
    """Modern and ancient windows, the ancient file lacking the last day of each chromosome."""
    one, two = scratch(s, "modern"), scratch(s, "ancient")
    ex = exposure(s, d)
    writers.windows_bed(ex.withColumn("frac", F.col("l_mod")), one)
    writers.windows_bed(ex.join(lengths(s, d), "chrom").where("e < length").withColumn("frac", F.col("l_anc")), two)
    return readers.exposures(s, one, two)


def missing_ancient_file(s, d):
    at = scratch(s, "modern")
    writers.windows_bed(exposure(s, d).withColumn("frac", F.col("l_mod")), at)
    return readers.exposures(s, at, at + "-none")


def gaps_file(s, d):
    """Gaps in both layouts."""
    at = scratch(s, "gaps")
    name = F.concat(F.lit("chr"), F.col("k").cast("string"))
    binned = F.concat_ws(" ", F.lit("585"), name, F.col("s").cast("string"), F.col("e").cast("string"))
    plain = F.concat_ws("\t", name, F.col("s").cast("string"), F.col("e").cast("string"))
    days(s, d, R).select(F.when(F.col("s") % 2 == 0, binned).otherwise(plain).alias("value")).write.text(at)
    return readers.gaps(s, at)


def mask_file(s, d):
    """A gzipped mask, merged and cut to chromosome lengths that come from a file as well."""
    at, sizes = scratch(s, "mask"), scratch(s, "lengths")
    days(s, d, A).select(F.concat_ws("\t", F.col("k").cast("string"), F.col("s").cast("string"), F.col("e").cast("string")).alias("value")).write.option("compression", "gzip").text(at)
    days(s, d, A).select("k").distinct().select(F.concat_ws(" ", F.concat(F.lit("chr"), F.col("k").cast("string")), F.lit("1500")).alias("value")).write.text(sizes)
    return readers.bed(s, at, readers.chrom_lengths(s, sizes))


def site_file(s, d):
    from strandloom.functions.alleles import allele_set

    at = scratch(s, "sites")
    rows = sites(s, d).select("chrom", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt"), "anc", *[allele_set(F.col(p)).alias(p) for p in ("ND", "EU", "NA", "AF")], "H1", "H2", "H3")
    writers.sites(rows, at, ["H1", "H2", "H3"])
    return readers.sites(s, at)


def report_file(s, d):
    at = scratch(s, "report")
    conf = evaluate.confusion(truth(s, d), pred(s, d), ["chrom", "hap"], 86400)
    writers.report({"tag": "all"}, evaluate.report(conf, STATES).select("state", "support_bp"), at)
    states = s.read.text(at).select(F.from_json("value", "tag string, per_state map<string, struct<support_bp: bigint>>").alias("x"))
    return states.select("x.tag", F.explode("x.per_state").alias("state", "v")).select("tag", "state", "v.support_bp")


def constant_mask(s, d):
    return writers.constant_mask(lengths(s, d), 5 * HOUR, 1.0)


def json_rows(s, d):
    at = scratch(s, "json")
    writers.json_lines(table(s, d, "nation"), at)
    return s.read.schema("n_nationkey int, n_name string, n_regionkey int").json(at)


def fasta_file(s, d):
    """A contig for each region, read back, and the ancestral base at some places."""
    at = scratch(s, "fasta")
    seq = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "").alias("seq"))
    writers.fasta(seq.select(F.concat(F.lit("chr"), F.col("n_regionkey").cast("string")).alias("contig"), "seq"), at, 20)
    places = table(s, d, "nation").select(F.concat(F.lit("chr"), F.col("n_regionkey").cast("string")).alias("chrom"), (F.col("n_nationkey").cast("long") * 3 - 2).alias("pos"))
    return readers.ancestral(places, readers.fasta_blocks(s, at))


def call_file(s, d) -> str:
    """Genotypes by index, written as a call file; its path."""
    at = scratch(s, "vcf")
    rows = sites(s, d).select("chrom", "pos", F.lit("A").alias("ref"), F.lit("C,G").alias("alt"), F.concat_ws("|", (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 2).cast("string")).alias("s1"), F.when(F.col("event_id") % 2 == 0, "./.").otherwise("2/1").alias("s2"))
    head = s.createDataFrame([("##fileformat=VCFv4.2",), ("#" + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s1 s2".split()),)], "value string").coalesce(1)
    head.unionByName(writers.vcf_rows(rows, ["s1", "s2"])).write.text(at)
    return at


def vcf_file(s, d):
    """Genotypes of one chromosome, read back as bases."""
    return readers.vcf(s, call_file(s, d), chrom="chr2")


def genetic_map(s, d):
    return writers.genetic_map(lengths(s, d), 1e-6, 500_000).withColumn("cm", F.round("cm", 6))


def latex_rows(s, d):
    return writers.latex_rows(table(s, d, "nation").withColumn("x", F.col("n_nationkey") / 8), ["n_name", "x"])


QUERIES = {
    "segments_file": segments_file, "windows_file": windows_file, "exposure_files": exposure_files, "missing_ancient_file": missing_ancient_file, "gaps_file": gaps_file, "mask_file": mask_file, "site_file": site_file,
    "report_file": report_file, "constant_mask": constant_mask, "json_rows": json_rows, "fasta_file": fasta_file, "vcf_file": vcf_file, "genetic_map": genetic_map, "latex_rows": latex_rows,
}


def oracles() -> dict[str, str]:
    from strandloom.plans.domain import LENGTHS, TRUTH_PRED, each_day, islands_sql

    text = lambda p: f"CASE WHEN \"{p}\" IN ('.', '{{}}') THEN '.' ELSE \"{p}\" END AS \"{p}\""
    assert all(list(x) == sorted(x) for x in ([*y.strip("{}").split(",")] for y in SETS))
    return {
        "segments_file": f"WITH {TRUTH_PRED} SELECT chrom, 'MX_' || hap AS sample, s, e, state FROM p",
        "windows_file": f"WITH {EXPOSURE} SELECT chrom, win, s, e, l_mod AS frac FROM ex",
        "exposure_files": f"WITH {EXPOSURE} SELECT ex.* FROM ex JOIN lens USING (chrom) WHERE e < length",
        "missing_ancient_file": f"WITH {EXPOSURE} SELECT * REPLACE (0.0::DOUBLE AS l_anc) FROM ex",
        "gaps_file": f"WITH {days_sql('a', R)} SELECT 'chr' || k AS chrom, s, e FROM a",
        "mask_file": f"WITH {days_sql('a', A)}, c AS (SELECT k, s, least(e, 1500) AS e FROM a WHERE s < 1500), i AS ({islands_sql(each_day('c'))}) SELECT 'chr' || k AS chrom, s, e FROM i",
        "site_file": f"WITH {SITES} SELECT chrom, pos, 'A' AS ref, 'C' AS alt, anc, {text('ND')}, {text('EU')}, {text('NA')}, {text('AF')}, H1, H2, H3 FROM st",
        "report_file": f"WITH {CONFUSION} SELECT 'all' AS tag, truth_state AS state, sum(bp)::BIGINT AS support_bp FROM conf GROUP BY truth_state",
        "constant_mask": f"WITH {EVENTS}, {LENGTHS} SELECT chrom, w AS win, w * {5 * HOUR} AS s, w * {5 * HOUR} + {5 * HOUR} AS e, 1.0::DOUBLE AS frac FROM lens, LATERAL (SELECT unnest(range(length // {5 * HOUR})) AS w)",
        "json_rows": "SELECT * FROM nation",
        "fasta_file": "WITH q AS (SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_name) AS seq FROM nation GROUP BY n_regionkey) SELECT 'chr' || n.n_regionkey AS chrom, n_nationkey::BIGINT * 3 - 2 AS pos, CASE WHEN n_nationkey * 3 - 2 >= 0 AND n_nationkey * 3 - 2 < length(seq) THEN substr(seq, n_nationkey * 3 - 1, 1) ELSE '.' END AS anc FROM nation n JOIN q USING (n_regionkey)",
        "vcf_file": f"WITH {EVENTS} SELECT chrom, pos, 'A' AS ref, 'C,G' AS alt, (['A', 'C', 'G'])[event_id % 3 + 1] || '|' || (['A', 'C', 'G'])[event_id % 2 + 1] AS s1, CASE WHEN event_id % 2 = 0 THEN '.|.' ELSE 'G|C' END AS s2 FROM ev WHERE chrom = 'chr2'",
        "genetic_map": f"WITH {EVENTS}, {LENGTHS} SELECT DISTINCT chrom, pos, round(pos * 1e-6::DOUBLE * 100, 6) AS cm FROM (SELECT chrom, unnest(list_concat(range(0, length + 1, 500000), [length])) AS pos FROM lens)",
        "latex_rows": "SELECT n_name || ' & ' || printf('%.3f', n_nationkey / 8.0::DOUBLE) || ' \\\\' AS value FROM nation",
    }
