"""Queries from files to inputs and scores: preparation, callability, call regions, reports of several runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.alleles import set_text
from strandloom.operators import evaluate, intervals, tracts
from strandloom.operators.shared import scratch
from strandloom.operators.tracts import STATES
from strandloom.plans import prepare, site_queries
from strandloom.plans.domain import ANCIENT, DAY, EVENTS, EXPOSURE, HOUR, LENGTHS, MODERN, TRUTH_PRED, covered, exposure, lengths, pred, table, truth
from strandloom.plans.model_queries import em_sql, em_steps
from strandloom.plans.source_queries import call_file
from strandloom.sources import readers, writers

KEYS = ["chrom", "hap"]
#: A second archaic mask.
OTHER = ("error", 1_800)
UNIT, REPEATS = "ACGTTGCAN", 100_000
PANELS = {"ND": ["g2"], "EU": ["g1"], "NA": ["g1", "g2"], "AF": ["g0", "g1"]}


def prepared_sites(s, d):
    """Site rows of calls whose three genotypes serve as panels and ingroup; contigs end before the last sites."""
    contigs = s.createDataFrame([(f"chr{i}", UNIT) for i in (1, 2, 3)], "contig string, seq string").withColumn("seq", F.repeat("seq", REPEATS))
    calls = site_queries.calls(s, d).withColumn("gt", F.array("g0", "g1", "g2"))
    rows = prepare.site_rows(calls, ["g0", "g1", "g2"], PANELS, ["g0"], readers.blocks_of(contigs))
    return rows.select("chrom", "pos", "ref", "alt", "anc", *[set_text(F.col(p)).alias(p) for p in PANELS], "g0_1", "g0_2")


def callability_windows(s, d):
    strict, *archaic = (intervals.merge(covered(s, d, *x), ["chrom"]) for x in (MODERN, ANCIENT, OTHER))
    modern, both = prepare.callability(strict, archaic, lengths(s, d), 5 * HOUR)
    return modern.withColumn("mask", F.lit("modern")).unionByName(both.withColumn("mask", F.lit("both")))


def vcf_region(s, d):
    """Calls of a file within the covered stretches."""
    return readers.vcf(s, call_file(s, d), region=intervals.merge(covered(s, d, *MODERN), ["chrom"]), width=HOUR)


def msp_segments(s, d):
    """A local-ancestry file of a line for each day, read back as runs of one ancestry by haplotype."""
    at = scratch(s, "msp")
    code = lambda k: (F.expr(f"(win * {k} + s div {HOUR}) % 7 div 3")).cast("string")
    lines = exposure(s, d).select("chrom", "win", F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), F.lit("0"), F.lit("0"), F.lit("1"), code(1), code(2), code(3)).alias("value"))
    head = s.createDataFrame([("#Subpopulation order/codes: EUR=0\tNAT=1\tAFR=2",), ("#chm\tspos\tepos\tsgpos\tegpos\tn\ttsk_1.0\ttsk_1.1\ttsk_2.0",)], "value string")
    head.coalesce(1).write.text(at)
    lines.select("value").write.mode("append").text(at)
    return tracts.run_segments(readers.msp(s, at, {"EUR": "EU", "NAT": "NA", "AFR": "AF"}), KEYS, "spos", "epos", "state")


def found_files(s, d):
    """The seeds of the folders that files lie in."""
    at = scratch(s, "seeds")
    table(s, d, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("seed")).write.partitionBy("seed").text(at)
    return readers.find_files(s, at, "*.txt").select(F.regexp_extract("path", r"seed=(\d+)", 1).cast("int").alias("seed")).distinct()


def confusion_file(s, d):
    at = scratch(s, "confusion")
    writers.confusion_text(evaluate.confusion(truth(s, d), pred(s, d), KEYS, DAY), STATES, at)
    return s.read.csv(at, sep="\t", header=True, nullValue="\x00").select("truth_state", *[F.col(x).cast("long").alias(x) for x in STATES])


def column_plan(s, d):
    """Nations as samples, grouped by region; those of the last region are listed by none."""
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()
    header = ["CHROM", "POS", "REF", "ALT", *[r.n_name for r in rows]]
    groups = {}
    for r in rows:
        if r.n_regionkey < 4:
            groups.setdefault(r.r_name, []).append(r.n_name)
    plan, lacking = readers.column_plan(header, {**groups, "NONE": ["NOWHERE"]})
    out = [(g, header[i], i) for g, at in plan.items() for i in at] + [("lacking", n, -1) for n in lacking]
    return s.createDataFrame(out, "grp string, name string, at int")


def pooled_confusion(s, d):
    return evaluate.pooled(truth(s, d), pred(s, d), KEYS, DAY, "chrom")


def summary_files(s, d):
    """A report document of each run, read back as one long table."""
    at, conf = scratch(s, "summaries"), evaluate.pooled(truth(s, d), pred(s, d), KEYS, DAY, "chrom").where("chrom is not null")
    writers.reports(evaluate.report(conf.withColumnRenamed("chrom", "run"), STATES, "run"), "run", at)
    rows = readers.summaries(s, f"{at}/run=*/part-*", {"run": r"run=(\w+)"})
    return rows.select("run", "state", "support_bp", "total_bp", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall")])


def sample_map(s, d):
    """Nations as samples of their regions, written and read back."""
    at = scratch(s, "samples")
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.sample_map(rows.select(F.col("n_name").alias("sample"), F.col("r_name").alias("population")), at)
    return s.read.schema("sample string, population string").csv(at, sep="\t")


def masked_em_step(s, d):
    """One EM step over masked counts."""
    ex = exposure(s, d).select("chrom", "win", "s", "e", "l_mod", "l_anc")
    return em_steps(s, site_queries.masked_observations(s, d).join(ex, ["chrom", "win"]), 1)


QUERIES = {f.__name__: f for f in (prepared_sites, callability_windows, vcf_region, msp_segments, found_files, confusion_file, column_plan, pooled_confusion, summary_files, sample_map, masked_em_step)}


def _bases(cols) -> str:
    parts = ", ".join(f"regexp_split_to_array({c}, '[|/]')" for c in cols)
    return f"list_sort(list_distinct(list_filter(list_concat({parts}), lambda a: a <> '.' AND length(a) = 1)))" if len(cols) > 1 else f"list_sort(list_distinct(list_filter({parts}, lambda a: a <> '.' AND length(a) = 1)))"


def _merged(name: str, source: str) -> str:
    return f"""{name} AS (SELECT chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {source})) GROUP BY chrom, g)"""


def oracles() -> dict[str, str]:
    cut = lambda *types: "(" + " UNION ALL ".join(f"SELECT ev.chrom, pos AS s, least(pos + {n}, length) AS e FROM ev JOIN lens USING (chrom) WHERE event_type = '{t}'" for t, n in types) + ")"
    share = lambda mask, source: f"SELECT w.chrom, w.win, w.s, w.e, coalesce(sum(least(w.e, i.e) - greatest(w.s, i.s)) FILTER (WHERE i.s IS NOT NULL), 0)::DOUBLE / greatest(1, w.e - w.s) AS frac, '{mask}' AS mask FROM w LEFT JOIN {source} i ON i.chrom = w.chrom AND i.s < w.e AND w.s < i.e GROUP BY w.chrom, w.win, w.s, w.e"
    text = lambda p: f"CASE WHEN len({p}) = 0 THEN '.' ELSE '{{' || array_to_string({p}, ',') || '}}' END"
    code = lambda k: f"((win * {k} + s // {HOUR}) % 7 // 3)"
    overlap = "t JOIN p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e"
    by_run = f"c AS (SELECT t.chrom, t.state AS ts, p.state AS ps, sum(least(t.e, p.e) - greatest(t.s, p.s))::BIGINT AS bp FROM {overlap} GROUP BY ALL)"
    return {
        "prepared_sites": f"""WITH {site_queries.CALLS}, f AS (SELECT *, split_part(replace(g0, '/', '|'), '|', 1) AS h1, CASE WHEN contains(replace(g0, '/', '|'), '|') THEN split_part(replace(g0, '/', '|'), '|', 2) ELSE '.' END AS h2,
  {', '.join(f'{_bases(c)} AS p_{p.lower()}' for p, c in PANELS.items())} FROM cl WHERE length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) > 1)) = 0),
m AS (SELECT *, list_filter([h1, h2], lambda a: a <> '.' AND length(a) = 1) AS mx FROM f)
SELECT chrom, pos, ref, alt, CASE WHEN pos < {len(UNIT) * REPEATS} THEN substr('{UNIT}', (pos % {len(UNIT)})::INTEGER + 1, 1) ELSE '.' END AS anc, {', '.join(f'{text("p_" + p.lower())} AS "{p}"' for p in PANELS)}, h1 AS g0_1, h2 AS g0_2
FROM m WHERE len(mx) > 0 AND ({' OR '.join(f'NOT list_has_all(p_{p.lower()}, mx)' for p in PANELS)})""",
        "callability_windows": f"""WITH {EVENTS}, {LENGTHS}, {_merged('mi', cut(MODERN))}, {_merged('ai', cut(ANCIENT, OTHER))}, xi AS (SELECT mi.chrom, greatest(mi.s, ai.s) AS s, least(mi.e, ai.e) AS e FROM mi JOIN ai ON ai.chrom = mi.chrom AND ai.s < mi.e AND mi.s < ai.e),
w AS (SELECT chrom, w AS win, w * {5 * HOUR} AS s, least(w * {5 * HOUR} + {5 * HOUR}, length) AS e FROM lens, LATERAL (SELECT unnest(range((length + {5 * HOUR - 1}) // {5 * HOUR})) AS w))
{share('modern', 'mi')} UNION ALL {share('both', 'xi')}""",
        "vcf_region": f"WITH {EVENTS} SELECT chrom, pos, 'A' AS ref, 'C,G' AS alt, (['A', 'C', 'G'])[event_id % 3 + 1] || '|' || (['A', 'C', 'G'])[event_id % 2 + 1] AS s1, CASE WHEN event_id % 2 = 0 THEN '.|.' ELSE 'G|C' END AS s2 FROM ev WHERE EXISTS (SELECT 1 FROM ev i WHERE i.event_type = '{MODERN[0]}' AND i.chrom = ev.chrom AND i.pos <= ev.pos AND ev.pos < i.pos + {MODERN[1]})",
        "msp_segments": f"""WITH {EXPOSURE}, l AS (SELECT chrom, win, s, e, unnest(['MX_1_1', 'MX_1_2', 'MX_2_1']) AS hap, unnest([{code(1)}, {code(2)}, {code(3)}]) AS c FROM ex)
SELECT chrom, hap, min(s) AS s, max(e) AS e, (['EU', 'NA', 'AF'])[c + 1] AS state FROM (SELECT *, win - row_number() OVER (PARTITION BY chrom, hap, c ORDER BY win) AS g FROM l) GROUP BY chrom, hap, c, g""",
        "found_files": "SELECT DISTINCT n_regionkey AS seed FROM nation",
        "confusion_file": f"WITH {TRUTH_PRED}, {by_run} SELECT ts AS truth_state, " + ", ".join(f"coalesce(sum(bp) FILTER (ps = '{x}'), 0)::BIGINT AS \"{x}\"" for x in STATES) + " FROM c GROUP BY ts",
        "column_plan": "SELECT CASE WHEN n_regionkey < 4 THEN r_name ELSE 'neand' END AS grp, n_name AS name, (row_number() OVER (ORDER BY n_nationkey) + 3)::INTEGER AS at FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'lacking', 'NOWHERE', -1",
        "pooled_confusion": f"WITH {TRUTH_PRED}, {by_run} SELECT chrom, ts AS truth_state, ps AS pred_state, sum(bp)::BIGINT AS bp FROM c GROUP BY GROUPING SETS ((chrom, ts, ps), (ts, ps))",
        "summary_files": f"""WITH {TRUTH_PRED}, {by_run}, r AS (SELECT DISTINCT chrom AS run FROM ev), m AS (SELECT run, state, (SELECT coalesce(sum(bp), 0) FROM c WHERE chrom = run AND ts = state AND ps = state) AS tp, (SELECT coalesce(sum(bp), 0) FROM c WHERE chrom = run AND ts = state) AS sup,
  (SELECT coalesce(sum(bp), 0) FROM c WHERE chrom = run AND ps = state) AS pb, (SELECT sum(bp) FROM c WHERE chrom = run) AS total, (SELECT sum(bp) FILTER (ts = ps) FROM c WHERE chrom = run) AS good FROM r, (VALUES {', '.join(f"('{x}')" for x in STATES)}) v(state))
SELECT run, state, sup::BIGINT AS support_bp, total::BIGINT AS total_bp, round(good::DOUBLE / total, 9) AS accuracy, round(tp::DOUBLE / nullif(pb, 0), 9) AS precision, round(tp::DOUBLE / nullif(sup, 0), 9) AS recall FROM m""",
        "sample_map": "SELECT n_name AS sample, r_name AS population FROM nation JOIN region ON n_regionkey = r_regionkey",
        "masked_em_step": em_sql(site_queries.masked_sql()),
    }
