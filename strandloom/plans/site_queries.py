"""Queries of site tables, scalar rules, joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import alleles as al
from strandloom.functions import scalars as sc
from strandloom.operators import hmm, intervals, observe
from strandloom.plans.domain import ANCIENT, COUNTS, DAY, EVENTS, EXPOSURE, HOUR, MODERN, ZEROED, counts, covered, events, exposure, segments, segments_sql, table, zeroed

SETS = ("{A}", "{A,G}", "{C,T}", "{}", ".", "{G}", "{A,C,G,T}")
ANC, ALLELES, GTS, ALTS = "ACGTacgtN.", "ACGT.gta", ("A|G", "C/C", ".", "./.", "T", ".|A", "AT|C"), ("A", "C,G", "AT", "G,TTA", "T")
_panel = {"EU": "event_id * 7 + event_id % 5", "NA": "event_id * 3", "AF": "event_id // 7", "ND": "event_id // 11"}
_hap = {"H1": 1, "H2": 5, "H3": 13}


def sites(s, d) -> DataFrame:
    """Wide site table made of events: chrom, pos, anc, EU, NA, AF, ND, H1, H2, H3."""
    pick = lambda items, n: F.get(F.array(*[F.lit(x) for x in items]), (F.expr(n.replace("//", "div")) % len(items)).cast("int"))
    return events(s, d).select(
        "event_id", "chrom", "pos", pick(ANC, "event_id").alias("anc"), *[pick(SETS, n).alias(p) for p, n in _panel.items()], *[pick(ALLELES, f"event_id // {k}").alias(h) for h, k in _hap.items()]
    )


def _pick(items, n: str) -> str:
    return f"([{', '.join(repr(x) for x in items)}])[({n}) % {len(items)} + 1]"


SITES = EVENTS + f", st AS (SELECT event_id, chrom, pos, {_pick(ANC, 'event_id')} AS anc, " + ", ".join(f'{_pick(SETS, n)} AS "{p}"' for p, n in _panel.items()) + ", " + ", ".join(f"{_pick(ALLELES, f'event_id // {k}')} AS {h}" for h, k in _hap.items()) + " FROM ev)"
_set = lambda c: f"(CASE WHEN {c} IN ('', '{{}}', '.') THEN NULL ELSE string_split(trim({c}, '{{}}'), ',') END)"
_long = "lg AS (SELECT event_id, chrom, pos, anc, \"EU\", \"NA\", \"AF\", \"ND\", unnest(['H1', 'H2', 'H3']) AS hap, unnest([H1, H2, H3]) AS allele FROM st)"
_usable = "regexp_matches(anc, '[A-Z]') AND anc = upper(anc) AND allele <> '.' AND upper(allele) <> anc"
_diff = ", ".join(f"coalesce(NOT list_contains({_set(chr(34) + p + chr(34))}, allele), false) AS d_{p.lower()}" for p in observe.PANELS)
FIXED = ("event_id", "chrom", "pos", "anc", *observe.PANELS)


def long_sites(s, d):
    return observe.to_long(sites(s, d), FIXED)


def allele_set_parse(s, d):
    return sites(s, d).select("event_id", *[F.array_join(al.allele_set(F.col(p)), "+").alias(f"set_{p.lower()}") for p in observe.PANELS])


def allele_filters(s, d):
    return long_sites(s, d).select("event_id", "hap", al.usable_ancestral(F.col("anc")).alias("usable"), al.derived(F.col("allele"), F.col("anc")).alias("derived"))


def panel_differences(s, d):
    return observe.differences(long_sites(s, d)).select("event_id", "hap", *[f"d_{p.lower()}" for p in observe.PANELS])


def windows(s, d):
    """Windows of 5 hours less the last ten minutes."""
    return exposure(s, d).select("chrom", F.explode(F.expr(f"sequence(s, e - 1, {5 * HOUR})")).alias("s")).select("chrom", (F.col("s") / (5 * HOUR)).cast("long").alias("win"), "s", (F.col("s") + 5 * HOUR - 600).alias("e"))


_wins = f"ow AS (SELECT chrom, s // {5 * HOUR} AS win, s, s + {5 * HOUR - 600} AS e FROM (SELECT chrom, unnest(range(s, e, {5 * HOUR})) AS s FROM ex))"


def _windows_disjoint(s, d):
    w = windows(s, d)
    return w.withColumn("e", F.least("e", F.coalesce(F.lead("s").over(W.partitionBy("chrom").orderBy("s")), F.col("e"))))


_wins_disjoint = _wins + ", dw AS (SELECT chrom, win, s, least(e, coalesce(lead(s) OVER (PARTITION BY chrom ORDER BY s), e)) AS e FROM ow)"


def site_windows(s, d):
    return observe.assign_windows(sites(s, d).select("event_id", "chrom", "pos"), _windows_disjoint(s, d).withColumnRenamed("win", "w0").withColumn("win", F.col("s")).drop("w0"), ["chrom"], 6 * HOUR)


def site_observations(s, d):
    wins = _windows_disjoint(s, d).withColumn("win", F.col("s"))
    return observe.observations(sites(s, d).drop("event_id"), wins, 6 * HOUR).select("chrom", "hap", "win", "o_eu", "o_na", "o_af", "o_nd")


def masked_observations(s, d):
    """Counts by day within the modern and the ancient mask."""
    wins = exposure(s, d).select("chrom", "win", "s", "e")
    long = observe.to_long(observe.assign_equal_windows(sites(s, d), DAY), [*FIXED, "win"])
    haps = wins.select("chrom").distinct().withColumn("hap", F.explode(F.array(F.lit("H1"), F.lit("H2"), F.lit("H3"))))
    masks = [intervals.merge(covered(s, d, *r), ["chrom"]) for r in (MODERN, ANCIENT)]
    return observe.masked_counts(observe.differences(long), haps, wins.select("chrom", "win"), ["chrom"], *masks, DAY)


def indel_filter(s, d):
    rows = calls(s, d)
    return rows.where(al.single_base(F.col("ref"), F.col("alt")))


def calls(s, d):
    pick = lambda items, n: F.get(F.array(*[F.lit(x) for x in items]), (F.expr(n) % len(items)).cast("int"))
    return events(s, d).select("event_id", "chrom", "pos", pick(("A", "C", "GT", "G"), "event_id").alias("ref"), pick(ALTS, "event_id div 4").alias("alt"), *[pick(GTS, f"event_id div {k}").alias(f"g{i}") for i, k in enumerate((1, 7, 49))])


CALLS = EVENTS + f", cl AS (SELECT event_id, chrom, pos, {_pick(('A', 'C', 'GT', 'G'), 'event_id')} AS ref, {_pick(ALTS, 'event_id // 4')} AS alt, " + ", ".join(f"{_pick(GTS, f'event_id // {k}')} AS g{i}" for i, k in enumerate((1, 7, 49))) + " FROM ev)"
_gt = "list_distinct(list_filter(list_concat(" + ", ".join(f"regexp_split_to_array(g{i}, '[|/]')" for i in range(3)) + "), lambda a: a <> '.' AND length(a) = 1))"


def genotype_sets(s, d):
    return calls(s, d).select("event_id", al.set_text(al.genotype_alleles(F.array("g0", "g1", "g2"))).alias("alleles"))


def diploid_split(s, d):
    return calls(s, d).select("event_id", al.haplotypes(F.col("g0")).alias("h")).select("event_id", "h.h1", "h.h2")


def site_keep(s, d):
    rows = sites(s, d).select("event_id", F.array_distinct(F.filter(F.array("H1", "H2", "H3"), lambda a: a != ".")).alias("mx"), *[al.allele_set(F.col(p)).alias(p) for p in ("EU", "NA", "AF")])
    return rows.select("event_id", al.keep_site(F.col("mx"), [F.col(p) for p in ("EU", "NA", "AF")]).alias("keep"))


def varying_sites(s, d):
    rows = events(s, d).groupBy("chrom", F.expr("pos div 600").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("ones"))
    return rows.withColumn("keep", al.varies(F.col("ones"), F.col("n")))


def panel_limit(s, d):
    return observe.limit_panel(events(s, d).select("chrom", "hap").distinct(), ["chrom"], "hap", 4)


def names(s, d):
    row = table(s, d, "nation")
    n = F.col("n_nationkey").cast("string")
    return row.select(
        "n_nationkey", sc.chrom_with(F.when(F.col("n_nationkey") % 2 == 0, n).otherwise(F.concat(F.lit("chr"), n))).alias("chrom"), sc.chrom_without(F.concat(F.lit("chr"), n)).alias("bare"),
        al.clean_header(F.concat(F.lit("# ["), n, F.lit("]"), F.col("n_name"), F.lit(":GT"))).alias("header"), al.sample_name(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("MX_"), F.col("n_name")))).alias("sample"),
        al.node_name(F.concat(F.lit("tsk_"), n, F.lit(".hap"), (F.col("n_nationkey") % 2 + 1).cast("string"))).alias("node"),
    )


def scalar_rules(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")
    share = (F.col("p_size") % 11) / 10
    return rows.select(
        "p_partkey", F.round(sc.ratio(F.col("p_size") % 7, F.col("p_size") % 3), 9).alias("ratio"), F.round(sc.log2_ratio(F.col("p_size").cast("double"), F.col("p_retailprice")), 6).alias("log2"),
        sc.whole_count(share, (F.col("p_size") % 5).cast("long")).alias("k"), F.round(sc.minus_log10(F.when(F.col("p_size") % 9 == 0, F.lit(0.0)).otherwise(1 / F.col("p_retailprice"))), 6).alias("score"),
        sc.fraction_bin(share, 10).alias("bin"), sc.length_bin(F.col("p_retailprice"), [0, 950, 1000, 1500, 1900]).alias("length_bin"),
    )


def rule_strings(s, d):
    return table(s, d, "nation").select("n_nationkey", sc.rule_text("p_excess", "<", F.col("n_nationkey") / 64).alias("rule"))


def json_path(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def multiallelic(s, d):
    return observe.split_multiallelic(calls(s, d)).select("chrom", "pos", F.array_join("alleles", ",").alias("alleles"))


def merge_calls(s, d):
    rows = calls(s, d).groupBy("chrom", F.expr("pos div 300").alias("pos"), (F.col("event_id") % 2).alias("side")).agg(F.min("g0").alias("gt"))
    return observe.merge_calls(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"))


def long_tracts(s, d):
    rows = segments(s, d).withColumn("length", F.col("e") - F.col("s"))
    return rows.where(F.col("length") >= 4 * HOUR).withColumn("bin", sc.length_bin(F.col("length"), [0, 6 * HOUR, 12 * HOUR, DAY, 2 * DAY]))


def state_filter(s, d):
    from strandloom.operators.tracts import state_id

    return segments(s, d).where(F.col("state").isin("ND_EU", "ND_NA")).select("chrom", "hap", "s", "e", state_id(F.col("state")).alias("id"))


def posterior_filter(s, d):
    return events(s, d).where((F.col("value") >= 100) | (F.col("event_type") == "purchase")).select("event_id", "hap")


def aligned_windows(s, d):
    ex = exposure(s, d)
    return ex.select("chrom", "win", "l_mod").where("l_mod > 0").join(ex.select("chrom", "win", "l_anc").where("l_anc > 0"), ["chrom", "win"])


PAIR = ["chrom", "hap", "day"]


def _two_sets(s, d):
    ev = events(s, d).withColumn("day", F.expr(f"pos div {DAY}"))
    return tuple(ev.where(F.col("event_type") == t).select(*PAIR).distinct() for t in ("click", "error"))


def key_intersection(s, d):
    a, b = _two_sets(s, d)
    return a.join(b, PAIR, "left_semi")


def key_union(s, d):
    a, b = (x.withColumn("n", F.lit(1)) for x in _two_sets(s, d))
    return a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), PAIR, "full_outer").fillna(0)


def missing_keys(s, d):
    a, b = _two_sets(s, d)
    return a.join(b, PAIR, "left_anti")


def first_of_panel(s, d):
    return events(s, d).withColumn("r", F.row_number().over(W.partitionBy("chrom").orderBy("pos", "event_id"))).where("r <= 5").select("chrom", "event_id", "pos")


def union_all(s, d):
    ev = events(s, d)
    return ev.where("state = 'EU'").select("event_id", "chrom").unionByName(ev.select("event_id", "chrom"))


def set_operations(s, d):
    a, b = _two_sets(s, d)
    tag = lambda x, n: x.withColumn("op", F.lit(n))
    return tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(a.union(b).distinct(), "union"))


def sorted_tracts(s, d):
    """Ordered by the sum of each haplotype, then place; rank keeps the order in the result."""
    rows = segments(s, d).groupBy("chrom", "hap", "state").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("chrom").orderBy(F.desc("bp"), "hap", "state")).cast("long")).orderBy("chrom", "rank")


def normalised_exposure(s, d):
    return zeroed(s, d).groupBy("chrom").agg(*[F.sum(o).alias(o) for o in hmm.OBS])


QUERIES = {
    "allele_set_parse": allele_set_parse, "allele_filters": allele_filters, "panel_differences": panel_differences, "site_windows": site_windows, "site_observations": site_observations,
    "site_equal_windows": lambda s, d: observe.assign_equal_windows(sites(s, d).select("event_id", "chrom", (F.col("pos") - 100_000).alias("pos")), 5 * HOUR),
    "masked_observations": masked_observations, "indel_filter": indel_filter, "genotype_sets": genotype_sets, "diploid_split": diploid_split, "site_keep": site_keep, "varying_sites": varying_sites, "panel_limit": panel_limit,
    "name_rules": names, "scalar_rules": scalar_rules, "rule_strings": rule_strings, "json_path": json_path, "multiallelic_chain": multiallelic, "merge_calls": merge_calls, "long_tracts": long_tracts,
    "state_filter": state_filter, "posterior_filter": posterior_filter, "aligned_windows": aligned_windows, "key_intersection": key_intersection, "key_union": key_union, "missing_keys": missing_keys,
    "first_of_panel": first_of_panel, "union_all": union_all, "set_operations": set_operations, "sorted_tracts": sorted_tracts, "normalised_exposure": normalised_exposure,
    "dense_counts": counts, "max_count": lambda s, d: hmm.max_count(counts(s, d), ["chrom", "hap"]), "exposure_summary": lambda s, d: hmm.exposure_summary(exposure(s, d)),
    "invalid_windows": lambda s, d: hmm.invalid_windows(counts(s, d)), "distinct_pairs": lambda s, d: events(s, d).select("chrom", "hap").dropDuplicates(),
    "callable_summary": lambda s, d: exposure(s, d).groupBy("chrom").agg(F.round(F.avg("l_mod"), 9).alias("mean_mod"), F.round(F.avg("l_anc"), 9).alias("mean_anc"), F.count(F.lit(1)).alias("windows"), F.round(F.sum(F.col("l_mod") * (F.col("e") - F.col("s"))), 3).alias("bp_mod")),
}


def masked_sql() -> str:
    """CTEs up to z, the masked counts of each window with its exposures."""
    obs = ", ".join(f"count(*) FILTER (d_{p.lower()}) AS o_{p.lower()}" for p in observe.PANELS)
    return f"""{EXPOSURE}, {SITES.removeprefix(EVENTS + ', ')}, {_long}, df AS (SELECT chrom, pos, hap, {_diff} FROM lg WHERE {_usable}),
mk AS (SELECT df.chrom, hap, pos // {DAY} AS win, d_eu AND m AS d_eu, d_na AND m AS d_na, d_af AND m AS d_af, d_nd AND a AS d_nd FROM (SELECT *, EXISTS (SELECT 1 FROM lm_i i WHERE i.chrom = df.chrom AND pos >= s AND pos < e) AS m, EXISTS (SELECT 1 FROM la_i i WHERE i.chrom = df.chrom AND pos >= s AND pos < e) AS a FROM df) df),
z AS (SELECT ex.chrom, h.hap, ex.win, ex.s, ex.e, {obs}, ex.l_mod, ex.l_anc FROM ex CROSS JOIN (VALUES ('H1'), ('H2'), ('H3')) h(hap) LEFT JOIN mk ON mk.chrom = ex.chrom AND mk.hap = h.hap AND mk.win = ex.win GROUP BY ALL)"""


def oracles() -> dict[str, str]:
    two = f"{EVENTS}, a AS (SELECT DISTINCT chrom, hap, pos // {DAY} AS day FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT chrom, hap, pos // {DAY} AS day FROM ev WHERE event_type = 'error')"
    obs = ", ".join(f"count(*) FILTER (d_{p.lower()}) AS o_{p.lower()}" for p in observe.PANELS)
    return {
        "allele_set_parse": f"WITH {SITES} SELECT event_id, " + ", ".join(f"array_to_string({_set(chr(34) + p + chr(34))}, '+') AS set_{p.lower()}" for p in observe.PANELS) + " FROM st",
        "allele_filters": f"WITH {SITES}, {_long} SELECT event_id, hap, regexp_matches(anc, '[A-Z]') AND anc = upper(anc) AS usable, allele <> '.' AND upper(allele) <> anc AS derived FROM lg",
        "panel_differences": f"WITH {SITES}, {_long} SELECT event_id, hap, {_diff} FROM lg WHERE {_usable}",
        "site_windows": f"WITH {EXPOSURE}, {_wins_disjoint} SELECT event_id, ev.chrom, pos, s AS win, s, e FROM ev JOIN dw ON dw.chrom = ev.chrom AND pos >= s AND pos < e",
        "site_observations": f"WITH {EXPOSURE}, {_wins_disjoint}, {SITES.removeprefix(EVENTS + ', ')}, {_long}, df AS (SELECT chrom, pos, hap, {_diff} FROM lg WHERE {_usable}) SELECT dw.chrom, h.hap, dw.s AS win, {obs} FROM dw CROSS JOIN (VALUES ('H1'), ('H2'), ('H3')) h(hap) LEFT JOIN df ON df.chrom = dw.chrom AND df.hap = h.hap AND pos >= s AND pos < e GROUP BY ALL",
        "masked_observations": f"WITH {masked_sql()} SELECT chrom, hap, win, {', '.join(hmm.OBS)} FROM z",
        "site_equal_windows": f"WITH {EVENTS} SELECT event_id, chrom, pos - 100000 AS pos, (pos - 100000) // {5 * HOUR} AS win FROM ev WHERE pos >= 100000",
        "indel_filter": f"WITH {CALLS} SELECT * FROM cl WHERE length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) > 1)) = 0",
        "genotype_sets": f"WITH {CALLS} SELECT event_id, CASE WHEN len({_gt}) = 0 THEN '.' ELSE '{{' || array_to_string(list_sort({_gt}), ',') || '}}' END AS alleles FROM cl",
        "diploid_split": f"WITH {CALLS} SELECT event_id, split_part(replace(g0, '/', '|'), '|', 1) AS h1, CASE WHEN contains(replace(g0, '/', '|'), '|') THEN split_part(replace(g0, '/', '|'), '|', 2) ELSE '.' END AS h2 FROM cl",
        "site_keep": f"WITH {SITES}, m AS (SELECT *, list_filter([H1, H2, H3], lambda a: a <> '.') AS mx FROM st) SELECT event_id, len(mx) > 0 AND (" + " OR ".join(f"NOT list_has_all(coalesce({_set(chr(34) + p + chr(34))}, []), mx)" for p in ("EU", "NA", "AF")) + ") AS keep FROM m",
        "varying_sites": f"WITH {EVENTS}, g AS (SELECT chrom, pos // 600 AS site, count(*) AS n, count(*) FILTER (event_type = 'click') AS ones FROM ev GROUP BY ALL) SELECT *, ones > 0 AND ones < n AS keep FROM g",
        "panel_limit": f"WITH {EVENTS}, r AS (SELECT chrom, hap, row_number() OVER (PARTITION BY chrom ORDER BY hap) AS r FROM (SELECT DISTINCT chrom, hap FROM ev)) SELECT chrom, hap FROM r WHERE r <= 4",
        "name_rules": "SELECT n_nationkey, 'chr' || n_nationkey AS chrom, n_nationkey::VARCHAR AS bare, n_name AS header, 'MX_' || n_name AS sample, 'MX_' || n_nationkey || '_' || (n_nationkey % 2 + 1) AS node FROM nation",
        "scalar_rules": """WITH x AS (SELECT *, (p_size % 11) / 10.0::DOUBLE AS sh, p_size % 5 AS n FROM part) SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE (p_size % 7)::DOUBLE / (p_size % 3) END, 9) AS ratio,
round(log2((p_size + 1e-9::DOUBLE) / (p_retailprice + 1e-9::DOUBLE)), 6) AS log2, greatest(0, least(round_even(sh * n, 0)::BIGINT, n)) AS k, round(CASE WHEN p_size % 9 = 0 THEN -log10(5e-324::DOUBLE) ELSE log10(p_retailprice) END, 6) AS score,
least(p_size % 11, 9) AS bin, CASE WHEN p_retailprice >= 1900 THEN 4 WHEN p_retailprice >= 1500 THEN 3 WHEN p_retailprice >= 1000 THEN 2 WHEN p_retailprice >= 950 THEN 1 ELSE 0 END AS length_bin FROM x""",
        "rule_strings": "SELECT n_nationkey, 'p_excess < ' || printf('%.6f', n_nationkey / 64.0::DOUBLE) AS rule FROM nation",
        "json_path": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "multiallelic_chain": f"WITH {CALLS}, u AS (SELECT chrom, pos, ref, unnest(string_split(alt, ',')) AS a FROM cl), f AS (SELECT * FROM u WHERE length(ref) = 1 AND length(a) = 1), g AS (SELECT chrom, pos, list_sort(list_distinct(list_concat(list(ref), list(a)))) AS s FROM f GROUP BY ALL) SELECT chrom, pos, array_to_string(s, ',') AS alleles FROM g WHERE len(s) BETWEEN 2 AND 4",
        "merge_calls": f"WITH {CALLS}, r AS (SELECT chrom, pos // 300 AS pos, event_id % 2 AS side, min(g0) AS gt FROM cl GROUP BY ALL) SELECT chrom, pos, coalesce(max(gt) FILTER (side = 0), '.') AS gt_a, coalesce(max(gt) FILTER (side = 1), '.') AS gt_b FROM r GROUP BY chrom, pos",
        "long_tracts": f"WITH {EVENTS}, {segments_sql('t')} SELECT *, e - s AS length, CASE WHEN e - s >= {2 * DAY} THEN 4 WHEN e - s >= {DAY} THEN 3 WHEN e - s >= {12 * HOUR} THEN 2 WHEN e - s >= {6 * HOUR} THEN 1 ELSE 0 END AS bin FROM t WHERE e - s >= {4 * HOUR}",
        "state_filter": f"WITH {EVENTS}, {segments_sql('t')} SELECT chrom, hap, s, e, CASE state WHEN 'ND_EU' THEN 1 ELSE 3 END AS id FROM t WHERE state LIKE 'ND%'",
        "posterior_filter": f"WITH {EVENTS} SELECT event_id, hap FROM ev WHERE value >= 100 OR event_type = 'purchase'",
        "aligned_windows": f"WITH {EXPOSURE} SELECT chrom, win, l_mod, l_anc FROM ex WHERE l_mod > 0 AND l_anc > 0",
        "key_intersection": f"WITH {two} SELECT * FROM a INTERSECT SELECT * FROM b",
        "key_union": f"WITH {two}, u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT u.*, (EXISTS (SELECT 1 FROM a WHERE a.chrom = u.chrom AND a.hap = u.hap AND a.day = u.day))::INTEGER AS a, (EXISTS (SELECT 1 FROM b WHERE b.chrom = u.chrom AND b.hap = u.hap AND b.day = u.day))::INTEGER AS b FROM u",
        "missing_keys": f"WITH {two} SELECT * FROM a EXCEPT SELECT * FROM b",
        "first_of_panel": f"WITH {EVENTS} SELECT chrom, event_id, pos FROM ev QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY pos, event_id) <= 5",
        "union_all": f"WITH {EVENTS} SELECT event_id, chrom FROM ev WHERE state = 'EU' UNION ALL SELECT event_id, chrom FROM ev",
        "set_operations": f"WITH {two} SELECT *, 'intersect' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'union' FROM (SELECT * FROM a UNION SELECT * FROM b)",
        "sorted_tracts": f"WITH {EVENTS}, {segments_sql('t')}, g AS (SELECT chrom, hap, state, sum(e - s)::BIGINT AS bp FROM t GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY bp DESC, hap, state) AS rank FROM g",
        "normalised_exposure": f"WITH {ZEROED} SELECT chrom, " + ", ".join(f"sum({o})::BIGINT AS {o}" for o in hmm.OBS) + " FROM z GROUP BY chrom",
        "dense_counts": f"WITH {COUNTS} SELECT * FROM obs",
        "max_count": f"WITH {COUNTS}, l AS (SELECT chrom, hap, win, unnest([0, 1, 2, 3]) AS p, unnest([o_eu, o_na, o_af, o_nd]) AS n FROM obs) SELECT n, chrom, hap, win, (['o_eu', 'o_na', 'o_af', 'o_nd'])[p + 1] AS panel FROM l ORDER BY n DESC, chrom, hap, win, p LIMIT 1",
        "exposure_summary": f"WITH {EXPOSURE} SELECT count(*) FILTER (l_mod > 0 AND l_anc > 0) AS \"both\", count(*) FILTER (l_mod > 0 AND l_anc = 0) AS mod_only, count(*) FILTER (l_mod = 0 AND l_anc > 0) AS anc_only, count(*) FILTER (l_mod = 0 AND l_anc = 0) AS neither FROM ex",
        "invalid_windows": f"WITH {COUNTS} SELECT count(*) FILTER (l_mod = 0 AND o_eu + o_na + o_af > 0) AS invalid_modern, count(*) FILTER (l_anc = 0 AND o_nd > 0) AS invalid_ancient FROM obs",
        "distinct_pairs": f"WITH {EVENTS} SELECT DISTINCT chrom, hap FROM ev",
        "callable_summary": f"WITH {EXPOSURE} SELECT chrom, round(avg(l_mod), 9) AS mean_mod, round(avg(l_anc), 9) AS mean_anc, count(*) AS windows, round(sum(l_mod * (e - s)), 3) AS bp_mod FROM ex GROUP BY chrom",
    }
