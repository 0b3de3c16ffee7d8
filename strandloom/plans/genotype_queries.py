"""Queries of calls with genotype arrays, of FASTA blocks, of decoded files and of scores at many thresholds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.operators import evaluate, genotypes, hmm, intervals, tracts
from strandloom.operators.shared import scratch
from strandloom.plans import model_queries, scores
from strandloom.plans.domain import DAY, EVENTS, HOUR, MODERN, PATHS, RATES, TRANS, TRUTH, TRUTH_PRED, covered, events, pred, segments_sql, truth, zeroed
from strandloom.sources import readers, stores, writers

#: Alternatives of a call by its event, and the reference by its place.
ALTS, REFS, PLACE = ("G", "C,G", "T", "AT", "G,CT,T", "."), ("A", "AC"), 300
SAMPLES = 3
#: Posterior thresholds, of events' values.
LEAST = (20.0, 60.0, 100.0, 150.0, 400.0)


def calls(s, d):
    """A call for each event: genotypes of three samples, numbered in the event's own alternatives; places repeat."""
    place = F.expr(f"pos div {PLACE}")
    pick = lambda items, n: F.get(F.array(*[F.lit(x) for x in items]), (n % len(items)).cast("int"))
    alts = F.filter(F.split(pick(ALTS, F.col("event_id")), ","), lambda a: a != ".")
    one = lambda k: (F.expr(f"(event_id div {k}) % 5") - 1).cast("int")
    held = events(s, d).select("event_id", "chrom", place.alias("pos"), pick(REFS, F.expr(f"pos div {PLACE} div 3")).alias("ref"), alts.alias("alts"))
    number = lambda k: F.when(one(k) <= F.size("alts"), one(k)).otherwise(F.lit(0))
    return held.select("event_id", "chrom", "pos", "ref", "alts", F.array(*[F.array(number(3**k), number(7 * 3**k)) for k in range(SAMPLES)]).alias("gt"))


def has(rows, n):
    """What the alternatives of each sample are, whatever haplotype they are on."""
    sets = [F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.get("gt", F.lit(i)), lambda a: a > 0), lambda a: F.get("alts", a - 1)))), ",").alias(f"s{i}") for i in range(n)]
    return rows.select("chrom", "pos", "ref", F.array_join(F.array_sort("alts"), ",").alias("alt"), *sets)


def restricted_calls(s, d):
    return has(genotypes.restricted(calls(s, d), [2, 0]), 2)


def restricted_file(s, d):
    """The same, written and read back within covered stretches."""
    at, mask = scratch(s, "calls"), covered(s, d, *MODERN)
    writers.vcf(calls(s, d), ["a", "b", "c"], at)
    region = intervals.merge(mask.select("chrom", F.expr(f"s div {PLACE}").alias("s"), F.expr(f"(e - 1) div {PLACE} + 1").alias("e")), ["chrom"])
    rows, names = readers.vcf_arrays(s, at, region=region, width=HOUR)
    return has(genotypes.restricted(rows, [names.index("c"), names.index("a")]), 2)


def merged_files(s, d):
    """Calls of even and of odd events as two files."""
    rows = calls(s, d)
    both, names = genotypes.merged([(rows.where(F.col("event_id") % 2 == k).drop("event_id"), ["x", "y", "z"]) for k in (0, 1)])
    return has(both, len(names))


def fasta_blocks(s, d):
    """Contigs written in lines of 61 and read back in blocks of 1000."""
    at = scratch(s, "fasta")
    seq = events(s, d).groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.upper(F.substring(x.event_type, 1, 3))), "").alias("seq"))
    writers.fasta(seq.select(F.col("chrom").alias("contig"), "seq"), at, 61)
    return readers.fasta_blocks(s, at, 1000).select("contig", "block", F.length("part").cast("long").alias("n"), F.md5("part").alias("md5"))


def archaic(s, d):
    """Decoded segments: an hour behind each event of some kinds, by user, with its value as probability."""
    rows = events(s, d).where("event_type IN ('error', 'signup')")
    return rows.select("chrom", "hap", F.col("pos").alias("s"), (F.col("pos") + 20 * HOUR).alias("e"), F.col("value").alias("score"))


def threshold_sweep(s, d):
    true = truth(s, d).where(F.col("state").isin(*evaluate.ARCHAIC))
    rows = evaluate.threshold_sweep(true, archaic(s, d), ["chrom", "hap"], DAY, LEAST)
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def decoded_files(s, d):
    """The files of all haplotypes put together, each line with its file's name, of which segments of one state and a least
    probability are read."""
    at = scratch(s, "decoded")
    name = F.format_string("run_tsk_%d.hap%d", F.expr("hap div 2"), F.col("hap") % 2 + 1)
    state = F.when(F.col("s") % 3 == 0, "Human").otherwise("Archaic")
    rows = archaic(s, d).select(name.alias("run"), "chrom", F.col("s").alias("start"), F.col("e").alias("end"), state.alias("state"), F.col("score").alias("mean_prob"))
    writers.decoded(rows, at)
    return readers.decoded(s, at, least=LEAST[2], file="run").select("chrom", "sample", "s", "e", F.round("mean_prob", 6).alias("mean_prob"))


def evaluated_file(s, d):
    """True and predicted segments as files, scored by the plan of the evaluate command: the report."""
    t, p = scratch(s, "truth"), scratch(s, "pred")
    named = lambda rows, end: rows.select(F.concat(F.lit("MX_"), F.col("hap").cast("string")).alias("Sample"), F.col("chrom").alias("CHROM"), F.col("s").alias("Start"), (F.col("e") + end).alias("End"), (F.col("e") - F.col("s")).alias("Length"), F.col("state").alias("State"))
    writers.segments(named(truth(s, d), 0), t)
    writers.segments(named(pred(s, d), -1), p)
    _, report = scores.evaluated(scores.truth(s, t), scores.predicted(s, [p]))
    return report.select("state", "support_bp", "total_bp", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def painted_ancestry(s, d):
    """Ancestry of each stretch, archaic within decoded segments that are probable enough."""
    local = pred(s, d).select("chrom", F.col("hap").cast("string").alias("sample"), "s", "e", F.regexp_replace("state", "^ND_", "").alias("state"))
    over = archaic(s, d).where(F.col("score") >= LEAST[2]).select("chrom", F.col("hap").cast("string").alias("sample"), "s", "e")
    return scores.painted(local, over).groupBy("chrom", "sample", "state").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def missing_modern_file(s, d):
    """Both exposures are one over the windows of sites where no window file is there."""
    spans = intervals.make_windows(events(s, d).groupBy("chrom").agg((F.max("pos") + 1).alias("length")), DAY)
    return readers.exposures(s, None, scratch(s, "none"), missing="ones", windows=spans)


def store_region(s, d):
    """Calls of a store by chromosome and place, within covered stretches."""
    at, mask = scratch(s, "store"), covered(s, d, *MODERN)
    stores.write_calls(calls(s, d), ["a", "b", "c"], at)
    region = intervals.merge(mask.select("chrom", F.expr(f"s div {PLACE}").alias("s"), F.expr(f"(e - 1) div {PLACE} + 1").alias("e")), ["chrom"])
    rows, names = stores.read_calls(s, at, region=region, width=HOUR)
    return rows.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.size("alts")).alias("alts"), F.lit(len(names)).alias("samples"))


def bucketed_tracts(s, d):
    """Counts, paths and true segments as tables dealt by haplotype; decoding, tracts and scoring move nothing by it."""
    keys = ["chrom", "hap"]
    named = lambda df, name, order: stores.bucketed(df, f"{name}_{uuid.uuid4().hex}", scratch(s, name), keys, 8, order)
    counts = named(zeroed(s, d), "counts", ["win"])
    path = named(hmm.decode(hmm.pack(counts, keys), keys, RATES, TRANS.log_matrix()), "path", ["win"])
    made = tracts.absorb_tracts(path, keys).withColumn("state", tracts.state_name(F.col("state")))
    return evaluate.confusion(named(truth(s, d), "truth", ["s"]), made, keys, DAY)


QUERIES = {f.__name__: f for f in (store_region, bucketed_tracts, restricted_calls, restricted_file, merged_files, fasta_blocks, threshold_sweep, decoded_files, evaluated_file, painted_ancestry, missing_modern_file)}


def _calls_sql() -> str:
    one = lambda k: f"(event_id // {k}) % 5 - 1"
    alts = f"list_filter(string_split(([{', '.join(map(repr, ALTS))}])[event_id % {len(ALTS)} + 1], ','), lambda a: a <> '.')"
    number = lambda k: f"CASE WHEN {one(k)} <= len(alts) THEN {one(k)} ELSE 0 END"
    refs = f"([{', '.join(map(repr, REFS))}])[(pos // {PLACE} // 3) % {len(REFS)} + 1]"
    return f"{EVENTS}, ca AS (SELECT *, {', '.join(f'[{number(3**k)}, {number(7 * 3**k)}] AS g{k}' for k in range(SAMPLES))} FROM (SELECT event_id, chrom, pos // {PLACE} AS pos, {refs} AS ref, {alts} AS alts FROM ev))"


def _has(g: str) -> str:
    """The alternatives that g has, as a list."""
    return f"list_transform(list_filter({g}, lambda a: a > 0), lambda a: alts[a])"


def oracles() -> dict[str, str]:
    snp = lambda x: f"list_filter({x}, lambda a: length(a) = 1)"
    union = lambda c: f"array_to_string(list_sort(list_distinct(flatten(list({c})))), ',')"

    def restricted(source: str) -> str:
        return f"""k AS (SELECT chrom, pos, ref, {snp(_has('g2'))} AS a, {snp(_has('g0'))} AS b FROM {source} WHERE length(ref) = 1),
n AS (SELECT chrom, pos, ref, list_sort(list_distinct(flatten(list(list_concat(a, b))))) AS alts, {union('a')} AS s0, {union('b')} AS s1 FROM k GROUP BY chrom, pos, ref)
SELECT chrom, pos, ref, array_to_string(alts, ',') AS alt, s0, s1 FROM n WHERE len(alts) BETWEEN 1 AND 3"""

    kind, seconds = MODERN
    mask = f"mk AS (SELECT DISTINCT chrom, unnest(range(pos // {PLACE}, (pos + {seconds} - 1) // {PLACE} + 1)) AS pos FROM ev WHERE event_type = '{kind}')"
    side = lambda k, i: f"array_to_string(list_sort(list_distinct(flatten(list({_has(f'g{i}')}) FILTER (event_id % 2 = {k})))), ',')"
    alleles = "list_distinct(list_concat(flatten(list(alts)), list(ref)))"
    arch = f"ar AS (SELECT chrom, hap, pos AS s, pos + {20 * HOUR} AS e, value AS score FROM ev WHERE event_type IN ('error', 'signup'))"
    isl = lambda name, source: f"{name} AS (SELECT thr, chrom, hap, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY thr, chrom, hap ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY thr, chrom, hap ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {source})) GROUP BY thr, chrom, hap, g)"
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / {b} END"
    bp = "coalesce(sum(bp) FILTER ({}), 0)::BIGINT"
    states = ("EU", "ND_EU", "NA", "ND_NA", "AF")
    cut = "t JOIN p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e"
    return {
        "store_region": f"WITH {_calls_sql()}, {mask} SELECT chrom, pos, count(*) AS calls, sum(len(alts))::BIGINT AS alts, {SAMPLES} AS samples FROM ca SEMI JOIN mk USING (chrom, pos) GROUP BY chrom, pos",
        "bucketed_tracts": f"WITH {PATHS}, {model_queries._absorb}, tr1 AS ({model_queries._runs('ab')}), {segments_sql('t', *TRUTH)} SELECT t.state AS truth_state, {model_queries._states.replace('state', 'tr1.state')} AS pred_state, sum(least(t.e, tr1.e) - greatest(t.s, tr1.s))::BIGINT AS bp FROM t JOIN tr1 ON t.chrom = tr1.chrom AND t.hap = tr1.hap AND t.s < tr1.e AND tr1.s < t.e GROUP BY ALL",
        "restricted_calls": f"WITH {_calls_sql()}, {restricted('ca')}",
        "restricted_file": f"WITH {_calls_sql()}, {mask}, cm AS (SELECT * FROM ca SEMI JOIN mk USING (chrom, pos)), {restricted('cm')}",
        "merged_files": f"""WITH {_calls_sql()}, m AS (SELECT chrom, pos, min_by(ref, (length(ref), ref)) AS ref, {alleles} AS al, {', '.join(f'coalesce({side(k, i)}, {chr(39) * 2}) AS s{3 * k + i}' for k in (0, 1) for i in range(SAMPLES))} FROM ca GROUP BY chrom, pos)
SELECT chrom, pos, ref, array_to_string(list_sort(list_filter(al, lambda a: a <> ref)), ',') AS alt, {', '.join(f's{i}' for i in range(2 * SAMPLES))} FROM m""",
        "fasta_blocks": f"WITH {EVENTS}, q AS (SELECT chrom, string_agg(upper(substr(event_type, 1, 3)), '' ORDER BY event_id) AS seq FROM ev GROUP BY chrom), b AS (SELECT chrom, b AS block, substr(seq, b * 1000 + 1, 1000) AS part FROM q, LATERAL (SELECT unnest(range((length(seq) + 999) // 1000)) AS b)) SELECT chrom AS contig, block, length(part) AS n, md5(part) AS md5 FROM b",
        "threshold_sweep": f"""WITH {TRUTH_PRED}, {arch}, th AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in LEAST)}]) AS thr), x AS (SELECT thr, ar.* FROM ar JOIN th ON score >= thr), {isl('pm', 'x')},
y AS (SELECT thr, chrom, hap, s, e FROM t, th WHERE state LIKE 'ND%'), {isl('tm', 'y')},
c AS (SELECT pm.thr, sum(least(pm.e, tm.e) - greatest(pm.s, tm.s)) AS tp FROM pm JOIN tm ON pm.thr = tm.thr AND pm.chrom = tm.chrom AND pm.hap = tm.hap AND pm.s < tm.e AND tm.s < pm.e GROUP BY pm.thr),
r AS (SELECT thr AS threshold, coalesce(tp, 0)::BIGINT AS tp, (SELECT coalesce(sum(e - s), 0) FROM pm WHERE pm.thr = th.thr)::BIGINT AS p, (SELECT coalesce(sum(e - s), 0) FROM tm WHERE tm.thr = th.thr)::BIGINT AS t, (SELECT count(*) FROM x WHERE x.thr = th.thr) AS segments FROM th LEFT JOIN c USING (thr)),
q AS (SELECT *, {ratio('tp', 'p')} AS pr, {ratio('tp', 't')} AS re FROM r)
SELECT threshold, tp, p - tp AS fp, t - tp AS fn, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1, segments FROM q""",
        "decoded_files": f"WITH {EVENTS}, {arch} SELECT chrom, 'MX_' || (hap // 2) || '_' || (hap % 2 + 1) AS sample, s, e, round(score, 6) AS mean_prob FROM ar WHERE s % 3 <> 0 AND score >= {LEAST[2]!r}",
        "evaluated_file": f"""WITH {TRUTH_PRED}, c AS (SELECT t.state AS ts, p.state AS ps, sum(least(t.e, p.e) - greatest(t.s, p.s))::BIGINT AS bp FROM {cut} GROUP BY ALL), st AS (SELECT unnest({list(states)}) AS state),
m AS (SELECT state, (SELECT {bp.format('ts = st.state AND ps = st.state')} FROM c) AS tp, (SELECT {bp.format('ts = st.state')} FROM c) AS su, (SELECT {bp.format('ps = st.state')} FROM c) AS pb, (SELECT sum(bp)::BIGINT FROM c) AS total_bp, (SELECT {bp.format('ts = ps')} FROM c) AS good FROM st),
r AS (SELECT *, tp::DOUBLE / nullif(pb, 0) AS p, tp::DOUBLE / nullif(su, 0) AS q FROM m)
SELECT state, su AS support_bp, total_bp, round(good::DOUBLE / total_bp, 9) AS accuracy, round(p, 9) AS precision, round(q, 9) AS recall, round(2 * p * q / (p + q), 9) AS f1 FROM r""",
        "painted_ancestry": f"""WITH {TRUTH_PRED}, {arch}, x AS (SELECT 0 AS thr, * FROM ar WHERE score >= {LEAST[2]!r}), {isl('am', 'x')}, lo AS (SELECT chrom, hap, s, e, replace(state, 'ND_', '') AS state FROM p),
i AS (SELECT lo.chrom, lo.hap, lo.state, sum(least(lo.e, am.e) - greatest(lo.s, am.s)) AS bp FROM lo JOIN am ON lo.chrom = am.chrom AND lo.hap = am.hap AND lo.s < am.e AND am.s < lo.e WHERE lo.state <> 'AF' GROUP BY ALL),
w AS (SELECT chrom, hap, state, sum(e - s) AS bp FROM lo GROUP BY ALL)
SELECT chrom, hap::VARCHAR AS sample, state, bp::BIGINT AS bp FROM (SELECT chrom, hap, 'ND_' || state AS state, bp FROM i UNION ALL SELECT w.chrom, w.hap, w.state, w.bp - coalesce(i.bp, 0) FROM w LEFT JOIN i USING (chrom, hap, state)) WHERE bp > 0""",
        "missing_modern_file": f"WITH {EVENTS}, l AS (SELECT chrom, max(pos) + 1 AS length FROM ev GROUP BY chrom) SELECT chrom, w AS win, w * {DAY} AS s, least(w * {DAY} + {DAY}, length) AS e, 1.0::DOUBLE AS l_mod, 1.0::DOUBLE AS l_anc FROM l, LATERAL (SELECT unnest(range((length + {DAY - 1}) // {DAY})) AS w)",
    }
