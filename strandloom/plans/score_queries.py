"""Queries of evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.scalars import fraction_bin
from strandloom.operators import evaluate as ev
from strandloom.operators import intervals, stats
from strandloom.operators.tracts import STATES
from strandloom.plans.domain import CONFUSION, DAY, EVENTS, EXPOSURE, HOUR, MODERN, TRUTH_PRED, covered, exposure, pred, table, truth

KEYS = ["chrom", "hap"]


def confusion(s, d):
    return ev.confusion(truth(s, d), pred(s, d), KEYS, DAY)


def confusion_inclusive(s, d):
    """The same when predicted ends are inclusive."""
    closed = pred(s, d).withColumn("e", F.col("e") - 1)
    return ev.confusion(truth(s, d), ev.half_open(closed, True), KEYS, DAY)


def masked_confusion(s, d):
    return ev.confusion(truth(s, d), pred(s, d), KEYS, DAY, intervals.merge(covered(s, d, *MODERN), ["chrom"]), ["chrom"])


def report(s, d):
    return ev.report(confusion(s, d), STATES).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})


def row_shares(s, d):
    return ev.normalise_rows(confusion(s, d)).withColumn("share", F.round("share", 9))


def binary_metrics(s, d):
    return ev.binary(ev.collapse(confusion(s, d))).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def _archaic(df):
    return df.where(F.col("state").isin(*ev.ARCHAIC)).select(*KEYS, "s", "e")


def interval_metrics(s, d):
    return ev.interval_metrics(_archaic(truth(s, d)), _archaic(pred(s, d)), KEYS, 31 * DAY, DAY)


def confusion_by_length(s, d):
    return ev.by_length(truth(s, d), pred(s, d), KEYS, DAY, [0, 6 * HOUR, 12 * HOUR, DAY])


#: Edges of lengths that leave out the shortest tracts and have a bin that no tract is in.
EDGES = (HOUR, 6 * HOUR, 12 * HOUR, DAY, 300 * DAY)


def length_scores(s, d):
    rows = ev.length_scores(ev.by_length(truth(s, d), pred(s, d), KEYS, DAY, EDGES), EDGES).drop("bin_end")
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def length_shares(s, d):
    return ev.length_shares(ev.by_length(truth(s, d), pred(s, d), KEYS, DAY, EDGES), STATES, EDGES).drop("bin_end").withColumn("share", F.round("share", 9))


def filter_grid(s, d):
    wins = intervals.effective(exposure(s, d)).select("chrom", "s", "e", "l_mod", "u")
    return ev.filter_grid(truth(s, d), pred(s, d), wins, KEYS, DAY, (0.5, 0.8), (0.0, 0.5, 0.7, 0.8), ["chrom"])


def grid_long(s, d):
    """The grid's recall by state, and what part of the first cell's length each cell retains."""
    grid = filter_grid(s, d)
    cell = grid.groupBy("l_thr", "u_thr", F.col("truth_state").alias("state")).agg(F.sum("bp").alias("support_bp"), F.sum(F.when(F.col("truth_state") == F.col("pred_state"), F.col("bp")).otherwise(0)).alias("hit"))
    base = cell.where("l_thr = 0.5 and u_thr = 0.0").select("state", F.col("support_bp").alias("base"))
    rows = cell.join(base, "state", "left")
    return rows.select("l_thr", "u_thr", "state", F.round(F.col("hit") / F.col("support_bp"), 9).alias("recall"), F.round(F.try_divide(F.col("support_bp"), F.col("base")), 9).alias("retained"))


def mean_std(s, d):
    rows = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"))
    return stats.mean_std(rows, ["l_returnflag", "l_linestatus"], ["q"]).withColumns({c: F.round(c, 6) for c in ("q_mean", "q_std")})


def pivot(s, d):
    rows = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return stats.pivot_table(rows, "l_returnflag", "l_linestatus", "q", ["F", "O"])


def quantile_table(s, d):
    return stats.quantiles(table(s, d, "orders"), "o_totalprice", keys=["o_orderstatus"]).withColumn("value", F.round("value", 4))


def describe(s, d):
    return stats.describe(table(s, d, "orders"), "o_totalprice", ["o_orderstatus"]).withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


def histogram(s, d):
    return stats.histogram(exposure(s, d), fraction_bin(F.col("l_mod"), 10), "chrom")


def grid_counts(s, d):
    wins = intervals.effective(exposure(s, d))
    bp = lambda t, n: intervals.window_bp(_archaic(t), ["chrom"], DAY, name=n)
    rows = wins.join(bp(truth(s, d), "t"), ["chrom", "win"], "left").join(bp(pred(s, d), "p"), ["chrom", "win"], "left").fillna(0, ["t", "p"])
    rows = rows.withColumns({"is_true": F.col("t") > 12 * DAY, "is_pred": F.col("p") > 16 * DAY})
    return stats.grid_counts(rows, (0, 0.2, 0.4, 0.6, 0.8, 1.0), (0, 0.2, 0.4, 0.6, 0.8, 1.0), "l_mod", "u")


def window_effects(s, d):
    grp = F.when(F.col("hap") % 2 == 0, "a").otherwise("b").alias("grp")
    rows = truth(s, d).where("state in ('EU', 'ND_EU')").select("chrom", grp, "s", "e", "state")
    bp = intervals.window_bp(rows, ["chrom", "grp", "state"], DAY).groupBy("chrom", "grp", "win").pivot("state", ["EU", "ND_EU"]).agg(F.sum("bp")).fillna(0)
    return stats.effects(bp, HOUR).select("chrom", "win", *[F.round(c, 9).alias(c) for c in ("p_a", "p_b", "effect_delta", "effect_log2_ratio")])


def _pvalues(s, d):
    """Returned lines of each part against the share of all lines."""
    rows = table(s, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c")).groupBy("l_partkey").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("c"))), F.lit(0)).alias("k"))
    p = F.when(F.col("l_partkey") % 50 == 0, F.lit(0.0)).otherwise(F.lit(1 / 3))
    return stats.with_tails(rows.withColumn("p", p))


def binomial_tails(s, d):
    return stats.with_scores(_pvalues(s, d)).select("l_partkey", "k", "n", *[F.round(c, 9).alias(c) for c in ("p_excess", "p_depletion")], *[F.round(c, 6).alias(c) for c in ("score_excess", "score_depletion")])


def threshold_table(s, d):
    return stats.thresholds(_pvalues(s, d), (0.01, 0.05, 0.1)).withColumn("threshold", F.round("threshold", 9))


def selected_thresholds(s, d):
    return stats.selected(stats.thresholds(_pvalues(s, d), (0.01, 0.05)), 0.05, 0.01).withColumns({c: F.round(c, 9) for c in ("suggestive", "strong")})


def _flagged(s, d):
    rows = _pvalues(s, d)
    return stats.flag(rows.withColumn("mask", F.col("l_partkey") % 7 != 0), stats.selected(stats.thresholds(rows, (0.01, 0.05)), 0.05, 0.01), 10, "mask")


def flag_windows(s, d):
    return _flagged(s, d).select("l_partkey", *[f"{x}_{y}" for x in ("excess", "depletion") for y in ("suggestive", "strong")])


QUERIES = {
    "confusion_bp": confusion, "confusion_inclusive": confusion_inclusive, "masked_confusion": masked_confusion, "metric_report": report, "row_normalised": row_shares, "binary_metrics": binary_metrics,
    "interval_metrics": interval_metrics, "confusion_by_length": confusion_by_length, "length_scores": length_scores, "length_shares": length_shares, "filter_grid": filter_grid, "grid_long": grid_long, "mean_std": mean_std, "pivot_table": pivot, "quantile_table": quantile_table,
    "describe": describe, "exposure_histogram": histogram, "grid_counts": grid_counts, "window_effects": window_effects, "binomial_tails": binomial_tails, "threshold_table": threshold_table,
    "selected_thresholds": selected_thresholds, "flag_windows": flag_windows, "flag_summary": lambda s, d: stats.flag_summary(_flagged(s, d)),
}

_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE {} END"
_pv = f"""pv0 AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k, CASE WHEN l_partkey % 50 = 0 THEN 0.0::DOUBLE ELSE {1 / 3!r}::DOUBLE END AS p FROM lineitem GROUP BY l_partkey),
term AS (SELECT l_partkey, k, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) AS t FROM (SELECT *, unnest(range(n + 1)) AS i FROM pv0 WHERE p > 0)),
pv AS (SELECT l_partkey, k, n, p, CASE WHEN k = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE least(1.0, x) END AS p_excess, CASE WHEN k >= n OR p = 0 THEN 1.0 ELSE least(1.0, y) END AS p_depletion
  FROM pv0 LEFT JOIN (SELECT l_partkey, sum(t) FILTER (i >= k) AS x, sum(t) FILTER (i <= k) AS y FROM term GROUP BY l_partkey) USING (l_partkey))"""


def _thr(levels) -> str:
    return "th AS (" + " UNION ALL ".join(
        f"SELECT '{dr}' AS direction, '{name}' AS calibration, {x}::DOUBLE AS level, quantile_cont(p_{dr}, {x}) AS threshold, {str(name == rec).lower()} AS recommended FROM pv WHERE {cond}"
        for dr, rec in (("excess", "all"), ("depletion", "positive")) for name, cond in (("all", "true"), ("positive", "p > 0")) for x in levels
    ) + ")"


def oracles() -> dict[str, str]:
    merged = lambda name, src: f"{name} AS (SELECT chrom, hap, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, hap ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY chrom, hap ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {src} WHERE state LIKE 'ND%')) GROUP BY chrom, hap, g)"
    masked = "{0}m AS (SELECT {0}.chrom, {0}.hap, greatest({0}.s, i.s) AS s, least({0}.e, i.e) AS e, state FROM {0} JOIN lm_i i ON i.chrom = {0}.chrom AND {0}.s < i.e AND i.s < {0}.e)"
    tp = TRUTH_PRED.removeprefix(EVENTS + ", ")
    effective = "xu AS (SELECT *, CASE WHEN l_mod = 0 THEN 0.0::DOUBLE ELSE l_anc / l_mod END AS u FROM ex)"
    grid = f"""WITH {EXPOSURE}, {tp}, {effective}, g(l_thr, u_thr) AS (SELECT unnest([0.5::DOUBLE, 0.8]) AS a, b FROM (SELECT unnest([0.0::DOUBLE, 0.5, 0.7, 0.8]) AS b)),
o AS (SELECT t.chrom, greatest(t.s, p.s) AS s, least(t.e, p.e) AS e, t.state AS ts, p.state AS ps FROM t JOIN p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e),
fg AS (SELECT l_thr, u_thr, ts AS truth_state, ps AS pred_state, sum(least(o.e, x.e) - greatest(o.s, x.s))::BIGINT AS bp FROM o JOIN xu x ON x.chrom = o.chrom AND o.s < x.e AND x.s < o.e JOIN g ON x.l_mod > l_thr AND x.u >= u_thr GROUP BY ALL)"""
    chosen = f"{_thr((0.01, 0.05))}, ch AS (SELECT direction, max(threshold) FILTER (recommended AND level = 0.05) AS suggestive, max(threshold) FILTER (recommended AND level = 0.01) AS strong FROM th GROUP BY direction)"
    flags = "fl AS (SELECT l_partkey, " + ", ".join(f"l_partkey % 7 <> 0 AND n >= 10 AND p_{dr} < (SELECT {w} FROM ch WHERE direction = '{dr}'){' AND p > 0' if dr == 'depletion' else ''} AS {dr}_{w}" for dr in ("excess", "depletion") for w in ("suggestive", "strong")) + " FROM pv)"
    bins = lambda c: " + ".join(f"({c} >= {x})::INTEGER" for x in (0.2, 0.4, 0.6, 0.8))
    binned = f"""bn AS (SELECT unnest({list(range(len(EDGES)))}) AS bin, unnest({list(EDGES)}) AS bin_start, unnest({list(EDGES[1:])} || [NULL]) AS bin_end),
cl AS (SELECT bin, t.state AS ts, p.state AS ps, sum(least(t.e, p.e) - greatest(t.s, p.s))::BIGINT AS bp FROM t JOIN p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e JOIN bn ON t.e - t.s >= bin_start AND (bin_end IS NULL OR t.e - t.s < bin_end) GROUP BY ALL)"""
    cell = lambda a, b: f"coalesce(sum(bp) FILTER (ts {a}LIKE 'ND%' AND ps {b}LIKE 'ND%'), 0)::BIGINT"
    safe = lambda x, y: f"CASE WHEN {y} > 0 THEN {x}::DOUBLE / ({y}) ELSE 0 END"
    return {
        "length_scores": f"""WITH {TRUTH_PRED}, {binned}, c AS (SELECT bin, bin_start::BIGINT AS bin_start, {cell("", "")} AS tp, {cell("NOT ", "")} AS fp, {cell("", "NOT ")} AS fn, {cell("NOT ", "NOT ")} AS tn FROM bn LEFT JOIN cl USING (bin) GROUP BY ALL),
r AS (SELECT *, {safe("tp", "tp + fp")} AS precision, {safe("tp", "tp + fn")} AS recall FROM c) SELECT bin, bin_start, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1.format("0")}, 9) AS f1 FROM r""",
        "length_shares": f"""WITH {TRUTH_PRED}, {binned}, st AS (SELECT unnest({list(STATES)}) AS state), m AS (SELECT bn.bin, bin_start::BIGINT AS bin_start, a.state AS truth_state, b.state AS pred_state, coalesce(bp, 0)::BIGINT AS bp FROM bn CROSS JOIN st a CROSS JOIN st b LEFT JOIN cl ON cl.bin = bn.bin AND ts = a.state AND ps = b.state)
SELECT *, round({safe("bp", "sum(bp) OVER (PARTITION BY bin, truth_state)")}, 9) AS share FROM m""",
        "confusion_bp": f"WITH {CONFUSION} SELECT * FROM conf",
        "confusion_inclusive": f"WITH {CONFUSION} SELECT * FROM conf",
        "masked_confusion": f"WITH {EXPOSURE}, {tp}, {masked.format('t')}, {masked.format('p')} SELECT t.state AS truth_state, p.state AS pred_state, sum(least(t.e, p.e) - greatest(t.s, p.s))::BIGINT AS bp FROM tm t JOIN pm p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e GROUP BY ALL",
        "metric_report": f"""WITH {CONFUSION}, m AS (SELECT state, (SELECT coalesce(sum(bp), 0) FROM conf WHERE truth_state = state AND pred_state = state) AS tp, (SELECT coalesce(sum(bp), 0) FROM conf WHERE truth_state = state) AS sup, (SELECT coalesce(sum(bp), 0) FROM conf WHERE pred_state = state) AS pb FROM (VALUES {', '.join(f"('{x}')" for x in STATES)}) v(state)),
r AS (SELECT state, tp::DOUBLE / pb AS precision, tp::DOUBLE / sup AS recall, sup::BIGINT AS support_bp FROM m) SELECT state, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1.format("'nan'::DOUBLE")}, 9) AS f1, support_bp, (SELECT round(sum(bp) FILTER (truth_state = pred_state)::DOUBLE / sum(bp), 9) FROM conf) AS accuracy, (SELECT sum(bp)::BIGINT FROM conf) AS total_bp FROM r""",
        "row_normalised": f"WITH {CONFUSION} SELECT truth_state, pred_state, bp, round(bp::DOUBLE / sum(bp) OVER (PARTITION BY truth_state), 9) AS share FROM conf",
        "binary_metrics": f"""WITH {CONFUSION}, b AS (SELECT truth_state LIKE 'ND%' AS t, pred_state LIKE 'ND%' AS p, bp FROM conf), c AS (SELECT coalesce(sum(bp) FILTER (t AND p), 0)::BIGINT AS tp, coalesce(sum(bp) FILTER (NOT t AND p), 0)::BIGINT AS fp, coalesce(sum(bp) FILTER (t AND NOT p), 0)::BIGINT AS fn, coalesce(sum(bp) FILTER (NOT t AND NOT p), 0)::BIGINT AS tn FROM b),
r AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM c) SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1.format('0')}, 9) AS f1 FROM r""",
        "interval_metrics": f"""WITH {TRUTH_PRED}, {merged('mt', 't')}, {merged('mp', 'p')}, n AS (SELECT (SELECT sum(least(a.e, b.e) - greatest(a.s, b.s)) FROM mt a JOIN mp b ON a.chrom = b.chrom AND a.hap = b.hap AND a.s < b.e AND b.s < a.e)::BIGINT AS o, (SELECT sum(e - s) FROM mt)::BIGINT AS t, (SELECT sum(e - s) FROM mp)::BIGINT AS p, (SELECT count(*) FROM (SELECT chrom, hap FROM mt UNION SELECT chrom, hap FROM mp)) AS k),
v AS (SELECT 'Archaic' AS view, o AS tp, p - o AS fp, t - o AS fn, k * {31 * DAY} - t - p + o AS tn FROM n UNION ALL SELECT 'Modern', k * {31 * DAY} - t - p + o, t - o, p - o, o FROM n),
r AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM v) SELECT view, tp, fp, fn, tn, round(precision, 4) AS precision, round(recall, 4) AS recall, round({_F1.format('0')}, 4) AS f1 FROM r""",
        "confusion_by_length": f"WITH {TRUTH_PRED} SELECT CASE WHEN t.e - t.s >= {DAY} THEN 3 WHEN t.e - t.s >= {12 * HOUR} THEN 2 WHEN t.e - t.s >= {6 * HOUR} THEN 1 ELSE 0 END AS bin, t.state AS truth_state, p.state AS pred_state, sum(least(t.e, p.e) - greatest(t.s, p.s))::BIGINT AS bp FROM t JOIN p ON t.chrom = p.chrom AND t.hap = p.hap AND t.s < p.e AND p.s < t.e GROUP BY ALL",
        "filter_grid": f"{grid} SELECT * FROM fg",
        "grid_long": f"{grid}, c AS (SELECT l_thr, u_thr, truth_state AS state, sum(bp) AS sup, coalesce(sum(bp) FILTER (truth_state = pred_state), 0) AS hit FROM fg GROUP BY ALL) SELECT c.l_thr, c.u_thr, c.state, round(c.hit::DOUBLE / c.sup, 9) AS recall, round(c.sup::DOUBLE / b.sup, 9) AS retained FROM c LEFT JOIN c b ON b.state = c.state AND b.l_thr = 0.5 AND b.u_thr = 0",
        "mean_std": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS q_mean, round(stddev_samp(l_quantity), 6) AS q_std FROM lineitem GROUP BY ALL",
        "pivot_table": "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F')::BIGINT AS \"F\", sum(l_quantity) FILTER (l_linestatus = 'O')::BIGINT AS \"O\" FROM lineitem GROUP BY l_returnflag",
        "quantile_table": "SELECT o_orderstatus, x.level, round(x.value, 4) AS value FROM (SELECT o_orderstatus, unnest([" + ", ".join(f"{{'level': {x}::DOUBLE, 'value': quantile_cont(o_totalprice, {x})}}" for x in stats.LEVELS) + "]) AS x FROM orders GROUP BY o_orderstatus)",
        "describe": "SELECT o_orderstatus, count(*) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders GROUP BY o_orderstatus",
        "exposure_histogram": f"WITH {EXPOSURE}, b AS (SELECT chrom, " + " + ".join(f"(l_mod >= {i / 10})::INTEGER" for i in range(1, 10)) + " AS bin FROM ex) SELECT chrom, bin, count(*) AS n FROM b GROUP BY GROUPING SETS ((chrom, bin), (bin))",
        "grid_counts": f"""WITH {EXPOSURE}, {tp}, {effective}, a AS (SELECT w.chrom, w.win, w.l_mod, w.u, (SELECT coalesce(sum(least(t.e, w.e) - greatest(t.s, w.s)), 0) FROM t WHERE t.chrom = w.chrom AND state LIKE 'ND%' AND t.s < w.e AND w.s < t.e) > {12 * DAY} AS tr, (SELECT coalesce(sum(least(p.e, w.e) - greatest(p.s, w.s)), 0) FROM p WHERE p.chrom = w.chrom AND state LIKE 'ND%' AND p.s < w.e AND w.s < p.e) > {16 * DAY} AS pr FROM xu w)
SELECT {bins('l_mod')} AS x_bin, {bins('u')} AS y_bin, count(*) AS windows, count(*) FILTER (tr) AS n_true, count(*) FILTER (pr) AS n_pred, count(*) FILTER (tr AND pr) AS n_both FROM a GROUP BY ALL""",
        "window_effects": f"""WITH {EXPOSURE}, {tp}, b AS (SELECT t.chrom, w.win, t.hap % 2 AS g, coalesce(sum(least(t.e, w.e) - greatest(t.s, w.s)) FILTER (state = 'EU'), 0) AS eu, coalesce(sum(least(t.e, w.e) - greatest(t.s, w.s)) FILTER (state = 'ND_EU'), 0) AS nd FROM t JOIN (SELECT * FROM wins UNION ALL SELECT chrom, max(win) + 1, max(e), max(e) + {DAY} FROM wins GROUP BY chrom) w ON w.chrom = t.chrom AND t.s < w.e AND w.s < t.e WHERE state IN ('EU', 'ND_EU') GROUP BY ALL),
e AS (SELECT x.chrom, x.win, x.nd::DOUBLE / (x.eu + x.nd) AS p_a, y.nd::DOUBLE / (y.eu + y.nd) AS p_b FROM b x JOIN b y ON x.chrom = y.chrom AND x.win = y.win AND x.g = 0 AND y.g = 1 WHERE x.eu + x.nd >= {10 * HOUR} AND y.eu + y.nd >= {10 * HOUR}) SELECT chrom, win, round(p_a, 9) AS p_a, round(p_b, 9) AS p_b, round(p_a - p_b, 9) AS effect_delta, round(log2((p_a + 1e-9::DOUBLE) / (p_b + 1e-9::DOUBLE)), 9) AS effect_log2_ratio FROM e""",
        "binomial_tails": f"WITH {_pv} SELECT l_partkey, k, n, round(p_excess, 9) AS p_excess, round(p_depletion, 9) AS p_depletion, round(0 - log10(greatest(p_excess, 5e-324::DOUBLE)), 6) AS score_excess, round(0 - log10(greatest(p_depletion, 5e-324::DOUBLE)), 6) AS score_depletion FROM pv",
        "threshold_table": f"WITH {_pv}, {_thr((0.01, 0.05, 0.1))} SELECT direction, calibration, level, round(threshold, 9) AS threshold, recommended FROM th",
        "selected_thresholds": f"WITH {_pv}, {chosen} SELECT direction, round(suggestive, 9) AS suggestive, round(strong, 9) AS strong FROM ch",
        "flag_windows": f"WITH {_pv}, {chosen}, {flags} SELECT * FROM fl",
        "flag_summary": f"WITH {_pv}, {chosen}, {flags} SELECT count(*) AS windows, " + ", ".join(f"count(*) FILTER ({x}_{y}) AS {x}_{y}" for x in ("excess", "depletion") for y in ("suggestive", "strong")) + " FROM fl",
    }
