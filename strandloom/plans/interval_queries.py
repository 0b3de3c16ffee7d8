"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.plans.domain import DAY, MODERN, EVENTS, EXPOSURE, HOUR, LENGTHS, WINDOWS, covered, days, days_sql, each_day, events, exposure, islands_sql, lengths, segments, segments_sql

K = ["k"]
R, A, N = ("l_returnflag = 'R'", "l_returnflag = 'A'", "l_returnflag = 'N' and l_linestatus = 'F'")
WIDTH = 32
_abc = ", ".join([days_sql("a", R), days_sql("b", A), days_sql("c", N)])
_abc_days = f"{_abc}, da AS ({each_day('a')}), db AS ({each_day('b')}), dc AS ({each_day('c')})"


def _lists(s, d):
    return days(s, d, R), days(s, d, A), days(s, d, N)


def _merged(s, d):
    return [iv.merge(x, K) for x in _lists(s, d)]


def subtract_labelled(s, d):
    a, b, _ = _lists(s, d)
    return iv.subtract_labelled(a.select("k", "s", "e", "st"), iv.merge(b, K), K, WIDTH)


def _coverage(s, d):
    size = lengths(s, d)
    return iv.coverage(iv.clip(iv.merge(covered(s, d, *MODERN), ["chrom"]).join(size, "chrom"), 0, F.col("length")).drop("length"), size, ["chrom"], 5 * HOUR)


_cov = f"""{EVENTS}, {LENGTHS}, i AS (SELECT chrom, pos AS s, pos + {MODERN[1]} AS e FROM ev WHERE event_type = '{MODERN[0]}'),
m AS (SELECT chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= top THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i)) GROUP BY chrom, g),
mm AS (SELECT m.chrom, m.s, least(m.e, length) AS e FROM m JOIN lens USING (chrom)),
w AS (SELECT chrom, w AS win, w * {5 * HOUR} AS s, least(w * {5 * HOUR} + {5 * HOUR}, length) AS e FROM lens, LATERAL (SELECT unnest(range((length + {5 * HOUR - 1}) // {5 * HOUR})) AS w)),
cov AS (SELECT w.chrom, w.win, w.s, w.e, coalesce(sum(least(w.e, mm.e) - greatest(w.s, mm.s)) FILTER (WHERE mm.s IS NOT NULL), 0)::DOUBLE / greatest(1, w.e - w.s) AS frac FROM w LEFT JOIN mm ON mm.chrom = w.chrom AND mm.s < w.e AND w.s < mm.e GROUP BY w.chrom, w.win, w.s, w.e)"""

_uv = "x AS (SELECT DISTINCT d.k, d.d FROM da d ANTI JOIN db USING (k, d))"
_regimes = {
    "none": "SELECT k, d FROM x",
    "single": "SELECT k, d FROM x SEMI JOIN db2 USING (k, d)",
    "union": "SELECT k, d FROM x SEMI JOIN (SELECT * FROM db2 UNION SELECT * FROM dc) USING (k, d)",
    "intersection": "SELECT k, d FROM x SEMI JOIN db2 USING (k, d) SEMI JOIN dc USING (k, d)",
}


def _regime(mode):
    def f(s, d):
        a, b, c = _lists(s, d)
        return iv.regime(a, [days(s, d, "l_returnflag = 'N' and l_linestatus = 'O'"), c], b, K, mode)

    return f


QUERIES = {
    "merge_intervals": lambda s, d: iv.merge(days(s, d, R), K),
    "merge_intervals_prebinned": lambda s, d: iv.merge(days(s, d), K, stretch=64),
    "clip_intervals": lambda s, d: iv.clip(days(s, d, R), 300, 900),
    "overlap_pairs": lambda s, d: iv.overlaps(*[x.select("k", "s", "e", "st") for x in _lists(s, d)[:2]], K, WIDTH),
    "intersect_two": lambda s, d: iv.intersect(*_merged(s, d)[:2], K, WIDTH),
    "intersect_many": lambda s, d: iv.intersect_many(_lists(s, d), K),
    "union_many": lambda s, d: iv.union_many(_lists(s, d), K),
    "subtract_intervals": lambda s, d: iv.subtract(*_lists(s, d)[:2], K),
    "intersect_and_subtract": lambda s, d: iv.intersect_and_subtract(*_lists(s, d)[:2], K),
    "subtract_labelled": subtract_labelled,
    "window_coverage": _coverage,
    "windows_above_fraction": lambda s, d: iv.windows_above(_coverage(s, d), ["chrom"], 0.5),
    "points_in_intervals": lambda s, d: iv.points_in(events(s, d), covered(s, d, *MODERN), ["chrom"], HOUR).select("event_id", "chrom", "pos"),
    "total_length": lambda s, d: iv.total_length(iv.merge(days(s, d, R), K), K),
    "overlap_length": lambda s, d: iv.total_length(iv.intersect(*_merged(s, d)[:2], K, WIDTH), K),
    "clip_labelled_to_mask": lambda s, d: iv.overlaps(segments(s, d), iv.merge(covered(s, d, *MODERN), ["chrom"]), ["chrom"], DAY),
    "archaic_bp_by_window": lambda s, d: iv.window_bp(segments(s, d).where("state in ('ND_EU', 'ND_NA')"), ["chrom", "hap"], DAY),
    "truth_window_counts": lambda s, d: iv.window_bp(segments(s, d).where("state in ('EU', 'ND_EU')"), ["chrom", "state"], DAY),
    "make_windows": lambda s, d: iv.make_windows(lengths(s, d), 7 * HOUR),
    "make_whole_windows": lambda s, d: iv.make_windows(lengths(s, d), 7 * HOUR, last=False),
    "effective_coverage": lambda s, d: iv.effective(exposure(s, d)),
    **{f"mask_regime_{m}": _regime(m) for m in _regimes},
}


def oracles() -> dict[str, str]:
    merged = lambda p: f"WITH {_abc_days} {islands_sql(p)}"
    out = {
        "merge_intervals": f"WITH {days_sql('a', R)} {islands_sql(each_day('a'))}",
        "merge_intervals_prebinned": f"WITH {days_sql('a')} {islands_sql(each_day('a'))}",
        "clip_intervals": f"WITH {days_sql('a', R)} SELECT k, greatest(s, 300) AS s, least(e, 900) AS e, f, st FROM a WHERE greatest(s, 300) < least(e, 900)",
        "overlap_pairs": f"WITH {_abc} SELECT a.k, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, a.st, b.st AS st_b FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e",
        "intersect_two": merged("SELECT * FROM da INTERSECT SELECT * FROM db"),
        "intersect_many": merged("SELECT * FROM da INTERSECT SELECT * FROM db INTERSECT SELECT * FROM dc"),
        "union_many": merged("SELECT * FROM da UNION SELECT * FROM db UNION SELECT * FROM dc"),
        "subtract_intervals": merged("SELECT * FROM da EXCEPT SELECT * FROM db"),
        "intersect_and_subtract": f"WITH {_abc_days}, i AS ({islands_sql('SELECT * FROM da INTERSECT SELECT * FROM db')}), o AS ({islands_sql('SELECT * FROM da EXCEPT SELECT * FROM db')}) SELECT *, true AS inside FROM i UNION ALL SELECT *, false FROM o",
        "subtract_labelled": f"""WITH {_abc}, r AS (SELECT k, s, e, st, row_number() OVER () AS id FROM a), h AS (SELECT DISTINCT k, unnest(range(s, e)) AS d FROM b),
x AS (SELECT r.k, st, id, d FROM r, LATERAL (SELECT unnest(range(r.s, r.e)) AS d)), y AS (SELECT x.* FROM x ANTI JOIN h USING (k, d))
SELECT k, st, min(d) AS s, max(d) + 1 AS e FROM (SELECT *, d - row_number() OVER (PARTITION BY id ORDER BY d) AS g FROM y) GROUP BY k, st, id, g""",
        "window_coverage": f"WITH {_cov} SELECT chrom, win, s, e, frac FROM cov",
        "windows_above_fraction": f"WITH {_cov}, k AS (SELECT chrom, win, s, e, win - row_number() OVER (PARTITION BY chrom ORDER BY win) AS g FROM cov WHERE frac > 0.5) SELECT chrom, min(s) AS s, max(e) AS e FROM k GROUP BY chrom, g",
        "points_in_intervals": f"WITH {EVENTS} SELECT event_id, chrom, pos FROM ev WHERE EXISTS (SELECT 1 FROM ev i WHERE i.event_type = '{MODERN[0]}' AND i.chrom = ev.chrom AND i.pos <= ev.pos AND ev.pos < i.pos + {MODERN[1]})",
        "total_length": f"WITH {days_sql('a', R)} SELECT k, count(*) AS bp FROM ({each_day('a')}) GROUP BY k",
        "overlap_length": f"WITH {_abc_days} SELECT k, count(*) AS bp FROM (SELECT * FROM da INTERSECT SELECT * FROM db) GROUP BY k",
        "clip_labelled_to_mask": f"""WITH {EXPOSURE}, {segments_sql('t')}
SELECT t.chrom, t.hap, greatest(t.s, i.s) AS s, least(t.e, i.e) AS e, t.state FROM t JOIN lm_i i ON i.chrom = t.chrom AND t.s < i.e AND i.s < t.e""",
        "make_windows": f"WITH {EVENTS}, {LENGTHS} SELECT chrom, w AS win, w * {7 * HOUR} AS s, least(w * {7 * HOUR} + {7 * HOUR}, length) AS e FROM lens, LATERAL (SELECT unnest(range((length + {7 * HOUR - 1}) // {7 * HOUR})) AS w)",
        "make_whole_windows": f"WITH {EVENTS}, {LENGTHS} SELECT chrom, w AS win, w * {7 * HOUR} AS s, w * {7 * HOUR} + {7 * HOUR} AS e FROM lens, LATERAL (SELECT unnest(range(length // {7 * HOUR})) AS w)",
        "effective_coverage": f"WITH {EXPOSURE} SELECT chrom, win, s, e, l_mod, l_anc, CASE WHEN l_mod = 0 THEN 0.0::DOUBLE ELSE l_anc / l_mod END AS u FROM ex",
    }
    by_window = f"""WITH {EVENTS}, {LENGTHS}, {WINDOWS}, {segments_sql('t')} SELECT t.chrom, {{key}}, w.win, sum(least(t.e, w.e) - greatest(t.s, w.s))::BIGINT AS bp
FROM t JOIN wins w ON w.chrom = t.chrom AND t.s < w.e AND w.s < t.e WHERE state IN {{states}} GROUP BY ALL"""
    out["archaic_bp_by_window"] = by_window.format(key="hap", states="('ND_EU', 'ND_NA')")
    out["truth_window_counts"] = by_window.format(key="state", states="('EU', 'ND_EU')")
    second = days_sql("b2", "l_returnflag = 'N' and l_linestatus = 'O'")
    for mode, points in _regimes.items():
        out[f"mask_regime_{mode}"] = f"WITH {_abc_days}, {second}, db2 AS ({each_day('b2')}), {_uv} {islands_sql(points)}"
    return out


