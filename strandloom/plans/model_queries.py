"""Queries of the model: emissions, decoding, expectation, tracts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions.hmm_params import RATES as RATE_NAMES
from strandloom.functions.hmm_params import rate_columns, transition_columns
from strandloom.operators import hmm, intervals, tracts
from strandloom.plans.domain import COUNTS, DAY, PATHS, RATES, TRANS, ZEROED, counts, emission_sql, events, path, table, zeroed
from strandloom.plans.pipeline import fixed_run

KEYS = ["chrom", "hap"]
CONFIG = {
    "mutation": 1.25e-8, "window_length": 1000, "generation_time": 29.0, "rr": 1e-8, "t_introgression_c": 56000.0, "t_n_c": 640000.0, "t_af_c": 100000.0, "t_ea_c": 40000.0, "t_mexicans_c": 15000.0,
    "t_introgression": 55000.0, "t_mexicans": 500.0, "admixture_modern": [0.45, 0.5, 0.05], "admixture_nd": 0.025,
}


#: Parameters of a run for each supplier.
PARAMS = {"ti": "1000.0 + s_suppkey % 900", "tmex": "16.0 + s_suppkey % 50", "rr": "1e-8 * (1 + s_nationkey)", "a": "0.2 + 0.05 * (s_suppkey % 7)", "b": "0.1 + 0.01 * s_nationkey", "c1": "0.02 + 0.01 * (s_suppkey % 3)", "c2": "0.03"}


def parameters(s, d):
    """A supplier's parameters, of which its balance is the mutation rate's share."""
    rows = table(s, d, "supplier").selectExpr("s_suppkey", "s_acctbal", *[f"CAST({x} AS DOUBLE) AS {n}" for n, x in PARAMS.items()])
    return rows.withColumns({"mutation": F.col("s_acctbal") * 1e-12, "width": F.lit(1000.0), "years": F.lit(29.0)})


def initial_rates(s, d):
    """Starting rates of each supplier's run."""
    times = {r: F.lit(CONFIG[f"t_{x}_c"]) for r, x in zip(RATE_NAMES, ("introgression", "n", "af", "ea", "mexicans"), strict=True)}
    made = rate_columns(F.col("mutation"), F.col("width"), F.col("years"), times)
    return parameters(s, d).select("s_suppkey", *[F.round(c * 1e6, 6).alias(r) for r, c in made.items()])


def transition_matrix(s, d):
    """Transitions of each supplier's run: p, q, v."""
    made = transition_columns(*[F.col(n) for n in ("ti", "tmex", "rr", "a", "b", "c1", "c2", "width")])
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), v.alias("v")) for p, row in enumerate(made) for q, v in enumerate(row)])
    return parameters(s, d).select("s_suppkey", F.explode(cells).alias("x")).select("s_suppkey", "x.p", "x.q", F.round("x.v", 9).alias("v"))


def _round(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def emissions(s, d):
    e = [f"e{i}" for i in range(5)]
    return _round(hmm.emissions(zeroed(s, d), RATES), e).select(*KEYS, "win", *e)


def posteriors(s, d):
    return _round(hmm.posteriors(hmm.pack(zeroed(s, d), KEYS), KEYS, RATES, TRANS.log_matrix()), [*(f"g{i}" for i in range(5)), "loglik"])


def em_step(s, d):
    """One step: the rates after it and the log likelihood before."""
    return em_steps(s, zeroed(s, d), 1)


def em_steps(s, counts, steps):
    """The rates after some steps and the log likelihood before the last."""
    packed = hmm.pack(counts, KEYS).persist()
    rates, seen = hmm.em(packed, KEYS, RATES, TRANS.log_matrix(), steps=steps)
    packed.unpersist()
    return s.createDataFrame([(n, round(float(x), 6), round(seen[-1], 4)) for n, x in zip(("i", "n", "af", "ea", "mex"), rates, strict=True)], "rate string, value double, loglik double")


def em_fit(s, d):
    """All steps: the log likelihood before each, and the rates at the end under -1 to -5."""
    packed = hmm.pack(zeroed(s, d), KEYS).persist()
    rates, seen = hmm.em(packed, KEYS, RATES, TRANS.log_matrix())
    packed.unpersist()
    return s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(seen)], "step int, loglik double").unionByName(s.createDataFrame([(-1 - i, round(float(x), 6)) for i, x in enumerate(rates)], "step int, loglik double"))


#: Gaps are the stretches of so many seconds that have a purchase.
GAP = 300


def gaps(s, d):
    at = F.expr(f"(pos div {GAP}) * {GAP}")
    return events(s, d).where("event_type = 'purchase'").select("chrom", at.alias("s"), (at + GAP).alias("e"))


_gaps = f"gp AS (SELECT DISTINCT chrom, pos // {GAP} AS h FROM ev WHERE event_type = 'purchase')"


def split_tracts(s, d):
    return tracts.inclusive(tracts.split_tracts(path(s, d), KEYS))


def absorb_tracts(s, d):
    return tracts.inclusive(tracts.absorb_tracts(path(s, d), KEYS))


def gap_free_tracts(s, d):
    cut = intervals.merge(gaps(s, d), ["chrom"])
    return tracts.inclusive(tracts.clean_gaps(tracts.absorb_tracts(path(s, d), KEYS), cut, ["chrom"], DAY))


def run_segments(s, d):
    rows = path(s, d).select("chrom", "hap", F.col("s").alias("spos"), F.col("e").alias("epos"), (F.col("state") + 1).alias("code"))
    return tracts.run_segments(rows, KEYS, "spos", "epos", "code")


QUERIES = {
    "flagship_tracts": absorb_tracts, "initial_rates": initial_rates, "transition_matrix": transition_matrix, "emissions": emissions, "viterbi_path": path, "posteriors": posteriors, "em_step": em_step, "em_three_steps": lambda s, d: em_steps(s, zeroed(s, d), 3), "em_fit": em_fit,
    "split_tracts": split_tracts, "absorb_tracts": absorb_tracts, "gap_free_tracts": gap_free_tracts, "run_segments": run_segments, "plain_run": lambda s, d: fixed_run(counts(s, d), KEYS, RATES, TRANS.log_matrix(), gaps(s, d), DAY),
}

_states = "(['UNINFORMATIVE', 'EU', 'ND_EU', 'NA', 'ND_NA', 'AF'])[state + 2]"


def _runs(source: str, state: str = "state") -> str:
    return f"SELECT chrom, hap, min(s) AS s, max(e) AS e, {state} AS state FROM (SELECT *, win - row_number() OVER (PARTITION BY chrom, hap, {state} ORDER BY win) AS g FROM {source}) GROUP BY chrom, hap, {state}, g"


_absorb = """ab AS (SELECT chrom, hap, win, s, e, coalesce(last_value(nullif(state, -1) IGNORE NULLS) OVER (PARTITION BY chrom, hap ORDER BY win ROWS UNBOUNDED PRECEDING),
  first_value(nullif(state, -1) IGNORE NULLS) OVER (PARTITION BY chrom, hap ORDER BY win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS state FROM path)"""
_out = f'SELECT chrom, hap, s AS "Start", e - 1 AS "End", e - s AS "Length", {_states} AS "State"'


def _hours(source: str) -> str:
    """Runs of source's tracts without the stretches of gp."""
    return f"""hh AS (SELECT t.*, h FROM (SELECT *, row_number() OVER () AS id FROM ({source})) t, LATERAL (SELECT unnest(range(t.s // {GAP}, t.e // {GAP})) AS h)),
ok AS (SELECT hh.* FROM hh ANTI JOIN gp USING (chrom, h)),
cut AS (SELECT chrom, hap, state, min(h) * {GAP} AS s, (max(h) + 1) * {GAP} AS e FROM (SELECT *, h - row_number() OVER (PARTITION BY id ORDER BY h) AS g FROM ok) GROUP BY chrom, hap, state, id, g)"""


def _forward_backward(em: str, k: str = "") -> str:
    """Scaled recursions over the windows of em's scores; f and b hold a list of five numbers for each haplotype and window.
    k ends the names of this step's tables."""
    dot = lambda v, q: " + ".join(f"{v}[{p + 1}] * {float(np.exp(TRANS.log_matrix())[p, q])!r}::DOUBLE" for p in range(5))
    back = lambda v, p: " + ".join(f"{v}[{q + 1}] * {float(np.exp(TRANS.log_matrix())[p, q])!r}::DOUBLE" for q in range(5))
    return f"""em{k} AS ({em}),
lk{k} AS (SELECT chrom, hap, win, greatest(e0, e1, e2, e3, e4) AS top, [{', '.join(f'exp(e{i} - greatest(e0, e1, e2, e3, e4))' for i in range(5))}] AS l FROM em{k}),
f{k} AS (SELECT chrom, hap, win, list_transform(x, lambda v: v / list_sum(x)) AS a, list_sum(x) AS c, top FROM (SELECT chrom, hap, win, top, [{', '.join(f'l[{i + 1}] / 5' for i in range(5))}] AS x FROM lk{k} WHERE win = 0)
  UNION ALL SELECT chrom, hap, win, list_transform(x, lambda v: v / list_sum(x)) AS a, list_sum(x) AS c, top FROM (SELECT lk.chrom, lk.hap, lk.win, lk.top, [{', '.join(f'({dot("f.a", i)}) * lk.l[{i + 1}]' for i in range(5))}] AS x FROM f{k} f JOIN lk{k} lk ON lk.chrom = f.chrom AND lk.hap = f.hap AND lk.win = f.win + 1)),
b{k} AS (SELECT chrom, hap, win, [1.0::DOUBLE, 1.0, 1.0, 1.0, 1.0] AS v FROM f{k} QUALIFY row_number() OVER (PARTITION BY chrom, hap ORDER BY win DESC) = 1
  UNION ALL SELECT b.chrom, b.hap, b.win - 1, [{', '.join(f'({back("y", i)}) / c' for i in range(5))}] FROM (SELECT b.chrom, b.hap, b.win, f.c, [{', '.join(f'b.v[{i + 1}] * lk.l[{i + 1}]' for i in range(5))}] AS y FROM b{k} b JOIN lk{k} lk USING (chrom, hap, win) JOIN f{k} f USING (chrom, hap, win) WHERE b.win > 0) b),
gm{k} AS (SELECT chrom, hap, win, list_transform(x, lambda v: v / list_sum(x)) AS g FROM (SELECT f.chrom, f.hap, f.win, [{', '.join(f'f.a[{i + 1}] * b.v[{i + 1}]' for i in range(5))}] AS x FROM f{k} f JOIN b{k} b USING (chrom, hap, win))),
ll{k} AS (SELECT chrom, hap, sum(ln(c)) + sum(top) AS loglik FROM f{k} GROUP BY chrom, hap)"""


def _em_tables(rows: str, steps: int) -> str:
    """Steps one after the other; each takes its rates from the one row that the step before it leaves."""
    num: dict[int, list[str]] = {r: [] for r in range(5)}
    den: dict[int, list[str]] = {r: [] for r in range(5)}
    for state, panel in enumerate(hmm.PANELS):
        for o, r in zip(hmm.OBS, panel, strict=True):
            x = "l_anc" if o == "o_nd" else "l_mod"
            num[r].append(f"CASE WHEN {x} > 0 THEN g[{state + 1}] * {o} ELSE 0 END")
            den[r].append(f"g[{state + 1}] * {x}")
    first = f"rate0 AS (SELECT {', '.join(f'{float(RATES[r])!r}::DOUBLE AS r{r}' for r in range(5))})"
    tables = [rows, first]
    for k in range(1, steps + 1):
        after = ", ".join(f"CASE WHEN sum({' + '.join(den[r])}) > 1e-8 THEN sum({' + '.join(num[r])}) / (sum({' + '.join(den[r])}) + 1e-20) ELSE (SELECT r{r} FROM rate{k - 1}) END AS r{r}" for r in range(5))
        tables += [_forward_backward(emission_sql(f"z, rate{k - 1}", rate=lambda r: f"r{r}"), str(k)), f"rate{k} AS MATERIALIZED (SELECT {after} FROM gm{k} JOIN z USING (chrom, hap, win))"]
    return f"WITH RECURSIVE {', '.join(tables)}"


def em_sql(rows: str = ZEROED, steps: int = 1) -> str:
    out = " UNION ALL ".join(f"SELECT '{n}' AS rate, round(r{r}, 6) AS value, (SELECT round(sum(loglik), 4) FROM ll{steps}) AS loglik FROM rate{steps}" for r, n in enumerate(("i", "n", "af", "ea", "mex")))
    return f"{_em_tables(rows, steps)} {out}"


def _fit_sql(steps: int = 20, tol: float = 1e-8) -> str:
    """All steps are made; what comes after the first that gains less than tol is left out."""
    seen = " UNION ALL ".join(f"SELECT {k} AS k, sum(loglik) AS v, r0, r1, r2, r3, r4 FROM ll{k}, rate{k} GROUP BY ALL" for k in range(1, steps + 1))
    rates = " UNION ALL ".join(f"SELECT {-1 - r} AS step, round(r{r}, 6) AS loglik FROM seen, last WHERE k = n" for r in range(5))
    return f"""{_em_tables(ZEROED, steps)}, seen AS MATERIALIZED ({seen}),
last AS (SELECT coalesce(min(k) FILTER (WHERE abs(gain) < {tol!r}::DOUBLE), {steps}) AS n FROM (SELECT k, v - lag(v) OVER (ORDER BY k) AS gain FROM seen))
SELECT k - 1 AS step, round(v, 6) AS loglik FROM seen, last WHERE k <= n UNION ALL {rates}"""


def oracles() -> dict[str, str]:
    theta = f"(s_acctbal::DOUBLE * 1e-12::DOUBLE * 1000.0::DOUBLE / {CONFIG['generation_time']!r}::DOUBLE)"
    rates = ", ".join(f"round({theta} * {CONFIG[k]!r}::DOUBLE * 1e6::DOUBLE, 6) AS {n}" for n, k in zip(RATE_NAMES, ("t_introgression_c", "t_n_c", "t_af_c", "t_ea_c", "t_mexicans_c"), strict=True))
    absorb = f"WITH {PATHS}, {_absorb}, tr1 AS ({_runs('ab')}) {_out} FROM tr1"
    return {
        "initial_rates": f"SELECT s_suppkey, {rates} FROM supplier",
        "transition_matrix": _matrix_oracle(),
        "emissions": f"WITH {ZEROED}, em AS ({emission_sql('z')}) SELECT chrom, hap, win, {', '.join(f'round(e{i}, 6) AS e{i}' for i in range(5))} FROM em",
        "viterbi_path": f"WITH {PATHS} SELECT * FROM path",
        "posteriors": f"WITH RECURSIVE {ZEROED}, {_forward_backward(emission_sql('z'))} SELECT gm.chrom, gm.hap, gm.win, {', '.join(f'round(g[{i + 1}], 6) AS g{i}' for i in range(5))}, round(loglik, 6) AS loglik FROM gm JOIN ll USING (chrom, hap)",
        "em_step": em_sql(),
        "em_three_steps": em_sql(steps=3),
        "em_fit": _fit_sql(),
        "split_tracts": f"WITH {PATHS}, tr1 AS ({_runs('path')}) {_out} FROM tr1",
        "absorb_tracts": absorb,
        "flagship_tracts": absorb,
        "gap_free_tracts": f"WITH {PATHS}, {_absorb}, {_gaps}, {_hours(_runs('ab'))} {_out} FROM cut",
        "run_segments": f"WITH {PATHS}, tr1 AS ({_runs('path')}) SELECT chrom, hap, s, e, state + 1 AS state FROM tr1",
        "plain_run": f"WITH {PATHS.replace(ZEROED, COUNTS + ', z AS (SELECT * FROM obs)').replace('CASE WHEN z.l_mod = 0 AND z.l_anc = 0 THEN -1 ELSE bt.q END', 'bt.q')}, {_gaps}, {_hours(_runs('path'))} {_out} FROM cut",
    }


def _matrix_oracle() -> str:
    """The matrix from its published form, entry by entry."""
    given = ", ".join(f"({x.replace('1e-8', '1e-8::DOUBLE')})::DOUBLE AS {n}" for n, x in PARAMS.items())
    base = f"(SELECT *, exp(-ti * x) AS ei, exp(-(ti - tmex) * x) AS eim, exp(-tmex * x) AS em FROM (SELECT *, rr * 1000 AS x FROM (SELECT s_suppkey, {given} FROM supplier)))"
    parts = f"(SELECT *, 1 - em AS k, (1 - eim) * em + (1 - em) * a AS fa, (1 - eim) * em + (1 - em) * b AS fb FROM {base})"
    c = {0: ("fa", "k * a", "c1"), 1: ("fb", "k * b", "c2")}
    cells = []
    for p in range(5):
        for q in range(5):
            if q == 4:
                v = "k * (1 - a - b)" + (" + em" if p == 4 else "")
            else:
                own, other, share = c[q // 2]
                v = f"({own if p // 2 == q // 2 and p < 4 else other}) * ({share if q % 2 else f'1 - {share}'})" + (" + ei" if p == q else "")
            cells.append(f"SELECT s_suppkey, {p} AS p, {q} AS q, round({v}, 9) AS v FROM x")
    return f"WITH x AS {parts} " + " UNION ALL ".join(cells)
