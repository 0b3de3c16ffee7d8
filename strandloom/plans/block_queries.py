"""Queries of the model over blocks of windows, of pairs of states, and of runs that go on after a stop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import hmm, hmm_blocks, hmm_refit
from strandloom.operators.shared import scratch
from strandloom.plans import model_queries
from strandloom.plans.domain import DAY, PATHS, RATES, TRANS, ZEROED, counts, emission_sql, zeroed
from strandloom.plans.model_queries import KEYS
from strandloom.plans.pipeline import em_run

#: Windows of a block, so that haplotypes of any length have several.
BLOCK = 20
NAMES = ("i", "n", "af", "ea", "mex")


def viterbi_blocks(s, d):
    return hmm_blocks.decode(hmm_blocks.pack(zeroed(s, d), KEYS, BLOCK), KEYS, RATES, TRANS.log_matrix())


def posteriors_blocks(s, d):
    rows = hmm_blocks.posteriors(hmm_blocks.pack(zeroed(s, d), KEYS, BLOCK), KEYS, RATES, TRANS.log_matrix())
    return model_queries._round(rows, [*(f"g{i}" for i in range(5)), "loglik"])


def em_resumed(s, d):
    """Three steps over blocks, of which two are made by a run that goes on from the first one's state."""
    at, packed = scratch(s, "em"), hmm_blocks.pack(zeroed(s, d), KEYS, BLOCK).persist()
    for steps in (1, 3):
        rates, seen = hmm.em(packed, KEYS, RATES, TRANS.log_matrix(), steps, expect=hmm_blocks.expectations, state=at)
    packed.unpersist()
    return s.createDataFrame([(n, round(float(x), 6), round(seen[-1], 4)) for n, x in zip(NAMES, rates, strict=True)], "rate string, value double, loglik double")


def pair_sums(s, d):
    """Expected numbers of neighbouring windows in states p and q."""
    rows = hmm_blocks.expectations(hmm_blocks.pack(zeroed(s, d), KEYS, BLOCK), KEYS, RATES, TRANS.log_matrix())
    sums = rows.agg(*[F.sum(c).alias(c) for c in hmm_blocks.PAIRS])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(int(c[2])).alias("p"), F.lit(int(c[3])).alias("q"), F.col(c).alias("v")) for c in hmm_blocks.PAIRS])).alias("x"))
    return long.select("x.p", "x.q", F.round("x.v", 6).alias("v"))


def refit_fit(s, d):
    """Eight steps that fit transitions too: the log likelihood before each, then a, b and the archaic share under -1 to -3."""
    packed = hmm.pack(zeroed(s, d), KEYS).persist()
    _, t, seen = hmm_refit.em(packed, KEYS, RATES, TRANS, steps=8)
    packed.unpersist()
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(seen)] + [(-1, t.a), (-2, t.b), (-3, t.c1)], "step int, loglik double")


def em_segments(s, d):
    """Segments of a run with one EM step: zeroed counts, fitted rates, masked paths, absorbed windows, gaps cut out."""
    return em_run(counts(s, d), KEYS, RATES, TRANS, model_queries.gaps(s, d), DAY, steps=1, block=BLOCK)[0]


QUERIES = {f.__name__: f for f in (viterbi_blocks, posteriors_blocks, em_resumed, pair_sums, refit_fit, em_segments)}


def _pairs_sql() -> str:
    m = np.exp(TRANS.log_matrix())
    cells = " UNION ALL ".join(f"SELECT {p} AS p, {q} AS q, round(coalesce(sum(a[{p + 1}] * {float(m[p, q])!r}::DOUBLE * l[{q + 1}] * v[{q + 1}] / c), 0), 6) AS v FROM x" for p in range(5) for q in range(5))
    tables = model_queries._forward_backward(emission_sql("z"))
    return f"WITH RECURSIVE {ZEROED}, {tables}, x AS (SELECT o.a, f.c, lk.l, b.v FROM f JOIN lk USING (chrom, hap, win) JOIN b USING (chrom, hap, win) JOIN f o ON o.chrom = f.chrom AND o.hap = f.hap AND o.win = f.win - 1) {cells}"


def oracles() -> dict[str, str]:
    whole = model_queries.oracles()
    fitted = PATHS.removeprefix("RECURSIVE " + ZEROED).replace(emission_sql("z"), emission_sql("z, rate1", rate=lambda r: f"r{r}"))
    tail = f"{model_queries._absorb}, {model_queries._gaps}, {model_queries._hours(model_queries._runs('ab'))} {model_queries._out} FROM cut"
    return {"em_segments": f"{model_queries._em_tables(ZEROED, 1)}{fitted}, {tail}", "viterbi_blocks": whole["viterbi_path"], "posteriors_blocks": whole["posteriors"], "em_resumed": whole["em_three_steps"], "pair_sums": _pairs_sql()}
