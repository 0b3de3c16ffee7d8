"""Kernels over blocks against those over whole haplotypes, pairs of states, refitted transitions, runs that go on."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.hmm_params import Transitions
from strandloom.operators import em_state, hmm, hmm_blocks, hmm_refit
from strandloom.plans.pipeline import em_run, fixed_run
from table_rows import rows

T = Transitions(ti=1500, tmex=20, rr=2e-6, a=0.4, b=0.4, c1=0.1, c2=0.1, width=1000)
RATES = np.array([0.5, 4.0, 1.5, 1.0, 0.3])
KEYS = ["chrom", "hap"]


@pytest.fixture(scope="module")
def data(spark):
    """Haplotypes of 0 to 400 windows, with windows without exposure, long ties and first windows other than 0."""
    df = hmm.sample(spark, 6, 400, RATES, T.log_matrix()).where("win >= hap * 13 AND win < 400 - hap * 60")
    bare = (F.col("win") % 50 < 12) | (F.col("hap") == 3)
    return df.withColumns({c: F.when(bare, 0).otherwise(F.col(c)) for c in (*hmm.OBS, "l_mod", "l_anc")}).drop("state").cache()


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_paths_and_posteriors(data, block):
    packed, blocks = hmm.pack(data, KEYS), hmm_blocks.pack(data, KEYS, block)
    for mask in (True, False):
        assert rows(hmm_blocks.decode(blocks, KEYS, RATES, T.log_matrix(), mask)) == rows(hmm.decode(packed, KEYS, RATES, T.log_matrix(), mask))
    want = hmm.posteriors(packed, KEYS, RATES, T.log_matrix()).toPandas().sort_values(["hap", "win"])
    got = hmm_blocks.posteriors(blocks, KEYS, RATES, T.log_matrix()).toPandas().sort_values(["hap", "win"])
    for c in ("g0", "g1", "g2", "g3", "g4", "loglik"):
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-10)


def test_equal_scores_over_blocks_take_the_lowest_state(spark):
    df = spark.range(40).selectExpr("'c' AS chrom", "1 AS hap", "id AS win", "id AS s", "id + 1 AS e", *(f"0L AS {o}" for o in hmm.OBS), "1.0D AS l_mod", "1.0D AS l_anc")
    flat = np.log(np.full((5, 5), 0.2))
    for rates in (RATES, np.ones(5)):
        assert rows(hmm_blocks.decode(hmm_blocks.pack(df, KEYS, 7), KEYS, rates, flat)) == rows(hmm.decode(hmm.pack(df, KEYS), KEYS, rates, flat))


def test_hopeless_windows_over_blocks(spark):
    """Scores far beyond what exp() holds."""
    df = spark.range(30).selectExpr("'c' AS chrom", "1 AS hap", "id AS win", "id AS s", "id + 1 AS e", *(f"if(id % 7 = {k}, 100000L, 0L) AS {o}" for k, o in enumerate(hmm.OBS)), "1.0D AS l_mod", "1.0D AS l_anc")
    packed, blocks = hmm.pack(df, KEYS), hmm_blocks.pack(df, KEYS, 4)
    assert rows(hmm_blocks.decode(blocks, KEYS, RATES, T.log_matrix())) == rows(hmm.decode(packed, KEYS, RATES, T.log_matrix()))
    got, want = (sorted(x.collect()) for x in (hmm_blocks.posteriors(blocks, KEYS, RATES, T.log_matrix()), hmm.posteriors(packed, KEYS, RATES, T.log_matrix())))
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want])


def test_expectations_and_pairs(data):
    total = lambda df, names: np.array(df.agg(*[F.sum(n) for n in names]).first(), float)
    names = [*hmm_blocks.SUMS, "loglik"]
    want = total(hmm.expectations(hmm.pack(data, KEYS), KEYS, RATES, T.log_matrix()), names)
    whole = hmm_blocks.expectations(hmm.pack(data, KEYS), KEYS, RATES, T.log_matrix())
    blocks = hmm_blocks.expectations(hmm_blocks.pack(data, KEYS, 17), KEYS, RATES, T.log_matrix())
    assert np.allclose(total(whole, names), want) and np.allclose(total(blocks, names), want)
    pairs = total(blocks, hmm_blocks.PAIRS)
    assert np.allclose(pairs, total(whole, hmm_blocks.PAIRS)) and np.isclose(pairs.sum(), data.count() - data.select("hap").distinct().count())


def test_pairs_against_all_paths():
    rng = np.random.default_rng(1)
    like, trans = rng.random((1, 4, 5)), np.exp(T.log_matrix())
    weight = {p: 0.2 * like[0, 0, p[0]] * np.prod([trans[p[i - 1], p[i]] * like[0, i, p[i]] for i in range(1, 4)]) for p in itertools.product(range(5), repeat=4)}
    want = np.zeros((5, 5))
    for p, w in weight.items():
        for a, b in itertools.pairwise(p):
            want[a, b] += w / sum(weight.values())
    one = np.ones((1, 5))
    _, got, ll = hmm_blocks.smooth(like, trans, one, np.array([True]), one)
    assert np.allclose(got[0], want) and np.isclose(np.exp(ll[0]), sum(weight.values()))


def test_refit_rises_and_finds_the_shares(spark):
    truth = replace(T, a=0.3, b=0.6, c1=0.15, c2=0.15)
    packed = hmm_blocks.pack(hmm.sample(spark, 8, 3000, RATES, truth.log_matrix()), KEYS, 1000).persist()
    rates, t, seen = hmm_refit.em(packed, KEYS, RATES * 1.2, replace(T, a=0.5, b=0.3, c1=0.05, c2=0.05), steps=12)
    packed.unpersist()
    assert all(b >= a - 1e-2 for a, b in itertools.pairwise(seen))
    assert np.allclose(rates, RATES, rtol=0.15) and abs(t.a - 0.3) < 0.08 and abs(t.b - 0.6) < 0.08 and abs(t.c1 - 0.15) < 0.05 and t.c1 == t.c2


def test_refit_of_exact_pairs():
    truth = replace(T, a=0.25, b=0.55, c1=0.12, c2=0.12)
    t = hmm_refit.refitted(replace(T, a=0.5, b=0.3, c1=0.05, c2=0.05), np.exp(truth.log_matrix()) * 1e7)
    assert np.allclose([t.a, t.b, t.c1], [0.25, 0.55, 0.12], atol=1e-4)
    stay = hmm_refit.refitted(T, np.zeros((5, 5)))
    assert np.allclose([stay.a, stay.b, stay.c1], [T.a, T.b, T.c1], atol=1e-6)


@pytest.mark.parametrize("refit", [False, True])
def test_a_stopped_run_goes_on(spark, data, tmp_path, refit):
    args = (data, KEYS, RATES * 1.1, T, None, 1000)
    one, a, seen = em_run(*args, steps=4, block=50, refit=refit)
    at = f"file://{tmp_path}/{refit}"
    em_run(*args, steps=2, block=50, refit=refit, state=at)
    made, b, again = em_run(*args, steps=4, block=50, refit=refit, state=at)
    assert seen == again and a.tolist() == b.tolist() and rows(one) == rows(made)
    assert em_state.history(spark, f"{at}/steps", ["i"]).count() == 4


def test_runs_over_blocks(data):
    assert rows(fixed_run(data, KEYS, RATES, T.log_matrix(), None, 1000, block=30)) == rows(fixed_run(data, KEYS, RATES, T.log_matrix(), None, 1000))


def test_scans_step_along_the_blocks_of_many_keys_at_once(spark):
    """Keys of 1 to 3 blocks, null too: a call has all keys of a batch with as many blocks, and rows of a key stay in order."""
    df = spark.range(600).selectExpr("nullif(id div 3, 7) AS k", "id % 3 AS block", "array(cast(id AS double), 1D) AS m").where("block <= coalesce(k, 0) % 3")

    def made(x):
        k, n, _ = x["m"].shape
        return {"seen": x["m"][:, :, 0].cumsum(1), "keys": np.full((k, n), k)}

    got = hmm_blocks._scan(df.coalesce(1), ["k"], "seen double, keys int", made).collect()
    want = {}
    for r in sorted(df.collect(), key=lambda r: (-1 if r.k is None else r.k, r.block)):
        want[r.k, r.block] = want.get((r.k, r.block - 1), 0) + r.m[0]
    assert {(r.k, r.block): r.seen for r in got} == want and len(got) == len(want)
    assert sum(r["keys"] == 1 for r in got) < 30  # the last key of a task may come alone
