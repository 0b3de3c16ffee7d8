import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions.hmm_params import Transitions, from_config, transition_columns
from strandloom.operators import hmm, tracts
from strandloom.plans.pipeline import em_run
from table_rows import rows

T = Transitions(ti=1500, tmex=20, rr=1e-8, a=0.4, b=0.5, c1=0.02, c2=0.03, width=1000)
RATES = np.array([0.5, 4.0, 1.5, 1.0, 0.3])


def test_rows_of_transitions_sum_to_one():
    assert np.allclose(np.exp(T.log_matrix()).sum(1), 1)


def test_config():
    rates, t = from_config({"mutation": 1e-8, "window_length": 1000, "generation_time": 25, "rr": 1e-8, "t_introgression_c": 50000, "t_n_c": 600000, "t_af_c": 90000, "t_ea_c": 40000, "t_mexicans_c": 10000, "t_introgression": 50000, "t_mexicans": 500, "admixture_modern": [0.4, 0.5, 0.1], "admixture_nd": 0.02})
    assert np.allclose(rates, np.array([50000, 600000, 90000, 40000, 10000]) * 4e-7) and (t.ti, t.tmex, t.c1) == (2000, 20, 0.02)


def test_columns_of_parameters(spark):
    sets = [T, Transitions(900, 500, 3e-6, 0.1, 0.2, 0.3, 0.05, 500)]
    df = spark.createDataFrame([tuple(map(float, (t.ti, t.tmex, t.rr, t.a, t.b, t.c1, t.c2, t.width))) for t in sets], "ti double, tmex double, rr double, a double, b double, c1 double, c2 double, width double")
    made = transition_columns(*[F.col(c) for c in df.columns])
    for t, r in zip(sets, df.select(*[c for row in made for c in row]).collect(), strict=True):
        assert np.allclose(np.reshape(r, (5, 5)), np.exp(t.log_matrix()))


def brute(emit, log_trans):
    paths = list(itertools.product(range(5), repeat=len(emit)))
    return paths, np.array([sum(emit[i, x] for i, x in enumerate(p)) + sum(log_trans[p[i], p[i + 1]] for i in range(len(p) - 1)) - np.log(5) for p in paths])


def test_kernels_against_all_paths():
    emit = np.random.default_rng(0).normal(size=(2, 5, 5)) * 3
    found, (gamma, ll) = hmm.viterbi(emit, T.log_matrix()), hmm.forward_backward(emit, np.exp(T.log_matrix()))
    for m in range(2):
        paths, score = brute(emit[m], T.log_matrix())
        assert list(paths[int(score.argmax())]) == found[m].tolist()
        weight = np.exp(score)
        assert np.isclose(np.log(weight.sum()), ll[m])
        for i in range(5):
            share = [weight[[p[i] == s for p in paths]].sum() / weight.sum() for s in range(5)]
            assert np.allclose(share, gamma[m, i])


def test_equal_scores_take_the_lowest_state():
    assert hmm.viterbi(np.zeros((1, 4, 5)), np.zeros((5, 5))).tolist() == [[0, 0, 0, 0]]


def test_no_underflow():
    emit = np.full((1, 3, 5), -5000.0)
    gamma, ll = hmm.forward_backward(emit, np.exp(T.log_matrix()))
    assert np.isclose(ll[0], -15000) and np.allclose(gamma.sum(2), 1)


def test_em_rises_and_finds_the_rates(spark):
    data = hmm.sample(spark, 8, 3000, RATES, Transitions(1500, 20, 2e-6, 0.4, 0.4, 0.1, 0.1, 1000).log_matrix())
    packed = hmm.pack(data, ["chrom", "hap"]).persist()
    rates, seen = hmm.em(packed, ["chrom", "hap"], RATES * 1.3, Transitions(1500, 20, 2e-6, 0.4, 0.4, 0.1, 0.1, 1000).log_matrix(), steps=12)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(seen))
    assert np.allclose(rates, RATES, rtol=0.12)


def test_zero_exposure(spark):
    row = [("chr1", 1, 0, 0, 10, 3, 2, 1, 4, 0.0, 0.0), ("chr1", 1, 1, 10, 20, 3, 2, 1, 4, 1.0, 0.0)]
    df = spark.createDataFrame(row, "chrom string, hap long, win long, s long, e long, o_eu long, o_na long, o_af long, o_nd long, l_mod double, l_anc double")
    assert rows(hmm.zero_uncovered(df), "win", "o_eu", "o_nd") == [(0, 0, 0), (1, 3, 0)]
    assert rows(hmm.invalid_windows(df)) == [(1, 2)]
    path = hmm.decode(hmm.pack(df, ["chrom", "hap"]), ["chrom", "hap"], RATES, T.log_matrix())
    assert rows(path.where("win = 0"), "state") == [(-1,)]
    made, _, seen = em_run(df, ["chrom", "hap"], RATES, T.log_matrix(), df.select("chrom", F.lit(5).alias("s"), F.lit(8).alias("e")).cache(), 10, steps=2)
    assert rows(made, "Start", "End") == [(0, 4), (8, 19)] and len(seen) == 2


@pytest.mark.parametrize("path, split, absorb", [
    ([-1, 0, 0, -1, 1, 1, -1], [(0, 999, "UNINFORMATIVE"), (1000, 2999, "EU"), (3000, 3999, "UNINFORMATIVE"), (4000, 5999, "ND_EU"), (6000, 6999, "UNINFORMATIVE")], [(0, 3999, "EU"), (4000, 6999, "ND_EU")]),
    ([-1, -1], [(0, 1999, "UNINFORMATIVE")], [(0, 1999, "UNINFORMATIVE")]),
])
def test_tracts(spark, path, split, absorb):
    df = spark.createDataFrame([("h", i, i * 1000, i * 1000 + 1000, x) for i, x in enumerate(path)], "hap string, win long, s long, e long, state int")
    assert sorted(rows(tracts.inclusive(tracts.split_tracts(df, ["hap"])), "Start", "End", "State")) == split
    assert sorted(rows(tracts.inclusive(tracts.absorb_tracts(df, ["hap"])), "Start", "End", "State")) == absorb


def test_kernels_take_small_groups_and_give_flat_arrays(spark):
    """What a worker holds at once is a few MB, whatever the batch, and no object for each window."""
    n, many = 30, 10_000
    b = pd.DataFrame({"hap": range(many), **{c: [np.ones(n)] * many for c in hmm.READ}})
    sizes = [len(part) for part, *_ in hmm._batches(iter([b]))]
    assert sum(sizes) == many and max(sizes) * n * 40 <= 4 << 20
    rows_ = spark.range(60).selectExpr("id div 30 AS hap", "id % 30 AS win", "id AS s", "id + 1 AS e", *(f"id % 3 AS {o}" for o in hmm.OBS), "1.0D AS l_mod", "1.0D AS l_anc")
    got = hmm.posteriors(hmm.pack(rows_, ["hap"]), ["hap"], [0.2, 0.5, 0.6, 0.9, 1.4], np.log(np.full((5, 5), 0.2)))
    assert "array<array" not in got._jdf.queryExecution().optimizedPlan().treeString() and "g0#" in got._jdf.queryExecution().optimizedPlan().toString()
    assert all(abs(sum(r[f"g{i}"] for i in range(5)) - 1) < 1e-9 for r in got.collect()) and got.count() == 60
