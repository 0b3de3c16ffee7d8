"""Scores by the length of true tracts, over several runs, and their command."""

import random
from collections import Counter

import pytest

from strandloom.operators import evaluate
from strandloom.operators.tracts import STATES
from strandloom.plans import scores
from strandloom.plans.run import main
from strandloom.sources import writers

DDL = "run int, k string, s long, e long, state string"


def drawn(rng):
    """Tracts of two runs with equal names of haplotypes, disjoint in each."""
    out = []
    for run in range(2):
        for k in "ab":
            at = 0
            while at < 400:
                at, s = at + rng.randint(1, 60), at + rng.randint(0, 3)
                if s < at:
                    out.append((run, k, s, at, rng.choice(STATES)))
    return out


@pytest.mark.parametrize("edges", [(0,), (0, 10, 30), (5, 10, 20, 40, 1000)])
def test_by_length_against_all_pairs(spark, edges):
    rng = random.Random(len(edges))
    t, p = drawn(rng), drawn(rng)
    want = Counter()
    for run, k, s, e, state in t:
        bins = [i for i, edge in enumerate(edges) if e - s >= edge]
        for run2, k2, s2, e2, state2 in p:
            if bins and (run, k) == (run2, k2) and s < e2 and s2 < e:
                want[bins[-1], state, state2] += min(e, e2) - max(s, s2)
    conf = evaluate.by_length(spark.createDataFrame(t, DDL), spark.createDataFrame(p, DDL), ["run", "k"], 64, edges)
    assert {(r.bin, r.truth_state, r.pred_state): r.bp for r in conf.collect()} == dict(want)
    got = {r.bin: r for r in evaluate.length_scores(conf, edges).collect()}
    assert sorted(got) == list(range(len(edges))) and [got[i].bin_end for i in sorted(got)] == [*edges[1:], None]
    for i, r in got.items():
        cell = lambda a, b: sum(n for (j, x, y), n in want.items() if j == i and (x in evaluate.ARCHAIC) == a and (y in evaluate.ARCHAIC) == b)  # noqa: B023, E731
        assert (r.tp, r.fp, r.fn, r.tn) == (cell(True, True), cell(False, True), cell(True, False), cell(False, False))
        assert r.recall == pytest.approx(r.tp / (r.tp + r.fn) if r.tp + r.fn else 0)
    shares = evaluate.length_shares(conf, STATES, edges).collect()
    assert len(shares) == len(edges) * len(STATES) ** 2
    for i in range(len(edges)):
        for state in STATES:
            of = [r for r in shares if (r.bin, r.truth_state) == (i, state)]
            assert all(r.bp == want[i, state, r.pred_state] for r in of)
            assert sum(r.share for r in of) == pytest.approx(1 if sum(r.bp for r in of) else 0)


def test_edges_have_to_ascend(spark):
    t = spark.createDataFrame([], DDL)
    for edges in ((), (5, 5), (10, 0)):
        with pytest.raises(ValueError, match="ascend"):
            evaluate.by_length(t, t, ["k"], 64, edges)
    empty = evaluate.by_length(t, t, ["k"], 64, (0, 9))
    assert [r[:] for r in evaluate.length_scores(empty, (0, 9)).orderBy("bin").collect()] == [(0, 0, 9, 0, 0, 0, 0, 0.0, 0.0, 0.0), (1, 9, None, 0, 0, 0, 0, 0.0, 0.0, 0.0)]


def test_command_over_runs(spark, tmp_path):
    def seg(name, data):
        rows = spark.createDataFrame([("MX_0_1", "chr1", s, e, e - s, state) for s, e, state in data], "Sample string, CHROM string, Start long, End long, Length long, State string")
        writers.segments(rows, str(tmp_path / name))
        return str(tmp_path / name)

    t0, p0 = seg("t0", [(0, 100, "EU"), (100, 130, "ND_EU")]), seg("p0", [(0, 109, "EU"), (110, 129, "ND_EU")])
    # The same sample in another run: its segments meet those of that run alone.
    t1, p1 = seg("t1", [(0, 130, "ND_EU")]), seg("p1", [(0, 129, "ND_EU")])
    table = lambda name: spark.read.csv(f"{tmp_path}/out/{name}", sep="\t", header=True, inferSchema=True).orderBy("bin")
    with pytest.warns(UserWarning, match="run 2 is left out"):
        main(["evaluate", "-truth", t0, t1, str(tmp_path / "none"), "-segments", p0, p1, p1, "-lengths", "0", "50", "-out", str(tmp_path / "out")])
    assert [(r.bin_start, r.tp, r.fp, r.fn, r.tn) for r in table("lengths").collect()] == [(0, 20, 0, 10, 0), (50, 130, 0, 0, 100)]
    assert {(r.bin, r.truth_state, r.pred_state): r.bp for r in table("length_shares").where("bp > 0").collect()} == {(0, "ND_EU", "ND_EU"): 20, (0, "ND_EU", "EU"): 10, (1, "EU", "EU"): 100, (1, "ND_EU", "ND_EU"): 130}
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        scores.paired_runs(spark, [str(tmp_path / "none")], [p0])
    with pytest.raises(ValueError, match="2 files"):
        scores.paired_runs(spark, [t0, t1], [p0])
