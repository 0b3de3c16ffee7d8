from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from table_rows import rows

lists = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30), st.integers(0, 8)).map(lambda x: (x[0], x[1], x[1] + x[2])), max_size=12)
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, xs):
    return spark.createDataFrame(xs, "k int, s long, e long")


def places(xs):
    return {(k, i) for k, s, e in xs for i in range(s, e)}


def got(df):
    return places([(r.k, r.s, r.e) for r in df.collect()])


def runs(spark, found):
    """Maximal runs of (k, place) as rows."""
    out = []
    for k, i in sorted(found):
        if out and out[-1][0] == k and out[-1][2] == i:
            out[-1][2] = i + 1
        else:
            out.append([k, i, i + 1])
    return frame(spark, out)


def deeper(spark, xs, ys):
    """Places that more of xs than of ys cover."""
    depth = lambda zs, k, i: sum(q == k and s <= i < e for q, s, e in zs)
    return runs(spark, {(k, i) for k, i in places(xs) if depth(xs, k, i) > depth(ys, k, i)})


def closed(spark, xs, gap):
    out = []
    for k, s, e in sorted(x for x in xs if x[1] < x[2]):
        if out and out[-1][0] == k and s <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([k, s, e])
    return frame(spark, out)


def test_below_zero(spark):
    a = frame(spark, [(1, -9, -3), (1, -3, 2), (2, -7, -7), (None, -4, 4), (None, 0, 9)])
    assert rows(iv.merge(a, ["k"], stretch=4)) == rows(iv.merge(a, ["k"])) == [(1, -9, 2), (None, -4, 9)]


def test_golden(spark):
    a = frame(spark, [(1, 0, 5), (1, 5, 9), (1, 12, 12), (1, 20, 30)])
    m = iv.merge(a, ["k"])
    assert rows(m) == [(1, 0, 9), (1, 20, 30)]
    b = frame(spark, [(1, 3, 25)])
    assert rows(iv.intersect(m, b, ["k"], 8)) == [(1, 20, 25), (1, 3, 9)]
    assert rows(iv.subtract(m, b, ["k"])) == [(1, 0, 3), (1, 25, 30)]


def test_coverage_golden(spark):
    lengths = spark.createDataFrame([(1, 2500)], "k int, length long")
    cov = iv.coverage(frame(spark, [(1, 500, 1500), (1, 2400, 2500)]), lengths, ["k"], 1000)
    assert [r.frac for r in cov.orderBy("win").collect()] == [0.5, 0.5, 0.2]
    assert rows(iv.windows_above(cov, ["k"], 0.2)) == [(1, 0, 2000)]


@quick
@given(lists, lists)
def test_algebra(spark, xs, ys):
    a, b = frame(spark, xs), frame(spark, ys)
    pa, pb = places(xs), places(ys)
    m = iv.merge(a, ["k"])
    assert got(m) == pa and rows(iv.merge(m, ["k"])) == rows(m) == rows(iv.merge(a, ["k"], stretch=5))
    assert got(iv.subtract(a, b, ["k"])) == pa - pb
    assert got(iv.intersect_many([a, b], ["k"])) == pa & pb == got(iv.intersect(m, iv.merge(b, ["k"]), ["k"], 4))
    assert got(iv.union_many([a, b], ["k"])) == pa | pb
    assert rows(iv.sweep([a, b], ["k"], F.col("d0") > F.col("d1"), stretch=3)) == rows(deeper(spark, xs, ys))
    assert rows(iv.merge(a, ["k"], 2, 3)) == rows(closed(spark, xs, 2))
    sides = {inside: got(iv.intersect_and_subtract(a, b, ["k"]).where(F.col("inside") == inside)) for inside in (True, False)}
    assert sides == {True: pa & pb, False: pa - pb}
    pairs = sorted((x, y) for x in xs for y in ys if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))
    assert iv.overlaps(a, b, ["k"], 3).count() == len(pairs)


def test_gaps_keep_labels(spark):
    t = spark.createDataFrame([(1, 0, 10000, "EU"), (2, 0, 5, "EU")], "k int, s long, e long, state string")
    cut = iv.subtract_labelled(t, iv.merge(frame(spark, [(1, 1000, 2000), (1, 2000, 3000), (9, 0, 5)]), ["k"]), ["k"], 500)
    assert rows(cut, "k", "s", "e", "state") == [(1, 0, 1000, "EU"), (1, 3000, 10000, "EU"), (2, 0, 5, "EU")]


def test_empty(spark):
    none = frame(spark, [])
    assert iv.merge(none, ["k"]).count() == iv.subtract(none, none, ["k"]).count() == iv.intersect_many([none, none], ["k"]).count() == 0


def test_plans_cross_nothing(spark):
    a = frame(spark, [(1, 0, 5)])
    for df in (iv.intersect(a, a, ["k"], 4), iv.subtract(a, a, ["k"]), iv.points_in(a.withColumn("pos", a.s), a, ["k"], 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_subtract_labelled_meets_the_cuts_of_a_bin_as_one_row(spark):
    cuts = [(1, 10 * i + 3, 10 * i + 7 + i % 4) for i in range(200)] + [(2, -50, -40), (2, -5, 12)]
    tracts = [(1, 0, 2100), (1, 0, 2100), (1, 4, 6), (1, 5, 95), (2, -60, 30), (3, 0, 5), (None, 0, 5)]
    want = []
    for k, s, e in tracts:
        left = [p for p in range(s, e) if not any(k == q and a <= p < b for q, a, b in cuts)]
        cut = [i for i in range(len(left)) if i == 0 or left[i] != left[i - 1] + 1]
        want += [(k, left[i], left[j - 1] + 1) for i, j in zip(cut, [*cut[1:], len(left)])]
    got = iv.subtract_labelled(frame(spark, tracts), frame(spark, cuts), ["k"], 64)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "_cuts" in got._jdf.queryExecution().optimizedPlan().toString()
