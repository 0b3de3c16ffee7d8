"""Migrant tracts against a walk of every sample at every place."""

import random

from strandloom.operators import genealogy

LENGTH, TARGETS = 40, [("EU", "e", 10.0), ("NA", "n", 10.0), ("AF", "a", 10.0), ("ND", "d", 25.0)]


def walk(sample, at, edges, times, moves, dest, time, eps=1e-5):
    if times[sample] > time + eps:
        return False
    node = sample
    while True:
        parent = next((p for c, p, s, e in edges if c == node and s <= at < e), None)
        if parent is None:
            return False
        if any(n == node and d == dest and abs(t - time) <= eps and s <= at < e for n, d, t, s, e in moves):
            return True
        if times[node] >= time - eps:
            return False
        node = parent


def test_against_every_place(spark):
    rnd = random.Random(3)
    times = {n: float(t) for n, t in enumerate(sorted(rnd.choices(range(0, 40), k=40)))} | {100: 10.0, 101: 25.0}
    edges = []
    for n, t in times.items():
        older = [m for m in times if times[m] > t]
        cuts = [0, *sorted(rnd.sample(range(1, LENGTH), 2)), LENGTH]
        for s, e in zip(cuts, cuts[1:]):
            if older and rnd.random() < 0.9:
                edges.append((n, min(rnd.sample(older, min(3, len(older))), key=times.get), s, e))
    moves = [(rnd.choice(list(times)), rnd.choice("enad"), rnd.choice([10.0, 25.0, 10.0 + 5e-6, 12.0]), s := rnd.randint(0, 30), s + rnd.randint(1, 10)) for _ in range(120)]
    samples = [n for n in times if times[n] < 12] + [100, 101]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    got = genealogy.migrant_tracts(
        frame([(n, n) for n in samples], "sample long, node long"), frame(edges, "child long, parent long, s long, e long"), frame(list(times.items()), "node long, time double"),
        frame(moves, "node long, dest string, time double, s long, e long"), TARGETS, LENGTH, width=7,
    )
    rows = got.collect()
    have = {(r.sample, r.label, i) for r in rows for i in range(r.s, r.e)}
    want = {(n, label, i) for n in samples for label, d, t in TARGETS for i in range(LENGTH) if walk(n, i, edges, times, moves, d, t)}
    assert have == want and len(want) > 100 and len(have) == sum(r.e - r.s for r in rows)
    states = {}
    for r in genealogy.five_states(got).collect():
        for i in range(r.s, r.e):
            states.setdefault((r.sample, i), set()).add(r.state)
    for n in samples:
        for i in range(LENGTH):
            has = {label for label, *_ in TARGETS if (n, label, i) in want}
            assert states.get((n, i), set()) == {f"ND_{x}" if "ND" in has else x for x in has & {"EU", "NA"}} | (has & {"AF"})


def test_no_lineage(spark):
    none = genealogy.migrant_tracts(*[spark.createDataFrame([], x) for x in ("sample long, node long", "child long, parent long, s long, e long", "node long, time double", "node long, dest string, time double, s long, e long")], TARGETS, LENGTH)
    assert none.count() == 0 and none.columns == ["sample", "label", "s", "e"]
