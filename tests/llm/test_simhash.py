import random

import pytest
import xxhash

from strandloom.llm import simhash as s
from strandloom.llm.components import components


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(len(ws) - 3, 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(pairs, tau):
    fps = [f for _, f in pairs]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for (d, _), x in zip(pairs, label, strict=True):
        low[x] = min([v for v in (low.get(x), d) if v is not None], default=None)
    return sorted(((d, f"{f:016x}", low[x]) for (d, f), x in zip(pairs, label, strict=True)), key=str)


def test_odd_rows(odd, empty):
    from odd_rows import ODD

    want = brute([(d, brute_fingerprint(t)) for d, t, *_ in ODD], 4)
    assert sorted((tuple(r) for r in s.near_duplicates(odd).collect()), key=str) == want
    kept = s.keep_one(odd)
    assert kept.columns == odd.columns and [tuple(r) for r in sorted(kept.collect(), key=str)] == [tuple(r) for r in sorted(s.keep_one(odd.repartition(5)).collect(), key=str)]
    by = [(r.doc_id, r.text) for r in kept.collect()]
    # 1, 5 and a row without doc_id are alike; so are texts without a word; both texts of doc_id 6 stay.
    assert sorted(d for d, _ in by) == [1, 2, 6, 6, 7, 8, 9, 10]
    assert s.near_duplicates(empty).count() == s.keep_one(empty).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_links_lose_nothing(spark, most):
    rnd = random.Random(1)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    edges = s.links(spark.createDataFrame([(s.signed(x),) for x in fps], "fp long"), most=most)
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(s.signed(x), s.signed(x)) for x in fps]
    want = [w for _, _, w in sorted(((i, x, c) for i, (x, c) in enumerate(zip(fps, got, strict=True))))]
    label = brute([(i, x) for i, x in enumerate(fps)], 4)
    by = {f: c for _, f, c in label}
    same = lambda values: [[i for i, v in enumerate(values) if v == u] for u in dict.fromkeys(values)]
    assert same(want) == same([by[f"{x:016x}"] for x in fps])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5), (-7, 100)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in (100, 200, 300, -7)} == {-7}


def shingles(text):
    ws = text.lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


@pytest.mark.parametrize("options", [{}, {"most": 8, "cell": 6}])
def test_similar_texts_against_all_pairs(spark, options):
    """Copies with a few words changed, added or moved, in groups small and large; with small options, groups that no task
    may hold whole."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(900)]
    texts = []
    for group in (1, 1, 1, 2, 3, 5, 60, 40, *[1] * 20):
        base = rnd.choices(words, k=rnd.randint(60, 300))
        for _ in range(group):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id.doc_id: r.first.doc_id for r in s.similar(d, [d.doc_id], **options).collect()}
    assert all(label[i] == label[got[i]] for i in got)
    assert sum(got[i] == label[i] for i in got) >= 0.97 * len(texts)


def test_unlike_texts_of_one_doc_id_stay(spark):
    rows = [(1, "one text of seven words or so"), (1, "and quite another one that has more words"), (None, "a third text that has no doc_id at all"), (None, "a third text that has no doc_id at all")]
    kept = [s.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect() for n in (1, 3)]
    assert all(sorted(map(tuple, k), key=str) == sorted(map(tuple, rows[:3]), key=str) for k in kept)


def test_unlike_texts_that_repeat_a_passage_stay(spark):
    """Most of the shingles of each are one, repeated; the distinct ones have next to nothing in common."""
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, "row " * 1000 + own(1, 300)), (2, "row " * 1000 + own(2, 300)), (3, "a cell | " * 120 + own(3, 350)), (4, "a cell | " * 120 + own(4, 350))]
    assert s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_equal_fingerprints_of_unlike_sets_are_compared(spark, monkeypatch):
    real = s.wide_fingerprint
    monkeypatch.setattr(s, "wide_fingerprint", lambda t, k=5: (real("same", k)[0], *real(t, k)[1:]))
    rows = [(1, "one text of seven words or so"), (2, "quite another text of seven words here"), (3, "One text  of seven words or so")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = spark.createDataFrame([(i, *map(int, real("same")[0]), real(t)[1], real(t)[2]) for i, t in rows], "i long, f0 long, f1 long, f2 long, f3 long, named long, n long")
    assert made.select("f0", "f1", "f2", "f3").distinct().count() == 1 and made.select("named").distinct().count() == 2
    nodes = made.selectExpr("i AS node", "struct(f0, f1, f2, f3, named) AS fp", "struct(i) AS low", "n").where("i < 3")
    texts = docs.selectExpr("struct(doc_id AS i) AS id", "text")
    assert s.similar_links(texts, nodes, 48, 5, 0.8, 4096, 1024).count() == 0


@pytest.mark.parametrize("times", [5, 20, 60])
def test_near_copies_that_repeat_a_passage_are_found(spark, times):
    rnd = random.Random(times)
    texts = []
    for k in range(20):
        base = [f"w{k}x{i}" for i in range(150)]
        copy = list(base)
        copy[rnd.randrange(150)] = "changed"
        texts += [" ".join(base), " ".join(copy) + " a tail of just six words" * times]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert s.keep_one(d).count() <= 21


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "some words of a text here", 7, 8, 9), (2, "some words of a text here", 1, 2, 3)], "doc_id long, text string, _did int, _th int, row int")
    assert [tuple(r) for r in s.keep_one(d).collect()] == [(1, "some words of a text here", 7, 8, 9)]
