import random

from strandloom.llm import line_dedup as ld


def test_align():
    assert ld.align([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert ld.align([], [1]) == [] and ld.align([1, 1], [1, 1, 1]) == [(0, 0), (1, 1)]
    pairs = ld.align(list(range(50)) + [7, 7], [99, *range(25, 50), *range(25)])
    assert all(a < b and c < d for (a, c), (b, d) in zip(pairs, pairs[1:], strict=False)) and len(pairs) == 25


P1, P2, P3 = "the first passage has a number of words in it", "the second passage also has a number of words", "a third passage with quite a few words more"


def test_common_blocks_go_from_the_later_document(spark):
    data = [(1, f"{P1}\nx\n{P2}"), (2, f"own line of text\n{P1}\nx\n{P2}\nend"), (3, f"{P3}\n{P2}"), (4, "short one\nx"), (5, None), (6, ""), (7, f"{P1}\nx\n{P2}")]
    got = {r.doc_id: (r.text, r.n_lines_before, r.n_removed) for r in ld.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: (f"{P1}\nx\n{P2}", 3, 0), 2: ("own line of text\nend", 5, 3), 3: (P3, 2, 1), 4: ("short one\nx", 2, 0), 5: (None, 0, 0), 6: ("", 1, 0), 7: ("", 3, 3)}


def test_many_documents_with_one_line(spark):
    data = [(i, f"{P1}\nown words of number {i} are here to stay") for i in range(500)]
    got = ld.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: int(i > 0) for i in range(500)}


def test_odd_rows(odd, empty):
    got = ld.line_dedup(odd)
    assert got.count() == odd.count() and got.columns[: len(odd.columns)] == odd.columns
    by = {r.doc_id: r.text for r in got.where("doc_id in (1, 2, 3, 4, 6)").collect()}
    assert by[1].startswith("Hello") and by[2] is None and by[3] == "" and by[4] == " \t\n"
    assert ld.line_dedup(empty).count() == 0


def brute(data, least=8):
    """Lines in runs of consecutive lines, of least words or more, that any earlier document has."""
    out = {}
    for n, (d, t) in enumerate(data):
        b, gone = t.split("\n"), set()
        for _, u in data[:n]:
            a = u.split("\n")
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if sum(len(x.split()) for x in b[j : j + k]) >= least:
                        gone |= set(range(j, j + k))
        out[d] = "\n".join(x for i, x in enumerate(b) if i not in gone)
    return out


def test_blocks_of_any_earlier_document(spark):
    """Blocks whose lines have other first documents, and lines that the first document has in another order."""
    one, two = "five words are in this", "and five more in that"
    data = [(1, one), (2, two), (3, f"{one}\n{two}"), *[(i, f"{one}\n{two}") for i in range(4, 9)], (11, f"{P1}\n{P2}"), (12, f"{P2}\n{P1}"), (13, f"{P2}\n{P1}")]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[3] == f"{one}\n{two}" and not any(got[i] for i in (4, 5, 6, 7, 8, 13)) and got == brute(data)


def test_random_documents_lose_what_earlier_ones_have(spark):
    rnd = random.Random(5)
    pool = ["", "x", "two words", "a b c", "of four words each", "five words are in this", "six words are in this one", P1, P2]
    data = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(120)]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute(data)


def test_repeats_and_short_lines_go(spark):
    """Passages that a document has twice, and copies whose lines repeat or have under four words."""
    verse = "\n".join(["row row row", "your boat", "", "row row row", "your boat"] * 3)
    data = [(1, f"{P1}\nx\n{P1}"), (2, f"own words\n{P1}\nmore own\n{P1}"), (3, verse), (4, verse), (5, f"{P3}\n{verse}\nend")]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: data[0][1], 2: "own words\nmore own", 3: verse, 4: "", 5: f"{P3}\nend"} == brute(data)


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, P1, 7, "a", 1), (2, f"{P1}\nend", 8, "b", 2)], "doc_id long, text string, _did int, removed string, did int")
    got = ld.line_dedup(d)
    assert got.columns[:5] == d.columns and sorted(tuple(r) for r in got.collect()) == [(1, P1, 7, "a", 1, 1, 0), (2, "end", 8, "b", 2, 2, 1)]


def test_alignment_alone_finds_blocks_in_order(spark):
    """What the patience diff matches, without any look-up of windows."""
    data = [(1, f"{P1}\nx\n{P2}\ny\n{P3}"), (2, f"own\n{P1}\nx\n{P2}\nmore own\n{P3}")]
    got = {r.did: r.removed for r in ld.removed_lines(spark.createDataFrame(data, "doc_id long, text string"), lookups=False).collect()}
    assert got == {2: [1, 2, 3, 5]}
    assert ld.common_lines([1, 2, 3], [9, 1, 2, 3], [5] * 4, 8, lookups=False) == [1, 2, 3]


def test_many_later_documents_of_one(spark, monkeypatch):
    """Partners of one earlier document in many parts."""
    monkeypatch.setattr(ld, "PARTNERS", 3)
    data = [(i, f"{P1}\nwords of document {i} that it has alone and keeps" + (f"\n{P2}" if i % 7 == 0 else "")) for i in range(400)]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute(data)
