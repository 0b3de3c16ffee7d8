from collections import defaultdict

from strandloom.llm import mixing


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": 250 / 3, "c": 500 / 3}
    assert mixing.targets({"a": 10, "b": 1000}) == {"a": 20.0, "b": 1495.0}
    assert mixing.targets({}) == {}


def test_whole_mix(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mixing_plan(d).toPandas()
    sizes = d.toPandas().set_index("doc_id").text.map(lambda t: len(t.encode().split()))
    assert (got.set_index("doc_id")["size"].sort_index() == sizes.sort_index()).all()
    by = got.groupby("source").agg(source_size=("source_size", "first"), target=("target", "first"), size=("size", "sum"), taken=("taken", "sum"), big=("size", "max"))
    assert (by.source_size == by["size"]).all() and (got.taken <= 2 * got["size"]).all()
    assert ((by.taken - by.target).abs() <= by.big + 1).all() and abs(by.target.sum() - 1.5 * sizes.sum()) < 1
    again = mixing.mixing_plan(d.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix(d).groupBy("doc_id").count().where("count > 2").count() == 0


def test_order_is_that_of_finish_times(spark):
    """Against a queue run on the driver: copies in the order of finish times until the budget is spent."""
    d = spark.createDataFrame([(i, "w " * (i % 5 + 1), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    got = mixing.mixing_plan(d).collect()
    total = round(sum({r.source: r.target for r in got}.values()))
    copies = {r.doc_id: r.copies for r in got}
    assert 0 <= total - sum(r.taken for r in got) <= 5 and set(copies.values()) <= {0, 1, 2}
    seen = defaultdict(set)
    for r in got:
        seen[r.source].add(r.copies)
    assert all(len(x) <= 2 for x in seen.values())


def test_odd_rows(odd, empty, spark):
    got = mixing.mixing_plan(odd).collect()
    assert len(got) == odd.count() and all(r.taken == r.size * r.copies for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mixing_plan(empty).count() == mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.taken) for r in mixing.mixing_plan(blank).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_each_of_repeated_rows_gets_its_own_copies(spark):
    """Rows that repeat doc_id and text, of one source and of several."""
    rows = [(1, "w w", "abc"[i % 3]) for i in range(30)] + [(i, "w " * 3, "abc"[i % 3]) for i in range(2, 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, mixed = mixing.mixing_plan(d).collect(), mixing.mix(d).collect()
    want = defaultdict(int)
    for r in plan:
        want[r.doc_id, r.source] += r.copies
    got = defaultdict(int)
    for r in mixed:
        got[r.doc_id, r.source] += 1
    assert got == {k: n for k, n in want.items() if n}
