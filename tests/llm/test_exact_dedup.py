from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.llm import exact_dedup as e
from strandloom.llm.common import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())


def expected(data):
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for ids in groups.values():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), i == top) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_odd_rows(odd, empty):
    from odd_rows import ODD

    assert got(e.exact_dedup(odd)) == expected(ODD)
    assert e.exact_dedup(empty).count() == 0


def test_clashing_hashes_are_told_apart(spark):
    data = [(i, t) for i, t in enumerate(["aaaa. bbbb. ", "bbbb. aaaa. ", "aaaa. bbbb. ", "aaaa. aaaa. ", "", "AAAA. bbbb. "])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(e.exact_dedup(df, least=1, most=50, chunk_hash=F.length)) == expected(data)


def test_chunks_join_to_the_text(spark):
    text = ("Some words here. " * 100 + "\n") * 3 + "z" * 20_000
    cs = spark.createDataFrame([(text,)], "t string").select(e.chunks(F.col("t")).alias("c")).first().c
    assert "".join(cs) == text and max(map(len, cs)) <= e.CHUNK_MAX + 2 and len(cs) > 5


def test_a_change_moves_few_chunks(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(600))
    a, b = (spark.createDataFrame([(t,)], "t string").select(e.chunks(F.col("t")).alias("c")).first().c for t in (text, text[:50] + "inserted " + text[50:]))
    assert len(set(b) - set(a)) <= 3


def test_rows_without_id_are_one_group(spark):
    data = [(None, "One text.")] * 300 + [(7, "one text.")] * 300 + [(8, None)]
    assert got(e.exact_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5))) == expected(data)
