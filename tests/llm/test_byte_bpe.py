import hashlib
import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from strandloom.llm import byte_bpe as b

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return b.Coder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_like_the_library(own, library):
    rnd = random.Random(3)
    texts = ["", "a" * 1000, "ab" * 700, " " * 500 + "x", "=" * 777 + "-" * 333, "\u00e9\u65e5\u672c\u8a9e" * 100, "\x00\x01" * 60, "<|endoftext|> it's"]
    texts += ["".join(rnd.choice(s) for _ in range(n)) for s, n in (("abcdefgh", 1500), ("ab", 900), ("aeioustn ", 3000), ("the ing", 2000))]
    got = list(own.encode(texts))
    assert [[int(i) for w in ws for i in w.split()] for ws in got] == [library.encode_ordinary(t) for t in texts]
    assert list(own.decode(got)) == [t.encode() for t in texts]


def test_long_words(own, library):
    """Words that fill whole windows, of few and of many letters, against the library; linear in time."""
    rnd = random.Random(7)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [draw("abcdefghijklmnopqrstuvwxyz", 100_000), draw("ACGT", 20_000), draw(["the", "ing", "tion", "a", "e"], 10_000), draw("=-_*#", 20_000), draw("\u00e9\u65e5\u0434", 10_000), "=" * 50_001, "abcde" * 10_001, draw("abcdefghij", 37) * 900, " " * 50_000 + "x"]
    for t in texts:
        began = time.time()
        assert [int(i) for w in next(own.encode([t])) for i in w.split()] == library.encode_ordinary(t)
        assert time.time() - began < 60
        assert next(own.decode(own.encode([t]))) == t.encode()
    assert len(own.long) == 1 and not own.db.sql("SELECT current_setting('temp_directory')").fetchall()[0][0]


def test_a_million_letters(own, library):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    got = [int(i) for w in next(own.encode([text])) for i in w.split()]
    assert time.time() - began < 120 and got == library.encode_ordinary(text)


def test_one_word_in_all_ways(own, library):
    """Contracted whole by either query, and from windows."""
    rnd = random.Random(9)
    for letters in ("abcdefgh", "ab", "the ing", " =", "\n\t "):
        word = "".join(rnd.choice(letters) for _ in range(700)).encode()
        short = [list(map(int, ids.split())) for _, ids, _ in own.contract([word])]
        assert short == [own.contract_long(word)] == [own.joined(word)]


def test_odd_rows(spark, odd, empty, library):
    from odd_rows import ODD

    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {t: library.encode_ordinary(t or "") for _, t, *_ in ODD}
    want = sorted(((d, len(ids[t]), sha(" ".join(map(str, ids[t])).encode()), sha((t or "").encode())) for d, t, *_ in ODD), key=str)
    assert sorted((tuple(r) for r in b.round_trip(odd, PATH, P.PATTERN).collect()), key=str) == want
    both = b.decode(b.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in both if r.doc_id) == sorted((d, ids[t], (t or "").encode()) for d, t, *_ in ODD if d)
    assert b.round_trip(empty, PATH, P.PATTERN).count() == b.tokens(empty, PATH, P.PATTERN, ["doc_id"]).count() == 0


def test_all_documents_like_the_library(spark, library):
    """The query's rows for every document of the table."""
    from strandloom.llm import queries

    sha = lambda x: hashlib.sha256(x).hexdigest()
    d = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    got = queries.QUERIES["op4_byte_bpe"](spark, d).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
