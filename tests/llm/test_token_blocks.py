import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strandloom.llm import token_blocks as t

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 200, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).zipf(1.2, n).clip(0, top).astype(np.uint32)
    names, lengths, back = t.unpack(t.pack(ids, [7, None], [n, 0]))
    assert names == [7, None] and lengths.tolist() == [n, 0] and (back == ids).all()


def test_outliers_cost_little():
    ids = np.full(25_600, 5, np.uint32)
    ids[::256] = 4_000_000
    assert len(t.pack(ids, [1], [len(ids)])) < 3000


def test_odd_rows(spark, odd, empty):
    from odd_rows import ODD

    tok = Tokenizer.from_file(PATH)
    want = []
    for d, x, *_ in ODD:
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(t.token_blocks(odd, PATH).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got] == sorted((d for d, *_ in ODD), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert t.token_blocks(empty, PATH).count() == 0


def test_reading_gives_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "don't stop"), (1, "a b")], "doc_id long, text string")
    t.write_tokens(df, f"file://{tmp_path}/x", PATH, 2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in t.read_tokens(spark, f"file://{tmp_path}/x").collect()}
    tok = Tokenizer.from_file(PATH)
    assert got == {1: [*tok.encode("a b", add_special_tokens=False).ids, 2], 2: [*tok.encode("don't stop", add_special_tokens=False).ids, 2]}


def test_added_tokens_are_found(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["a word <|endoftext|> and more", "pre<|endoftext|>post it's", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> x", "Été (<|endoftext|>) 日"]
    assert [x.tolist() for x in t.Encoder(PATH).encode(texts)] == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_all_documents_like_the_library():
    """Every text of the table, and those with added tokens, against the untouched tokenizer."""
    import pandas as pd

    tok, own = Tokenizer.from_file(PATH), t.Encoder(PATH)
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("").tolist()
    texts += ["a word <|endoftext|> and more", "x<|startoftext|>y", "<|ENDOFTEXT|> \u212b e\u0301 \u0130I'LL", "it's 12\u00bd \u2028 \x85 \x1c end"]
    assert own.by_word
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_get_whole_texts(tmp_path):
    import json

    config = json.load(open(PATH))
    config["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    (tmp_path / "v.json").write_text(json.dumps(config))
    tok, own = Tokenizer.from_file(str(tmp_path / "v.json")), t.Encoder(str(tmp_path / "v.json"))
    texts = ["two words", "", None, "it's \n so"]
    assert not own.by_word and [x.tolist() for x in own.encode(texts)] == [tok.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_query_on_all_documents(spark):
    """Starts, counts and checksums that the query reads back, for every document of the table."""
    from strandloom.llm import queries

    d, tok, start, want = "/root/testdata/sf0.01", Tokenizer.from_file(PATH), 0, []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.QUERIES["op2_token_blocks"](spark, d).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
