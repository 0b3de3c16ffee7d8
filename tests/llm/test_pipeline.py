import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken

from strandloom.llm import byte_bpe, line_dedup
from strandloom.llm.common import written

D = "/root/testdata/sf0.001"


def near_brute(docs):
    """The smallest doc_id of each component of texts with 0.8 of their five-word shingles in common."""
    shingles = []
    for t in docs.text:
        ws = t.lower().split()
        shingles.append({" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    ids, low = docs.doc_id.tolist(), docs.doc_id.tolist()
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    return {d for d, x in zip(ids, low, strict=True) if d == x}


def test_stages_take_effect(spark):
    docs, columns = cp.documents(spark, D), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, D), "test")
        kept[name] = docs.toPandas()
        assert name == "byte_bpe" or docs.columns == columns
    before = kept["line_dedup"]
    assert (before.text.str.len() == before.n_chars).all() and len(kept["language_id"]) > len(before) > 0.7 * len(kept["language_id"])
    near = kept["simhash_near_dedup"]
    assert near.doc_id.is_unique and set(near.doc_id) <= set(before.doc_id)
    want = near_brute(before)
    assert set(near.doc_id) >= want and len(near) <= len(want) + 0.1 * (len(before) - len(want))
    mixed, coded = kept["mix_sources"], kept["byte_bpe"]
    assert mixed.groupby("doc_id").size().max() <= 2 and len(coded) == len(mixed) and coded.round_trip.all()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert all(list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) for r in coded.head(40).itertuples())


def test_odd_rows(spark, odd, empty):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars").withColumn("n_chars", odd.n_chars.cast("long")), empty):
        for _, stage in cp.STAGES:
            docs = written(stage(spark, docs, D), "test")
        assert docs.where("not round_trip").count() == 0


def test_line_blocks_are_of_some_length():
    assert line_dedup.BLOCK_WORDS >= 8
