import hashlib
import random

import numpy as np
import pytest

from strandloom.llm import substring_dedup as sd


def brute(data, window):
    key = lambda d: sd.LAST if d is None else d
    first = {}
    for d, t in data:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first[b[i : i + window]] = min(first.get(b[i : i + window], key(d)), key(d))
    out = []
    for d, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < key(d):
                gone[i : i + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), sum(bool(gone[i] and (not i or not gone[i - 1])) for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, window, anchor, block", [(1, 8, 4, 100), (2, 8, 5, 60), (3, 10, 4, 30)])
def test_against_all_strings(spark, monkeypatch, seed, window, anchor, block):
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 0 if seed == 2 else 1 << 20)
    rnd = random.Random(seed)
    ws = ["".join(rnd.choice("ab\u00e9") for _ in range(rnd.randint(1, 6))) for _ in range(30)]
    data = []
    for i in range(60):
        t = " ".join(rnd.choice(ws) for _ in range(rnd.randint(0, 14)))
        if data and rnd.random() < 0.4:
            o = rnd.choice(data)[1] or ""
            a = rnd.randint(0, len(o))
            t = t[:5] + o[a : a + rnd.randint(0, 60)] + t[5:]
        data.append((rnd.choice([i, i, i, 3, None]), t if rnd.random() < 0.95 else None))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in sd.substring_dedup(df, window, anchor, block).collect()), key=str) == brute(data, window)


def test_odd_rows(odd, empty):
    from odd_rows import ODD

    data = [(d, t) for d, t, *_ in ODD]
    assert sorted((tuple(r) for r in sd.substring_dedup(odd).collect()), key=str) == brute(data, 50)
    assert sd.substring_dedup(empty).count() == 0
    blank = odd.where("doc_id in (2, 3)")
    assert {r.n_bytes for r in sd.substring_dedup(blank).collect()} == {0}


def test_suffix_array():
    rnd = random.Random(5)
    for n in [*range(30), 200, 1000]:
        for alphabet in (b"a", b"ab", b"abc", bytes(range(256))):
            t = bytes(rnd.choice(alphabet) for _ in range(n))
            assert sd.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:])


def test_same_bytes():
    rng = np.random.default_rng(2)
    data = np.tile(rng.integers(0, 4, 300, dtype=np.uint8), 3)
    data[650:655] = 9
    at = np.concatenate((np.arange(300, 420), np.arange(600, 800)))
    lead = np.concatenate((np.arange(0, 120), np.arange(0, 100), np.arange(400, 500)))
    want = [bytes(data[a : a + 20]) == bytes(data[b : b + 20]) for a, b in zip(at, lead, strict=True)]
    assert sd.same_bytes(data, at, lead, 20).tolist() == want and 0 < sum(want) < len(want)


def test_buckets_stay_small(spark, monkeypatch):
    """With the same shuffle partitions, eight times the text meets in more buckets, not in larger ones."""
    monkeypatch.setattr(sd, "BUCKET", 10_000, raising=False)
    most, meet = [], sd.meet

    def watched(rows, function, schema):
        most.append(rows.selectExpr("bucket", "length(data) AS n").groupBy("bucket").sum("n").agg({"sum(n)": "max"}).first()[0])
        return meet(rows, function, schema)

    monkeypatch.setattr(sd, "meet", watched)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(600)) for _ in range(240)]
    data = [(i, t) for k in (0, 1000) for i, t in enumerate(texts, k)]
    for part in (data[:30] + data[240:270], data):
        got = sd.substring_dedup(spark.createDataFrame(part, "doc_id long, text string").repartition(3), block=20_000)
        assert {(r.doc_id >= 1000, r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()} == {(False, 600, 0, 0), (True, 600, 600, 1)}
    assert max(most[2:]) < 2 * max(most[:2])


def test_crowded_bucket(monkeypatch):
    """Windows are compared in passes, and slice by slice, with the same result."""
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 26, 500)
    starts = np.concatenate(([0], np.cumsum(counts + 7)))
    text = rng.integers(97, 99, starts[-1], dtype=np.uint8)
    did = rng.integers(0, 40, 500)
    windows = [(text[a + i : a + i + 8].tobytes(), d) for a, n, d in zip(starts.tolist(), counts.tolist(), did.tolist(), strict=False) for i in range(n)]
    first = {}
    for w, d in windows:
        first[w] = min(first.get(w, d), d)
    want = [i for i, (w, d) in enumerate(windows) if first[w] < d]
    for compared, piece in ((1 << 20, 1 << 20), (1000, 1 << 20), (1000, 300)):
        monkeypatch.setattr(sd, "COMPARED", compared)
        monkeypatch.setattr(sd, "SLICE", piece)
        found = list(sd.late_windows(text, counts, did, 8))
        assert len(found) == max(1, -(-len(windows) // compared)) and sorted(np.concatenate([n for n, _ in found]).tolist()) == want
        for n, run in found:
            assert (np.searchsorted(np.cumsum(counts), n, "right") == run).all()
    assert 0 < len(want) < len(windows)
