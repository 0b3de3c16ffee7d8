"""The manifest against hashlib, on odd rows and on trees of several levels."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import merkle
from strandloom.llm.common import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def ways(nodes, fanout):
    """The top over nodes, and for each node the siblings before and after it at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout :][:fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        at = [i // fanout for i in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def expected(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = ways([leaf(r) for r in groups[s]], fanout)
    root, above = ways([trees[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above):
        for r, path in zip(groups[s], trees[s][1]):
            way = path + up
            now = (*r[:4], r[4] and r[4].translate(LOWER)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            fold = leaf(now)
            for a, b in way:
                fold = h(a, fold, b)
            out.append((r[0], leaf(r), trees[s][0], root, h(*(a + b for a, b in way)), fold, fold == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert got(merkle.manifest(odd)) == expected(rows, 16)
    assert merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("fanout", [4, 16])
def test_levels_sources_and_repeated_rows(spark, fanout):
    rows = [(i, "big", "en", i, f"Text {i}") for i in range(300)] + [(i, f"s{i % 40}", None, None, "A" if i % 3 else None) for i in range(60)]
    rows += [(7, "é", "en", 1, "Same")] * 40 + [(None, None, None, None, None)] * 2 + [(1, "lone", "x", 0, "")]
    out = got(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout))
    assert out == expected(rows, fanout)
    assert 0 < sum(not r[-1] for r in out) < len(out) / 2


def test_one_row(spark):
    (r,) = merkle.manifest(spark.createDataFrame([(3, "a", "en", 1, "x")], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h() and r.verified
