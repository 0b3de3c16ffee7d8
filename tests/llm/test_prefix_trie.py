"""The trie against a dictionary of all prefixes, over few and many ranges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def digest(t):
    role, text = t
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[: prefix_trie.WIDTH]


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def total(p):
        leaves, saved = 0 if children[p] else 1, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in children[p]:
            n, s = total(q)
            leaves, saved = leaves + n, saved + s
        return leaves, saved

    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(built[c]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]), *total(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.NODES).collect()), key=str)


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(120):
        kind = rnd.random()
        for t in range(rnd.choice([1, 2, 3, 12])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), "hi" if kind < 0.5 else rnd.choice(["a", "bb", "é", ""]), 1, "x"))
    return rows


ODD = [(1, None, None, None, 1, "x"), (1, 0, "user", "", 1, "x"), (2, 0, "a", "b", 1, "x"), (2, 0, "a", "b", 1, "x"), (2, 0, "", "ab", 1, "x"), (None, 1, "user", "lost", 1, "x"), (-7, 3, "u", "t", 1, "x"), (-5, 1, "u", "w" * 50_000, 1, "x"), (10**15, None, "u", "z", 1, "x")]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_trie(spark, parts):
    rows = made(parts)
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), parts)) == expected(rows)


def test_odd_rows(spark):
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(ODD, SCHEMA))) == expected(ODD)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_one_conversation_span_ranges(spark):
    rows = [(c, t, "u", f"t{t}", 1, "x") for c in range(0, 4000, 5) for t in range(10)] + [(c, 0, "v", str(c), 1, "x") for c in range(1, 300, 5)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 9)) == expected(rows)


def test_sweeps_of_any_cut_add_up(spark):
    """Ranges cut at every place of a small sorted table, stitched in Python as trie() stitches them in Spark."""
    rows = sorted(([bytes([x]) * 16 for x in d], c) for c, d in enumerate([[], [1], [1], [1, 2], [1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 3], [2], [2, 5, 6, 7], [2, 5, 6, 7], [3]]))
    whole = [r for r in prefix_trie.sweep((c, d, [7] * len(d)) for d, c in rows) if r["what"] != "edge"]
    root = next(r for r in whole if r["what"] == "part" and r["depth"] == 0)
    for cut in range(1, len(rows)):
        parts = [list(prefix_trie.sweep((c, d, [7] * len(d)) for d, c in half)) for half in (rows[:cut], rows[cut:])]
        (a,), (b,) = ([r for r in p if r["what"] == "edge"] for p in parts)
        fixes = list(prefix_trie.corrections(a["last"], b["first"], a["sizes"]))
        for name in ("n_children", "n_leaves", "saved_tokens"):
            assert sum(r[name] for p in parts for r in p if r["what"] == "part" and r["depth"] == 0) + fixes[0][name] == root[name], (cut, name)
