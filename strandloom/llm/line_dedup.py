"""Line dedup by pairwise alignment.

A line goes from a document if it lies in a block of consecutive lines, of BLOCK_WORDS words or more, that an earlier
document has too. Such a block is covered by windows: from each line, forwards and backwards, the fewest lines that have
BLOCK_WORDS words. What lines a window has depends on them alone, so an earlier document with the block has the same
windows. A document is aligned by patience diff with the first document of each of its windows; the common blocks go, and
windows that no order-keeping alignment can match (moved or repeated passages) are looked up in that document and go too.
So a line that many documents share makes one pair for each of them and not one for any two, and no block is missed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, salts, written

#: Words that a common block needs to be deleted.
BLOCK_WORDS = 8
#: Odd base of the windows' hashes, polynomials modulo 2 ** 64 of the hashes of their lines, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LAST = (1 << 63) - 1
#: What a line's second hash is made with; a line goes only if both hashes are those of a line of the earlier document.
SECOND = 43


def in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (i, j), sorted by i, whose j increase: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1] = [j]
        at[k : k + 1] = [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal lines of a and b, increasing in both: equal lines at both ends of a stretch are matched,
    then lines that stand once in both, and so on in the stretches between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once_a = {x for x, c in Counter(a[i:m]).items() if c == 1}
        once_b = {x for x, c in Counter(b[j:n]).items() if c == 1}
        shared = once_a & once_b
        if not shared:
            continue
        where = {b[k]: k for k in range(j, n) if b[k] in shared}
        anchors = in_order([(k, where[a[k]]) for k in range(i, m) if a[k] in shared])
        out += anchors
        for (i0, j0), (i1, j1) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if i0 + 1 < i1 and j0 + 1 < j1:
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def windows(hs: np.ndarray, ws: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and hash of the windows of documents whose lines stand one after another in hs (hashes) and
    ws (words), each from its begin to the next: from each line, forwards and backwards, the fewest lines with least
    words. None where the document has not so many. A line of so many words is one window."""
    n = len(hs)
    upto = np.concatenate(([0], np.cumsum(ws, dtype=np.int64)))
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.arange(n)
    ahead = np.searchsorted(upto, upto[:-1] + least) - 1
    back = np.searchsorted(upto, upto[1:] - least, "right") - 1
    on, before = ahead < begins[1:][doc], (back >= begins[:-1][doc]) & (ws < least)
    first, last = np.concatenate((at[on], back[before])), np.concatenate((ahead[on], at[before]))
    powers, inverse, sums = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumprod(np.full(n, BASE, np.uint64), out=powers[1:])
    np.cumprod(np.full(n, INVERSE, np.uint64), out=inverse[1:])
    np.cumsum(hs.astype(np.int64, copy=False).view(np.uint64) * inverse[:-1], out=sums[1:])
    key = (sums[last + 1] - sums[first]) * powers[first] + (last - first).astype(np.uint64) * np.uint64(INVERSE)
    return first, last, key.view(np.int64)


def common_lines(a: Sequence[int], b: Sequence[int], words: Sequence[int], least: int, lookups: bool = True) -> list[int]:
    """Lines of b in blocks that a has too, consecutive in both, with at least that many words: those of the alignment and,
    with lookups, those whose windows a has elsewhere."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*align(a, b), (None, None)]:
        if before is None or (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        if i is None:
            break
        block.append(j)
        before = (i, j)
    gone, has = set(out), set(a)
    if not lookups or all(k in gone or x not in has for k, x in enumerate(b)):
        return out
    # Lines that a has elsewhere or more often: lines of a that b lacks get no words, as no common window has them.
    size = dict(zip(b, words, strict=True))
    _, _, theirs = windows(np.array(a, np.int64), np.array([size.get(x, 0) for x in a], np.int64), np.array([0, len(a)]), least)
    first, last, own = windows(np.array(b, np.int64), np.array(words, np.int64), np.array([0, len(b)]), least)
    hit = np.isin(own, theirs)
    edges = np.zeros(len(b) + 1, np.int64)
    np.add.at(edges, first[hit], 1)
    np.add.at(edges, last[hit] + 1, -1)
    return sorted(gone.union(np.flatnonzero(np.cumsum(edges[:-1])).tolist()))


def window_rows(lines: DataFrame, least: int) -> DataFrame:
    """(did, th, h): the distinct windows of each document of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            begins = np.concatenate(([0], np.cumsum(b["hs"].map(len)))).astype(np.int64)
            if not begins[-1]:
                continue
            first, _, key = windows(np.concatenate(b["hs"].to_list()), np.concatenate(b["ws"].to_list()), begins, least)
            doc = np.searchsorted(begins, first, "right") - 1
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.ones(len(doc), bool)
            new[1:] = (np.diff(doc) != 0) | (key[1:] != key[:-1])
            yield pd.DataFrame({"did": b["did"].to_numpy()[doc[new]], "th": b["th"].to_numpy()[doc[new]], "h": key[new]})

    return lines.mapInPandas(run, "did long, th long, h long")


#: Later documents that meet one copy of an earlier one's lines, about.
PARTNERS = 256


def removed_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, lookups: bool = True) -> DataFrame:
    """(did, th, removed): for each document that loses lines, their places from 0. did is doc_id, or LAST for null. Without
    lookups only what alignments match goes.

    The lines of an earlier document are sent once for each PARTNERS later ones, ahead of them in one order, so what moves
    grows with the pairs and not with pairs times lines."""
    key = [F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th")]
    split = docs.where("text is not null").select(*key, F.split("text", "\n").alias("ls"))
    lines = written(
        split.select("did", "th", F.transform("ls", lambda x: F.xxhash64(x)).alias("hs"), F.transform("ls", lambda x: F.xxhash64(x, F.lit(SECOND))).alias("hs2"), F.transform("ls", lambda x: F.regexp_count(x, F.lit(WORD))).alias("ws")).distinct(),
        "op9-lines",
    )
    own = written(window_rows(lines, block_words).withColumn("salt", F.pmod(F.xxhash64("did", "th"), F.lit(salts(docs.sparkSession))).cast("int")), "op9-windows")
    firsts = own.groupBy("h").agg(F.min(F.struct("did", "th")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = own.select("h", "salt").distinct().join(firsts.select("h", "first"), "h")
    pairs = (
        own.join(spread, ["h", "salt"])
        .where((F.col("first.did") != F.col("did")) | (F.col("first.th") != F.col("th")))
        .select("did", "th", "salt", F.col("first.did").alias("did0"), F.col("first.th").alias("th0"))
        .distinct()
    )
    pairs = written(pairs, "op9-pairs")
    # A salt's later documents of one earlier document are dealt to parts by their number.
    sizes = pairs.groupBy("did0", "th0", "salt").agg((F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("th", "did"), F.col("parts") + 1).cast("int")
    dealt = pairs.join(sizes, ["did0", "th0", "salt"]).withColumn("part", part)
    at = ["did0", "th0", "salt", "part"]
    heads = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts")))).join(lines.select(F.col("did").alias("did0"), F.col("th").alias("th0"), "hs", "hs2"), ["did0", "th0"])
    zero = F.lit(0).cast("long")
    heads = heads.select(*at, F.lit(0).alias("later"), zero.alias("did"), zero.alias("th"), "hs", "hs2", F.array().cast("array<int>").alias("ws"))
    tails = dealt.join(lines, ["did", "th"]).select(*at, F.lit(1).alias("later"), "did", "th", "hs", "hs2", "ws")
    both = heads.union(tails).repartition(*at).sortWithinPartitions(*at, "later").drop(*at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, has = [], set()
        for b in batches:
            out = []
            for later, did, th, hs, hs2, ws in zip(b["later"].tolist(), b["did"], b["th"], b["hs"], b["hs2"], b["ws"], strict=True):
                if not later:
                    first, has = hs.tolist(), set(zip(hs.tolist(), hs2.tolist(), strict=True))
                    continue
                gone = [k for k in common_lines(first, hs.tolist(), ws.tolist(), block_words, lookups) if (int(hs[k]), int(hs2[k])) in has]
                if gone:
                    out.append((did, th, gone))
            yield pd.DataFrame({"did": np.array([x[0] for x in out], np.int64), "th": np.array([x[1] for x in out], np.int64), "at": [x[2] for x in out]})

    found = both.mapInPandas(run, "did long, th long, at array<int>")
    return found.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("removed"))


def line_dedup(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with text less the blocks of lines, of block_words or more, that an earlier document has, and n_lines_before, n_removed (0 and 0 for a null text,
    which stays null). Columns of docs that have these names give way.

    Earlier is the smaller doc_id (null last), then the smaller hash of the text; rows that repeat both are one
    document and are cut alike. An empty text has one empty line, which is never deleted. A text keeps its other lines,
    in order, joined by line ends; it may become empty. Lines are compared by two 64-bit hashes. An empty table gives no
    rows. Texts move once, to meet their deletions; before that, only hashes do."""
    gone = removed_lines(docs, block_words).select("did", "th", "removed")
    rest = docs.drop("n_lines_before", "n_removed")
    # The row travels as one value, so its columns may have any names.
    keyed = rest.select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"))
    split = keyed.join(gone, ["did", "th"], "left").withColumn("lines", F.split("row.text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return split.select(
        *[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in rest.columns],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines_before"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
