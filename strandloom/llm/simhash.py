"""SimHash near-duplicates, candidates pruned by pigeonring chains.

Fingerprints of 64 bits lie on a ring of tau + 1 segments. If two differ in tau bits at most, then from some segment
on every chain of l consecutive segments differs in l * tau / (tau + 1) bits at most (rounded down). So the first
segment of such a chain is equal, and the first two differ in one bit at most: fingerprints that share a key, the bits
of two neighbouring segments with one bit of the second left out, are the candidates. Longer chains prune them before
all 64 bits are compared.

Texts of a similarity of 0.8 differ in 15 percent of the bits, where no key that is equal for certain tells anything.
similar() therefore takes 256 bits, a ring of four segments of 64, and keys of as many bits as the number of
fingerprints asks for, drawn within a segment; a pair at that similarity is expected to share MEET keys. Members of a
key are held to the same chains of segments, and what is left is linked if the sets of shingles are as similar as asked.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import salts, with_lowest, written
from strandloom.llm.components import components

BITS, TAU, SHINGLE, SEED = 64, 4, 4, 42
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1
#: Fingerprints that share a key are compared with each other in one task up to this number; beyond it they are linked
#: through the fingerprints around them, which takes work in proportion to their number.
RUN = 4096
#: Of similar(): 64-bit words of a fingerprint, words of a shingle, least share of common shingles, bits that candidates
#: may differ in. Texts of similarity 0.8 differ in 39 bits on average with a deviation of 6, those of 0.6 in 59.
WORDS, SIMILAR_SHINGLE, LEAST, SIMILAR_TAU = 4, 5, 0.8, 48
#: Candidates, and bytes of their shingles, that are compared in one task, about.
CELL, CELL_BYTES = 1024, 32 << 20
#: Share of bits in which texts of similarity 0.8 differ: the angle of vectors of cosine 8 / 9, and keys that they are to share.
FAR, MEET = math.acos(8 / 9) / math.pi, 4.0
#: Odd multipliers that make further words of a shingle's hash.
MIX = np.array([[0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], [0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]], np.uint64)


def shingle_digests(text: str | None, shingle: int) -> np.ndarray:
    """[n, 8] bytes of the hashes of the shingles of text, repeats included; of all its words if they are fewer."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(ws))
    digest = xxhash.xxh64_digest
    cut = zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in cut]), np.uint8).reshape(-1, 8)


def majority(rows: np.ndarray) -> np.ndarray:
    """Bytes whose bits are 1 where over half of the rows have 1."""
    ones = np.zeros(8 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 255):
        ones += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(rows))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the shingles of text, repeats included; 0 if it has no word."""
    rows = shingle_digests(text, shingle)
    return int(majority(rows).view(">i8")[0]) if len(rows) else 0


def wide_fingerprint(text: str | None, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, int, int]:
    """WORDS signed words of the SimHash of the distinct shingles of text (zeros if it has no word), a hash of their sorted
    set, and their number. A passage that a text repeats counts once, as it does in the similarity."""
    h = np.unique(shingle_digests(text, shingle).view(np.uint64)).reshape(-1, 1)
    named = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
    if not len(h):
        return np.zeros(WORDS, np.int64), named, 0
    x = h * MIX[0]
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    x ^= x >> np.uint64(32)
    return majority(np.ascontiguousarray(np.hstack((h, x))).view(np.uint8)).view(np.int64), named, len(h)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.int64, len(b))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def segments(tau: int) -> list[int]:
    """Masks of the tau + 1 segments of the ring."""
    edges = [BITS * i // (tau + 1) for i in range(tau + 2)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(tau: int) -> list[tuple[int, int, int]]:
    """(start, mask, mark): the key of a fingerprint for chains from start is its bits in mask, marked by which mask."""
    rng, out, segs = random.Random(7), [], segments(tau)
    for i, s in enumerate(segs):
        after = segs[(i + 1) % len(segs)]
        out += [(i, s | after & ~(1 << b), rng.getrandbits(64)) for b in range(BITS) if after >> b & 1]
    return out


def chain_masks(tau: int, start: int) -> list[tuple[np.uint64, int]]:
    """(bits of the chain of l segments from start, differences allowed) for l from 3 to all."""
    segs, mask, out = segments(tau), 0, []
    for k in range(tau + 1):
        mask |= segs[(start + k) % (tau + 1)]
        if k >= 2 or k == tau:
            out.append((np.uint64(mask), (k + 1) * tau // (tau + 1)))
    return out


def stars(fps: np.ndarray, masks: list[tuple[np.uint64, int]]) -> tuple[list, list]:
    """Edges from each fingerprint to the one from which its part of the run was reached, over links of the run."""
    out_a, out_b = [], []
    open_ = np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not open_[first]:
            continue
        open_[first] = False
        todo = [first]
        while todo:
            left = np.flatnonzero(open_)
            if not len(left):
                return out_a, out_b
            diff = fps[left] ^ fps[todo.pop()]
            for mask, most in masks:
                ok = np.bitwise_count(diff & mask) <= most
                left, diff = left[ok], diff[ok]
            open_[left] = False
            todo += left.tolist()
            out_a += [first] * len(left)
            out_b += left.tolist()
    return out_a, out_b


def linker(tau: int, most: int):
    """For mapInPandas over rows (key, start, fp) sorted by key: edges (a, b), or a = b for members of a run over most."""
    chains = [chain_masks(tau, i) for i in range(tau + 1)]

    def frame(a, b, dense) -> pd.DataFrame:
        return pd.DataFrame({"a": np.asarray(a, np.uint64).view(np.int64), "b": np.asarray(b, np.uint64).view(np.int64), "dense": dense})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, held, dense = None, 0, [], False

        def close() -> Iterator[pd.DataFrame]:
            fps = np.concatenate(held)
            if not dense and len(fps) > 1:
                a, b = stars(fps, chains[start])
                if a:
                    yield frame(fps[a], fps[b], False)

        for batch in batches:
            keys, fps, begins = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["start"].to_numpy()
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            # Pairs that end within this batch, the usual case, are compared all at once.
            inner = np.flatnonzero(sizes[1:-1] == 2) + 1
            x, y, s = fps[cuts[inner]], fps[cuts[inner] + 1], begins[cuts[inner]]
            for i in range(tau + 1):
                ok = s == i
                for mask, allowed in chains[i]:
                    ok &= np.bitwise_count((x ^ y) & mask) <= allowed
                if ok.any():
                    yield frame(x[ok], y[ok], False)
            for k in range(len(sizes)):
                if 0 < k < len(sizes) - 1 and sizes[k] < 3:
                    continue
                lo, hi = cuts[k], cuts[k + 1]
                if key is None or keys[lo] != key:
                    if held:
                        yield from close()
                    key, start, held, dense = keys[lo], int(begins[lo]), [], False
                held.append(fps[lo:hi])
                if dense or sum(map(len, held)) > most:
                    dense = True
                    got = np.concatenate(held)
                    yield frame(got, got, True)
                    held = [got[:0]]
        if held:
            yield from close()

    return run


def ball(tau: int) -> list[int]:
    """Patterns of up to tau / 2 bits: two fingerprints at most tau bits apart meet in such a distance."""
    out, layer = [0], {0}
    for _ in range(tau // 2):
        layer = {x | 1 << b for x in layer for b in range(BITS) if not x >> b & 1}
        out += sorted(layer)
    return out


def dense_links(fps: DataFrame, tau: int) -> DataFrame:
    """Edges (a, b) that join what tau links within fps (fp), without comparing pairs: fingerprints with a common
    neighbour in tau / 2 bits are linked to the smallest that has it. tau is even."""
    near = fps.select("fp", F.explode(F.array(*[F.lit(signed(x)) for x in ball(tau)])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = first = None
        for b in batches:
            keys, got = b["key"].to_numpy(), b["fp"].to_numpy()
            if not len(keys):
                continue
            new = np.concatenate(([key is None or keys[0] != key], np.diff(keys) != 0))
            heads = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            to = np.where(heads >= 0, got[heads], first if first is not None else 0)
            key, first = keys[-1], to[-1]
            yield pd.DataFrame({"a": to[~new], "b": got[~new]})

    return near.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(run, "a long, b long").distinct()


def links(fps: DataFrame, tau: int = TAU, most: int = RUN) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fps (fp, distinct) that differ in tau bits at most."""
    keys = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("start"), F.col("fp").bitwiseAND(F.lit(signed(m))).bitwiseXOR(F.lit(signed(x))).alias("key")) for i, m, x in variants(tau)])
    # Fingerprints are few and small beside their keys: they are dealt to as many tasks as the keys will need.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.repartition(parts).select("fp", F.explode(keys).alias("k")).select("k.key", "k.start", "fp")
    found = written(rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(linker(tau, most), "a long, b long, dense boolean"), "op6-links")
    edges = found.where("not dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    return edges if dense.isEmpty() else edges.union(dense_links(dense, tau))


def near_duplicates(docs: DataFrame, tau: int = TAU, shingle: int = SHINGLE, most: int = RUN) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, fingerprint, component_id.

    Fingerprints link at tau or fewer differing bits; component_id is the smallest doc_id that links reach. Null and
    empty texts, and those without a word, have fingerprint zero and are linked like any other. Repeated rows get the
    same result; a null doc_id is never the smallest unless its component has no other. An empty table gives no rows.

    Pairs are never listed: equal fingerprints are one node, the members of a key yield a forest, and runs of over most
    members are linked through common neighbours. Counting and joining back are salted, so neither one fingerprint nor
    one component of a third of all rows meets in one task."""
    if tau % 2:
        raise ValueError("tau has to be even")
    made = written(fingerprints(docs, shingle), "op6-fingerprints")
    named = components_of(made, lambda nodes: links(nodes.select("fp"), tau, most), F.col("fp"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components_of(made: DataFrame, link: Callable[[DataFrame], DataFrame], node: Column, value: str = "doc_id", name: str = "component_id", *extra: Column) -> DataFrame:
    """made, rows with a fingerprint fp, with name: the smallest value in the component of the row's fingerprint. link
    gives edges (a, b) of nodes; its argument has a row for each fingerprint: node, fp, low (the smallest value), extra."""
    dealt = made.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(salts(made.sparkSession))).cast("int"))
    parts = written(dealt.groupBy("fp", "salt").agg(F.min(value).alias("low"), *extra), "op6-parts")
    # Numbers of nodes are those of the written rows, so they stay when tasks are run again.
    nodes = written(parts.groupBy("fp").agg(F.min("low").alias("low"), *extra).withColumn("node", node), "op6-nodes")
    roots = components(link(nodes))
    rooted = written(nodes.join(roots, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root")), "op6-rooted")
    named = with_lowest(rooted, "root", "low", name).select("fp", name)
    ends = parts.select("fp", "salt").join(named, "fp")
    return dealt.join(ends, ["fp", "salt"]).drop("salt")


def wide_keys(count: int) -> list[tuple[int, int, int]]:
    """(word, mask, mark) of each key of count fingerprints: as many bits as count has, so that unlike fingerprints that
    share a key stay few at every size, and as many keys as let a pair that differs in FAR of its bits share MEET."""
    bits = min(max(math.ceil(math.log2(max(count, 2))), 12), 40)
    rng = random.Random(11)
    draw = lambda: sum(1 << b for b in rng.sample(range(64), bits))
    return [(i % WORDS, draw(), rng.getrandbits(64)) for i in range(math.ceil(MEET / (1 - FAR) ** bits))]


def within(diff: np.ndarray, tau: int) -> np.ndarray:
    """Whether rows of differing bits [n, WORDS] have tau at most: from some word on, chains of l consecutive words of the
    ring stay within l * tau / WORDS. Chains grow word by word, over the rows that are left."""
    d = np.bitwise_count(diff).astype(np.int16)
    ok = np.zeros(len(d), bool)
    for start in range(WORDS):
        left, chain = np.flatnonzero(~ok), 0
        for k in range(WORDS):
            chain = chain + d[left, (start + k) % WORDS]
            fits = chain <= (k + 1) * tau // WORDS
            left, chain = left[fits], chain[fits]
        ok[left] = True
    return ok


def tree(fps: np.ndarray, tau: int, like: Callable[[int, np.ndarray], np.ndarray] | None = None, apart: np.ndarray | None = None) -> tuple[list, list]:
    """Links (places a, b) that join what all links of the rows of fps join: breadth first from each. like keeps those of
    the places given that are like a first one; rows of one value of apart are known to be joined."""
    out_a, out_b = [], []
    open_ = np.ones(len(fps), bool)
    for first in range(len(fps)):
        todo = [first] if open_[first] else []
        open_[first] = False
        while todo:
            at, left = todo.pop(), np.flatnonzero(open_)
            if not len(left):
                break
            if apart is not None:
                left = left[apart[left] != apart[at]]
            left = left[within(fps[left] ^ fps[at], tau)]
            if like is not None and len(left):
                left = like(at, left)
            open_[left] = False
            todo += left.tolist()
            out_a += [at] * len(left)
            out_b += left.tolist()
    return out_a, out_b


FP = [f"f{i}" for i in range(WORDS)]
LINKED = "a long, b long"


def linked(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b})


def candidate_linker(tau: int, most: int, short: int = 32):
    """For mapInPandas over rows (key, node, f0, f1, ...) sorted by key: links (a, b) of candidates within each key. Runs up
    to short compare all pairs, many runs at once; longer ones make a tree; members of a run over most are candidates
    unseen, linked to the run's first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = head = None

        def chunk(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[pd.DataFrame]:
            """Links in whole runs, none over most."""
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            size = np.diff(cuts)
            at = np.flatnonzero(np.repeat(size <= short, size))
            for off in range(1, short):
                at = at[at + off < len(keys)]
                at = at[keys[at] == keys[at + off]]
                if not len(at):
                    break
                ok = at[within(fps[at] ^ fps[at + off], tau)]
                yield linked(nodes[ok], nodes[ok + off])
            for k in np.flatnonzero(size > short).tolist():
                part = slice(cuts[k], cuts[k + 1])
                a, b = tree(fps[part], tau)
                yield linked(nodes[part][a], nodes[part][b])

        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64)
        for b in batches:
            got = b["key"].to_numpy(), b["node"].to_numpy(), b[FP].to_numpy().view(np.uint64)
            keys, nodes, fps = (np.concatenate(x) for x in zip(held, got, strict=True))
            if dense is not None:
                more = int(np.searchsorted(keys, dense, "right"))
                yield linked(np.full(more, head), nodes[:more])
                keys, nodes, fps = keys[more:], nodes[more:], fps[more:]
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from chunk(keys[:last], nodes[:last], fps[:last])
            held = keys[last:], nodes[last:], fps[last:]
            if len(held[0]) > most:
                dense, head = held[0][0], held[1][0]
                yield linked(np.full(len(held[1]), head), held[1])
                held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield from chunk(*held)

    return run


def candidates(nodes: DataFrame, tau: int, most: int, cell: int) -> DataFrame:
    """Those of nodes (node, fp, low, n) that share a group with another, with group, parts and lead: groups are the
    components of pairs that share a key and differ in tau bits at most. A group of parts over 1 is too large for one
    task; about 32 of its members lead."""
    made = [F.col(f"fp.{FP[w]}").bitwiseAND(F.lit(signed(m))).bitwiseXOR(F.lit(signed(x))) for w, m, x in wide_keys(nodes.count())]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "fp").repartition(tasks).select("node", *[f"fp.{c}" for c in FP], F.explode(F.array(*made)).alias("key"))
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInPandas(candidate_linker(tau, most), LINKED), "op6-candidates")
    roots = components(found).withColumnRenamed("root", "group")
    salted = nodes.join(roots, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts(nodes.sparkSession))))
    named = written(salted, "op6-groups")
    size = F.greatest(F.count(F.lit(1)) / cell, 8 * F.sum("n") / CELL_BYTES)
    sizes = named.groupBy("group", "salt").agg(size.alias("size"), F.count(F.lit(1)).alias("all"))
    whole = W.partitionBy("group")
    sizes = sizes.select("group", "salt", (F.sum("size").over(whole).cast("int") + 1).alias("parts"), F.sum("all").over(whole).alias("all"))
    lead = F.pmod(F.xxhash64("node", F.lit(7)), F.col("all")) < 32
    return named.join(sizes, ["group", "salt"]).select("node", "fp", "low", "group", "parts", lead.alias("lead"))


class Sets:
    """Sorted distinct shingle hashes of some texts."""

    def __init__(self, raw: pd.Series, least: float):
        self.sets, self.least = [np.frombuffer(x, np.uint64) for x in raw], least
        self.sizes = np.array([len(x) for x in self.sets], np.int64)

    def like(self, at: int, left: np.ndarray) -> np.ndarray:
        own, n = self.sets[at], len(self.sets[at])
        left = left[np.minimum(self.sizes[left], n) >= self.least * np.maximum(self.sizes[left], n)]
        if not len(left) or not n:
            return left
        flat = np.concatenate([self.sets[k] for k in left])
        hit = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
        common = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(self.sizes[left])[:-1])), dtype=np.int64)
        return left[common >= self.least * (n + self.sizes[left] - common)]


def similar_links(docs: DataFrame, nodes: DataFrame, tau: int, shingle: int, least: float, most: int, cell: int) -> DataFrame:
    """Edges (a, b) of nodes (node, fp, low, n), low the id of one document: of candidates whose sets of shingles have a
    share of least in common, as many as leave the same components. docs has rows (id, text).

    Candidates of a group meet in one task up to cell of them. A larger group is cut into parts, each with the group's
    leaders; then members outside the group's largest component, by what is linked so far, meet every part."""
    chosen = written(candidates(nodes, tau, most, cell), "op6-chosen")
    kept = ["node", "group", "parts", "lead", *FP]

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                yield part[kept].assign(has=[np.unique(shingle_digests(t, shingle).view(np.uint64)).tobytes() for t in part["text"]])

    # The chosen are few beside docs as a rule; Spark broadcasts them where their size on disk allows it.
    rows = docs.join(chosen.withColumnRenamed("low", "id"), "id").dropDuplicates(["node"]).select("node", "group", "parts", "lead", *[f"fp.{c}" for c in FP], "text")
    kinds = "node long, group long, parts int, lead boolean, " + ", ".join(f"{c} long" for c in FP)
    sets = written(rows.mapInPandas(shingles, kinds + ", has binary"), "op6-sets").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))

    def joined(pdf: pd.DataFrame, apart: np.ndarray | None = None) -> pd.DataFrame:
        nodes, fps = pdf["node"].to_numpy(), np.ascontiguousarray(pdf[FP].to_numpy()).view(np.uint64)
        a, b = tree(fps, tau, Sets(pdf["has"], least).like, apart)
        return linked(nodes[a], nodes[b])

    every = F.sequence(F.lit(0), F.col("parts") - 1)
    met = sets.withColumn("i", F.explode(F.when(F.col("lead") & (F.col("parts") > 1), every).otherwise(F.array("part"))))
    edges = written(met.select("group", "i", "node", *FP, "has").groupBy("group", "i").applyInPandas(lambda pdf: joined(pdf), LINKED), "op6-met")
    large = sets.where("parts > 1")
    if large.isEmpty():
        return edges
    named = written(large.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")), "op6-named")
    sums = named.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sums.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    rest = named.join(main, "group").withColumns({"rights": F.expr(f"int(rest div {cell}) + 1"), "other": F.col("root") != F.col("main")})
    rest = rest.withColumn("right", F.pmod(F.xxhash64("node", F.lit(6)), F.col("rights")).cast("int"))
    left = rest.select("group", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "root", "node", *FP, "has")
    right = rest.where("other").select("group", F.explode(every).alias("i"), F.col("right").alias("j"), "root", "node", *FP, "has")

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        return joined(pdf, pdf["root"].to_numpy())

    return edges.union(written(left.unionByName(right).groupBy("group", "i", "j").applyInPandas(cross, LINKED), "op6-across"))


def similar(docs: DataFrame, carry: list[Column], least: float = LEAST, shingle: int = SIMILAR_SHINGLE, tau: int = SIMILAR_TAU, most: int = RUN, cell: int = CELL) -> DataFrame:
    """(id, fp, first) for each row of docs: id a struct of the columns carry, which tell texts apart, first the smallest id of
    its component. Texts are linked that have least of their distinct shingles in common (Jaccard) and fingerprints of
    tau differing bits at most, which README gives the recall of. Texts of one set of shingles are one node, so equal
    fingerprints of unlike sets are candidates like any others; texts without a word are alike."""
    ids = docs.select(*carry).schema.fields
    names = [f.name for f in ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [wide_fingerprint(t, shingle) for t in b["text"]]
            words = np.concatenate([x for x, *_ in made] or [np.zeros(0, np.int64)]).reshape(-1, WORDS)
            yield pd.concat((b[names].reset_index(drop=True), pd.DataFrame(words, columns=FP)), axis=1).assign(named=[x for _, x, _ in made], n=[n for *_, n in made])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ids), *(f"{c} long" for c in FP), "named long", "n long"])
    made = docs.select(*carry, "text").mapInPandas(run, schema).select(F.struct(*names).alias("id"), F.struct(*FP, "named").alias("fp"), "n")
    texts = docs.select(F.struct(*carry).alias("id"), "text")
    return components_of(written(made, "op6-wide"), lambda nodes: similar_links(texts, nodes, tau, shingle, least, most, cell), F.monotonically_increasing_id(), "id", "first", F.max("n").alias("n")).drop("n")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of similar(): that of the smallest doc_id (null last), then of the smallest hash of
    the text, then of the row. Rows that are equal in all columns count as one. So no text goes that is unlike all others,
    whatever doc_ids are null or repeated, and reruns keep the same rows."""
    key = {"_did": F.coalesce("doc_id", F.lit(LAST)), "_th": F.xxhash64("text"), "_rh": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    named = [c.alias(k) for k, c in key.items()]
    first = similar(docs, named, **options).where("id = first").select("id.*").distinct()
    # The row travels as one value, so its columns may have any names.
    rows = docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(first, list(key), "left_semi").dropDuplicates(list(key)).select("row.*")
