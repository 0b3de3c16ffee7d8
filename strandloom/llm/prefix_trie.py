"""Prefix trie of conversations: who begins alike, and what a shared prefix would save.

A turn is its digest, a conversation the array of its turns' digests. All arrays are sorted globally by range, copies of
one conversation by conv_id, so that no range is held by one value. Each task sweeps its sorted range once: the common
prefix with the row before says which open nodes close, a stack holds the open ones. Nodes that lie on the path of a
range's first or last row may go on in the neighbouring range; they leave the task as parts under the digest of their
prefix. All that a node tells is a sum or a minimum over its parts, but for what neighbours both counted: where two ranges
meet, the common prefix of the last row before and the first row behind says which nodes those are, and corrections
are added. What comes from one range to the stitching is at most two paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import written

#: Bytes of a turn's digest; conversations borrow turns from the first of each FAMILY, fewer than HEADS.
WIDTH, FAMILY, HEADS = 16, 5, 9
#: Ids of conversations in one row while they are on their way to a digest; rows of a batch to and from Python.
BLOCK, BATCH = 256, 2048

NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: what: node (whole, with its parent), child (whole; its parent is a part, parent its prefix), part (key its prefix), ends
#: (ids under key), edge (first and last row of the range).
SWEPT = pa.schema(
    [("what", pa.string()), ("range", pa.int32()), ("seq", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("sizes", pa.list_(pa.int64()))]
)
SWEPT_DDL = "what string, range int, seq long, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, first binary, last binary, sizes array<long>"


def turn_digest(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, d: digests of its turns in order, s: UTF-8 bytes of their texts). Rows without a conv_id belong to no
    conversation. Null turns come first; turns of one number are ordered by digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", turn_digest(role, text).alias("d"), F.octet_length(text).cast("long").alias("s")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.d").alias("d"), F.col("t.s").alias("s"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """convs with their first turns taken from the first conversation of their family, as many as crc32 of the decimal
    conv_id says. A head goes to FAMILY conversations at most."""
    n = F.crc32(F.col("conv_id").cast("string")) % HEADS
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("of"), F.slice("d", 1, HEADS - 1).alias("hd"), F.slice("s", 1, HEADS - 1).alias("hs"))
    met = convs.withColumn("of", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "of", "left").withColumn("n", n.cast("int"))
    joined = lambda own, head, kind: F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("n")), F.slice(own, F.col("n") + 1, F.size(own)))
    return met.select("conv_id", joined(F.col("d"), F.col("hd"), "array<binary>").alias("d"), joined(F.col("s"), F.col("hs"), "array<bigint>").alias("s"))


class Node:
    """An open node of a sweep. first: on the path of the range's first row, so it may have begun before. done holds its
    children's rows until its own smallest conversation is known."""

    __slots__ = ("depth", "size", "first", "low", "convs", "children", "leaves", "saved", "ends", "done", "key")

    def __init__(self, depth: int, size: int, first: bool):
        self.depth, self.size, self.first = depth, size, first
        self.low, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.done, self.key = None, [], None


def common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def prefix_key(d: list[bytes], depth: int) -> bytes:
    return hashlib.sha256(b"".join(d[:depth])).digest()


class Ends:
    """The ids of equal conversations, in order: their digest and, where the range may hold a part of them alone, blocks."""

    def __init__(self, first: bool):
        self.first, self.hash, self.n, self.ids, self.blocks = first, hashlib.sha256(), 0, [], []

    def add(self, conv: int) -> None:
        self.hash.update((f",{conv}" if self.n else str(conv)).encode())
        self.n += 1
        self.ids.append(str(conv))
        if len(self.ids) == BLOCK:
            self.cut()

    def cut(self) -> None:
        if self.ids:
            self.blocks.append(",".join(self.ids))
            self.ids = []


def sweep(rows: Iterator[tuple[int, list[bytes], list[int]]]) -> Iterator[dict]:
    """What one sorted range of (conv_id, d, s) tells, as dictionaries of SWEPT."""
    stack, before, sizes, first_row, ends = [Node(0, 0, True)], None, [], None, None

    def told(node: Node) -> dict:
        return {"conv_id": node.low, "depth": node.depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends": node.ends}

    def keyed(node: Node) -> bytes:
        if node.key is None:
            node.key = prefix_key(before, node.depth)
        return node.key

    def ended(last: bool) -> Iterator[dict]:
        """Closes the group of equal rows on top of the stack; blocks where it is the range's first or last."""
        node = stack[-1]
        if not (ends.first or last):
            node.ends = ends.hash.hexdigest()
            return
        ends.cut()
        for k, block in enumerate(ends.blocks):
            yield {"what": "ends", "key": keyed(node), "seq": k, "ends": block}

    def closed(last: bool) -> Iterator[dict]:
        node = stack.pop()
        node.leaves += node.children == 0
        node.saved += (node.convs - 1) * node.size
        up = stack[-1] if stack else None
        if last or node.first:
            for row in node.done:
                yield row | {"what": "child", "parent": keyed(node)}
            yield told(node) | {"what": "part", "key": keyed(node), "parent": keyed(up) if up else None}
        else:
            for row in node.done:
                yield row | {"what": "node", "parent_conv_id": node.low}
            if up.first:
                yield told(node) | {"what": "child", "parent": keyed(up)}
            else:
                up.done.append(told(node))
        if up:
            up.low = node.low if up.low is None else min(up.low, node.low)
            up.convs, up.leaves, up.saved = up.convs + node.convs, up.leaves + node.leaves, up.saved + node.saved

    for conv, d, s in rows:
        shared = -1 if before is None else common(before, d)
        if before is None or shared < len(d) or len(d) < len(before):
            if before is not None:
                yield from ended(False)
            while len(stack) - 1 > max(shared, 0):
                yield from closed(False)
            for k in range(len(stack) - 1, len(d)):
                stack[-1].children += 1
                stack.append(Node(k + 1, s[k], before is None))
            ends = Ends(before is None)
        before, sizes = d, s
        first_row = d if first_row is None else first_row
        top = stack[-1]
        top.convs += 1
        top.low = conv if top.low is None else min(top.low, conv)
        ends.add(conv)
    if before is None:
        return
    yield from ended(True)
    while stack:
        yield from closed(True)
    yield {"what": "edge", "first": b"".join(first_row), "last": b"".join(before), "sizes": sizes}


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def swept(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    rows = (r for b in given for at in range(0, b.num_rows, BATCH) for r in zip(*(c.to_pylist() for c in b.slice(at, BATCH).columns)))
    yield from batches((r | {"range": part} for r in sweep(rows)), SWEPT)


def turns_of(joined: bytes) -> list[bytes]:
    return [joined[i : i + WIDTH] for i in range(0, len(joined), WIDTH)]


def corrections(last: bytes, first: bytes, sizes: list[int]) -> Iterator[dict]:
    """What two ranges counted twice: last is the row before their border with the sizes of its texts, first the row behind."""
    a, b = turns_of(last), turns_of(first)
    n, saved, out = common(a, b), 0, []
    for depth in range(n, -1, -1):
        saved += sizes[depth - 1] if depth else 0
        out.append((depth, -1 if depth < n else 0, -1 if len(a) == n else 0, saved))
    key = hashlib.sha256()
    for depth, children, leaves, saved in reversed(out):
        if depth:
            key.update(a[depth - 1])
        yield {"key": key.copy().digest(), "depth": depth, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}


FIX = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def fixed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches((c for b in given for r in b.to_pylist() for c in corrections(r["last"], r["first"], r["sizes"])), FIX)


HASHED = pa.schema([("key", pa.binary()), ("whole", pa.string())])


def hashed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, whole) of blocks (key, ends) that come in order: a digest is fed block by block, no list of ids is held."""

    def rows() -> Iterator[dict]:
        key, so_far = None, None
        for batch in given:
            for at in range(0, batch.num_rows, BATCH):
                for k, block in zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns)):
                    if k != key:
                        if key is not None:
                            yield {"key": key, "whole": so_far.hexdigest()}
                        key, so_far = k, hashlib.sha256()
                        so_far.update(block.encode())
                    else:
                        so_far.update(f",{block}".encode())
        if key is not None:
            yield {"key": key, "whole": so_far.hexdigest()}

    yield from batches(rows(), HASHED)


def trie(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of the trie over convs (conv_id, d, s), a written table with one row for each conv_id: NODES.

    Every distinct sequence of first turns is a node, the empty one the root, to which conversations without turns belong
    as well. No conversation: no node. A node with more conversations than a range, and one with very many children, is a few
    numbers for each range. The ids of conversations that end at one node meet in one task as blocks of 256 and are
    hashed in their order without being held, because the digest is over all of them in a row. A row holds a
    conversation: 24 bytes a turn."""
    parts = parts or int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = convs.select("conv_id", "d", "s").repartitionByRange(parts, "d", "conv_id").sortWithinPartitions("d", "conv_id")
    out = written(placed.mapInArrow(swept, SWEPT_DDL), "op13-swept")
    kind = lambda what: out.where(F.col("what") == what)
    edges = kind("edge").select("range", "first", "last", "sizes")
    pairs = edges.select("range", F.lag("range").over(W.orderBy("range")).alias("before"))  # a number for each range
    borders = pairs.join(edges.select("range", "first"), "range").join(edges.select(F.col("range").alias("before"), "last", "sizes"), "before")
    fixes = borders.select("last", "first", "sizes").mapInArrow(fixed, "key binary, depth long, n_children long, n_leaves long, saved_tokens long")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = kind("part").select("key", "parent", "conv_id", *NODES[3:7], "depth", "ends").unionByName(fixes, allowMissingColumns=True)
    blocks = kind("ends").select("key", "range", "seq", "ends").repartition("key").sortWithinPartitions("key", "range", "seq")
    whole = blocks.select("key", "ends").mapInArrow(hashed, "key binary, whole string")
    merged = met.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), *sums, F.max("ends").alias("ends")).join(whole, "key", "left")
    merged = written(merged.withColumn("ends", F.coalesce("whole", "ends")).drop("whole"), "op13-stitched")
    names = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Children of a node that spans ranges look its name up by range and prefix, so that no key has all of them.
    at = kind("part").select("range", F.col("key").alias("parent")).join(names, "parent")
    child = kind("child").drop("parent_conv_id").join(at, ["range", "parent"])
    rows = kind("node").unionByName(child.select(out.columns)).unionByName(merged.join(names, "parent", "left").drop("key", "parent"), allowMissingColumns=True)
    none = hashlib.sha256().hexdigest()
    return rows.select(*NODES[:7], F.coalesce("ends", F.lit(none)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """The trie over rebuilt conversations of turns (conv_id, turn, role, text; other columns are not read): see
    conversations(), rebuilt() and trie() for nulls, ties, and conversations without turns. Repeated rows are turns of their
    own. Null roles and texts are empty; a turn is its role and text. An empty table gives an empty result."""
    convs = written(conversations(turns), "op13-conversations")
    return trie(written(rebuilt(convs), "op13-rebuilt"), parts)
