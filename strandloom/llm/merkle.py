"""Merkle manifest of a table: a hash for each row, a tree for each source, and one root over the sources' trees.

Texts are hashed where they are read and never move. Places within a source come from one global range sort and the
counts of its partitions, so a source of any size is ranked by many tasks. Going up, every level groups at most FANOUT
nodes by the number of their parent; coming down, every level joins the runs of that level with the one row of their
parent, so that siblings are appended over keys that are unique on both sides however large a source is. The last level
is not shuffled: a run of leaves and the way from it to the root are one row that is unfolded in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import ascii_lower, written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and the value; - if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*(field(fields[f]) for f in FIELDS))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with i, their place from 0 within their group by order, and n, the group's rows. Needs a written table, as the
    range sort reads it twice."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "op12-sorted").withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(W.partitionBy(group).orderBy("part"))
    places = counts.select(group, "part", (upto - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy(group)).alias("n"))
    return dealt.join(places, [group, "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass
class Tree:
    """runs: for each level from the leaves, its runs (g, p: number of the parent, nodes: array of (i, hash, item));
    tops: (g, level, hash, item) of what remains of each group."""

    runs: list[DataFrame]
    tops: DataFrame


def climb(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees over leaves (g, i, n, hash, item), one for each g. item is carried by leaves alone."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    now, runs, tops, level = leaves, [], None, 0
    item = leaves.schema["item"].dataType
    while True:
        top = now.where("n = 1").select("g", F.lit(level).alias("level"), "hash", "item")
        tops = top if tops is None else tops.union(top)
        if most <= 1:
            return Tree(runs, tops)
        run = now.where("n > 1").groupBy("g", "n", F.floor(F.col("i") / fanout).alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "hash", "item"))).alias("nodes"))
        run = run.withColumn("hash", F.sha2(F.array_join("nodes.hash", ""), 256))
        runs.append(written(run.select("g", "p", F.ceil(F.col("n") / fanout).alias("n"), "nodes", "hash"), f"op12-level{level}"))
        now = runs[-1].select("g", F.col("p").alias("i"), "n", "hash", F.lit(None).cast(item).alias("item"))
        most, level = -(-most // fanout), level + 1


def descend(tree: Tree, tops: DataFrame, carried: list[str]) -> DataFrame:
    """For each leaf of tree: its hash and item, path, and the carried columns of its top. path is, from the leaf up to the
    end of the top's own path, the siblings before and after the node at each level. tops are those of the tree with
    path and the carried columns."""
    tops = tops.select("g", "level", "hash", "item", "path", *carried)
    above = None
    for level in reversed(range(len(tree.runs) + 1)):
        here = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("i"), "hash", "item", "path", *carried)
        if above is not None:
            run = tree.runs[level].select("g", F.col("p").alias("i"), "nodes")
            met = run.join(above.select("g", "i", "path", *carried), ["g", "i"])
            each = met.select("g", F.posexplode("nodes").alias("at", "node"), F.col("nodes.hash").alias("all"), "path", *carried)
            step = F.struct(F.array_join(F.slice("all", 1, F.col("at")), "").alias("before"), F.array_join(F.slice("all", F.col("at") + 2, F.size("all")), "").alias("after"))
            here = here.union(each.select("g", "node.i", "node.hash", "node.item", F.concat(F.array(step), "path"), *carried))
        above = here
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs (FIELDS; other columns are not read): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    leaf hashes a row's fields, each behind its length (null: -). The leaves of a source ascend by doc_id (null first; rows
    of one doc_id by leaf, and rows that are wholly equal in any order, which gives the same rows); a null source is one
    of its own and comes first. Every fanout consecutive nodes become the hash of their hashes until one remains, the
    subroot; the subroots, ordered by source bytewise, likewise give root. proof_sha256 hashes all siblings on the way
    to the root. folded_root folds that way again from the row as it is now: where 5 divides crc32 of the decimal doc_id
    (a null doc_id: never) the text was lower-cased (A-Z), so verified is false there unless no letter changed. Empty
    texts have length 0 and differ from null. An empty table gives an empty result."""
    fields = {f: F.col(f) for f in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    now = F.when(tampered, leaf(fields | {"text": ascii_lower(F.col("text"))}))
    # The source behind a digit: never null, in the order of sources with null first.
    group = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("g")
    leaves = written(docs.select(group, "doc_id", leaf(fields).alias("hash"), now.alias("now"), F.monotonically_increasing_id().alias("row")), "op12-leaves")
    places = numbered(leaves, "g", "doc_id", "hash", "row")
    sources = climb(places.select("g", "i", "n", "hash", F.struct("doc_id", "now").alias("item")), fanout)
    tops = written(sources.tops.withColumn("all", F.lit("")), "op12-subroots")
    over = climb(numbered(tops.select("all", "g", "hash"), "all", "g").select(F.col("all").alias("g"), "i", "n", "hash", F.col("g").alias("item")), fanout)
    root = over.tops.withColumn("path", F.array().cast(f"array<{STEP}>")).withColumn("root", F.col("hash"))
    way = descend(over, root, ["root"]).select(F.col("item").alias("g"), "path", "root", F.col("hash").alias("subroot"))
    rows = descend(sources, tops.join(way, "g"), ["root", "subroot"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), "")
    folded = F.aggregate("path", F.coalesce("item.now", "hash"), lambda h, s: digest(s.before, h, s.after))
    out = rows.select("item.doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
