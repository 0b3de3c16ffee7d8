"""True tracts from a recorded genealogy: tables of edges, nodes and migrations along a sequence.

The lineages of all samples are walked together, from child to parent, as rows (sample, node, s, e) that meet the edges of
their node by overlap. What a lineage passed between is known by interval, so one walk serves any number of migrations. Each
step is a table in the shared folder; rows of one sample that reach one node in touching intervals are merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import intervals
from strandloom.operators.shared import written

EPS = 1e-5


def migrant_tracts(
    samples: DataFrame, edges: DataFrame, nodes: DataFrame, migrations: DataFrame, targets: Sequence[tuple[str, object, float]], length: int, width: int | None = None, eps: float = EPS
) -> DataFrame:
    """(sample, label, s, e): where the lineage of a sample (sample, node) lay on a node when that migrated to dest at a time, for each
    target (label, dest, time), merged. edges: (child, parent, s, e); nodes: (node, time); migrations: (node, dest, time, s, e).

    A lineage is followed from node to node as long as it has an edge there, up to the first node that is as old as the target; that node
    counts. Samples older than the target have no tracts. width: of the bins in which overlaps are joined."""
    width = width or max(1, length // 16)
    last = max(t for *_, t in targets)
    marks = reduce(DataFrame.unionByName, [migrations.where((F.col("dest") == d) & F.col("time").between(t - eps, t + eps)).select("node", F.lit(label).alias("label"), F.lit(float(t)).alias("at"), "s", "e") for label, d, t in targets])
    known = edges.select(F.col("child").alias("node"), "parent", "s", "e").join(nodes.select("node", "time"), "node")
    born = samples.join(nodes, "node").where(F.col("time") <= last + eps)
    front = born.select("sample", "node", F.col("time").alias("born"), F.lit(float("-inf")).alias("before"), F.lit(0).cast("long").alias("s"), F.lit(length).cast("long").alias("e"))
    hits = []
    while True:
        moved = written(intervals.overlaps(front, known, ["node"], width), "lineages")
        if moved.isEmpty():
            break
        hits.append(intervals.overlaps(moved, marks, ["node"], width).where((F.col("before") < F.col("at") - eps) & (F.col("born") <= F.col("at") + eps)).select("sample", "label", "s", "e"))
        up = moved.where(F.col("time") < last - eps).select("sample", F.col("parent").alias("node"), "born", F.col("time").alias("before"), "s", "e")
        front = intervals.merge(up, ["sample", "node", "born", "before"])
    if not hits:
        return samples.select("sample").limit(0).selectExpr("sample", "'' AS label", "0L AS s", "0L AS e")
    return intervals.merge(reduce(DataFrame.unionByName, hits), ["sample", "label"])


def five_states(tracts: DataFrame, eu: str = "EU", na: str = "NA", af: str = "AF", nd: str = "ND") -> DataFrame:
    """(sample, s, e, state) of migrant_tracts: ancestry EU and NA, archaic where the ND tracts of the sample lie over it, and AF."""
    of = lambda label: tracts.where(F.col("label") == label).select("sample", "s", "e")
    parts = []
    for label in (eu, na):
        cut = intervals.intersect_and_subtract(of(label), of(nd), ["sample"])
        parts.append(cut.select("sample", "s", "e", F.when(F.col("inside"), F.lit(f"ND_{label}")).otherwise(F.lit(label)).alias("state")))
    return reduce(DataFrame.unionByName, [*parts, of(af).withColumn("state", F.lit("AF"))])
