"""Connected components of a graph. Nodes are of any type that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, with_lowest, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of the component.

    Large-star and small-star rounds (Kiveris et al., 2014): each links every node to the smallest node it knows, until
    all edges are those of stars. Rounds grow with the logarithm of the longest path. Every round is a table in the
    shared folder, so a lost executor costs no more than its tasks; only a count and a checksum come to the driver."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or found[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        state = tuple(found)
        # A node of very many edges is dealt to many tasks (with_lowest).
        both = with_lowest(now.union(now.select("b", "a")), "a", "b", "m").withColumn("m", F.least("m", "a"))
        large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = with_lowest(large, "a", "b", "m")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        before, now = now, written(small.distinct(), "edges")
        discard(now.sparkSession, before.written_path)
