"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, written

#: Weights of the sources in the order of their names, repeating; share of all words to take; most times a source is taken.
WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2
#: Rows that a task sorts at once, about, and the fewest buckets.
ROWS_A_BUCKET, BUCKETS = 20_000, 512


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> dict:
    """Words to take of each source. sizes: words of each source, in the order that the weights follow. The total is
    share of all words; a source stops at repeats times its words, and what it leaves goes to the others by weight."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    left, open_, out = share * sum(sizes.values()), dict(sizes), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if weight[s] * unit > repeats * n]
        if not full:
            return {s: out[s] if s in out else weight[s] * unit for s in sizes}
        for s in full:
            out[s] = float(repeats * open_.pop(s))
            left -= out[s]
    return {s: out[s] for s in sizes}


def mixing_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, text_hash.

    size counts the words of the text (null: 0). Each source is shuffled by a seeded hash; a document of it gets the
    virtual finish time (words of its source up to and with it) / target, and its next copy that time plus source
    words / target. Of all copies in the order of finish time, those stay that fit in the total budget. So reruns give
    the same rows, every source comes within a document of its target, and no document is taken more than repeats
    times. Null sources count as one source, the last; empty texts have size 0 and are taken 0 words. Rows that repeat
    doc_id and text follow each other in an order that their equality makes irrelevant. An empty table gives no rows.

    Running sums are made in two steps, sums of buckets first and then within each bucket, so no task sorts a source.
    Only the sums by source, a row for each, come to the driver."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), "text"))
    sizes = written(
        docs.select("doc_id", "source", n.alias("size"), F.xxhash64("text").alias("text_hash"), digest.alias("digest")).withColumn(
            "u", F.conv(F.substring(F.col("digest"), 1, 15), 16, 10).cast("long")
        ).drop("digest"),
        "op5-sizes",
    )
    sums = sizes.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    spark = docs.sparkSession
    total = sum(r.s for r in sums)
    goal = targets({r.source: r.s for r in sums}, weights, share, repeats) if total else {r.source: 0.0 for r in sums}
    budget = int(sum(goal.values()) + 1e-6)
    buckets = max(BUCKETS, sum(r.n for r in sums) // ROWS_A_BUCKET)
    table = spark.createDataFrame(
        [(r.source, r.s, float(goal[r.source])) for r in sums], "source string, source_size long, target double"
    )
    bucketed = sizes.withColumn("b", F.expr(f"u div {(1 << 60) // buckets + 1}"))
    own = W.partitionBy("source").orderBy("b")
    before = (
        bucketed.groupBy("source", "b")
        .agg(F.sum("size").alias("in_b"))
        .select("source", "b", (F.sum("in_b").over(own) - F.col("in_b")).alias("before"))
    )
    inner = W.partitionBy("source", "b").orderBy("u", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    cum = bucketed.withColumn("within", F.sum("size").over(inner))
    cum = cum.join(before.withColumnRenamed("source", "s2").withColumnRenamed("b", "b2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
    table = table.withColumnRenamed("source", "s3")
    table = F.broadcast(table) if len(sums) <= 10_000 else table
    cum = cum.join(table, F.col("source").eqNullSafe(F.col("s3")))
    safe = F.when(F.col("target") > 0, F.col("target"))
    timed = written(
        cum.select(
            "doc_id", "source", "size", "source_size", "target", "text_hash", "u",
            *[((F.col("before") + F.col("within") + F.lit(e) * F.col("source_size")) / safe).alias(f"v{e}") for e in range(repeats)],
        ),
        "op5-times",
    )
    cut = cutoff(timed, budget, buckets, repeats)
    fits = [fit(F.col(f"v{e}"), cut).cast("int") for e in range(repeats)] if cut else []
    copies = sum(fits[1:], fits[0]) if cut else F.lit(0)
    return timed.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), "text_hash"
    ).withColumn("taken", F.col("size") * F.col("copies"))


def fit(v, cut: tuple):
    """Whether the copy with finish time v comes no later than cut."""
    d, (v0, u0, d0) = F.coalesce("doc_id", F.lit(-1)), (F.lit(cut[0]), F.lit(cut[1]).cast("long"), F.lit(cut[2]).cast("long"))
    return F.coalesce((v < v0) | ((v == v0) & ((F.col("u") < u0) | ((F.col("u") == u0) & (d <= d0)))), F.lit(False))


def cutoff(timed: DataFrame, budget: int, buckets: int, repeats: int) -> tuple | None:
    """The last copy (finish time, hash, doc_id) in the order of finish times that fits in budget. Finish times are
    spread evenly by construction, so equal steps of time are the ranges of the global sort; only the step in which the
    budget ends has to be looked at row by row."""
    entry = timed.where("size > 0 and target > 0").select(
        F.col("size"), F.col("u"), F.coalesce("doc_id", F.lit(-1)).alias("d"), F.explode(F.array(*[f"v{e}" for e in range(repeats)])).alias("v")
    )
    entry = entry.withColumn("step", F.least(F.floor(F.col("v") * buckets), F.lit(buckets * (repeats + 1))))
    steps = entry.groupBy("step").agg(F.sum("size").alias("n"))
    ran = steps.select("step", "n", F.sum("n").over(W.orderBy("step")).alias("upto"))
    edge = ran.where(F.col("upto") > F.lit(budget)).orderBy("step").first()
    if edge is None:
        last = entry.agg(F.max(F.struct("v", "u", "d")).alias("x")).first().x
        return tuple(last) if last else None
    inside = entry.where(F.col("step") == edge.step).withColumn(
        "upto", F.sum("size").over(W.orderBy("v", "u", "d").rowsBetween(W.unboundedPreceding, 0)) + F.lit(edge.upto - edge.n)
    )
    last = inside.where(F.col("upto") <= budget).agg(F.max(F.struct("v", "u", "d")).alias("x")).first().x
    if last is None:
        last = entry.where(F.col("step") < edge.step).agg(F.max(F.struct("v", "u", "d")).alias("x")).first().x
    return tuple(last) if last else None


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as many times as its copies, with its own columns. Rows that repeat doc_id,
    text and source are numbered, and each gets the copies of one row of the plan."""
    # Keys without nulls, so that numbering and join need one exchange of the texts.
    keys = {"_id": F.coalesce("doc_id", F.lit(0)), "_no_id": F.col("doc_id").isNull(), "_source": F.coalesce("source", F.lit("")), "_no_source": F.col("source").isNull()}
    named = [c.alias(k) for k, c in keys.items()]
    same = [*keys, "_th"]
    plan = mixing_plan(docs, **options).select(*named, F.col("text_hash").alias("_th"), "copies").groupBy(*same).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("all")).where("all[0] > 0")
    rows = docs.select(F.struct("*").alias("row"), *named, F.xxhash64("text").alias("_th"))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*same).orderBy(F.xxhash64("row"))))
    taken = rows.join(plan, same).select("row", F.get("all", F.col("_n") - 1).alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
