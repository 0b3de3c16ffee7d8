"""Scoring of predicted tracts against true ones by common length."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.scalars import length_bin, ratio
from strandloom.operators import intervals

#: Archaic states; fixed values.
ARCHAIC = ("ND_EU", "ND_NA")
#: Where bins of tract lengths begin; fixed values.
LENGTH_EDGES = (0, 10_000, 20_000, 25_000, 30_000, 40_000, 50_000, 70_000, 100_000)


def half_open(tracts: DataFrame, end_inclusive: bool) -> DataFrame:
    return tracts.withColumn("e", F.col("e") + 1) if end_inclusive else tracts


def confusion(truth: DataFrame, pred: DataFrame, keys: Sequence[str], width: int, mask: DataFrame | None = None, mask_keys: Sequence[str] | None = None) -> DataFrame:
    """(truth_state, pred_state, bp) over keys that both have, from rows (keys, s, e, state); with mask (mask_keys, s, e;
    disjoint), within its intervals alone. A mask by chromosome is not copied for each haplotype: the common stretches
    meet it on its own keys."""
    both = intervals.overlaps(truth.select(*keys, "s", "e", F.col("state").alias("truth_state")), pred.select(*keys, "s", "e", F.col("state").alias("pred_state")), keys, width)
    if mask is not None:
        by = list(mask_keys or keys)
        both = intervals.overlaps(both, mask.select(*by, "s", "e"), by, width)
    return both.groupBy("truth_state", "pred_state").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def pooled(truth: DataFrame, pred: DataFrame, keys: Sequence[str], width: int, run: str) -> DataFrame:
    """(run, truth_state, pred_state, bp) for each value of the key run, and with a null run for all of them together."""
    both = intervals.overlaps(truth.select(*keys, "s", "e", F.col("state").alias("truth_state")), pred.select(*keys, "s", "e", F.col("state").alias("pred_state")), keys, width)
    states = [F.col("truth_state"), F.col("pred_state")]
    return both.groupingSets([[F.col(run), *states], states], F.col(run), *states).agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def report(conf: DataFrame, states: Sequence[str], run: str | None = None) -> DataFrame:
    """For each state: precision, recall, f1 (NaN where undefined), support_bp, and accuracy and total_bp of all; with run, a
    column of conf, for each of its values."""
    spark = conf.sparkSession
    by = [run] if run else []
    base = spark.createDataFrame([(s,) for s in states], "state string")
    base = conf.select(run).distinct().crossJoin(F.broadcast(base)) if run else base
    roles = F.array(F.struct(F.col("truth_state").alias("state"), F.lit(1).alias("t")), F.struct(F.col("pred_state").alias("state"), F.lit(0).alias("t")))
    long = conf.select(*by, F.explode(roles).alias("x"), (F.col("truth_state") == F.col("pred_state")).alias("hit"), "bp")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("bp"))), F.lit(0))
    sums = long.groupBy(*by, "x.state").agg(part(F.col("hit") & (F.col("x.t") == 1)).alias("tp"), part(F.col("x.t") == 1).alias("support_bp"), part(F.col("x.t") == 0).alias("pred_bp"))
    total = conf.groupBy(*by).agg(F.sum("bp").alias("total_bp"), part(F.col("truth_state") == F.col("pred_state")).alias("right_bp"))
    rows = base.join(sums, [*by, "state"], "left").fillna(0, ["tp", "support_bp", "pred_bp"])
    rows = rows.join(total, run) if run else rows.crossJoin(F.broadcast(total))
    nan = float("nan")
    p, r = ratio(F.col("tp"), F.col("pred_bp"), nan), ratio(F.col("tp"), F.col("support_bp"), nan)
    return rows.select(*by, "state", p.alias("precision"), r.alias("recall"), f1(p, r, nan).alias("f1"), "support_bp", ratio(F.col("right_bp"), F.col("total_bp"), nan).alias("accuracy"), F.coalesce("total_bp", F.lit(0)).alias("total_bp"))


def f1(p: Column, r: Column, empty: float) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(empty))


def normalise_rows(conf: DataFrame) -> DataFrame:
    """conf with share, the part of the true state's length; 0 for a state without any."""
    whole = conf.groupBy("truth_state").agg(F.sum("bp").alias("whole"))
    return conf.join(whole, "truth_state").select("truth_state", "pred_state", "bp", ratio(F.col("bp"), F.col("whole")).alias("share"))


def collapse(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion of archaic and other: (by, truth_archaic, pred_archaic, bp)."""
    return conf.groupBy(*by, F.col("truth_state").isin(*ARCHAIC).alias("truth_archaic"), F.col("pred_state").isin(*ARCHAIC).alias("pred_archaic")).agg(F.sum("bp").alias("bp"))


def binary(conf2: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each value of by): tp, fp, fn, tn, precision, recall, f1, 0 where undefined."""
    cell = lambda t, p: F.coalesce(F.sum(F.when((F.col("truth_archaic") == t) & (F.col("pred_archaic") == p), F.col("bp"))), F.lit(0))
    sums = conf2.groupBy(*by).agg(cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": p, "recall": r, "f1": f1(p, r, 0.0)})


def by_length(truth: DataFrame, pred: DataFrame, keys: Sequence[str], width: int, edges: Sequence[int] = LENGTH_EDGES) -> DataFrame:
    """(bin, truth_state, pred_state, bp): confusion by the length of the whole true tract. A bin goes from its edge to below
    the next, the last is open, tracts below the first edge are left out. One overlap join serves all bins, and with the run
    among the keys sums are those of all runs."""
    if not edges or any(a >= b for a, b in itertools.pairwise(edges)):
        raise ValueError(f"edges of lengths have to ascend: {list(edges)}")
    binned = truth.select(*keys, "s", "e", F.col("state").alias("truth_state"), length_bin(F.col("e") - F.col("s"), list(edges)).alias("bin")).where("bin is not null")
    both = intervals.overlaps(binned, pred.select(*keys, "s", "e", F.col("state").alias("pred_state")), keys, width)
    return both.groupBy("bin", "truth_state", "pred_state").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def _bins(conf: DataFrame, edges: Sequence[int]) -> DataFrame:
    """(bin, bin_start, bin_end) for each bin, a fixed few rows; the last has no end."""
    ends = [*map(int, edges[1:]), None]
    return conf.sparkSession.createDataFrame([(i, int(a), b) for i, (a, b) in enumerate(zip(edges, ends, strict=True))], "bin int, bin_start long, bin_end long")


def length_scores(conf: DataFrame, edges: Sequence[int] = LENGTH_EDGES) -> DataFrame:
    """For each bin of by_length()'s conf: bin, bin_start, bin_end, and binary() of archaic against other; zeros for a bin
    without common length."""
    return _bins(conf, edges).join(binary(collapse(conf, ["bin"]), ["bin"]), "bin", "left").fillna(0, ["tp", "fp", "fn", "tn", "precision", "recall", "f1"])


def length_shares(conf: DataFrame, states: Sequence[str], edges: Sequence[int] = LENGTH_EDGES) -> DataFrame:
    """The whole matrix of each bin, as it is drawn: bin, bin_start, bin_end, truth_state, pred_state, bp, and share, the part of
    the true state's length in the bin. Pairs without common length have 0; other states than those given have no cell."""
    one = conf.sparkSession.createDataFrame([(t, p) for t in states for p in states], "truth_state string, pred_state string")
    cells = _bins(conf, edges).crossJoin(F.broadcast(one)).join(conf, ["bin", "truth_state", "pred_state"], "left").fillna(0, ["bp"])
    whole = F.sum("bp").over(W.partitionBy("bin", "truth_state"))
    return cells.select("bin", "bin_start", "bin_end", "truth_state", "pred_state", "bp", ratio(F.col("bp"), whole).alias("share"))


def interval_metrics(truth: DataFrame, pred: DataFrame, keys: Sequence[str], length: int, width: int) -> DataFrame:
    """Archaic and Modern views of merged intervals over all keys that either has, each length long: precision, recall
    and f1, rounded to 4 digits, 0 where undefined."""
    t, p = intervals.merge(truth, keys), intervals.merge(pred, keys)
    sums = [
        intervals.intersect(t, p, keys, width).agg(F.sum(F.col("e") - F.col("s")).alias("both")),
        t.agg(F.sum(F.col("e") - F.col("s")).alias("t")),
        p.agg(F.sum(F.col("e") - F.col("s")).alias("p")),
        t.select(*keys).union(p.select(*keys)).distinct().agg(F.count(F.lit(1)).alias("n")),
    ]
    one = sums[0].crossJoin(sums[1]).crossJoin(sums[2]).crossJoin(sums[3]).fillna(0)
    one = one.select(F.col("both").alias("tp"), (F.col("p") - F.col("both")).alias("fp"), (F.col("t") - F.col("both")).alias("fn"), (F.col("n") * length - F.col("t") - F.col("p") + F.col("both")).alias("tn"))
    views = one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(x).alias("tp"), F.col(y).alias("fp"), F.col(z).alias("fn"), F.col(w).alias("tn")) for v, x, y, z, w in (("Archaic", "tp", "fp", "fn", "tn"), ("Modern", "tn", "fn", "fp", "tp"))])).alias("x")).select("x.*")
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return views.select("view", "tp", "fp", "fn", "tn", F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(f1(prec, rec, 0.0), 4).alias("f1"))


#: Length of the cells in which a key's rows are swept.
CELL = 1 << 20


def best_scores(pred: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """(keys, s, e, score): disjoint stretches that rows (keys, s, e, score) cover, with the greatest score of those over
    each. Rows are cut at multiples of cell, and each cell is one sweep over its rows in order that holds what is open."""
    cut = pred.where("s < e and score is not null").withColumn("_cell", F.explode(F.expr(f"sequence(s div {cell}, (e - 1) div {cell})")))
    at = [*keys, "_cell"]
    cut = cut.select(*at, F.greatest("s", F.col("_cell") * cell).cast("long").alias("s"), F.least("e", (F.col("_cell") + 1) * cell).cast("long").alias("e"), F.col("score").cast("double").alias("score"))

    def swept(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, same in itertools.groupby(rows, lambda r: r[:-3]):
            held, x, last = [], None, None
            for *_, s, e, score in itertools.chain(same, [(None, None, None)]):
                while held and (s is None or x < s):
                    if held[0][1] <= x:
                        heapq.heappop(held)
                        continue
                    to = held[0][1] if s is None else min(held[0][1], s)
                    if last and last[1] == x and last[2] == -held[0][0]:
                        last = (last[0], to, last[2])
                    else:
                        if last:
                            yield (*key[:-1], *last)
                        last = (x, to, -held[0][0])
                    x = to
                if s is not None:
                    x = s
                    heapq.heappush(held, (-score, e))
            if last:
                yield (*key[:-1], *last)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = swept(r for b in batches for r in zip(*(b[c].tolist() for c in b.columns)))
        while chunk := list(itertools.islice(rows, 10_000)):
            yield pd.DataFrame(chunk, columns=[*keys, "s", "e", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in pred.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "s long, e long, score double"])
    return cut.repartition(*at).sortWithinPartitions(*at, "s").mapInPandas(run, schema)


def threshold_sweep(truth: DataFrame, pred: DataFrame, keys: Sequence[str], width: int, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: tp, fp, fn (length), precision, recall, f1 (0 where undefined) and segments of the rows of pred
    (keys, s, e, score) that have so much at least, merged, against truth (keys, s, e), merged. One pass for any number of
    thresholds: a stretch counts for all up to its best score, so sums by the highest threshold that it reaches are
    cumulated over the table of thresholds."""
    levels = sorted({float(t) for t in thresholds})
    spark = pred.sparkSession
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: t <= F.col("score")))
    best = best_scores(pred, keys)
    common = intervals.overlaps(best, intervals.merge(truth, keys), keys, width)
    length = F.col("e") - F.col("s")
    parts = best.select(reached.alias("level"), length.alias("p"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("n"))
    parts = parts.union(common.select(reached, F.lit(0).cast("long"), length, F.lit(0))).union(pred.where("s < e").select(reached, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1)))
    sums = parts.where("level > 0").groupBy("level").agg(F.sum("p").alias("p"), F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    table = spark.createDataFrame(list(enumerate(levels, 1)), "level int, threshold double").join(sums, "level", "left").fillna(0)
    from_top = W.orderBy(F.desc("level"))  # a row for each threshold
    total = intervals.merge(truth, keys).agg(F.coalesce(F.sum(length), F.lit(0)).alias("t"))
    rows = table.select("threshold", *[F.sum(c).over(from_top).alias(c) for c in ("p", "tp", "n")]).crossJoin(F.broadcast(total))
    precision, recall = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("t"))
    return rows.select("threshold", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall, 0.0).alias("f1"), F.col("n").alias("segments"))


def filter_grid(truth: DataFrame, pred: DataFrame, windows: DataFrame, keys: Sequence[str], width: int, l_mod: Sequence[float], union: Sequence[float], window_keys: Sequence[str]) -> DataFrame:
    """(l_thr, u_thr, truth_state, pred_state, bp) within windows (window_keys, s, e, l_mod, u) with l_mod > l_thr and
    u >= u_thr, for each pair of thresholds. Overlaps are joined once; the grid, of a fixed few rows, meets windows."""
    grid = windows.sparkSession.createDataFrame([(float(a), float(b)) for a in l_mod for b in union], "l_thr double, u_thr double")
    kept = windows.crossJoin(F.broadcast(grid)).where("l_mod > l_thr and u >= u_thr").groupBy(*window_keys, "s", "e").agg(F.collect_list(F.struct("l_thr", "u_thr")).alias("cells"))
    both = intervals.overlaps(truth.select(*keys, "s", "e", F.col("state").alias("truth_state")), pred.select(*keys, "s", "e", F.col("state").alias("pred_state")), keys, width)
    inside = intervals.overlaps(both, kept, window_keys, width)
    return inside.select("truth_state", "pred_state", (F.col("e") - F.col("s")).alias("n"), F.explode("cells").alias("c")).groupBy("c.l_thr", "c.u_thr", "truth_state", "pred_state").agg(F.sum("n").alias("bp"))
