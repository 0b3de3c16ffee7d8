"""Algebra of half-open integer intervals: rows (keys, s, e).

Everything is a window or an equi-join on the keys, so plans stay inside code generation. Overlaps are joined by bins:
an interval is listed in each bin that it touches and a pair counts in the bin where its overlap begins, so no pair comes
twice and no two lists are crossed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clip(df: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    """Intervals cut to [lo, hi); what is empty goes."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumns({"s": F.greatest("s", lit(lo)), "e": F.least("e", lit(hi))}).where("s < e")


#: Units of a stretch. Work on one key is dealt out by stretches and joined where islands touch their edges, so no task
#: holds a whole chromosome; an interval is listed once for each stretch that it touches.
STRETCH = 1 << 20


def _cut(df: DataFrame, keys: Sequence[str], stretch: int) -> DataFrame:
    """Intervals cut at the edges of stretches, with the number of the stretch as _bin; empty ones go."""
    number = lambda x: f"({x} - pmod({x}, {stretch}L)) div {stretch}L"
    rows = df.where("s < e").select(*keys, "s", "e").withColumn("_bin", F.explode(F.expr(f"sequence({number('s')}, {number('(e - 1)')})")))
    kind = {c: rows.schema[c].dataType for c in ("s", "e")}
    return rows.withColumns({"s": F.greatest("s", F.col("_bin") * stretch).cast(kind["s"]), "e": F.least("e", (F.col("_bin") + 1) * stretch).cast(kind["e"])})


def _islands(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """keys, s and e of each island, and its number among those of its keys as _island."""
    order = W.partitionBy(*keys).orderBy("s", "e")
    top = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col("s") <= top + gap, 0).otherwise(1))
    marked = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def _joined(cut: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Islands of cut intervals: within each stretch, then the first and the last of all stretches of a key with each other.
    What lies between these two is an island of its own and stays with its stretch."""
    within = _islands(cut, [*keys, "_bin"], gap)
    last = F.max("_island").over(W.partitionBy(*keys, "_bin"))
    edge = (F.col("_island") == 1) | (F.col("_island") == F.col("_last"))
    dealt = within.withColumn("_last", last).withColumn("_bin", F.when(~edge, F.col("_bin"))).select(*keys, "_bin", "s", "e")
    return _islands(dealt, [*keys, "_bin"], gap).select(*keys, "s", "e")


def merge(df: DataFrame, keys: Sequence[str], gap: int = 0, stretch: int = STRETCH) -> DataFrame:
    """Union of each key's intervals as disjoint ones; those at most gap apart become one, empty ones go. Of those that begin
    at one place only the longest is moved, so copies are dropped before the shuffle."""
    return _joined(_cut(df, keys, stretch).groupBy(*keys, "_bin", "s").agg(F.max("e").alias("e")), keys, gap)


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of a and b that share key and overlap: keys, s and e of the overlap, and the other columns of both, those of
    b with _b behind names that a has too. width: of the bins, about that of the intervals."""
    binned = lambda x: x.where("s < e").withColumn("_bin", F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")))
    right = b
    for c in b.columns:
        if c not in keys and c in a.columns:
            right = right.withColumnRenamed(c, f"{c}_b") if c not in ("s", "e") else right
    left, right = binned(a).withColumnRenamed("s", "_as").withColumnRenamed("e", "_ae"), binned(right).withColumnRenamed("s", "_bs").withColumnRenamed("e", "_be")
    pairs = left.join(right, [*keys, "_bin"]).where("_as < _be and _bs < _ae")
    pairs = pairs.where(F.expr(f"greatest(_as, _bs) div {width} = _bin"))
    return pairs.withColumns({"s": F.greatest("_as", "_bs"), "e": F.least("_ae", "_be")}).drop("_bin", "_as", "_ae", "_bs", "_be")


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Intersection of two lists of disjoint intervals."""
    return overlaps(a.select(*keys, "s", "e"), b.select(*keys, "s", "e"), keys, width).select(*keys, "s", "e")


def sweep(lists: Sequence[DataFrame], keys: Sequence[str], wanted: Column, labels: dict[str, Column] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Maximal stretches where wanted holds, a condition on d0, d1, ... : how many intervals of each list cover a place; it
    may hold only where some list covers. labels are further columns of such conditions, and places of unlike labels stay
    apart. One pass over ends and beginnings for any number of lists; an end counts before a beginning at the same place."""
    ends = []
    for i, x in enumerate(lists):
        steps = _cut(x, keys, stretch).select(*keys, "_bin", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
        ends.append(steps.select(*keys, "_bin", F.col("x.at").alias("at"), *[(F.col("x.d") if i == j else F.lit(0)).alias(f"_{j}") for j in range(len(lists))]))
    by = [*keys, "_bin"]
    steps = reduce(DataFrame.unionByName, ends).groupBy(*by, "at").agg(*[F.sum(f"_{j}").alias(f"_{j}") for j in range(len(lists))])
    order = W.partitionBy(*by).orderBy("at")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    deep = steps.select(*by, F.col("at").alias("s"), F.lead("at").over(order).alias("e"), *[F.sum(f"_{j}").over(run).alias(f"d{j}") for j in range(len(lists))])
    return _joined(deep.where(wanted & F.col("e").isNotNull()).withColumns(labels or {}).select(*by, *(labels or {}), "s", "e"), [*keys, *(labels or {})], 0)


def intersect_many(lists: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return sweep(lists, keys, reduce(Column.__and__, [F.col(f"d{i}") > 0 for i in range(len(lists))]))


def union_many(lists: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return merge(reduce(DataFrame.unionByName, [x.select(*keys, "s", "e") for x in lists]), keys)


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sweep([a, b], keys, (F.col("d0") > 0) & (F.col("d1") == 0))


def intersect_and_subtract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a cut by b: rows with inside true for what both have, false for the rest of a."""
    return sweep([a, b], keys, F.col("d0") > 0, {"inside": F.col("d1") > 0}).select(*keys, "s", "e", "inside")


def subtract_labelled(tracts: DataFrame, cuts: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Labelled, possibly overlapping tracts less disjoint cuts. Each tract keeps its other columns; its pieces lie between
    the cuts that it meets."""
    # Equal tracts are one row with their number, so rows need no id, and tracts are evaluated once.
    rows = tracts.where("s < e").groupBy(*tracts.columns).agg(F.count(F.lit(1)).alias("_n"))
    bins = lambda s, e, name: F.explode(F.expr(f"sequence({s} div {width}, ({e} - 1) div {width})")).alias(name)
    left = rows.select("*", bins("s", "e", "_bin"))
    # The cuts of a bin are one value, so a tract meets a row for each of its bins and not one for each cut.
    right = cuts.where("s < e").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct("s", "e").alias("_cut"), bins("s", "e", "_cut_bin"))
    right = right.groupBy(*[f"_k{i}" for i in range(len(keys))], "_cut_bin").agg(F.collect_list("_cut").alias("_cuts"))
    on = reduce(Column.__and__, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin") == F.col("_cut_bin"))
    meets = f"filter(_cuts, _c -> s < _c.e AND _c.s < e AND greatest(s, _c.s) div {width} = _bin)"
    holes = F.expr(f"transform({meets}, _c -> named_struct('s', greatest(s, _c.s), 'e', least(e, _c.e)))")
    found = left.join(right, on, "left").groupBy(*tracts.columns, "_n").agg(F.sort_array(F.flatten(F.collect_list(holes))).alias("_holes"))
    begins, stops = F.concat(F.array("s"), F.col("_holes.e")), F.concat(F.col("_holes.s"), F.array("e"))
    pieces = found.withColumn("_p", F.explode(F.arrays_zip(begins.alias("s"), stops.alias("e"))))
    pieces = pieces.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    names = [c for c in tracts.columns if c not in ("s", "e")]
    return pieces.select(*names, F.col("_p.s").alias("s"), F.col("_p.e").alias("e")).where("s < e")


def make_windows(lengths: DataFrame, width: int, last: bool = True) -> DataFrame:
    """Windows of each row (keys, length): win, s, e. With last a shorter window ends the row, else it is left out."""
    n = f"(length + {width - 1}) div {width}" if last else f"length div {width}"
    rows = lengths.where(F.expr(f"{n} > 0")).withColumn("win", F.explode(F.expr(f"sequence(cast(0 as bigint), {n} - 1)")))
    return rows.withColumns({"s": F.col("win") * width, "e": F.least(F.col("win") * width + width, F.col("length"))}).drop("length")


def window_bp(df: DataFrame, keys: Sequence[str], width: int, value: Column | None = None, name: str = "bp") -> DataFrame:
    """Covered units of each (keys, win) that intervals touch; value weighs them."""
    rows = df.where("s < e").withColumn("win", F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")))
    bp = F.least(F.col("e"), (F.col("win") + 1) * width) - F.greatest(F.col("s"), F.col("win") * width)
    return rows.groupBy(*keys, "win").agg(F.sum(bp if value is None else bp * value).alias(name))


def coverage(df: DataFrame, lengths: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """(keys, win, s, e, frac) for all windows of lengths (keys, length); frac of disjoint intervals, 0 without any."""
    got = window_bp(df, keys, width)
    wins = make_windows(lengths, width)
    return wins.join(got, [*keys, "win"], "left").select(
        *keys, "win", "s", "e", (F.coalesce("bp", F.lit(0)) / F.greatest(F.lit(1), F.col("e") - F.col("s"))).alias("frac")
    )


def windows_above(windows: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Merged windows whose frac is over least."""
    return merge(windows.where(F.col("frac") > least).select(*keys, "s", "e"), keys)


def points_in(points: DataFrame, df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Rows of points (keys, pos) that lie in an interval."""
    bins = df.where("s < e").select(*keys, F.col("s").alias("_s"), F.col("e").alias("_e"), F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")).alias("_bin"))
    left = points.withColumn("_bin", F.expr(f"pos div {width}"))
    on = reduce(Column.__and__, [left[k] == bins[k] for k in [*keys, "_bin"]]) & (left["pos"] >= bins["_s"]) & (left["pos"] < bins["_e"])
    return left.join(bins, on, "left_semi").drop("_bin")


def total_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("bp"))


def effective(windows: DataFrame, part: str = "l_anc", whole: str = "l_mod", name: str = "u") -> DataFrame:
    """part / whole, 0 where whole is 0."""
    return windows.withColumn(name, F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)))


def regime(modern: DataFrame, masks: Sequence[DataFrame], gaps: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Evaluable space: modern less gaps, and of the masks none, the first, their union or their intersection."""
    base = subtract(modern, gaps, keys)
    if mode == "none":
        return base
    mask = {"single": lambda: masks[0], "union": lambda: union_many(masks, keys), "intersection": lambda: intersect_many(masks, keys)}[mode]()
    return intersect_many([base, mask], keys)
