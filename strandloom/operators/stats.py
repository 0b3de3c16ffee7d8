"""Summaries: quantiles, histograms, tables of thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.binomial import tails
from strandloom.functions.scalars import log2_ratio, minus_log10
from strandloom.operators.shared import written

#: Levels of the calibration tables.
LEVELS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.5, 0.95, 0.975, 0.99, 0.995, 0.999)


#: Ranges of values of a group, among which its distinct values are dealt evenly, nearly; distinct values of a group up to
#: which one aggregate holds them instead.
RANGES, HELD = 64, 1 << 18


def _group(keys: Sequence[str]) -> Column:
    """Keys as one column, whose nulls are equal in joins."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))


def quantiles(df: DataFrame, value: str, levels: Sequence[float] = LEVELS, keys: Sequence[str] = (), held: int = HELD) -> DataFrame:
    """Exact, linearly interpolated: rows (keys, level, value); none for a group without values.

    Equal values are counted first, into a table, so the input is read once. Where no group has more than held distinct values, one
    aggregate takes them. Else a sketch of the distinct values cuts each group into RANGES, sums of counts tell which
    of these hold the wanted ranks, and only they are sorted: no task holds a group, and the cuts decide no result."""
    numbers = df.select(_group(keys).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    numbers = written(numbers, "quantiles")
    if (numbers.groupBy("_k").count().agg(F.max("count")).first()[0] or 0) <= held:
        rows = numbers.groupBy("_k").agg(F.percentile("_v", F.array(*[F.lit(float(x)) for x in levels]), F.col("_n")).alias("_q"))
        each = rows.select("_k", F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in levels]).alias("level"), F.col("_q").alias("value"))).alias("x"))
        return each.select(*[F.col("_k")[k].alias(k) for k in keys], "x.level", "x.value")
    cuts = numbers.groupBy("_k").agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"), F.sum("_n").alias("_all"))
    dealt = numbers.join(cuts, "_k").select("_k", "_v", "_n", "_all", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    sums = dealt.groupBy("_k", "_range").agg(F.sum("_n").alias("_m"), F.first("_all").alias("_all"))
    sums = sums.withColumn("_before", F.sum("_m").over(W.partitionBy("_k").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_m"))
    at = sums.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("_at", (F.col("_all") - 1) * F.col("level"))
    ranks = at.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where("_rank >= _before AND _rank < _before + _m")
    wanted = ranks.groupBy("_k", "_range", "_before").agg(F.collect_list(F.struct("level", "_at", "_rank")).alias("_wanted"))
    run = W.partitionBy("_k", "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = dealt.join(wanted, ["_k", "_range"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(run))
    hit = F.filter("_wanted", lambda x: (x["_rank"] >= F.col("_upto") - F.col("_n")) & (x["_rank"] < F.col("_upto")))
    found = near.select("_k", "_v", F.explode(hit).alias("x")).select("_k", "_v", "x.*")
    side = lambda f: F.max(F.when(F.col("_rank") == f("_at"), F.col("_v")))
    both = found.groupBy("_k", "level", "_at").agg(side(F.floor).alias("_lo"), side(F.ceil).alias("_hi"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi")
    return both.select(*[F.col("_k")[k].alias(k) for k in keys], "level", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("value"))


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    c = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    wide = quantiles(df, value, list(names), keys).groupBy(_group(keys).alias("_k")).agg(*[F.max(F.when(F.col("level") == x, F.col("value"))).alias(n) for x, n in names.items()])
    return plain.withColumn("_k", _group(keys)).join(wide, "_k", "left").select(*keys, "count", "mean", "std", "min", *names.values(), "max")


def histogram(df: DataFrame, number: Column, key: str) -> DataFrame:
    """Rows by bin number, for each key and, with a null key, for all."""
    return df.withColumn("bin", number).groupingSets([[F.col(key), F.col("bin")], [F.col("bin")]], F.col(key), F.col("bin")).agg(F.count(F.lit(1)).alias("n"))


def grid_counts(df: DataFrame, edges_x: Sequence[float], edges_y: Sequence[float], x: str, y: str) -> DataFrame:
    """Windows of each cell of two binnings (last bins closed), and how many are true, predicted and both."""

    def number(c: str, edges: Sequence[float]) -> Column:
        return reduce(lambda out, i: F.when(F.col(c) >= edges[i], F.lit(i)).otherwise(out), range(1, len(edges) - 1), F.lit(0))

    return df.groupBy(number(x, edges_x).alias("x_bin"), number(y, edges_y).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("is_true").alias("n_true"), F.count_if("is_pred").alias("n_pred"), F.count_if(F.col("is_true") & F.col("is_pred")).alias("n_both")
    )


def effects(window_bp: DataFrame, width: int, least: int = 10) -> DataFrame:
    """From (CHR, win, grp, EU, ND_EU) of two groups, those windows with least * width of background in both: shares p_a
    and p_b, their difference and log2 ratio."""
    rows = window_bp.withColumn("background", F.col("EU") + F.col("ND_EU")).withColumn("p", F.coalesce(F.try_divide(F.col("ND_EU"), F.col("background")), F.lit(0.0)))
    side = lambda g: rows.where(F.col("grp") == g).select("chrom", "win", F.col("background").alias(f"background_{g}"), F.col("p").alias(f"p_{g}"))
    both = side("a").join(side("b"), ["chrom", "win"]).where(f"background_a >= {least * width} and background_b >= {least * width}")
    return both.withColumns({"effect_delta": F.col("p_a") - F.col("p_b"), "effect_log2_ratio": log2_ratio(F.col("p_a"), F.col("p_b"))})


def with_tails(df: DataFrame, k: str = "k", n: str = "n", p: str = "p") -> DataFrame:
    excess, depletion = tails(F.col(k), F.col(n), F.col(p))
    return df.withColumns({"p_excess": excess, "p_depletion": depletion})


def with_scores(df: DataFrame) -> DataFrame:
    """Scores of the tails; NaN stays NaN."""
    return df.withColumns({f"score_{x}": minus_log10(F.col(f"p_{x}")) for x in ("excess", "depletion")})


def thresholds(pvals: DataFrame, levels: Sequence[float], positive_depletion: bool = True) -> DataFrame:
    """Rows (direction, calibration, level, threshold, recommended): quantiles of both tails over all windows and over
    those whose expected share is positive."""
    best = {"excess": "all", "depletion": "positive" if positive_depletion else "all"}
    cells = [F.struct(F.lit(x).alias("direction"), F.lit(name).alias("calibration"), F.when(ok, F.col(f"p_{x}")).alias("tail")) for x in best for name, ok in (("all", F.lit(True)), ("positive", F.col("p") > 0))]
    long = pvals.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(~F.isnan("tail"))
    got = quantiles(long, "tail", levels, ["direction", "calibration"])
    recommended = reduce(Column.__or__, [(F.col("direction") == x) & (F.col("calibration") == name) for x, name in best.items()])
    return got.select("direction", "calibration", "level", F.col("value").alias("threshold"), recommended.alias("recommended"))


def selected(table: DataFrame, suggestive: float, strong: float) -> DataFrame:
    """One row for each direction: the recommended thresholds at two levels."""
    at = lambda x: F.max(F.when(F.col("recommended") & (F.col("level") == x), F.col("threshold")))
    return table.groupBy("direction").agg(at(suggestive).alias("suggestive"), at(strong).alias("strong"))


def flag(windows: DataFrame, chosen: DataFrame, least: int = 0, mask: str | None = None) -> DataFrame:
    """windows with flags for p below the chosen thresholds, where mask holds and n is least or more; depletion only where
    p > 0. chosen has a row for each of two directions."""
    wide = chosen.groupBy().pivot("direction", ["excess", "depletion"]).agg(F.first("suggestive").alias("suggestive"), F.first("strong").alias("strong"))
    ok = F.col("n") >= least
    if mask:
        ok = ok & F.col(mask)
    cols = {f"{d}_{s}": F.coalesce(ok & (F.col(f"p_{d}") < F.col(f"{d}_{s}_t")) & ((F.col("p") > 0) if d == "depletion" else F.lit(True)), F.lit(False)) for d in ("excess", "depletion") for s in ("suggestive", "strong")}
    limits = wide.select(*[F.col(c).alias(f"{c}_t") for c in wide.columns])
    return windows.crossJoin(F.broadcast(limits)).withColumns(cols).drop(*limits.columns)


def flag_summary(flagged: DataFrame) -> DataFrame:
    names = [f"{d}_{s}" for d in ("excess", "depletion") for s in ("suggestive", "strong")]
    return flagged.agg(F.count(F.lit(1)).alias("windows"), *[F.count_if(c).alias(c) for c in names])


def mean_std(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))])


def pivot_table(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
