"""State paths as tracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators import intervals

#: States of the model in order; -1 is UNINFORMATIVE. Fixed values.
STATES = ("EU", "ND_EU", "NA", "ND_NA", "AF")
UNINFORMATIVE = "UNINFORMATIVE"


def state_name(state: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in STATES]), F.when(state >= 0, state)), F.lit(UNINFORMATIVE))


def state_id(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i))]), name)


def runs(path: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """Runs of equal states of rows (keys, win, s, e, state): keys, s, e, state."""
    order = W.partitionBy(*keys).orderBy("win")
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = path.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run", state).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run").select(*keys, "s", "e", F.col(state).alias("state"))


def split_tracts(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every change of state cuts, to and from -1 too."""
    return runs(path, keys)


def absorb_tracts(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows of state -1 go to the tract before them, at the beginning to the first one; all -1: one tract of -1."""
    order = W.partitionBy(*keys).orderBy("win")
    known = F.when(F.col("state") >= 0, F.col("state"))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    return runs(path.withColumn("state", F.coalesce(before, after, F.lit(-1))), keys)


def clean_gaps(tracts: DataFrame, gaps: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Tracts less gaps; gaps of a key that touch are one."""
    return intervals.subtract_labelled(tracts, intervals.merge(gaps, keys), keys, width)


def inclusive(tracts: DataFrame) -> DataFrame:
    """Segment rows as written: Start, inclusive End, Length, State."""
    rest = [c for c in tracts.columns if c not in ("s", "e", "state")]
    return tracts.select(*rest, F.col("s").alias("Start"), (F.col("e") - 1).alias("End"), (F.col("e") - F.col("s")).alias("Length"), state_name(F.col("state")).alias("State"))


def run_segments(rows: DataFrame, keys: Sequence[str], first: str, last: str, code: str) -> DataFrame:
    """Runs of one code in rows (keys, first, last, code), as from first of the run's first row to last of its last."""
    path = rows.select(*keys, F.col(first).alias("s"), F.col(last).alias("e"), F.col(first).alias("win"), F.col(code).alias("state"))
    return runs(path, keys)
