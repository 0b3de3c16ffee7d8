"""Scoring of files: true segments against predicted segments, decoded archaic segments or local-ancestry calls."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import evaluate, tracts
from strandloom.operators.tracts import STATES
from strandloom.sources import readers, writers

KEYS = ["chrom", "sample"]
#: Length of the cells in which overlaps are joined.
WIDTH = 1 << 20


def truth(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return readers.segments(spark, path, end_inclusive=False)


def predicted(spark: SparkSession, segments: Sequence[str] | None = None, decoded: Sequence[str] | None = None, msp: Sequence[str] | None = None, populations: dict[str, str] | None = None, least: float | None = None) -> DataFrame:
    """chrom, sample, s, e, state of segment files, or of local-ancestry calls (msp) whose ancestry becomes archaic within the
    decoded archaic segments of the same sample; decoded segments alone have the state ND_EU."""
    if segments:
        return readers.segments(spark, list(segments), end_inclusive=True)
    archaic = readers.decoded(spark, list(decoded), least).select(*KEYS, "s", "e") if decoded else None
    if not msp:
        return archaic.withColumn("state", F.lit("ND_EU"))
    rows = [tracts.run_segments(readers.msp(spark, p, populations), ["chrom", "hap"], "spos", "epos", "state").withColumnRenamed("hap", "sample") for p in msp]
    local = rows[0]
    for more in rows[1:]:
        local = local.unionByName(more)
    if archaic is None:
        return local
    return painted(local, archaic)


def painted(local: DataFrame, archaic: DataFrame) -> DataFrame:
    """local (chrom, sample, s, e, state) with ND_ before EU and NA within archaic (chrom, sample, s, e); other ancestries
    have no archaic state and stay."""
    over = evaluate.intervals.merge(archaic, KEYS)
    has = F.col("state").isin("EU", "NA")
    inside = evaluate.intervals.overlaps(local.where(has), over, KEYS, WIDTH).withColumn("state", F.concat(F.lit("ND_"), F.col("state")))
    outside = evaluate.intervals.subtract_labelled(local.where(has), over, KEYS, WIDTH)
    columns = [*KEYS, "s", "e", "state"]
    return inside.select(columns).unionByName(outside.select(columns)).unionByName(local.where(~has).select(columns))


#: Keys of rows of several runs, in which samples of one name are not one.
RUN_KEYS = ["run", *KEYS]


def paired_runs(spark: SparkSession, truths: Sequence[str], segments: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (run, chrom, sample, s, e, state) of the true and the predicted segments of several runs, the files of one run at
    one place of both lists. A run that lacks one of its files is left out with a warning; without any run this raises."""
    if len(truths) != len(segments):
        raise ValueError(f"{len(truths)} files of true segments and {len(segments)} of predicted ones")
    true, pred = [], []
    for run, (t, p) in enumerate(zip(truths, segments, strict=True)):
        lacking = [x for x in (t, p) if not readers.exists(spark, readers.expand(x))]
        if lacking:
            warnings.warn(f"run {run} is left out, there is no {lacking[0]}", stacklevel=2)
            continue
        true.append(truth(spark, t).withColumn("run", F.lit(run)))
        pred.append(predicted(spark, [p]).withColumn("run", F.lit(run)))
    if not true:
        raise FileNotFoundError("no run has both of its files")
    return reduce(DataFrame.unionByName, true), reduce(DataFrame.unionByName, pred)


def evaluated(true: DataFrame, pred: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Confusion by common length over the keys that both have, and the report of it."""
    conf = evaluate.confusion(true, pred, keys, WIDTH)
    return conf, evaluate.report(conf, STATES)


def sweep(true: DataFrame, decoded: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Binary scores of decoded segments (chrom, sample, s, e, mean_prob) at each threshold against the archaic segments of
    true; segments without a probability count at every threshold."""
    pred = decoded.select(*KEYS, "s", "e", F.coalesce("mean_prob", F.lit(float("inf"))).alias("score"))
    return evaluate.threshold_sweep(true.where(F.col("state").isin(*evaluate.ARCHAIC)).select(*KEYS, "s", "e"), pred, KEYS, WIDTH, thresholds)


def write(spark: SparkSession, true: str | Sequence[str], out: str, segments=None, decoded=None, msp=None, populations=None, least: Sequence[float] | None = None, lengths: Sequence[int] | None = None) -> None:
    """Confusion matrix, report and summary under out; for decoded segments and several thresholds a table of scores. Several
    files of true segments are runs with a file of segments each, whose lengths are added. With lengths, edges of bins (none:
    the usual ones), also scores and matrices by the length of the true segments."""
    files = [true] if isinstance(true, str) else list(true)
    keys, pred = KEYS, None
    if len(files) > 1:
        if not segments:
            raise ValueError("several runs are scored by files of segments")
        keys, (known, pred) = RUN_KEYS, paired_runs(spark, files, segments)
    else:
        known = truth(spark, files)
    if decoded and not msp and least and len(least) > 1:
        rows = sweep(known, readers.decoded(spark, list(decoded)), least)
        rows.coalesce(1).orderBy("threshold").write.mode("overwrite").csv(f"{out}/thresholds", sep="\t", header=True)
        return
    if pred is None:
        pred = predicted(spark, segments, decoded, msp, populations, least[0] if least else None)
    if lengths is not None:
        edges = list(lengths) or evaluate.LENGTH_EDGES
        binned = evaluate.by_length(known, pred, keys, WIDTH, edges).persist()
        for name, rows in (("lengths", evaluate.length_scores(binned, edges).orderBy("bin")), ("length_shares", evaluate.length_shares(binned, STATES, edges).orderBy("bin", "truth_state", "pred_state"))):
            rows.coalesce(1).write.mode("overwrite").csv(f"{out}/{name}", sep="\t", header=True)
        binned.unpersist()
    conf, report = evaluated(known, pred, keys)
    conf = conf.persist()
    writers.confusion_text(conf, STATES, f"{out}/confusion")
    one = report.persist().first()
    writers.report({"accuracy": one.accuracy, "total_bp": one.total_bp}, report.select("state", "precision", "recall", "f1", "support_bp"), f"{out}/report")
    conf.unpersist()
    report.unpersist()
