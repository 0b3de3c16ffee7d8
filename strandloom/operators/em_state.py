"""States of an EM run in the folder that all machines share: a run whose driver was lost goes on from the last step that was
written. A step is a row of its numbers, as doubles, so the run that goes on has the same bits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "step int, loglik double, params array<double>"


def add(spark: SparkSession, path: str, step: int, loglik: float, params: Sequence[float]) -> None:
    """Writes the state after a step: the log likelihood before it and the parameters after it."""
    row = [(step, float(loglik), [float(x) for x in params])]
    spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/step={step:04d}/state")


def seen(spark: SparkSession, path: str) -> tuple[list[float], np.ndarray | None]:
    """The log likelihoods of all whole steps in order, and the parameters after the last; None if there is no step."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/step=*/state/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return [], None
    rows = spark.read.schema(SCHEMA).parquet(*[str(f.getPath().getParent()) for f in found]).orderBy("step").collect()
    return [r.loglik for r in rows], np.array(rows[-1].params)


def guard(spark: SparkSession, path: str, text: str) -> None:
    """Keeps text at path, or raises if another text is there: a folder serves one run alone."""
    if table(spark, path):
        if spark.read.text(path, wholetext=True).first()[0].strip() != text:
            raise ValueError(f"{path} tells of another run: take a new folder")
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def table(spark: SparkSession, path: str) -> bool:
    """Whether a whole table lies at path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def history(spark: SparkSession, path: str, names: Sequence[str]):
    """(step, loglik, names...) of each step that was written: what a run shows of its way."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    return rows.select("step", "loglik", *[F.get("params", F.lit(i)).alias(n) for i, n in enumerate(names)])
