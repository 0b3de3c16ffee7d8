"""Expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of one byte a character take the faster function."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def salts(spark: SparkSession) -> int:
    """Parts into which the members of one group are dealt while they are counted and joined: as many as the session has
    shuffle partitions, 32 at least, so that a hot group is spread over the whole cluster."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_lowest(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with name, the smallest value of all rows that share their key. A key's rows are dealt to salts: the parts'
    minima are made first and joined back part by part, so no task meets all rows of a hot key."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts(rows.sparkSession))))
    parts = dealt.groupBy(key, "_salt").agg(F.min(value).alias("_low"))
    whole = parts.select(key, "_salt", F.min("_low").over(W.partitionBy(key)).alias(name))
    return dealt.join(whole, [key, "_salt"]).drop("_salt")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset on one machine, as in tests, a
    temporary folder is made and set once for the session's context; a cluster has to name one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandloom-"))
    return jsc.getCheckpointDir().get()


_local = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written under shared_dir and read again: lineage ends there, and lost executors cost no more
    than the tasks they ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _local.__dict__.setdefault("paths", []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of make() as a table; those that make() wrote on its way in this thread are deleted."""
    paths = _local.__dict__.setdefault("paths", [])
    before = len(paths)
    out = written(make(), name)
    discard(out.sparkSession, *paths[before:-1])
    del paths[before:-1]
    return out


_kept: dict = {}


def kept(key, make: Callable):
    """make() of this Python worker, made anew where the worker's last such object had another key: models and encoders of
    several operators are not held together by the workers that serve all of them."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
