"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() applies them in order, each
result written as Parquet under spark.checkpoint.dir and read again; what a stage wrote on its way is deleted. All stages but the last return the columns of
documents. Rows are never sampled or capped; an empty table passes through every stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, language_id, line_dedup, mixing, simhash
from strandloom.llm.common import documents, finished


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits one of the languages that docs teach; null texts and texts without a letter go."""
    return language_id.accepted(docs, language_id.train(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the blocks of lines that an earlier one has, with n_chars of what is left. One that loses all its
    words to earlier documents goes."""
    cut = line_dedup.line_dedup(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: texts with 0.8 of their five-word
    shingles in common are linked."""
    return simhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to twice."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of each document of the mix, and whether the ids decode to its text."""
    # Workers that ran the stages before still hold their models, so fewer words are remembered here.
    return byte_bpe.tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "source"], remembered=60_000)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage), ("mix_sources", mix_stage), ("byte_bpe", token_stage)]
#: Model scores, hash orders and merges are not SQL; tests hold run() against the stages' own rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
