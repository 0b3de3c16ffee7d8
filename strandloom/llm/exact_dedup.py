"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Texts are cut where their own content says so, each distinct chunk gets an identifier that was verified against the
chunk's characters, and documents are compared by their ordered identifier lists. Chunk texts move once, after each
task has merged its own repeats; documents themselves never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import ascii_lower, salts, written

#: A chunk ends behind a line end, or behind white space that follows . ! or ?, at least CHUNK_MIN characters after
#: its start; a stretch of CHUNK_MAX characters without such a place is cut there.
CHUNK_MIN, CHUNK_MAX = 512, 8192


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """Array of the consecutive chunks of text; joined they are the text. Empty text: empty array."""
    pattern = rf"(?s).{{{least},{most}}}?(?:\n|[.!?]\s)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashes(chunk_rows: DataFrame) -> DataFrame | None:
    """(h, c, sub) for the chunks c whose hash h another chunk has too; sub, from 0, tells them apart. None if the
    dictionary of all chunks has no such hash: then chunks have moved once and need not move again."""
    distinct = chunk_rows.groupBy("h", "c").agg(F.lit(1).alias("one"))
    shared = written(distinct.groupBy("h").agg(F.sum("one").alias("n")).where("n > 1").select("h"), "op1-shared")
    if shared.isEmpty():
        return None
    sub = distinct.join(shared, "h", "left_semi").select("h", "c", (F.row_number().over(W.partitionBy("h").orderBy("c")) - 1).alias("sub"))
    return written(sub, "op1-clashes")


def recipes(
    docs: DataFrame,
    least: int = CHUNK_MIN,
    most: int = CHUNK_MAX,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(doc_id, text_sha256, recipe) for each row; equal recipes mean equal normalised texts.

    recipe holds an identifier for each chunk: its 64-bit hash, once the dictionary of all chunks has shown that no
    other chunk has that hash. Should some have, their place in the hash's list of chunks joins the identifier."""
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), least, most).alias("cs"))
    rows = cut.select(F.explode("cs").alias("c")).select(chunk_hash(F.col("c")).cast("long").alias("h"), "c")
    sub = clashes(rows)
    plain = cut.select(
        "doc_id", "text_sha256", F.transform("cs", lambda c: F.struct(chunk_hash(c).cast("long").alias("h"), F.lit(0).alias("sub"))).alias("recipe")
    )
    if sub is None:
        return plain
    # Some hash stands for several chunks: identifiers of those chunks are looked up by hash and chunk.
    at = (
        cut.where(F.size("cs") > 0)
        .select("text_sha256", F.posexplode("cs").alias("pos", "c"))
        .withColumn("h", chunk_hash(F.col("c")).cast("long"))
        .groupBy("text_sha256", "pos", "h", "c")
        .agg(F.lit(1).alias("one"))
        .join(sub, ["h", "c"], "left")
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("h", F.coalesce("sub", F.lit(0)).alias("sub")).alias("id")))).alias("ids"))
        .select("text_sha256", F.col("ids.id").alias("named"))
    )
    return plain.join(at, "text_sha256", "left").select("doc_id", "text_sha256", F.coalesce("named", "recipe").alias("recipe"))


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, and empty texts are equal. Of equal
    texts the row with the largest doc_id stays. Null doc_ids come before all others: they stay only in a group that
    has no other. Rows that repeat both doc_id and text share one result. An empty table gives an empty result.

    Groups are counted in salted parts whose sums are then added, and joined back part by part, so a group that holds
    a third of all rows is spread over all tasks."""
    # By rows, not by doc_id: rows that repeat a doc_id (or have none) are spread too. Written, so that a salt never changes.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts(docs.sparkSession))).cast("int")
    salted = written(recipes(docs, **options).withColumn("salt", salt), "op1-recipes")
    parts = salted.groupBy("recipe", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("recipe")
    groups = parts.select(
        "recipe", "salt", F.max("top").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size")
    )
    return salted.join(groups, ["recipe", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
