"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Rows are combined in
three stages, each of which groups by the digest *and the full normalised text*, so equal digests of different texts
stay apart: (1) within each task (the map side of the aggregation), (2) within each digest and salt, the salt spreading
a hot text over ``salts`` reducers, (3) over the salts' winners of each digest. What is then joined back to the rows is
narrow (digest, id, size); a hot digest there is a skewed join, which adaptive execution splits.

Defined results: a null text counts as empty, and all empty texts are one group. Of equal texts the row with the most
code points in its original text stays, then the least id; a null id loses to any other. Repeated rows (same id, same
text) each count in ``group_size`` and bear the same flags. An empty table gives an empty result. Further columns of the
input are left alone by ``groups`` and kept by ``drop_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

WHITESPACE = r"[\x20\x09-\x0D]+"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.length(text).alias("n_chars"), F.regexp_replace(text, WHITESPACE, "").alias("norm")) \
        .select("id", "n_chars", "norm", digest(F.col("norm")).alias("digest"), F.xxhash64(F.lit(17), "norm").alias("mark"),
                F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64,
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``."""
    rows = _rows(docs, id_col, text_col, salts, digest)
    # bitwise_not turns the order of ids round without overflow; a null id is the least of all in a struct
    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("not_id"))).alias("best")
    salted = rows.groupBy("digest", "salt", "norm", "mark").agg(best, F.count("*").alias("n"))
    whole = salted.groupBy("digest", "norm", "mark").agg(F.max("best").alias("best"), F.sum("n").alias("n")) \
        .where("n > 1").select("digest", "mark", F.bitwise_not("best.not_id").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.select("id", "digest", "mark").join(whole, ["digest", "mark"], "left") \
        .select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest") \
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of repeated rows (same id and text) one stays."""
    found = groups(docs, id_col, text_col, salts)
    own, lost, its = free_names(docs, "own", "lost", "its")
    gone = found.where("not kept").select(F.col("id").alias(lost), F.col("digest").alias(its)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = docs.withColumn(own, F.sha2(F.regexp_replace(text, WHITESPACE, ""), 256))
    rest = rest.join(gone, F.col(id_col).eqNullSafe(F.col(lost)) & (F.col(own) == F.col(its)), "left_anti")
    return rest.dropDuplicates([id_col, own]).select(*docs.columns)
