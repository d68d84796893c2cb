"""Exact duplicates by combining in three steps that no hot text can overload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from clientela.llm.batches import free_name

BLANKS = r"[\x20\x09-\x0D]+"


def one_spaced(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    salts: int = 64,
) -> DataFrame:
    """One row per document with the group of equal texts that it belongs to.

    Texts are equal if they are identical after ``one_spaced``. Result: doc_id,
    keep_id (smallest id of the group), group_size, kept, digest.

    Each task first combines its own rows, which leaves one row per task for
    however many copies. Those are merged per text and salt, the salts' winners
    per text. All three steps group by digest *and* text, so equal digests of
    different texts never meet. Documents then look up their group by digest,
    a second hash and length, a join of two shuffles that adaptive execution
    splits for a hot text. No two texts are known that agree in all three.

    Null and empty texts are one group. A null id is never the smallest unless
    all are null. Rows that repeat id and text are reported alike, each counted.
    """
    texts = docs.select(F.col("doc_id"), one_spaced(F.col("text")).alias("whole"))
    texts = texts.withColumn("digest", digest(F.col("whole")))
    named = ("digest", F.xxhash64("whole").alias("hash"), F.char_length("whole").alias("length"))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    salted = texts.groupBy("digest", "whole", salt).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    winners = salted.groupBy("digest", "whole").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    found = texts.select("doc_id", *named).join(
        winners.select(*named, "keep_id", "group_size"), ["digest", "hash", "length"]
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, "digest")


def first_of_each(docs: DataFrame) -> DataFrame:
    """Documents without their later copies, all columns and texts as they are.

    A row goes if its id and text are a later copy, so an id that comes with two
    texts loses neither to the other. Rows with a null id stay.
    """
    groups = text_groups(docs)
    digest = free_name(docs, "digest")
    dropped = groups.where(~F.col("kept")).select("doc_id", F.col("digest").alias(digest)).distinct()
    marked = docs.withColumn(digest, sha256(one_spaced(F.col("text"))))
    return marked.join(dropped, ["doc_id", digest], "left_anti").select(*docs.columns)
