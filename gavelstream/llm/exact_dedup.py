"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions are used. Texts are equal when they are identical
after each run of white space is replaced by one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import WHITE, stash, text_or_empty, unused


def normalised(column: str = "text") -> Column:
    """The text (null: empty) with each run of white space as one space."""
    return F.regexp_replace(text_or_empty(column), WHITE + "+", " ")


def exact_duplicates(docs: DataFrame, prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, full_hash.

    The smallest doc_id of a group stays. Rows are compared by length, those
    left by a hash of their first prefix_chars characters, and only rows that
    still share both have their whole text hashed; with hash_all the others
    get a full_hash too, for callers that keep it.

    Null texts equal empty ones and each other. Rows that repeat a doc_id with
    an equal text are one document: each counts in group_size, and they are
    kept or dropped together. A null doc_id never wins over another id; in a
    group of nulls alone keep_id is null and all stay. Columns besides doc_id
    and text are ignored, whatever their names. An empty table gives none.

    A group's rows meet only in aggregates that combine before the shuffle and
    in equi-joins against one row per group, which Spark splits when skewed.
    """
    digest = F.sha2("body", 256)
    rows = docs.select("doc_id", normalised().alias("body"))
    # with hash_all the texts stay where they are read, as their hashes go instead
    content = digest.alias("full_hash") if hash_all else F.col("body")
    signed = rows.select("doc_id", content, F.length("body").alias("len"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("head"))

    # counted per pair first, so that a hot length or pair is a few partial counts from each task
    heads = stash(signed.groupBy("len", "head").agg(F.count("*").alias("n")), "dedup-heads")
    lengths = heads.groupBy("len").agg(F.sum("n").alias("rows")).where("rows > 1").select("len")
    pairs = heads.where("n > 1").join(lengths, "len", "left_semi").select("len", "head", F.lit(True).alias("open"))

    is_open = F.col("open").isNotNull()
    hashed = signed.join(pairs, ["len", "head"], "left")
    hashed = hashed.select("doc_id", is_open.alias("open"), F.col("full_hash") if hash_all else F.when(is_open, digest).alias("full_hash"))
    hashed = stash(hashed, "dedup-hashes")

    # written, so that the join below has an exchange of its own on each side, which Spark can split
    groups = hashed.where("open").groupBy("full_hash").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stash(groups, "dedup-groups")
    shared = hashed.where("open").join(groups, "full_hash").select("doc_id", "keep_id", "group_size", "full_hash")
    alone = hashed.where("not open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "full_hash")
    return shared.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "full_hash")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns; of rows that share a doc_id each by its own text."""
    gone = exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("full_hash").alias("_gone_hash")).distinct()
    own = unused("hash", docs.columns)  # a column, as a join computes a key that is not one several times
    hashed = docs.withColumn(own, F.sha2(normalised(), 256))
    same = hashed["doc_id"].eqNullSafe(gone["_gone_id"]) & (hashed[own] == gone["_gone_hash"])
    return hashed.join(gone, same, "left_anti").select(docs.columns)
