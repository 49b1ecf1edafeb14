"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hot_join, materialize, numbered, row_number, shuffle_partitions

#: Runs that one merge of the tree takes in.
FAN_IN_BITS = 3
KEYS = ("sha", "n_bytes", "check")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_no, the identifier, and of the normalised text the SHA-256, the length in bytes and a second hash."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(
        row_number(row_col).alias("row_no"), F.col(id_col).cast("long").alias("id"), text.alias("norm")
    ).select("row_no", "id", F.sha2(F.col("norm"), 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("check"))


def tree_merge(leaves: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row for each text: KEYS, keep (struct with the smallest identifier) and group_size.

    Every input partition is a leaf run. In round r the runs whose numbers agree but for their last r * fan_in_bits
    bits are merged: each task sorts what it has by run and digest and folds equal digests; rows are sent by the hash
    of run and digest, and the receiver sorts them again and keeps, for each digest whose length and second hash agree
    too, the smallest identifier and the number of rows. A digest that a third of all rows share is one row a task
    after the first fold. The minimum of a struct is kept by Spark's sort aggregate, so all of it is sorting that
    spills.
    """
    spark = leaves.sparkSession
    bits = max(fan_in_bits, math.ceil(math.log2(max(2, shuffle_partitions(spark)))))
    runs = leaves.select(
        *KEYS,
        F.struct(F.col("id").isNull().alias("none"), "id", "row_no").alias("keep"),
        F.lit(1).cast("long").alias("group_size"),
        F.pmod(F.spark_partition_id(), F.lit(1 << bits)).alias("run"),
    )
    for _ in range(math.ceil(bits / fan_in_bits)):
        runs = (
            runs.withColumn("run", F.shiftright("run", fan_in_bits))
            .groupBy("run", *KEYS)
            .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of equal texts the row with the smallest identifier stays.

    Texts are equal when identical after each run of white space has become one blank. Returns a row for each
    input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. A null identifier comes after all others. Rows
    that repeat with the same identifier are a tie: one of them is kept. Long texts are hashed as they are. An
    empty table gives an empty result. Other columns are not read.
    """
    return marked(docs, id_col, text_col).drop("row_no")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """What exact_dedup() returns, and row_no, which is row_col if that is given."""
    leaves = materialize(digests(docs, id_col, text_col, row_col), "digests")
    texts = materialize(tree_merge(leaves), "texts")
    total = texts.agg(F.sum("group_size")).first()[0] or 0
    return hot_join(leaves, texts, KEYS, "group_size", total).select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "row_no",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops; all columns stay. Rows go by number, so identifiers may repeat or be null."""
    docs, row = numbered(docs)
    dropped = marked(docs, id_col, text_col, row).filter(~F.col("kept")).select(F.col("row_no").alias(row))
    return docs.join(dropped, row, "left_anti").drop(row)
