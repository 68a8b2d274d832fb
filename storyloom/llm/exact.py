"""Exact dedup by content sort (op 8): equal texts become neighbours, then are compared in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.tables import written

# At most this many texts can each hold more than one part in HOT_PARTS of all rows.
HOT_PARTS = 10_000
SMALL_GROUP = 64
SPLITTER_CHARS = 32


def same(text: Column) -> Column:
    return text


def exact_groups(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = same,
    document_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    ``row`` holds all columns of ``docs``.  Texts are equal when the same after
    ``normalise``; null counts as empty.  Of equal texts the largest id stays;
    among rows equal in text and id one stays, and a null id only if the group
    has no other.

    Spark samples splitters and range-partitions the rows on the first
    characters and a hash of the text (so splitters stay short and a common
    opening does not crowd one range), sorts every range externally, and the
    window compares the whole texts of neighbours.  Texts that hold more than
    1/``HOT_PARTS`` of all rows, at most ``HOT_PARTS`` by count, are known
    beforehand: their rows are dealt over several ranges, and their keeper comes
    from an aggregate combined before its shuffle.
    """
    norm = normalise(F.coalesce(F.col(f"row.{text}"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row")).withColumns(
        {"doc_id": F.col(f"row.{document_id}"), "hash": F.xxhash64(norm)}
    )
    part = max(SMALL_GROUP, docs.count() // HOT_PARTS)
    crowded = rows.groupBy("hash").count().filter(F.col("count") > part)
    salts = F.ceil(F.col("count") / part).cast("int").alias("salts")
    crowded = written(crowded.select("hash", salts), "crowded-hashes")
    hot = rows.join(F.broadcast(crowded), "hash").groupBy("hash", F.sha2(norm, 256).alias("text_sha256"))
    hot = hot.agg(F.max("doc_id").alias("hot_id"), F.count("*").alias("hot_size"))
    hot = written(hot, "crowded-texts")

    rows = rows.join(F.broadcast(crowded), "hash", "left").withColumns(
        {
            "start": F.substring(norm, 1, SPLITTER_CHARS),
            "salt": F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)),
        }
    )
    ranges = rows.drop("salts").repartitionByRange("start", "hash", "salt").withColumn("norm", norm)
    equal = Window.partitionBy("start", "hash", "salt", "norm").orderBy(F.desc_nulls_last("doc_id"))
    group = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    compared = ranges.select(
        "row",
        "doc_id",
        "hash",
        F.sha2("norm", 256).alias("text_sha256"),
        F.max("doc_id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        F.row_number().over(equal).alias("place"),
    ).join(F.broadcast(hot), ["hash", "text_sha256"], "left")
    is_hot = F.col("hot_size").isNotNull()
    keep = F.when(is_hot, F.col("hot_id")).otherwise(F.col("keep_id"))
    return compared.select(
        "row",
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("hot_size", "group_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("place") == 1)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    return exact_groups(docs, **options).filter("kept").select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and verdict of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).drop("row")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
