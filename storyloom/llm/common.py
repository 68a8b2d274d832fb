"""What the operators of this folder share: reading tables, words, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.tables import written

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(document_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(document_id.cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def running_total(rows: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows in a total order.

    Rows are range-sorted; each range adds up its own, and only one sum per
    range is put in order.  No task sees more than one range.
    """
    spread = rows.withColumn("_value", value).repartitionByRange(*order)
    spread = written(spread.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = spread.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # One row per range, so their number is that of shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum("_value").over(within), F.lit(0))
    return (
        spread.join(F.broadcast(starts), "_range")
        .withColumn(name, total)
        .drop("_range", "_start", "_value")
    )
