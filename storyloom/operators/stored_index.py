"""The search index as a sorted table that is read by lexeme."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.tables import written

# Postings of a part: a few hundred MB at most, and one task's work to write.
ROWS_PER_PART = 2_000_000
# Row groups within a part; each keeps the first and last lexeme of its rows.
ROW_GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class StoredIndex:
    """Postings in parts that follow each other by (lex, article_id), and where each part begins and ends."""

    sparkSession: SparkSession
    path: str
    schema: T.StructType

    def table(self) -> DataFrame:
        """All postings; filters on ``lex`` still skip row groups."""
        return self.sparkSession.read.schema(self.schema).parquet(f"{self.path}/postings")

    def parts(self) -> DataFrame:
        """part, first, last, rows."""
        return self.sparkSession.read.parquet(f"{self.path}/parts")

    def postings(self, words: Iterable[str]) -> DataFrame:
        """Postings of these lexemes, a few of them: those of a query.

        The parts they can lie in are looked up first and become a partition filter, so no
        other file is opened.  Within a part the filter on ``lex`` skips all row groups
        and pages but theirs.
        """
        wanted = sorted(set(words))
        if not wanted:
            return self.table().drop("part").limit(0)
        inside = [(F.col("first") <= w) & (F.col("last") >= w) for w in wanted]
        numbers = [r.part for r in self.parts().filter(reduce(Column.__or__, inside)).select("part").collect()]
        held = self.table().filter(F.col("part").isin(numbers) & F.col("lex").isin(wanted))
        return held.drop("part")


def store_index(index: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> StoredIndex:
    """Write postings (lex, article_id, ...) range-partitioned and sorted by (lex, article_id).

    Ranges are of both columns, so the postings of a very common lexeme are cut into
    several parts like any others.
    """
    held = written(index, "postings")
    parts = max(1, math.ceil(held.count() / rows_per_part))
    ranges = held.repartitionByRange(parts, "lex", "article_id").withColumn("part", F.spark_partition_id())
    (
        ranges.sortWithinPartitions("part", "lex", "article_id")
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy("part").parquet(f"{path}/postings")
    )
    schema = T.StructType([*index.schema.fields, T.StructField("part", T.IntegerType())])
    stored = StoredIndex(index.sparkSession, path, schema)
    edges = stored.table().groupBy("part").agg(
        F.min("lex").alias("first"), F.max("lex").alias("last"), F.count("*").alias("rows")
    )
    edges.coalesce(1).write.parquet(f"{path}/parts")
    return stored
