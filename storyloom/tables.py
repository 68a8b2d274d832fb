"""Written intermediate tables: the way lineage is cut in every iterative operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="storyloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are those of the writer.

    Unlike a cached frame, the table survives lost executors; unlike an RDD
    checkpoint, it is columnar, prunable and has a size the optimizer knows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table go as soon as it is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def lookup(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Join of rows that may crowd on one key with a table of one row per key.

    The table is written first.  Its size is then known, so Spark broadcasts it
    if it is small; and it reaches the join through a shuffle of its own, which
    is what lets adaptive execution split a crowded key over many tasks.  A
    table aggregated on the same key would be joined in place and not split.
    """
    return rows.join(written(keys, "lookup"), on, how)


def page_rows(table: DataFrame, page: DataFrame) -> DataFrame:
    """Full rows of ``table`` for a page of (id, fetched_at, further columns).

    The page is bounded by its limit, so its ids become literals: they and the
    time span reach the scan of the table and skip what holds no hit, where a
    join would read every long text first.
    """
    spark, kind = table.sparkSession, table.schema["fetched_at"].dataType
    rows = page.withColumn("text", F.col("fetched_at").cast("string")).collect()
    local = spark.createDataFrame(rows, page.schema.add("text", "string")).drop("text", "fetched_at")
    if not rows:
        return table.limit(0).join(local, "id")
    # A day on either side keeps clear of time zone shifts.
    day = F.make_dt_interval(days=F.lit(1))
    first, last = (F.lit(end(r.text for r in rows)).cast(kind) for end in (min, max))
    found = table.filter(
        F.col("id").isin([r.id for r in rows])
        & F.col("fetched_at").between(first - day, last + day)
    )
    return found.join(F.broadcast(local), "id")


def placed_within(rows: DataFrame, key: str, order: list[str], name: str = "place") -> DataFrame:
    """Add ``name``: how many rows of the same key come before, in a total order within it.

    Rows are range-sorted by key and order, so a crowded key lies over many ranges.  Each
    range numbers its own rows; what earlier ranges hold of a key comes from one count per
    key and range.  No task sees more of a key than one range.
    """
    ranges = rows.repartitionByRange(key, *order)
    ranges = written(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    held = ranges.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    # As many rows per key as ranges hold it.
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(key, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    starts = written(starts.filter("_start > 0").toDF("_key", "_of", "_start"), "range-starts")
    within = Window.partitionBy("_range", key).orderBy(*order)
    numbered = ranges.withColumn("_own", F.row_number().over(within) - 1)
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of"))
    joined = numbered.join(starts, same, "left")
    return joined.withColumn(name, F.col("_own") + F.coalesce("_start", F.lit(0))).drop(
        "_range", "_own", "_key", "_of", "_start"
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the input has fewer splits than cores.

    Meant for heavy per-row work on a few files.  An input of many splits, the
    normal case at scale, is left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out to at least one task per core, whatever the splits of the input.

    Meant for heavy per-row work on files of few row groups: such a file may be read in
    many splits, of which only those with a row group's middle have rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions()))
