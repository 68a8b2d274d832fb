"""From feed items to article rows, and the statistics of an ingest run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.hashing import content_hash, simhash
from storyloom.functions.text import excerpt, normalize_whitespace, strip_html
from storyloom.functions.urls import canonical_url


def article_rows(items: DataFrame) -> DataFrame:
    """Normalise, hash and excerpt every item; other columns pass through."""
    plain = normalize_whitespace(strip_html(F.col("content")))
    basis = F.lower(normalize_whitespace(F.concat_ws("\n", "title", "content")))
    return (
        items.withColumn("content", plain)
        .withColumn("canonical_url", canonical_url(F.col("url")))
        .withColumn("excerpt", excerpt(F.col("content")))
        .withColumn("lang", F.lit(None).cast("string"))
        .withColumn("content_hash", content_hash(basis))
        .withColumn("simhash", simhash(F.concat_ws(" ", "title", "content")))
    )


def _counts(sources: DataFrame, fetches: DataFrame, items: DataFrame) -> DataFrame:
    events = (
        sources.filter("active").select(F.col("id").alias("source_id"), F.lit("source").alias("event"))
        .unionByName(fetches.select("source_id", F.col("outcome").alias("event")))
        .unionByName(
            items.select(
                "source_id", F.when(F.col("accepted"), "inserted").otherwise("duplicate").alias("event")
            )
        )
    )
    return events


def _totals() -> list:
    names = {
        "sources": "source",
        "fetched": "fetched",
        "not_modified": "not_modified",
        "inserted": "inserted",
        "duplicates": "duplicate",
        "errors": "error",
    }
    return [F.count_if(F.col("event") == event).alias(name) for name, event in names.items()]


def ingest_stats(sources: DataFrame, fetches: DataFrame, items: DataFrame) -> DataFrame:
    """One row: sources, fetched, not_modified, inserted, duplicates, errors."""
    return _counts(sources, fetches, items).agg(*_totals())


def ingest_stats_by_source(sources: DataFrame, fetches: DataFrame, items: DataFrame) -> DataFrame:
    return _counts(sources, fetches, items).groupBy("source_id").agg(*_totals())
