"""Listing queries over articles, sources and stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.dates import effective_time
from storyloom.functions.text import excerpt
from storyloom.settings import PAGE_SIZE
from storyloom.tables import page_rows, written


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with the name and site of their source.

    No hint: Spark broadcasts the sources when their size allows and splits a
    skewed source otherwise.
    """
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "site_url")
    return articles.join(named, "source_id")


def recent_articles(
    articles: DataFrame, sources: DataFrame, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Articles with source, newest first.

    The page is cut on ids and times, at once; full rows are read for it only.
    """
    order = [F.col("at").desc(), F.col("id")]
    keys = articles.select("id", "source_id", "fetched_at", effective_time().alias("at"))
    known = keys.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    page = known.orderBy(*order).offset(offset).limit(limit).drop("source_id")
    return with_source(page_rows(articles, page), sources).orderBy(*order)


def article_by_id(articles: DataFrame, sources: DataFrame, article_id: int) -> DataFrame:
    return with_source(articles.filter(F.col("id") == article_id), sources)


def count_articles(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("n"))


def count_stories(stories: DataFrame) -> DataFrame:
    return stories.filter("article_count > 0").agg(F.count("*").alias("n"))


def list_stories(
    stories: DataFrame, articles: DataFrame, limit: int | None = PAGE_SIZE, offset: int = 0
) -> DataFrame:
    """Stories with source count, latest time and the excerpt of the latest article.

    Without a limit one aggregation gives all of it.  A page is cut on the narrow
    (story, latest time) aggregate and written once; the distinct count and the
    excerpt are then computed for its stories only.
    """
    order = [F.col("latest_at").desc_nulls_last(), F.col("id")]
    filled = stories.filter("article_count > 0")
    members = articles.filter("story_id is not null").select(
        F.col("story_id").alias("id"), F.col("id").alias("article_id"),
        "source_id", "excerpt", effective_time().alias("at"),
    )
    latest = F.max("at").alias("latest_at")
    facts = [
        F.count_distinct("source_id").alias("source_count"),
        F.max_by("excerpt", F.struct("at", "article_id")).alias("excerpt"),
    ]
    if limit is None:
        listed = filled.join(members.groupBy("id").agg(latest, *facts), "id", "left")
    else:
        page = filled.join(members.groupBy("id").agg(latest), "id", "left")
        page = written(page.orderBy(*order).offset(offset).limit(limit), "story-page")
        chosen = members.join(F.broadcast(page.select("id")), "id", "left_semi")
        listed = page.join(chosen.groupBy("id").agg(*facts), "id", "left")
    return listed.withColumn("source_count", F.coalesce("source_count", F.lit(0))).orderBy(*order)


def story_by_id(stories: DataFrame, story_id: int) -> DataFrame:
    return stories.filter(F.col("id") == story_id)


def story_articles(articles: DataFrame, sources: DataFrame, story_id: int) -> DataFrame:
    """Timeline of a story, oldest first."""
    rows = with_source(articles.filter(F.col("story_id") == story_id), sources)
    return rows.withColumn("at", effective_time()).orderBy("at", "id")


def story_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of every story by first appearance: story_id, source_name, first_at."""
    rows = articles.filter("story_id is not null").withColumn("at", effective_time())
    first = rows.groupBy("story_id", "source_id").agg(F.min("at").alias("first_at"))
    return with_source(first, sources).select("story_id", "source_name", "first_at")


def home_feed(
    stories: DataFrame, articles: DataFrame, sources: DataFrame, page: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """A page of stories, or of recent articles while there is no story."""
    offset = (max(page, 1) - 1) * size
    if not stories.filter("article_count > 0").isEmpty():
        rows = list_stories(stories, articles, size, offset)
        return rows.select(
            F.lit("story").alias("kind"), "id", "title", "excerpt", F.col("latest_at").alias("at")
        )
    rows = recent_articles(articles, sources, size, offset)
    return rows.select(F.lit("article").alias("kind"), "id", "title", "excerpt", "at")


def lead_summaries(articles: DataFrame, max_length: int = 400) -> DataFrame:
    """Opening text of the first article of every story.

    The text is cut where it is read, so whole bodies are never shuffled.
    """
    rows = articles.filter("story_id is not null").select(
        "story_id",
        F.struct(effective_time(), "id").alias("place"),
        excerpt(F.concat(F.col("title"), F.lit(". "), F.col("content")), max_length).alias("text"),
    )
    return rows.groupBy("story_id").agg(F.min_by("text", "place").alias("summary"))
