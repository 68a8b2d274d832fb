"""News tables derived from the given parquet tables, growing with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.hashing import content_hash, simhash
from storyloom.functions.text import excerpt, normalize_whitespace
from storyloom.sources.feeds import triage
from storyloom.tables import spread

EPOCH = "2024-01-01 00:00:00"
STEP_MINUTES = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with long texts, whose few files should keep all cores busy."""
    return spread(table(spark, folder, name))


def minutes_after(minutes: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items in arrival order, one per web page."""
    page = F.col("page_id")
    return texts(spark, folder, "pages").select(
        page.alias("ord"),
        F.pmod(page, F.lit(20)).cast("int").alias("source_id"),
        F.when(page % 5 != 0, F.concat(F.lit("g"), (page % 200).cast("string"))).alias("guid"),
        "url",
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.col("html").alias("content"),
        F.when(page % 10 != 0, minutes_after(page * 10)).alias("published_at"),
        minutes_after(page * 10 + 30).alias("fetched_at"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Stored articles, one per document.  Unused columns are never computed."""
    fetched = minutes_after(F.col("doc_id") * STEP_MINUTES)
    shift = F.make_dt_interval(hours=(F.col("doc_id") % 5).cast("int"))
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80)
    basis = F.lower(normalize_whitespace(F.col("text")))
    docs = texts(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.substring("source", 4, 10).cast("int").alias("source_id"),
        F.lit(None).cast("bigint").alias("story_id"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("g"), (F.col("doc_id") % 400).cast("string"))).alias("guid"),
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string")
        ).alias("canonical_url"),
        title.alias("title"),
        F.col("text").alias("content"),
        excerpt(F.col("text")).alias("excerpt"),
        F.when(F.col("doc_id") % 7 != 0, fetched - shift).alias("published_at"),
        fetched.alias("fetched_at"),
        content_hash(basis).alias("content_hash"),
        simhash(F.col("text")).alias("simhash"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def latest_fetch(spark: SparkSession, folder: str) -> str:
    """The latest fetch time of ``articles`` as text; answered from file footers."""
    last = table(spark, folder, "documents").agg(F.max("doc_id").alias("n"))
    return last.select(minutes_after(F.col("n") * STEP_MINUTES).cast("string")).first()[0]


def placed_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with a simple story assignment, for the listing queries."""
    story = F.when(F.col("id") % 11 != 0, F.col("id") - F.col("id") % 7)
    return articles(spark, folder).withColumn("story_id", story)


def stories(spark: SparkSession, folder: str) -> DataFrame:
    """Story rows that go with ``placed_articles``; every third of them is empty."""
    placed = placed_articles(spark, folder)
    sizes = placed.filter("story_id is not null").groupBy("story_id").agg(F.count("*").alias("n"))
    seeds = placed.filter("id % 7 = 0").select("id", "title", "fetched_at")
    return seeds.join(sizes, F.col("id") == F.col("story_id")).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.col("title")).alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("array<float>").alias("centroid"),
        F.when(F.col("id") % 21 == 0, 0).otherwise(F.col("n")).cast("int").alias("article_count"),
        F.col("fetched_at").alias("first_seen_at"),
        F.col("fetched_at").alias("updated_at"),
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """One row per source of the documents."""
    ids = table(spark, folder, "documents").select(
        F.substring("source", 4, 10).cast("bigint").alias("id")
    ).distinct()
    return ids.select(
        "id",
        F.concat(F.lit("src"), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("https://src"), F.col("id").cast("string"), F.lit(".example.com/rss")).alias("feed_url"),
        F.concat(F.lit("https://src"), F.col("id").cast("string"), F.lit(".example.com")).alias("site_url"),
        (F.col("id") % 7 != 6).alias("active"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("old"), F.col("id").cast("string"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit(None).cast("timestamp_ntz").alias("last_fetched_at"),
        F.when(F.col("id") % 4 == 0, "old error").alias("last_error"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
    )


def escape_xml(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def landed_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """A feed response per page: RSS for even pages, Atom for odd ones, some failures.

    Pages 1 and 2 of every 20 do not parse, and page 14 has no items.
    """
    page = F.col("page_id")
    items = raw_items(spark, folder).withColumn("page_id", F.col("ord"))
    title, link, html = escape_xml(F.col("title")), escape_xml(F.col("url")), escape_xml(F.col("content"))
    number = page.cast("string")
    when = minutes_after(page * 10)
    rss = F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title> '),
        title,
        F.lit(" </title>"),
        F.when(page % 4 == 0, F.concat(F.lit("<link>"), link, F.lit("</link>"))).otherwise(""),
        F.when(page % 3 == 0, "<guid>").otherwise('<guid isPermaLink="false">'),
        link, F.lit("</guid><dc:creator>c"), number,
        F.lit("</dc:creator><dc:creator>second</dc:creator><content:encoded>"),
        html,
        F.lit("</content:encoded><pubDate>"),
        F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(" GMT</pubDate></item><item><title>no address</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'),
        title,
        F.lit('</title><link rel="self" href="https://self.example.com/"/><link rel="alternate" href="'),
        link, F.lit('"/><id>id'), number, F.lit("</id><author><name>a"), number,
        F.lit("</name></author><author><name>second</name></author>"),
        F.when(page % 20 == 11, F.concat(F.lit('<content type="xhtml"><div>hello <b>w'), number, F.lit("</b></div>")))
        .otherwise(F.concat(F.lit('<content type="html">'), html)),
        F.lit("</content><published>"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("Z</published></entry></feed>"),
    )
    # Two kinds of bodies that do not parse, and a feed without items.
    rss = F.when(page % 20 == 2, F.substr(rss, F.lit(1), F.length(rss) - 40)).otherwise(rss)
    rss = F.when(page % 20 == 14, '<rss version="2.0"><channel><title>none</title></channel></rss>').otherwise(rss)
    atom = F.when(page % 20 == 1, F.replace(atom, F.lit("<author>"), F.lit("a & b<author>"))).otherwise(atom)
    status = (
        F.when(page % 10 == 3, 304).when(page % 10 == 7, 404).when(page % 10 == 9, 500).otherwise(200)
    )
    return items.select(
        F.col("source_id").cast("bigint").alias("source_id"),
        page.alias("seq"),
        F.concat(F.lit("https://src"), F.col("source_id").cast("string"), F.lit(".example.com/rss")).alias("feed_url"),
        status.alias("status"),
        F.when(page % 4 != 1, F.concat(F.lit("e"), number)).alias("etag"),
        F.when(page % 3 == 0, F.concat(F.lit("m"), number)).alias("last_modified"),
        F.when(status == 200, F.when(page % 2 == 0, rss).otherwise(atom)).alias("body"),
    )


def triaged(spark: SparkSession, folder: str) -> DataFrame:
    return triage(landed_fetches(spark, folder))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Saved searches made of the words of the benchmark texts."""
    item = F.col("item_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("none")) for i in range(3)]
    raw = F.array_join(F.slice(F.split("text", r"\s+", -1), 3, 3), " ")
    kind = item % 6
    # Some are longer than what a search box takes, with what matters at the end.
    query = (
        F.when(item % 12 == 0, F.concat(F.repeat(F.lit("qqzzxx OR "), 80), w[0]))
        .when(item % 12 == 6, F.concat(F.repeat(F.concat(w[0], F.lit(" ")), F.lit(130)), F.lit("-"), w[1]))
        .when(item % 12 == 7, F.concat(F.repeat(F.lit("qqzzxx OR "), 80), F.lit('"'), raw, F.lit('"')))
        .when(kind == 0, F.concat_ws(" ", w[0], w[1]))
        .when(kind == 1, F.concat(F.lit('"'), raw, F.lit('"')))
        .when(kind == 2, F.concat(w[0], F.lit(" OR "), w[1], F.lit(" "), w[2]))
        .when(kind == 3, F.concat(w[0], F.lit(" -"), w[1]))
        .when(kind == 4, F.concat(F.lit("-"), w[0], F.lit(" -"), w[1]))
        .otherwise("  the and  ")
    )
    return table(spark, folder, "benchmark").select(
        item.alias("id"),
        F.concat(F.lit("alert "), item.cast("string")).alias("name"),
        query.alias("query"),
        F.lit("inbox").alias("channel"),
        F.lit(None).cast("string").alias("target"),
        (item % 5 != 4).alias("active"),
        F.lit(None).cast("timestamp_ntz").alias("last_run_at"),
        minutes_after(item).alias("created_at"),
    )


def earlier_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches already recorded: one alert per document, many for alert 0."""
    docs = table(spark, folder, "documents")
    alert = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 17)
    return docs.select(
        alert.cast("bigint").alias("alert_id"),
        F.col("doc_id").alias("article_id"),
        minutes_after(F.col("doc_id") % 50).alias("matched_at"),
        F.lit(False).alias("notified"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The given embeddings as articles; two of three already have a story."""
    vec = F.col("vec_id")
    at = minutes_after(vec * 10)
    return table(spark, folder, "embeddings").select(
        vec.alias("id"),
        F.when(vec % 3 != 0, vec % 40).alias("story_id"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        at.alias("fetched_at"),
        "embedding",
    )
