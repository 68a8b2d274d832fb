"""Landed feeds, the feed table and listing views."""

from datetime import datetime

from pyspark.sql import functions as F

from storyloom import hooks
from storyloom.operators.articles import article_rows, ingest_stats
from storyloom.plans import views
from storyloom.sources import feeds, registry

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"
 xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed</title>
<item><title> One </title><link> https://a.com/1 </link><guid isPermaLink="false">g1</guid><dc:creator>Ann</dc:creator>
 <description>short</description><content:encoded><![CDATA[<p>long &amp; full</p>]]></content:encoded>
 <pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><guid>https://a.com/2</guid><description>only description</description><pubDate>soon</pubDate></item>
<item><title>no address</title></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><title>Two</title><id>tag:1</id><link rel="self" href="https://a.com/self"/><link href="https://a.com/3"/>
 <author><name>Bob</name></author><updated>2024-01-02T03:04:05Z</updated><summary>sum</summary></entry>
<entry><title>Nowhere</title></entry></feed>"""

FETCHES = [
    (1, 1, 200, "e1", "m1", RSS),
    (2, 1, 304, None, None, None),
    (3, 1, 404, "x", None, None),
    (1, 2, 500, "bad", "bad", None),
    (4, 1, 200, None, None, "<html>not a feed</html>"),
    (5, 1, 200, None, "m5", ATOM),
]


def fetches(spark):
    df = spark.createDataFrame(
        FETCHES, "source_id long, seq int, status int, etag string, last_modified string, body string"
    )
    return feeds.triage(df.withColumn("feed_url", F.concat(F.lit("f"), F.col("source_id").cast("string"))))


def test_feed_items(spark):
    bodies = fetches(spark).filter("outcome = 'fetched'").select("source_id", "body")
    items = feeds.feed_items(bodies).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    got = [tuple(r) for r in items.orderBy("source_id", "position").collect()]
    assert got == [
        (1, 0, "g1", "https://a.com/1", "One", "Ann", "<p>long &amp; full</p>", datetime(2024, 1, 1, 10)),
        (1, 1, "https://a.com/2", "https://a.com/2", "(untitled)", None, "only description", None),
        (5, 0, "tag:1", "https://a.com/3", "Two", "Bob", "sum", datetime(2024, 1, 2, 3, 4, 5)),
    ]


def test_a_body_is_parsed_once(spark):
    triaged = fetches(spark)
    items = feeds.feed_items(triaged.filter("outcome = 'fetched'").select("source_id", "feed"))
    raw = feeds.feed_items(fetches(spark).filter("outcome = 'fetched'").select("source_id", "body"))
    for plan in (items, triaged.select("outcome", "error")):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert items.collect() == raw.collect()


def test_triage_and_stats(spark):
    rows = fetches(spark)
    got = {(r.source_id, r.seq): (r.outcome, r.error) for r in rows.collect()}
    assert got == {
        (1, 1): ("fetched", None),
        (2, 1): ("not_modified", None),
        (3, 1): ("error", "HTTP 404 fetching f3"),
        (1, 2): ("error", "HTTP 500 fetching f1"),
        (4, 1): ("error", "not a feed"),
        (5, 1): ("fetched", None),
    }
    sources = spark.createDataFrame([(1, True), (2, True), (9, False)], "id long, active boolean")
    items = spark.createDataFrame([(1, True), (1, False), (5, True)], "source_id long, accepted boolean")
    assert tuple(ingest_stats(sources, rows, items).first()) == (2, 2, 1, 2, 1, 3)


SOURCES = (
    "id long, name string, feed_url string, site_url string, active boolean, etag string, "
    "last_modified string, last_fetched_at timestamp_ntz, last_error string, created_at timestamp_ntz"
)


def test_upsert_and_fetch_state(spark):
    sources = spark.createDataFrame(
        [(1, "a", "f1", "s1", False, "old", "oldm", None, "err", None), (2, "b", "f2", None, True, "keep", None, None, "err", None)],
        SOURCES,
    )
    incoming = spark.createDataFrame(
        [(1, "x", "f1", "new"), (2, "n1", "f3", "first"), (3, "n2", "f3", "second")],
        "ord int, name string, feed_url string, site_url string",
    )
    after = {r.feed_url: r for r in registry.upsert_sources(sources, incoming).collect()}
    assert (after["f1"].name, after["f1"].site_url, after["f1"].active, after["f1"].id) == ("x", "s1", False, 1)
    assert (after["f3"].name, after["f3"].site_url, after["f3"].active) == ("n2", "first", True)
    assert after["f2"].name == "b" and len(after) == 3
    assert [r.name for r in registry.list_sources(sources, active_only=True).collect()] == ["b"]

    state = {r.id: r for r in registry.update_fetch_state(sources, fetches(spark), "2024-05-01 00:00:00").collect()}
    # The error after the success keeps the validators and replaces the error.
    assert (state[1].etag, state[1].last_modified, state[1].last_error) == ("e1", "m1", "HTTP 500 fetching f1")
    assert (state[2].etag, state[2].last_error, state[2].last_fetched_at) == ("keep", None, datetime(2024, 5, 1))


def test_article_rows(spark):
    items = spark.createDataFrame(
        [("T &amp; x", "<p>Body  text</p><script>no()</script>", "HTTPS://www.A.com/x/?utm_a=1")],
        "title string, content string, url string",
    )
    row = article_rows(items).first()
    assert (row.content, row.excerpt, row.canonical_url) == ("Body text", "Body text", "https://a.com/x")
    import hashlib

    assert row.content_hash == hashlib.sha256(b"t &amp; x body text").hexdigest()
    assert row.lang is None and row.simhash != 0


def story_tables(spark):
    base = "2024-01-01 00:00:00"
    rows = spark.createDataFrame(
        [(1, 10, 0, 1, "t1"), (2, 10, 1, 5, "t2"), (3, 10, 0, 5, "t3"), (4, 20, 1, 2, "t4"), (5, None, 0, 9, "t5")],
        "id long, story_id long, source_id long, h int, title string",
    )
    at = F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(hours="h")
    articles = rows.withColumns(
        {"published_at": F.lit(None).cast("timestamp_ntz"), "fetched_at": at, "content": F.concat(F.lit("c"), F.col("title")),
         "excerpt": F.concat(F.lit("x"), F.col("title"))}
    ).drop("h")
    stories = spark.createDataFrame(
        [(10, "s10", 3), (20, "s20", 1), (30, "empty", 0), (40, "lost", 2)], "id long, title string, article_count int"
    )
    sources = spark.createDataFrame([(0, "zero", "z"), (1, "one", "o")], "id long, name string, site_url string")
    return articles, stories, sources


def test_story_views(spark):
    articles, stories, sources = story_tables(spark)
    rows = views.list_stories(stories, articles).collect()
    assert [(r.id, r.source_count, r.excerpt) for r in rows] == [(10, 2, "xt3"), (20, 1, "xt4"), (40, 0, None)]
    assert [r.id for r in views.list_stories(stories, articles, 1, 1).collect()] == [20]
    assert [r.id for r in views.story_articles(articles, sources, 10).collect()] == [1, 2, 3]
    names = views.story_sources(articles, sources).filter("story_id = 10").orderBy("first_at").collect()
    assert [r.source_name for r in names] == ["zero", "one"]
    assert [r.id for r in views.recent_articles(articles, sources, 2, 1).collect()] == [2, 3]
    assert {r.kind for r in views.home_feed(stories, articles, sources).collect()} == {"story"}
    assert {r.kind for r in views.home_feed(stories.filter("id = 30"), articles, sources).collect()} == {"article"}
    assert {r.story_id: r.summary for r in views.lead_summaries(articles).collect()} == {10: "t1. ct1", 20: "t4. ct4"}


def test_hooks(spark):
    articles, _, _ = story_tables(spark)
    assert hooks.extract_facts(articles).isEmpty()
    assert {r.summary for r in hooks.summarize_stories(articles).collect()} == {"t1. ct1", "t4. ct4"}
    joined = {r.story_id: r.summary for r in hooks.summarize_stories(articles, lambda p: "|".join(t for t, _ in p)).collect()}
    assert joined == {10: "t1|t2|t3", 20: "t4"}


def test_summary_of_a_large_story_reads_every_article_in_order(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(300).select(
        (299 - F.col("id")).alias("id"), F.lit(1).cast("long").alias("story_id"), at.alias("published_at"),
        at.alias("fetched_at"), F.concat(F.lit("t"), (299 - F.col("id")).cast("string")).alias("title"), F.lit("1").alias("content"),
    )
    titles = " ".join(f"t{i}" for i in range(300))

    def joined(pairs):
        return " ".join(title for title, _ in pairs)

    assert [r.summary for r in hooks.summarize_stories(rows, joined).collect()] == [titles]
    parts = hooks.summarize_in_parts(rows, joined, " ".join, part_rows=7)
    assert [r.summary for r in parts.collect()] == [titles]
