"""The summary query holds no story whole."""

from pyspark.sql import functions as F

from storyloom import hooks
from storyloom.plans.queries import QUERIES
from storyloom.tables import placed_within

SMALL = "/root/testdata/sf0.001"


def test_summary_query_reads_stories_in_parts(spark, monkeypatch):
    whole, in_parts, used = hooks.summarize_stories, hooks.summarize_in_parts, []

    def watched(articles, partial, combine):
        used.append(articles)
        # Small parts, so that several levels are combined.
        return in_parts(articles, partial, combine, part_rows=4)

    monkeypatch.setattr(hooks, "summarize_in_parts", watched)
    got = {r.story_id: r.summary for r in QUERIES["u03_summary_hook"](spark, SMALL).collect()}
    assert len(used) == 1
    wanted = whole(used[0], lambda pairs: "; ".join(title[:10] for title, _ in pairs))
    assert got == {r.story_id: r.summary for r in wanted.collect()} and got


def test_places_of_a_crowded_key_are_found_over_ranges(spark):
    rows = spark.range(2_000).selectExpr(
        "if(id % 3 = 0, 7, if(id % 50 = 1, null, id % 40)) as story_id", "(id * 37) % 500 as at", "id"
    )
    # Nine ranges, as small as the table is.
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    earlier = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = placed_within(rows, "story_id", ["at", "id"])
        got = {r.id: (r.story_id, r.place) for r in found.collect()}
        # Of the key with a third of all rows, no range holds more than a share.
        ranges = rows.repartitionByRange("story_id", "at", "id").withColumn("r", F.spark_partition_id())
        assert ranges.filter("story_id = 7").select("r").distinct().count() >= 3
    finally:
        for name, value in earlier.items():
            spark.conf.set(name, value)
    members = {}
    for r in rows.collect():
        members.setdefault(r.story_id, []).append((r.at, r.id))
    assert got == {i: (s, n) for s, m in members.items() for n, (_, i) in enumerate(sorted(m))}


def test_runs_of_a_story_cross_batches(spark):
    """Small Arrow batches, stories of one article to many, an order found by time then id."""
    rows = spark.range(300).selectExpr(
        "if(id % 2 = 0, 1, id % 40) as story_id", "id", "concat('t', id) as title", "'c' as content",
        "cast(null as timestamp) as published_at", "timestamp_seconds((id * 37) % 100) as fetched_at",
    )
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        found = hooks.summarize_in_parts(rows, lambda pairs: ";".join(t for t, _ in pairs), ";".join, part_rows=5)
        got = {r.story_id: r.summary for r in found.collect()}
    finally:
        spark.conf.set(name, before)
    wanted = hooks.summarize_stories(rows, lambda pairs: ";".join(t for t, _ in pairs))
    assert got == {r.story_id: r.summary for r in wanted.collect()}


def test_summaries_call_the_hook_without_a_group_per_story(spark):
    """A group costs milliseconds of Python each, so runs are cut inside a task's batches."""
    rows = spark.range(20).selectExpr(
        "id % 9 as story_id", "id", "'t' as title", "'c' as content",
        "cast(null as timestamp) as published_at", "timestamp_seconds(id) as fetched_at",
    )
    seen = []
    whole = hooks.written
    try:
        hooks.written = lambda df, name: seen.append(df._jdf.queryExecution().toString()) or whole(df, name)
        hooks.summarize_in_parts(rows, lambda pairs: "x", "".join).collect()
    finally:
        hooks.written = whole
    assert seen and not any("FlatMapGroupsInPandas" in plan for plan in seen)
