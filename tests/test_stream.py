"""Micro-batches against the batch functions, and replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.plans.queries import QUERIES
from storyloom.sources.store import Store
from storyloom.streaming import poll


SHARED = " shared alpha beta gamma delta epsilon zeta eta theta"


def landed(spark):
    """Three batches: repeats inside a batch, across batches and by guid."""
    words = [f"story{i} " + " ".join(f"w{i}x{j}" for j in range(12)) + SHARED for i in range(5)]
    rows = []
    for i in range(15):
        kind = i % 7
        text = words[kind % 5] if kind < 5 else f"fresh{i} " + " ".join(f"f{i}y{j}" for j in range(12)) + SHARED
        rows.append((i, i % 3, f"g{i % 13}", f"https://a.com/{i % 11}?utm_x={i}", f"title {kind}", text, i))
    df = spark.createDataFrame(
        rows, "ord long, source_id long, guid string, url string, title string, content string, h int"
    )
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return df.select(
        "ord", "source_id", "guid", "url", "title", F.lit(None).cast("string").alias("author"), "content",
        F.lit(None).cast("timestamp").alias("published_at"),
        (base + F.make_dt_interval(hours="h")).alias("fetched_at"),
    )


def tables(cycle):
    return (
        sorted((r.ord, r.canonical_url) for r in cycle.articles().collect()),
        sorted((r.id, r.story_id) for r in cycle.assignments().collect()),
        sorted((r.alert_id, r.article_id) for r in cycle.matches().collect()),
    )


def check_stories(cycle):
    """Stored story rows against all members."""
    members = {}
    placed = cycle.articles().join(cycle.assignments().select("id", "story_id", "seeded"), "id")
    for r in placed.collect():
        members.setdefault(r.story_id, []).append(r)
    found = {r.id: r for r in cycle.stories().collect()}
    assert found.keys() == members.keys()
    for story, rows in members.items():
        seed = next(r for r in rows if r.seeded)
        assert (found[story].article_count, found[story].title) == (len(rows), seed.title)
        assert found[story].first_seen_at == (seed.published_at or seed.fetched_at)
        assert found[story].centroid == pytest.approx(np.mean([r.embedding for r in rows], axis=0).tolist(), abs=1e-6)


class Interrupted(Exception):
    pass


def interrupt_after(monkeypatch, cycle, table):
    """Let the cycle fail right after it has written ``table``."""
    write = Store.write

    def failing(self, name, batch_id, rows):
        write(self, name, batch_id, rows)
        if name == table and self is cycle.store:
            raise Interrupted

    monkeypatch.setattr(Store, "write", failing)


STORED = ("spans", "pending", "articles", "postings", "stories", "assignments", "matches", "alert_runs")


def contents(cycle):
    schemas = {
        "spans": poll.SPANS, "pending": poll.PENDING, "articles": poll.ARTICLES, "postings": poll.POSTINGS,
        "stories": poll.STORIES, "assignments": poll.ASSIGNMENTS, "matches": poll.MATCHES, "alert_runs": poll.ALERT_RUNS,
    }
    return {t: sorted(map(repr, cycle.store.read(t, schemas[t]).collect())) for t in STORED}


@pytest.mark.parametrize("table", ["articles", "stories", "matches"])
def test_replay_after_a_failure_between_tables(spark, tmp_path, monkeypatch, table):
    items = landed(spark).cache()
    alerts = spark.createDataFrame([(1, "story1 OR fresh5", True), (2, "-story0", True)], "id long, query string, active boolean")
    whole = poll.PollCycle(spark, str(tmp_path / "whole"), alerts, cluster_threshold=0.25)
    broken = poll.PollCycle(spark, str(tmp_path / "broken"), alerts, cluster_threshold=0.25)
    for batch in range(2):
        part = items.filter(f"ord div 5 = {batch}")
        whole.run(part, batch)
        if batch == 1:
            with monkeypatch.context() as patch:
                interrupt_after(patch, broken, table)
                with pytest.raises(Interrupted):
                    broken.run(part, batch)
        broken.run(part, batch)
    assert contents(broken) == contents(whole)


def shifted(rows, hours):
    return rows.withColumn("fetched_at", F.col("fetched_at") + F.make_dt_interval(hours=F.lit(hours)))


@pytest.mark.parametrize("table", ["articles", "stories"])
def test_articles_of_an_interrupted_batch_are_placed_later(spark, tmp_path, monkeypatch, table):
    """The next batch comes after the look-back has passed; the lost one is never replayed."""
    items = landed(spark).cache()
    alerts = spark.createDataFrame([(1, "story1", True)], "id long, query string, active boolean")
    cycle = poll.PollCycle(spark, str(tmp_path / "a"), alerts, cluster_threshold=0.25, snapshot_every=2)
    with monkeypatch.context() as patch:
        interrupt_after(patch, cycle, table)
        with pytest.raises(Interrupted):
            cycle.run(items.filter("ord < 5"), 0)
    lost = {r.id for r in cycle.articles().collect()}
    assert lost and cycle.assignments().isEmpty() and cycle.stories().isEmpty()
    assert {r.id for r in cycle.unplaced(1).collect()} == lost
    cycle.run(shifted(items.filter("ord between 5 and 9"), 200), 1)
    placed = [r.id for r in cycle.assignments().collect()]
    assert lost < set(placed) and len(placed) == len(set(placed)) == cycle.articles().count()
    check_stories(cycle)
    # Placed once: the next batch finds nothing left, and reads the snapshot of this one.
    assert cycle.unplaced(2).isEmpty()
    cycle.run(shifted(items.filter("ord >= 10"), 210), 2)
    assert cycle.assignments().count() == cycle.articles().count()
    assert cycle.store.finished("stories_snapshot") == {1}
    check_stories(cycle)


def test_a_window_opens_its_batches_only(spark, tmp_path):
    items = landed(spark).cache()
    alerts = spark.createDataFrame([(1, "story1", True)], "id long, query string, active boolean")
    cycle = poll.PollCycle(spark, str(tmp_path / "a"), lambda: alerts, cluster_threshold=0.25)
    for batch in range(3):
        cycle.run(shifted(items.filter(f"ord div 5 = {batch}"), 100 * batch), batch)
    now = "2024-01-05 14:00:00"
    batches = {f.split("batch_id=")[1].split("/")[0] for f in files_read(cycle.window("articles", poll.ARTICLES, now, 72, 3))}
    assert "1" in batches and "0" not in batches
    assert cycle.window("articles", poll.ARTICLES, now, None, 3).count() == cycle.articles().count()


def files_read(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_stream_equals_batches_and_replay_changes_nothing(spark, tmp_path):
    items = landed(spark).cache()
    alerts = spark.createDataFrame([(1, "story1 OR fresh5", True), (2, "-story0", True), (3, "title", False)], "id long, query string, active boolean")
    folder = str(tmp_path / "landed")
    for batch in range(3):
        items.filter(f"ord div 5 = {batch}").coalesce(1).write.mode("append").parquet(folder)
    streamed = poll.PollCycle(spark, str(tmp_path / "a"), alerts, cluster_threshold=0.25)
    stream = poll.read_items(spark, folder, max_files=1)
    streamed.start(stream, str(tmp_path / "progress")).awaitTermination()

    batched = poll.PollCycle(spark, str(tmp_path / "b"), alerts, cluster_threshold=0.25)
    for batch in range(3):
        batched.run(items.filter(f"ord div 5 = {batch}"), batch)
    want = tables(batched)
    assert tables(streamed) == want
    assert len(want[0]) < 15 and want[2]
    assert len({s for _, s in want[1]}) < len(want[1])
    stories = batched.stories().collect()
    assert sum(r.article_count for r in stories) == len(want[0])
    check_stories(batched)
    runs = {r.id: str(r.last_run_at) for r in batched.alert_table().collect()}
    assert runs == {1: "2024-01-01 14:00:00", 2: "2024-01-01 14:00:00", 3: "None"}
    batched.run(items.filter("ord div 5 = 2"), 2)
    assert tables(batched) == want
    assert sorted(batched.stories().collect()) == sorted(stories)


def test_prefilter_drops_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    items = landed(spark)
    items.union(items).write.parquet(folder)
    stream = poll.drop_recent_repeats(poll.read_items(spark, folder), ["url"])
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_prefilter_reads_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"text {n % 7}", "src1") for n in range(40)], "doc_id bigint, text string, source string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "whole"))
    (file,) = (tmp_path / "whole").glob("part-*.parquet")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "documents.parquet").write_bytes(file.read_bytes())
    for folder in ("many", "one"):
        assert QUERIES["r03_streaming_prefilter"](spark, str(tmp_path / folder)).count() == 7
