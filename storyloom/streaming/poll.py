"""The polling cycle as a Structured Streaming query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storyloom.functions.dates import effective_time, hours_before
from storyloom.operators.alerts import run_alerts, stamp_runs
from storyloom.operators.articles import article_rows
from storyloom.operators.cluster import assign_stories
from storyloom.operators.dedup import decide, recent
from storyloom.operators.embed import Embedder, backfill_embeddings, hash_embedding
from storyloom.operators.search import postings
from storyloom.settings import (
    CLUSTER_THRESHOLD,
    CLUSTER_WINDOW_HOURS,
    DEDUP_WINDOW_HOURS,
    HAMMING_THRESHOLD,
)
from storyloom.sources.store import Store
from storyloom.streaming.state import story_rows, touched_stories
from storyloom.tables import dealt, lookup, written

_TYPES = {
    "bigint": T.LongType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "vector": T.ArrayType(T.FloatType()),
    "places": T.ArrayType(T.IntegerType()),
    "sums": T.ArrayType(T.DoubleType()),
    "counts": T.ArrayType(T.LongType()),
}


def _schema(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ITEMS = _schema(
    """
    ord bigint, source_id bigint, guid string, url string, title string, author string,
    content string, published_at timestamp, fetched_at timestamp
    """
)
ARTICLES = _schema(
    """
    id bigint, ord bigint, source_id bigint, guid string, url string, canonical_url string,
    title string, author string, content string, excerpt string, lang string,
    published_at timestamp, fetched_at timestamp, content_hash string, simhash bigint,
    embedding vector
    """
)
ASSIGNMENTS = _schema("id bigint, story_id bigint, seeded boolean, fetched_at timestamp")
POSTINGS = _schema(
    "lex string, article_id bigint, title_tf int, body_tf int, positions places, fetched_at timestamp"
)
MATCHES = _schema(
    "alert_id bigint, article_id bigint, matched_at timestamp, notified boolean"
)
# Fetch times of every batch so far, by which reads of a window choose batches.
SPANS = _schema("batch bigint, first timestamp, last timestamp")
# Ids about to be placed: those of a batch that was interrupted are found here.
PENDING = _schema("id bigint")
STORIES = _schema(
    """
    id bigint, title string, first_seen_at timestamp, article_count bigint, first_at timestamp,
    first_id bigint, first_title string, sums sums, counts counts, updated_at timestamp
    """
)
ALERT_RUNS = _schema("id bigint, last_run_at timestamp")

# Batches between two snapshots of the story rows.
SNAPSHOT_EVERY = 32


def article_id(url: Column) -> Column:
    """60 bits of the SHA-256 of the address."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 15), 16, 10).cast("bigint")


class PollCycle:
    """One tick: de-duplicate and store items, place them in stories, run alerts.

    State is the stored tables and their look-back windows, nothing else, so a
    replayed batch finds the same state and overwrites its own output.  A batch that
    was interrupted and is never replayed leaves articles without a story; later
    batches place them, however old they are.

    ``alerts`` is a table, or a function that reads the present one.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        alerts: DataFrame | Callable[[], DataFrame],
        embed: Embedder = hash_embedding,
        dedup_hours: float = DEDUP_WINDOW_HOURS,
        hamming_threshold: int = HAMMING_THRESHOLD,
        cluster_hours: float | None = CLUSTER_WINDOW_HOURS,
        cluster_threshold: float = CLUSTER_THRESHOLD,
        snapshot_every: int = SNAPSHOT_EVERY,
    ):
        self.store = Store(spark, root)
        self.snapshot_every = snapshot_every
        self.spark = spark
        self.alerts = alerts
        self.embed = embed
        self.dedup_hours = dedup_hours
        self.hamming_threshold = hamming_threshold
        self.cluster_hours = cluster_hours
        self.cluster_threshold = cluster_threshold

    def articles(self, before: int | None = None) -> DataFrame:
        return self.store.read("articles", ARTICLES, before)

    def assignments(self, before: int | None = None) -> DataFrame:
        return self.store.read("assignments", ASSIGNMENTS, before)

    def matches(self, before: int | None = None) -> DataFrame:
        return self.store.read("matches", MATCHES, before)

    def stories(self, before: int | None = None) -> DataFrame:
        """Story rows, from stored sums; members are not read."""
        return story_rows(self.story_state(before))

    def story_state(self, before: int | None = None) -> DataFrame:
        """Rows of batches whose articles were not placed to the end do not count."""
        return self.store.latest("stories", STORIES, "id", before, counted="assignments")

    def alert_table(self, before: int | None = None) -> DataFrame:
        """The alerts with the time of their last run."""
        alerts = self.alerts() if callable(self.alerts) else self.alerts
        own = F.col("last_run_at").cast("timestamp") if "last_run_at" in alerts.columns else F.lit(None).cast("timestamp")
        runs = self.store.read("alert_runs", ALERT_RUNS, before)
        last = runs.groupBy("id").agg(F.max("last_run_at").alias("ran"))
        return alerts.join(last, "id", "left").withColumn("last_run_at", F.coalesce("ran", own)).drop("ran")

    def window(self, table: str, schema: T.StructType, now: str, hours: float | None, before: int) -> DataFrame:
        """Rows of earlier batches fetched within the window; other batches are not opened."""
        if hours is None:
            return self.store.read(table, schema, before)
        since = hours_before(now, hours, T.TimestampType())
        batches = [r.batch for r in self.spans(before).filter(F.col("last") > since).select("batch").collect()]
        return recent(self.store.read(table, schema, only=batches), now, hours)

    def spans(self, before: int) -> DataFrame:
        """One row per earlier batch; each batch writes them all anew, so one file is read."""
        known = [n for n in self.store.finished("spans") if n < before]
        return self.store.read("spans", SPANS, only=[max(known)] if known else [])

    def unplaced(self, before: int) -> DataFrame:
        """Ids of articles that earlier batches stored and no batch placed, of any age."""
        started, ended = self.store.finished("pending"), self.store.finished("assignments")
        open_batches = {n for n in started - ended if n < before}
        if not open_batches:
            return self.spark.createDataFrame([], PENDING)
        # An open batch was placed, if at all, by a later one.
        later = [n for n in ended if min(open_batches) < n < before]
        done = self.store.read("assignments", ASSIGNMENTS, only=later).select("id")
        return self.store.read("pending", PENDING, only=open_batches).distinct().join(done, "id", "left_anti")

    def run(self, items: DataFrame, batch_id: int) -> None:
        """Process one batch; its own latest fetch time is the present.

        Of the stored tables only key columns are read in full; everything else
        is limited to this batch, the batches of the look-back windows and the
        stories that are touched.
        """
        # A landed file is often one row group, which one task would parse alone.
        items = written(dealt(items.select(*ITEMS.fieldNames())), "poll-items")
        span = items.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))
        now = span.select(F.col("last").cast("string")).first()[0]
        if now is None:
            return
        span = span.select(F.lit(batch_id).cast("bigint").alias("batch"), "first", "last")
        self.store.write("spans", batch_id, self.spans(batch_id).unionByName(span).coalesce(1))
        self.store_articles(items, batch_id, now)
        self.place(batch_id, now)
        self.match(batch_id, now)

    def store_articles(self, items: DataFrame, batch_id: int, now: str) -> None:
        rows = written(article_rows(items), "poll-rows")
        decided = decide(rows, self.articles(batch_id), now, self.dedup_hours, self.hamming_threshold)
        accepted = decided.filter("accepted").withColumns(
            {"id": article_id(F.col("canonical_url")), "embedding": F.lit(None).cast("array<float>")}
        )
        accepted = written(accepted, "poll-accepted")
        # Ids first: what is interrupted after this line is found by ``unplaced``.
        self.store.write("pending", batch_id, accepted.select("id"))
        embedded = backfill_embeddings(accepted, self.embed)
        self.store.write("articles", batch_id, embedded.select(*ARTICLES.fieldNames()))

        # Reading back keeps the steps above out of the plans of the next ones.
        fresh = self.store.read("articles", ARTICLES, only=batch_id)
        self.store.write("postings", batch_id, postings(fresh, "fetched_at"))

    def place(self, batch_id: int, now: str) -> None:
        """Put new articles, and those an interrupted batch left behind, into stories."""
        fresh = self.store.read("articles", ARTICLES, only=batch_id)
        earlier = self.window("articles", ARTICLES, now, self.cluster_hours, batch_id)
        placed = self.window("assignments", ASSIGNMENTS, now, self.cluster_hours, batch_id)
        in_play = earlier.unionByName(fresh).join(placed.select("id", "story_id"), "id", "left")
        left = self.unplaced(batch_id)
        if not left.isEmpty():
            # Within the window they are in play anyway, and may have been placed since.
            swept = lookup(self.articles(batch_id), left.select("id").distinct(), "id")
            old = swept.join(in_play.select("id"), "id", "left_anti")
            in_play = in_play.unionByName(old.withColumn("story_id", F.lit(None).cast("bigint")))
        in_play = written(in_play.select("id", "story_id", "title", "published_at", "fetched_at", "embedding"), "poll-in-play")
        assigned = written(assign_stories(in_play, now, self.cluster_hours, self.cluster_threshold), "poll-assigned")
        members = assigned.join(in_play.drop("story_id").withColumn("at", effective_time()), "id")
        self.store.write("stories", batch_id, touched_stories(self.story_state(batch_id), members, now))
        self.store.write("assignments", batch_id, members.select(*ASSIGNMENTS.fieldNames()))
        if (batch_id + 1) % self.snapshot_every == 0:
            self.store.snapshot("stories", STORIES, "id", batch_id, counted="assignments")

    def match(self, batch_id: int, now: str) -> None:
        """Run the alerts that are active now, and note when they ran."""
        alerts = written(self.alert_table(batch_id), "poll-alerts")
        index = self.window("postings", POSTINGS, now, self.dedup_hours, batch_id + 1)
        found = run_alerts(
            alerts,
            self.window("articles", ARTICLES, now, self.dedup_hours, batch_id + 1),
            # An article of the window was matched no earlier than it was fetched.
            self.recent_matches(now, batch_id),
            now,
            self.dedup_hours,
            index=index.drop("fetched_at"),
        )
        self.store.write("matches", batch_id, found)
        stamped = stamp_runs(alerts, now).filter("active")
        self.store.write("alert_runs", batch_id, stamped.select("id", "last_run_at"))

    def recent_matches(self, now: str, before: int) -> DataFrame:
        since = hours_before(now, self.dedup_hours, T.TimestampType())
        return self.matches(before).filter(F.col("matched_at") > since)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run the cycle on all available input; one query never overlaps itself."""
        return (
            stream.writeStream.foreachBatch(self.run)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def read_items(
    spark: SparkSession, path: str, schema: T.StructType = ITEMS, max_files: int | None = None
) -> DataFrame:
    """Landed items as a stream of parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def drop_recent_repeats(stream: DataFrame, keys: list[str], hours: float = DEDUP_WINDOW_HOURS) -> DataFrame:
    """Cheap exact pre-filter within the look-back; the history check still follows."""
    return stream.withWatermark("fetched_at", f"{int(hours)} hours").dropDuplicatesWithinWatermark(keys)
