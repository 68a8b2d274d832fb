"""Places where a user plugs in models: facts and summaries.

Embedders are plain column functions, see ``storyloom.operators.embed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.dates import effective_time
from storyloom.plans.views import lead_summaries
from storyloom.tables import placed_within, written

FACTS = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("confidence", T.FloatType()),
    ]
)

# Rows and bytes of text that a summary task turns into Python values at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

FactBatches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def extract_facts(articles: DataFrame, extractor: FactBatches | None = None) -> DataFrame:
    """Facts of every article; without an extractor there are none.

    The extractor sees batches of (article_id, title, content), so a model is
    loaded once per task.
    """
    if extractor is None:
        return articles.sparkSession.createDataFrame([], FACTS)
    texts = articles.select(F.col("id").alias("article_id"), "title", "content")
    return texts.mapInPandas(extractor, FACTS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream of batches, a few and little text at a time."""
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(ends):
            held = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, held + BATCH_BYTES, side="right")))
            end = min(end, start + BATCH_ROWS)
            yield batch.slice(start, end - start)
            start = end


Pairs = list[tuple[str, str]]


def summarize_stories(
    articles: DataFrame, summarizer: Callable[[Pairs], str] | None = None
) -> DataFrame:
    """(story_id, summary); by default the opening of the first article.

    A summarizer turns all (title, content) pairs of a story, oldest first, into
    one text.  It sees the story whole, so a task holds one story at a time: for
    stories whose size is bounded.  Use ``summarize_in_parts`` for all others.
    """
    if summarizer is None:
        return lead_summaries(articles)

    def one_text(story: pd.DataFrame) -> pd.DataFrame:
        story = story.sort_values(["at", "id"])
        text = summarizer(list(zip(story["title"], story["content"], strict=True)))
        return pd.DataFrame({"story_id": story["story_id"].iloc[:1], "summary": [text]})

    kind = articles.schema["story_id"].dataType.simpleString()
    return _members(articles).groupBy("story_id").applyInPandas(one_text, f"story_id {kind}, summary string")


def summarize_in_parts(
    articles: DataFrame,
    partial: Callable[[Pairs], str],
    combine: Callable[[list[str]], str],
    part_rows: int = 256,
) -> DataFrame:
    """(story_id, summary) for a summary that the user declares associative.

    ``partial`` turns a run of articles, oldest first, into a text, and
    ``combine`` texts of successive runs into one.  Every article is read, in
    order, and no group holds more than ``part_rows`` of them; the order itself is
    found over ranges, so no task sees the members of a large story whole.
    """
    rows = _members(articles)
    kind = articles.schema["story_id"].dataType.simpleString()
    # Ranked on narrow columns; the texts meet their part by id.
    places = placed_within(rows.select("story_id", "at", "id"), "story_id", ["at", "id"])
    places = written(places.select("id", "place"), "summary-places")
    runs = rows.join(places, "id").withColumn("part", F.floor(F.col("place") / part_rows))

    schema = f"story_id {kind}, part bigint, text string"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, partial)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, lambda texts: combine([text for (text,) in texts]))

    # Rows of a run follow each other in a task, which holds one run at a time.
    runs = runs.repartition("story_id", "part").sortWithinPartitions("story_id", "part", "place")
    texts = written(runs.select("story_id", "part", "title", "content").mapInArrow(first, schema), "summary-parts")
    while not texts.filter("part > 0").isEmpty():
        level = texts.withColumn("next", F.floor(F.col("part") / part_rows)).repartition("story_id", "next")
        level = level.sortWithinPartitions("story_id", "next", "part").select("story_id", "next", "text")
        texts = written(level.mapInArrow(more, schema), "summary-parts")
    return texts.select("story_id", F.col("text").alias("summary"))


def _runs(batches: Iterator[pa.RecordBatch], text: Callable[[list[tuple]], str]) -> Iterator[pa.RecordBatch]:
    """One row (story_id, part, text) per run of rows with equal first two columns.

    ``text`` sees the other columns of the run; a run may cross batches.
    """
    key, held, done, kind = None, [], [], None

    def packed() -> pa.RecordBatch:
        stories, parts, texts = zip(*done)
        columns = [pa.array(stories, kind), pa.array(parts, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["story_id", "part", "text"])

    for frame in _slices(batches):
        kind = frame.schema.field(0).type
        for story, part, *rest in zip(*(column.to_pylist() for column in frame.columns)):
            if (story, part) != key:
                if held:
                    done.append((*key, text(held)))
                key, held = (story, part), []
            held.append(tuple(rest))
        if done:
            yield packed()
            done.clear()
    if held:
        done.append((*key, text(held)))
        yield packed()


def _members(articles: DataFrame) -> DataFrame:
    return articles.filter("story_id is not null").select(
        "story_id", effective_time().alias("at"), "id", "title", "content"
    )
