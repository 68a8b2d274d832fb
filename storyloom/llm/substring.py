"""Substring dedup by sliding sentence spans (op 6)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import table
from storyloom.tables import lookup, written

# A span is at least so many sentences and so many words.
SENTENCES = 3
WORDS = 15
# A sentence ends at a mark followed by white space, or at a line end.  Clauses count:
# a passage copied from the middle of a long sentence still holds whole ones.
BREAK = re.compile(r"(?<=[.!?,;:])\s+|\s*\n\s*|(?<=[。！？])")
SEED = 1


def starts_of(text: str) -> list[int]:
    """Where sentences start; each one reaches to the next, white space included."""
    return [0, *(m.end() for m in BREAK.finditer(text) if m.end() < len(text))]


def spans_of(text: str, sentences: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, words) of the shortest span from every sentence."""
    starts = starts_of(text)
    parts = [text[a:b].encode().lower().split() for a, b in zip(starts, [*starts[1:], len(text)])]
    sizes = np.cumsum([0, *map(len, parts)])
    # A span needs enough words and enough sentences that have any.
    filled = np.cumsum([0, *(bool(p) for p in parts)])
    enough = np.maximum(
        np.searchsorted(sizes, sizes[:-1] + words), np.searchsorted(filled, filled[:-1] + sentences)
    ).tolist()
    lines = [b" ".join(p) for p in parts]
    return [
        (i, end, b" ".join(filter(None, lines[i:end])))
        for i, end in enumerate(enough)
        if end <= len(parts) and parts[i]
    ]


@F.arrow_udf(T.ArrayType(T.LongType()))
def span_hashes(texts: pa.Array) -> pa.Array:
    """Hash of the span that starts at each sentence, null where none does."""
    found = []
    for text in texts.fill_null("").to_pylist():
        spans = {i: xxhash.xxh64_intdigest(line, SEED) - (1 << 63) for i, _, line in spans_of(text)}
        found.append([spans.get(i) for i in range(max(spans, default=-1) + 1)])
    return pa.array(found, pa.list_(pa.int64()))


@F.arrow_udf(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("sentences", T.IntegerType()), T.StructField("removed", T.IntegerType())])
)
def without_spans(texts: pa.Array, repeated: pa.Array) -> pa.Array:
    """The text without the sentences of the spans that start at the given sentences."""
    kept, counts, removed = [], [], []
    for text, firsts in zip(texts.to_pylist(), repeated.to_pylist()):
        starts = starts_of(text or "")
        gone = np.zeros(len(starts), bool)
        if firsts:
            ends = {i: end for i, end, _ in spans_of(text)}
            for first in firsts:
                gone[first : ends[first]] = True
            pieces = zip(starts, [*starts[1:], len(text)], gone)
            text = "".join([text[a:b] for a, b, out in pieces if not out]).rstrip()
        kept.append(text)
        counts.append(len(starts) if text or firsts else 0)
        removed.append(int(gone.sum()))
    columns = [pa.array(kept, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.int32())]
    return pa.StructArray.from_arrays(columns, names=["text", "sentences", "removed"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, firsts, sources: where the repeated spans of a text start, and whose they are.

    The first of equal spans, by (doc_id, hash of the text, place), is not
    repeated.  Rows equal in id and text are one document; null ids come first.
    Only hashes that occur twice meet their places, through a join that can be
    split where one span is everywhere.
    """
    unit = ["doc_id", "text_hash"]
    spans = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), span_hashes("text").alias("spans"))
    spans = written(spans, "spans")
    places = spans.select(*unit, F.posexplode("spans").alias("place", "span")).filter("span is not null")
    twice = places.groupBy("span").count().filter("count > 1").select("span")
    met = written(lookup(places, twice, "span"), "spans-twice")
    own = F.struct(*unit, "place")
    first = met.groupBy("span").agg(F.min(own).alias("first"))
    again = lookup(met, first, "span", "inner").filter(~own.eqNullSafe(F.col("first")))
    return again.groupBy(*unit).agg(
        F.array_sort(F.collect_set("place")).alias("firsts"),
        F.array_sort(F.collect_set("first.doc_id")).alias("sources"),
    )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """row, text, sentences, removed, sources of every row of ``docs``.

    ``row`` holds the columns of ``docs``, ``text`` lacks every sentence that a
    repeated span covers, ``sources`` are the ids where those spans stay.  A text
    without repeated spans is unchanged, null included; one that is all copies
    becomes empty.
    """
    found = written(repeated_spans(docs.select("doc_id", "text")), "spans-repeated")
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash"))
    joined = rows.join(found, same, "left")
    cut = joined.withColumn("cut", without_spans("row.text", "firsts"))
    return cut.select("row", "cut.text", "cut.sentences", "cut.removed", "sources")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without spans that repeat earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("row.doc_id", "sentences", "removed", "sources", "text")
