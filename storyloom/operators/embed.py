"""Lexical hash embeddings and vector arithmetic."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.hashing import flat_lists, list_slices
from storyloom.functions.text import content_tokens
from storyloom.settings import EMBEDDING_DIM

Embedder = Callable[[Column], Column]

# Words whose places a task remembers.
HELD_WORDS = 50_000


def hash_embedding(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Signed token counts hashed into ``dim`` places, scaled to length 1.

    A text without content tokens gives the zero vector, null gives null.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(tokens: pa.Array) -> pa.Array:
        hashed: dict[str, tuple[int, float]] = {}
        parts = [_embedded(part, dim, hashed) for part in list_slices(tokens)]
        values = pa.concat_arrays([pa.array(part.ravel()) for part in parts])
        offsets = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, values, mask=tokens.is_null())

    return embed(content_tokens(text))


def _embedded(tokens: pa.Array, dim: int, hashed: dict[str, tuple[int, float]]) -> np.ndarray:
    """Rows of length 1 of a slice of a batch; ``hashed`` holds words met before."""
    starts, words = flat_lists(tokens)
    coded = words.dictionary_encode()
    places = np.zeros(len(coded.dictionary), dtype=np.int64)
    signs = np.zeros(len(coded.dictionary))
    if len(hashed) > HELD_WORDS:
        hashed.clear()
    for code, word in enumerate(coded.dictionary.to_pylist()):
        known = hashed.get(word)
        if known is None:
            digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
            known = int.from_bytes(digest[:4], "little") % dim, 1.0 if digest[4] % 2 == 0 else -1.0
            hashed[word] = known
        places[code], signs[code] = known
    codes = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(tokens)), np.diff(starts))
    sums = np.bincount(
        doc * dim + places[codes], weights=signs[codes], minlength=len(tokens) * dim
    ).reshape(len(tokens), dim)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return (sums / norms).astype(np.float32)


def embedder(provider: str = "stub", dim: int = EMBEDDING_DIM, **registered: Embedder) -> Embedder:
    """The embedder of that name; an unknown name falls back with a warning.

    An embedder maps a text column to an ``array<float>`` column.  Model-backed
    ones are pandas or Arrow UDFs handed in by keyword.
    """
    if provider in registered:
        return registered[provider]
    if provider != "stub":
        warnings.warn(f"unknown embedder {provider!r}, using hash embeddings", stacklevel=2)
    return lambda text: hash_embedding(text, dim)


def article_text() -> Column:
    return F.concat(F.col("title"), F.lit("\n"), F.col("content"))


def backfill_embeddings(articles: DataFrame, embed: Embedder = hash_embedding) -> DataFrame:
    """Fill null embeddings.  Rows that have one send no text to the embedder."""
    missing = F.when(F.col("embedding").isNull(), article_text())
    return articles.withColumn("embedding", F.coalesce("embedding", embed(missing)))


def reembed_all(articles: DataFrame, embed: Embedder = hash_embedding) -> DataFrame:
    """Detach every story and compute every embedding anew."""
    return articles.withColumns(
        {"story_id": F.lit(None).cast("bigint"), "embedding": embed(article_text())}
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Keys whose sums a task holds before it sends them on.
HELD_KEYS = 4_096

_SUMS = "sums array<double>, counts array<bigint>"


def _packed(names: list, sums: list, counts: list, key: str, kind: pa.DataType) -> pa.RecordBatch:
    def lists(parts: list, to: pa.DataType) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], to))

    columns = [pa.array(names, kind), lists(sums, pa.float64()), lists(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[key, "sums", "counts"])


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two arrays; the shorter one counts as padded with zeros."""
    if len(a) < len(b):
        a, b = b, a
    a = a.copy()
    a[: len(b)] += b
    return a


def _column_sums(flat: np.ndarray, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sum, place by place, of the lists ``first`` to ``last`` (exclusive)."""
    sizes = np.diff(starts[first : last + 1])
    part = flat[starts[first] : starts[last]]
    if (sizes == sizes[0]).all():
        return part.reshape(last - first, sizes[0]).sum(axis=0)
    total = np.zeros(0, flat.dtype)
    for row in range(first, last):
        total = _added(total, flat[starts[row] : starts[row + 1]])
    return total


def merge_sums(parts: DataFrame, key: str) -> DataFrame:
    """One row (key, sums, counts) per key from any number of such rows.

    Rows of a key follow each other within a task, which holds the sums of one key at a
    time besides the batch it reads, however many keys there are.
    """
    kind = parts.schema[key].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, counts, arrow_kind = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow_kind = batch.column(0).type
            names = batch.column(0).to_pylist()
            flat = []
            for column in (1, 2):
                starts, values = flat_lists(batch.column(column))
                flat.append((values.to_numpy(zero_copy_only=False), starts))
            edges = [0, *(n for n in range(1, len(names)) if names[n] != names[n - 1]), len(names)]
            ready: tuple[list, list, list] = ([], [], [])
            for first, last in zip(edges, edges[1:]):
                more = [_column_sums(values, starts, first, last) for values, starts in flat]
                if sums is not None and names[first] == held:
                    sums, counts = _added(sums, more[0]), _added(counts, more[1])
                    continue
                if sums is not None:
                    for out, value in zip(ready, (held, sums, counts)):
                        out.append(value)
                held, (sums, counts) = names[first], more
            if ready[0]:
                yield _packed(*ready, key, arrow_kind)
        if sums is not None:
            yield _packed([held], [sums], [counts], key, arrow_kind)

    together = parts.select(key, "sums", "counts").repartition(key).sortWithinPartitions(key)
    return together.mapInArrow(merge, f"`{key}` {kind}, {_SUMS}")


def vector_sums(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """(key, sums, counts) per place of the vectors of each key; nulls do not count.

    A task adds the vectors of each key up and sends one array per key, so a key with
    very many vectors costs one row per task.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}

        def packed(arrow_kind: pa.DataType) -> pa.RecordBatch:
            values = list(totals.values())
            return _packed(list(totals), [v[0] for v in values], [v[1] for v in values], key, arrow_kind)

        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.column(0).type
            starts, values = flat_lists(batch.column(1))
            flat = values.to_numpy(zero_copy_only=False).astype(float)
            there = ~np.isnan(flat) if values.null_count else np.ones(len(flat), bool)
            flat, there = np.where(there, flat, 0.0), there.astype(np.int64)
            for i, name in enumerate(batch.column(0).to_pylist()):
                part = slice(starts[i], starts[i + 1])
                if starts[i] == starts[i + 1]:
                    continue
                if name in totals:
                    held = totals[name]
                    totals[name] = (_added(held[0], flat[part]), _added(held[1], there[part]))
                else:
                    totals[name] = (flat[part].copy(), there[part].copy())
            if len(totals) > HELD_KEYS:
                yield packed(arrow_kind)
                totals = {}
        if totals:
            yield packed(arrow_kind)

    return merge_sums(vectors.select(key, embedding).mapInArrow(local, f"`{key}` {kind}, {_SUMS}"), key)


def mean_vector(sums: Column, counts: Column) -> Column:
    return F.zip_with(sums, counts, lambda s, n: F.try_divide(s, n).cast("float"))


def centroids(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Element-wise mean per key; null vectors and null elements do not count."""
    sums = vector_sums(vectors, key, embedding)
    return sums.select(key, mean_vector(F.col("sums"), F.col("counts")).alias("centroid"))
