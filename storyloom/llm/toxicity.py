"""Toxicity by classifier chains (op 3)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import table

# Order of the chain: the model of a category sees the probabilities of those before.
CATEGORIES = ("junk", "toxic")
# The most labelled rows that are learned from; they are drawn by a hash of the id.
SAMPLE_ROWS = 20_000
FEATURES = 128
LEAST_DOCUMENTS = 4
FOLDS = 4
RIDGE = 0.5
THRESHOLD = 0.5
STEPS = 12

LETTERS = re.compile(r"[^\W\d_]+")
# A feature is a word, or its first letters: inflected forms share those.
PREFIXES = (0, 4, 5, 6)


def parts_of(text: str) -> list[set[str]]:
    """Distinct words of a text, then their beginnings by length."""
    words = set(LETTERS.findall(text.lower()))
    return [words if size == 0 else {w[:size] for w in words if len(w) > size} for size in PREFIXES]


def labelled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and one 0/1 column per category, of at most ``sample_rows`` documents.

    Of repeated labels of a document the worst counts; incomplete ones are left out.
    """
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic").dropna()
    one = marks.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(c) for c in CATEGORIES))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


@dataclass
class Chain:
    """Linear models in chain order over shared features."""

    places: list[dict[str, int]]
    weights: np.ndarray
    links: np.ndarray
    biases: np.ndarray

    def features(self, text: str) -> list[int]:
        found = []
        for place, parts in zip(self.places, parts_of(text)):
            found += [place[p] for p in place.keys() & parts]
        return found

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.features(t) for t in texts]
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return rows, np.fromiter((f for x in lists for f in x), np.int64, len(rows))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of each category for each text."""
        rows, columns = self.matrix(texts)
        found = np.zeros((len(texts), len(self.biases)))
        for k, bias in enumerate(self.biases):
            linear = np.bincount(rows, self.weights[k, columns], len(texts))
            found[:, k] = sigmoid(bias + linear + found[:, :k] @ self.links[k, :k])
        return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(STEPS):
        p = sigmoid(x @ weight)
        slope = x.T @ (p - y) + penalty * weight
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weight -= step
        if np.abs(step).max() < 1e-4:
            break
    return weight


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, places: list[dict[str, int]]) -> Chain:
    """Each later model learns from out-of-fold probabilities of the earlier ones.

    Probabilities that a model gives its own training rows are too sure; those of
    a model that has not seen the row are like what later rows will get.
    """
    count, size = y.shape[1], x.shape[1]
    weights, links, biases = np.zeros((count, size)), np.zeros((count, count)), np.zeros(count)
    earlier = np.zeros((len(x), 0))
    for k in range(count):
        inputs = np.column_stack([x, earlier])
        fitted = logistic(inputs, y[:, k])
        weights[k], links[k, :k], biases[k] = fitted[:size], fitted[size:-1], fitted[-1]
        unseen = np.zeros(len(x))
        for fold in np.unique(folds):
            out = folds == fold
            if out.all():
                part = fitted
            else:
                part = logistic(inputs[~out], y[~out, k])
            unseen[out] = sigmoid(inputs[out] @ part[:-1] + part[-1])
        earlier = np.column_stack([earlier, unseen])
    return Chain(places, weights, links, biases)


def feature_counts(rows: DataFrame) -> DataFrame:
    """kind, part, documents and documents per category of every feature."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.StringType())])
    for name in ("documents", *CATEGORIES):
        schema = schema.add(name, T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows are the bounded sample's, so are the counters.
        counters: dict[tuple, Counter] = {}
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            marks = zip(*(batch.column(c).to_pylist() for c in CATEGORIES))
            for text, mark in zip(texts, marks):
                for kind, parts in enumerate(parts_of(text)):
                    counters.setdefault((kind, mark), Counter()).update(parts)
        for (kind, mark), counter in counters.items():
            seen = pa.array(counter.values(), pa.int64())
            columns = [pa.array([kind] * len(seen), pa.int32()), pa.array(counter.keys(), pa.string()), seen]
            none = pa.array(np.zeros(len(seen), np.int64))
            columns += [seen if m else none for m in mark]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = rows.select("text", *CATEGORIES).mapInArrow(count, schema)
    return found.groupBy("kind", "part").agg(*(F.sum(c).alias(c) for c in schema.names[2:]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    features: int = FEATURES,
    folds: int = FOLDS,
) -> Chain:
    """Chain fitted to at most ``sample_rows`` labelled documents, a documented bound.

    Spark counts every word and word beginning of those documents, and ranks
    them per category by chi-square; the driver gets the ``features`` best of
    each category and the rows as short lists of feature numbers.
    """
    sample = F.broadcast(labelled(labels, sample_rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = rows.select("doc_id", "text", *CATEGORIES)
    totals = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in CATEGORIES)).first()
    n = totals["n"]
    counts = feature_counts(rows).filter(F.col("documents") >= LEAST_DOCUMENTS)
    ranked = counts
    for c in CATEGORIES:
        share = (totals[c] or 0) / max(n, 1)
        expected = F.col("documents") * share
        surplus = F.greatest(F.lit(0.0), F.col(c) - expected)
        ranked = ranked.withColumn(f"chi_{c}", surplus * surplus / F.greatest(F.lit(1e-9), expected))
    places: list[dict[str, int]] = [{} for _ in PREFIXES]
    best = {}
    if n:
        ranked = ranked.select("kind", "part", *(f"chi_{c}" for c in CATEGORIES)).cache()
        for c in CATEGORIES:
            top = ranked.filter(F.col(f"chi_{c}") > 0).orderBy(F.desc(f"chi_{c}"), "kind", "part")
            best.update({(r.kind, r.part): None for r in top.limit(features).collect()})
        ranked.unpersist()
    for place, (kind, part) in enumerate(best):
        places[kind][part] = place
    size = len(best)
    blank = Chain(places, np.zeros((len(CATEGORIES), size)), np.zeros((len(CATEGORIES),) * 2), np.zeros(len(CATEGORIES)))
    if not n:
        blank.biases[:] = -35.0
        return blank

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def listed(texts: pa.Array) -> pa.Array:
        return pa.array([blank.features(t) for t in texts.fill_null("").to_pylist()], pa.list_(pa.int32()))

    folded = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).alias("fold")
    got = rows.select("doc_id", listed("text").alias("listed"), folded, *CATEGORIES).collect()
    got.sort(key=lambda r: (r["doc_id"], r["listed"]))
    x = np.zeros((n, size))
    for i, r in enumerate(got):
        x[i, r["listed"]] = 1.0
    y = np.array([[r[c] for c in CATEGORIES] for r in got], float)
    return fit_chain(x, y, np.array([r["fold"] for r in got]), places)


def probabilities(chain: Chain):
    """Column function: probabilities of all categories of a text; null counts as empty."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pa.Array) -> pa.Array:
        found = chain.score(texts.fill_null("").to_pylist())
        ends = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, p_<category> per category, and toxic (p_toxic at or over the threshold) of every row.

    Without any labels every probability is 0.  Texts without words get what the
    biases of the chain say.
    """
    chain = train(docs, labels, **options)
    scored = docs.select("doc_id", probabilities(chain)(F.col("text")).alias("p"))
    columns = [F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(CATEGORIES)]
    return scored.select("doc_id", *columns, (F.col("p")[len(CATEGORIES) - 1] >= threshold).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    score = probabilities(train(docs, labels, **options))
    return docs.filter(score(F.col("text"))[len(CATEGORIES) - 1] < threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and verdict of every row of ``documents``, by a chain fitted to ``labels``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
