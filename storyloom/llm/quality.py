"""Quality scores: random Fourier features, ridge regression, isotonic calibration (op 5)."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import fold, table
from storyloom.tables import written

HELD_FOLDS = 5
CUT = 0.3
WAVES = 192
WIDTH = 3.0
RIDGE = 0.3
FOLDS = 4
BINS = 512
SEED = 7
# Standard deviations beyond which a statistic says no more.
FAR = 6.0

STATISTICS = (
    "log_words",
    "log_chars",
    "word_chars",
    "log_distinct",
    "distinct",
    "top_word",
    "echo",
    "upper",
    "lower",
    "digit",
    "space",
    "mark",
    "symbol",
    "beyond_ascii",
    "log_lines",
    "distinct_lines",
    "short_lines",
    "packed",
)

UPPER, LOWER, DIGIT, SPACE, MARK, SYMBOL, BEYOND = range(7)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, BEYOND, np.int64)
    for byte in range(128):
        c = chr(byte)
        if c.isupper():
            classes[byte] = UPPER
        elif c.islower():
            classes[byte] = LOWER
        elif c.isdigit():
            classes[byte] = DIGIT
        elif c.isspace() or byte < 32:
            classes[byte] = SPACE
        else:
            classes[byte] = MARK if c in ".,;:'\"()-?" else SYMBOL
    return classes


CLASSES = _byte_classes()


def statistics_of(text: str) -> list[float]:
    """Shape of a text; an empty one is all zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    counts = Counter(words)
    return [
        np.log(len(words)),
        np.log(len(raw)),
        len(raw) / len(words),
        np.log(len(counts)),
        len(counts) / len(words),
        max(counts.values()) / len(words),
        sum(map(operator.eq, words, words[1:])) / len(words),
        *kinds.tolist(),
        np.log(len(lines)),
        len(set(lines)) / len(lines),
        sum(len(line) < 20 for line in lines) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pa.Array) -> pa.Array:
    found = [statistics_of(t) for t in texts.fill_null("").to_pylist()]
    return pa.array(found, pa.list_(pa.float64()))


class Waves:
    """Cosines at random frequencies: their products approximate a Gaussian kernel."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, waves: int = WAVES, width: float = WIDTH):
        draw = np.random.default_rng(SEED)
        self.centre, self.spread = centre, np.where(spread > 1e-9, spread, 1.0)
        self.rates = draw.normal(0.0, 1.0 / width, (len(centre), waves))
        self.shifts = draw.uniform(0.0, 2 * np.pi, waves)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """One row per text, the last column being the constant 1."""
        scaled = np.clip((rows - self.centre) / self.spread, -FAR, FAR)
        cosines = np.sqrt(2.0 / len(self.shifts)) * np.cos(scaled @ self.rates + self.shifts)
        return np.column_stack([cosines, np.ones(len(rows))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def normal_equations(rows: DataFrame, waves: Waves) -> np.ndarray:
    """Sums of z z' and z y by fold: (fold, line of the matrix, values), from rows (stats, y, part).

    Every partition adds up its own; partitions' lines meet by (fold, line), so
    the driver gets one line per fold and wave whatever the input.
    """
    size = len(waves.shifts) + 1
    names = ["part", "line", "values"]

    def emit(sums: dict) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        columns = [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([sums[k] for k in keys], pa.list_(pa.float64())),
        ]
        if keys:
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            z = waves(_matrix(batch.column("stats")))
            y, part = batch.column("y").to_numpy(), batch.column("part").to_numpy()
            for p in np.unique(part):
                mine = z[part == p]
                both = np.column_stack([mine, y[part == p]])
                totals[p] = totals.get(p, 0.0) + mine.T @ both
        yield from emit({(int(p), i): m[i] for p, m in totals.items() for i in range(size)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, line, values in zip(*(batch.column(c).to_pylist() for c in names)):
                sums[part, line] = sums.get((part, line), 0.0) + np.array(values)
        yield from emit(sums)

    schema = "part int, line int, values array<double>"
    lines = rows.select("stats", "y", "part").mapInArrow(local, schema)
    merged = lines.repartition("part", "line").mapInArrow(merge, schema).collect()
    totals = np.zeros((FOLDS, size, size + 1))
    for r in merged:
        totals[r["part"], r["line"]] = r["values"]
    return totals


def solve(total: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    size = len(total)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    return np.linalg.solve(total[:, :size] + np.diag(penalty), total[:, size])


def isotonic(bins: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to the share of ones per bin.

    ``bins`` are (bin, rows, ones).  Neighbours that would decrease are pooled; a
    pool's knot is its mean bin.  One row of either kind is added to each pool, so
    a short pool is not certain.
    """
    pools: list[list[float]] = []
    for place, rows, ones in sorted(bins):
        pools.append([rows, ones, place * rows])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    rows, ones, places = np.array(pools).T
    return places / rows, np.maximum.accumulate((ones + 0.5) / (rows + 1.0))


def score_column(waves: Waves, folds: np.ndarray):
    """Column function: raw score of statistics by the model of all folds but that of the row.

    ``part`` -1, or rows not learned from, get the model of all.
    """
    total = folds.sum(axis=0)
    models = np.stack([solve(total - own) for own in folds] + [solve(total)])

    @F.arrow_udf(T.DoubleType())
    def score(stats: pa.Array, part: pa.Array) -> pa.Array:
        z = waves(_matrix(stats))
        return pa.array((z * models[part.to_numpy(zero_copy_only=False)]).sum(axis=1))

    return score


def quality(docs: DataFrame, labels: DataFrame, held_folds: int = HELD_FOLDS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), predicted (score >= cut) of every row.

    Only labels of rows that are not held out are learned from, all of them; of
    repeated labels of a document the worst counts.  Null texts count as empty.
    Without labels every score is 0.5.
    """
    held = fold(F.col("doc_id"), held_folds) == 0
    stats = docs.select("doc_id", held.alias("held_out"), statistics(F.col("text")).alias("stats"))
    stats = written(stats, "quality-statistics")
    marks = labels.select("doc_id", "quality").dropna().groupBy("doc_id")
    marks = marks.agg(F.min("quality").cast("double").alias("y"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("part")
    known = stats.filter(~F.col("held_out")).join(marks, "doc_id").select("doc_id", "stats", "y", part)
    known = written(known, "quality-known")

    size = range(len(STATISTICS))
    moments = [F.avg(F.col("stats")[i]) for i in size] + [F.stddev_pop(F.col("stats")[i]) for i in size]
    row = known.agg(F.count("*"), *moments).first()
    if not row[0]:
        flat = stats.withColumn("score", F.lit(0.5))
    else:
        values = np.array(row[1:], float)
        waves = Waves(values[: len(STATISTICS)], values[len(STATISTICS) :])
        raw = score_column(waves, normal_equations(known, waves))
        # Scores are near 0 to 1, so there are a few hundred bins.
        place = F.floor(F.least(F.greatest(raw("stats", "part"), F.lit(-1.0)), F.lit(2.0)) * BINS)
        bins = known.select(place.alias("bin"), "y").groupBy("bin").agg(F.count("*"), F.sum("y")).collect()
        knots, shares = isotonic([(r[0], r[1], r[2]) for r in bins])
        knots = (knots + 0.5) / BINS

        @F.arrow_udf(T.DoubleType())
        def calibrated(scores: pa.Array) -> pa.Array:
            return pa.array(np.interp(scores.to_numpy(zero_copy_only=False), knots, shares))

        flat = stats.withColumn("score", calibrated(raw("stats", F.lit(FOLDS))))
    return flat.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out flag, score and prediction of every row of ``documents``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
