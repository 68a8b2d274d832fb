"""Centroid clustering on integer vectors by a tournament of bisectors (op 12).

Every pair of centroids has a bisecting plane with an integer normal and an integer
threshold.  A vector starts with centroid 0 and meets the others in order; the sign
of one linear test per meeting says which of the two is nearer, so after k - 1 tests
one centroid is left and one exact distance is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.tables import spread, written

SIZE = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
# Scaled components up to here keep every test, sum and distance of 64 of them in 64 bits.
LARGEST = 1 << 26
# Vectors that meet one centroid at a time.
TILE = 8_192


def grid(embedding: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down, as long integers."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(embedding: Column, size: int) -> Column:
    """Vectors of ``size`` finite components."""
    bad = F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return F.coalesce((F.size(embedding) == size) & ~bad, F.lit(False))


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of all pairs: j beats i < j where normal[i, j] . x > threshold[i, j].

    |x - ci|^2 - |x - cj|^2 = 2 (cj - ci) . x - (|cj|^2 - |ci|^2), all in integers.
    """
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def tournament(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; a test of zero keeps the smaller number."""
    holder = np.zeros(len(vectors), np.int64)
    for at in range(0, len(vectors), TILE):
        rows, own = vectors[at : at + TILE], holder[at : at + TILE]
        for rival in range(1, len(thresholds)):
            side = np.einsum("ij,ij->i", rows, normals[own, rival]) - thresholds[own, rival]
            own[side > 0] = rival
    return holder


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def _partial_sums(centroids: np.ndarray):
    """One row per centroid and task: how many vectors it won, and their sum."""
    count, size = centroids.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bisectors(centroids)
        sums, won = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), size)
            nearest = tournament(vectors, *planes)
            order = np.argsort(nearest, kind="stable")
            present, starts = np.unique(nearest[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(vectors[order], starts, axis=0)
            won += np.bincount(nearest, minlength=count)
        there = np.flatnonzero(won)
        columns = [pa.array(there.astype(np.int32)), pa.array(won[there])]
        columns.append(pa.array(list(sums[there]), pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "won", "sums"])

    return added


def _final(centroids: np.ndarray):
    """Cluster and squared distance of every vector."""
    size = centroids.shape[1]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = bisectors(centroids)
        for batch in batches:
            vectors = matrix(batch.column(1), size)
            nearest = tournament(vectors, *planes)
            gap = vectors - centroids[nearest]
            columns = [batch.column(0), pa.array(nearest.astype(np.int32)), pa.array((gap * gap).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return assigned


def first_centroids(vectors: DataFrame, count: int, seed: int = SEED) -> np.ndarray:
    """The ``count`` vectors of smallest SHA-256 of ``seed:vec_id``; at most that many rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "vector").limit(count).collect()
    return np.array([r.vector for r in first], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact componentwise floor of the mean; one without vectors stays.

    Tasks send at most one array per centroid, added up before the shuffle; k x size
    numbers come back.  Sums fit 64 bits up
    to 2^37 vectors; beyond, Spark's addition raises an error.
    """
    schema = "cluster int, won bigint, sums array<bigint>"
    parts = vectors.select("vector").mapInArrow(_partial_sums(centroids), schema)
    places = parts.select("cluster", "won", F.posexplode("sums").alias("place", "sum"))
    sums = places.groupBy("cluster", "place").agg(F.sum("won").alias("won"), F.sum("sum").alias("sum"))
    new = centroids.copy()
    for row in sums.collect():
        new[row.cluster, row.place] = row.sum // row.won
    return new


def clusters(
    embeddings: DataFrame,
    vector_id: str = "vec_id",
    embedding: str = "embedding",
    size: int = SIZE,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Vectors that are null, of another size, or hold null or non-finite components take no
    part; rows that repeat an id are vectors of their own, and a null id starts no centroid
    while others are left.  With fewer vectors than ``count`` each starts one centroid; an
    empty table gives an empty result.  Equal distances go to the smaller number.  Other
    columns, whatever their names, are not read.  A component beyond 2^26 after scaling is
    an error, as squared distances would leave 64 bits.
    """
    spark = embeddings.sparkSession
    kept = embeddings.select(F.col(vector_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("e"))
    kept = kept.filter(usable(F.col("e"), size))
    too_large = F.exists("e", lambda x: F.abs(x.cast("double")) * scale > F.lit(float(LARGEST)))
    message = F.format_string("vec_id %s holds a component beyond 2^26", F.col("vec_id"))
    whole = F.when(too_large, F.raise_error(message)).otherwise(grid(F.col("e"), scale))
    vectors = written(spread(kept.select("vec_id", whole.cast("array<bigint>").alias("vector"))), "centroid-vectors")
    centroids = first_centroids(vectors, count, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return vectors.mapInArrow(_final(centroids), "vec_id bigint, cluster int, distance bigint"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the distances summed per cluster and over all, and each centroid's digest.

    One row per centroid is fetched and joined, which ``count`` bounds.
    """
    assigned = written(assigned, "centroid-assigned")
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    named = [
        (i, sums[i], sum(sums.values()), ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids) if i in sums
    ]
    facts = assigned.sparkSession.createDataFrame(
        named, "cluster int, cluster_inertia bigint, inertia bigint, components string"
    ).withColumn("centroid_sha256", F.sha2("components", 256))
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, exact distance and inertia of every vector of ``embeddings``; see ``clusters``."""
    return with_inertia(*clusters(table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    """The same rounds in SQL: all distances of all pairs, least first."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x "
        "FROM embeddings WHERE len(embedding) = 64 "
        "AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS n, x FROM kept "
        "ORDER BY sha256('2:' || vec_id) LIMIT 40)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.x) AS x, min(struct_pack(d := {far}::BIGINT, n := c.n)) AS best "
            f"FROM kept v, c{r} c GROUP BY v.vec_id)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT n, list(y ORDER BY p) AS x FROM (SELECT best.n AS n, p, "
                f"floor(sum(x[p])::HUGEINT / count(*))::BIGINT AS y FROM a{r}, range(1, 65) t(p) GROUP BY ALL) GROUP BY n)"
            )
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.n = c.n)"
            )
    return f"""
WITH {', '.join(steps)}
SELECT a.vec_id, a.best.n::INTEGER AS cluster, a.best.d AS distance,
       sum(a.best.d) OVER (PARTITION BY a.best.n)::BIGINT AS cluster_inertia,
       sum(a.best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.n = a.best.n
"""


ORACLE = _oracle()
