"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm.centroids import bisectors, clusters, tournament, with_inertia


def plain(rows, size, count, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if usable(v, size)]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1])

    centroids = [v for _, v in sorted(kept, key=order)[:count]]

    def distance(v, c):
        return sum((x - y) ** 2 for x, y in zip(v, c))

    def nearest(v):
        return min(range(len(centroids)), key=lambda n: (distance(v, centroids[n]), n))

    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own) if c == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, nearest(v), distance(v, centroids[nearest(v)])) for i, v in kept]
    return found, centroids


def usable(vector, size):
    return vector is not None and len(vector) == size and all(x is not None and math.isfinite(x) for x in vector)


def rows_of(size, count):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=size) * rng.choice([0.01, 1, 30])).tolist()) for i in range(count)]
    # Grids of few values make ties; ids and rows repeat.
    rows += [(1_000 + i, (rng.integers(-1, 2, size) / 256).tolist()) for i in range(60)]
    rows += [rows[0], (3, rows[5][1]), (None, rows[1][1]), (None, [0.5] * size)]
    rows += [(2_000, None), (2_001, [0.0] * (size - 1)), (2_002, [float("nan")] * size), (2_003, [None] * size)]
    return rows + [(2_004, [float("-inf")] * size), (2_005, []), (2_006, [0.0] * size), (2_007, [-0.0] * size)]


@pytest.mark.parametrize("size, count", [(4, 7), (64, 5)])
def test_clusters_equal_plain_arithmetic(spark, size, count):
    rows = rows_of(size, 150)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash"))
    assigned, centroids = clusters(frame.repartition(3), size=size, count=count, rounds=3)
    found, wanted = plain(rows, size, count, 3)
    assert centroids.tolist() == wanted
    got = with_inertia(assigned, centroids).collect()

    def key(row):
        return (row[0] is None, row[0] or 0, *row[1:])

    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(found, key=key)
    total = sum(d for _, _, d in found)
    for r in got:
        assert r.inertia == total
        assert r.cluster_inertia == sum(d for _, c, d in found if c == r.cluster)
        digest = hashlib.sha256(",".join(map(str, wanted[r.cluster])).encode()).hexdigest()
        assert r.centroid_sha256 == digest


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<double>")
    assigned, centroids = clusters(frame, size=2, count=40)
    assert len(centroids) == 2
    assert sorted((r.vec_id, r.cluster, r.distance) for r in assigned.collect()) == [(1, 0, 0), (2, 0, 0)]
    for empty in (frame.limit(0), frame.filter("vec_id = 3")):
        assert with_inertia(*clusters(empty, size=2)).count() == 0


def test_components_that_leave_the_range_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vec_id 1 holds a component"):
        clusters(frame, size=2)


def test_a_test_of_zero_favours_the_smaller_number():
    centroids = np.array([[4, 0], [0, 0], [0, 0], [2, 2]])
    vectors = np.array([[2, 0], [0, 0], [2, 1], [3, 5]])
    assert tournament(vectors, *bisectors(centroids)).tolist() == [0, 1, 3, 3]
