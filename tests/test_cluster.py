"""Parallel clustering against the sequential loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import cluster
from storyloom.operators.embed import centroids



def frame(spark, rows):
    base = "2024-01-01 00:00:00"
    df = spark.createDataFrame(
        [(r["id"], r["story"], r["at"], r["fetched"], r["v"]) for r in rows],
        "id long, story_id long, at int, fetched int, embedding array<float>",
    )
    hours = lambda c: F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(hours=c)
    return df.select(
        "id", "story_id", hours("at").alias("published_at"), hours("fetched").alias("fetched_at"),
        "embedding", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"),
    )


def sim(a, b):
    a, b = np.asarray(a, dtype=np.float32).astype(float), np.asarray(b, dtype=np.float32).astype(float)
    return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)


def usable(r):
    return r["v"] is not None and any(r["v"])


def sequential(rows, now, window, threshold):
    """Articles one by one, each looking at everything clustered so far."""
    story = {r["id"]: r["story"] for r in rows}
    done = [r for r in rows if r["story"] is not None]
    seeded = set()
    for r in sorted((r for r in rows if r["story"] is None and r["v"] is not None), key=lambda r: (r["at"], r["id"])):
        best = None
        if usable(r):
            for rank, c in enumerate(sorted(done, key=lambda c: (c["new"], c["at"], c["id"]))):
                if usable(c) and (window is None or c["fetched"] > now - window):
                    candidate = (-sim(r["v"], c["v"]), rank, c["id"])
                    if -candidate[0] >= threshold and (best is None or candidate < best):
                        best = candidate
        if best is None:
            story[r["id"]] = r["id"]
            seeded.add(r["id"])
        else:
            story[r["id"]] = story[best[2]]
        done.append(r)
    return {i: (s, i in seeded) for i, s in story.items() if any(r["id"] == i and r["story"] is None and r["v"] is not None for r in rows)}


def random_rows(rng, n):
    rows = []
    for i in range(n):
        v = [float(rng.randint(-1, 2)) for _ in range(4)]
        rows.append(
            {
                "id": rng.randint(0, 10**6) * n + i,
                "story": rng.choice([None, None, None, 7, 8]),
                "at": rng.randint(0, 40),
                "fetched": rng.randint(0, 100),
                "v": rng.choice([v, v, v, v, [0.0] * 4, None, [1.0, 2.0, 0.0, 1.0]]),
            }
        )
        rows[-1]["new"] = rows[-1]["story"] is None
    return rows


@pytest.mark.parametrize(("window", "block_rows"), [(72, 9), (None, 1000)])
def test_parallel_equals_sequential(spark, window, block_rows):
    rows = random_rows(random.Random(block_rows), 90)
    got = cluster.assign_stories(
        frame(spark, rows), "2024-01-05 04:00:00", window, 0.8, block_rows=block_rows
    ).collect()
    want = sequential(rows, 100, window, 0.8)
    assert {r.id: (r.story_id, r.seeded) for r in got} == want
    assert any(s for _, s in want.values()) and not all(s for _, s in want.values())


def test_tiles_agree_with_plain_search(monkeypatch):
    """Small tiles, ties and order limits of the matrix search."""
    monkeypatch.setattr(cluster, "_TILE", 7)
    rng = np.random.default_rng(3)
    offered = rng.integers(-1, 2, (60, 3)).astype(float)
    offered = offered[(offered != 0).any(axis=1)]
    offered /= np.linalg.norm(offered, axis=1, keepdims=True)
    wanted, limit = offered.copy(), np.arange(len(offered))
    chosen, sims = cluster._top_one(wanted, offered, limit, 0.5)
    for i in range(len(wanted)):
        every = np.round(offered[:i] @ wanted[i], 9)
        if i == 0 or every.max() < 0.5:
            assert chosen[i] == -1
        else:
            assert chosen[i] == int(np.argmax(every)) and sims[i] == every.max()


def test_threshold_passes_when_equal(spark):
    rows = [
        {"id": 1, "story": 5, "at": 0, "fetched": 90, "v": [1.0, 0.0]},
        {"id": 2, "story": None, "at": 1, "fetched": 90, "v": [0.6, 0.8]},
    ]
    for threshold, hits in ((0.6, 1), (0.600001, 0)):
        best = cluster.nearest_clustered(frame(spark, rows), "2024-01-05 04:00:00", 72, threshold)
        assert best.count() == hits


def test_old_candidates_are_ignored(spark):
    rows = [
        {"id": 1, "story": 5, "at": 0, "fetched": 1, "v": [1.0, 0.0]},
        {"id": 2, "story": None, "at": 1, "fetched": 90, "v": [1.0, 0.0]},
    ]
    assert cluster.nearest_clustered(frame(spark, rows), "2024-01-05 04:00:00", 72, 0.5).isEmpty()


def test_incremental_runs_equal_bookkeeping(spark):
    """Two runs: story rows stay in step with their members."""
    rows = random_rows(random.Random(11), 40)
    for r in rows:
        r["story"] = None
    early = frame(spark, [r for r in rows if r["at"] < 20])
    placed, stories = cluster.cluster(early, None, "2024-01-02 00:00:00", None, 0.8)
    later = frame(spark, [r for r in rows if r["at"] >= 20])
    both = placed.unionByName(later)
    placed, stories = cluster.cluster(both, stories, "2024-01-03 00:00:00", None, 0.8)
    members = {}
    for r in placed.filter("story_id is not null").collect():
        members.setdefault(r.story_id, []).append(r)
    found = {s.id: s for s in stories.collect()}
    assert found.keys() == members.keys()
    for story, rows_ in members.items():
        assert found[story].article_count == len(rows_)
        assert found[story].title == f"t{story}"
        mean = np.mean([r.embedding for r in rows_], axis=0)
        assert found[story].centroid == pytest.approx(list(mean), abs=1e-6)


def test_centroids(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 0.0]), (2, [5.0, 5.0])], "k int, embedding array<float>")
    got = {r.k: r.centroid for r in centroids(rows, "k").collect()}
    assert got == {1: [2.0, 1.0], 2: [5.0, 5.0]}


def test_sums_of_uneven_vectors_and_null_keys(spark):
    rows = [(None, [1.0, None]), (None, [2.0, 5.0, 7.0]), (3, []), (3, None), (4, [float("nan"), 1.0])]
    frame_ = spark.createDataFrame(rows, "k long, embedding array<float>").repartition(3)
    got = {r.k: r.centroid for r in centroids(frame_, "k").collect()}
    assert set(got) == {None, 4} and got[None] == [1.5, 5.0, 7.0]


def test_merging_holds_one_key_at_a_time(spark):
    """10^5 keys in one partition: memory of the worker does not grow with their number."""
    import resource

    import pyarrow as pa

    from storyloom.operators.embed import merge_sums

    def peak(batches):
        for batch in batches:
            size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([size])], names=["rows", "peak"])

    peaks, batch_rows = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for keys in (10_000, 100_000):
            parts = spark.range(2 * keys).select(
                (F.col("id") % keys).alias("k"),
                F.array_repeat(F.lit(1.0), 64).alias("sums"), F.array_repeat(F.lit(1).cast("long"), 64).alias("counts"),
            )
            seen = merge_sums(parts, "k").mapInArrow(peak, "rows long, peak long").collect()
            assert sum(r.rows for r in seen) == keys
            peaks[keys] = max(r.peak for r in seen)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    # The sums of 100,000 keys would be 100 MB.
    assert peaks[100_000] < peaks[10_000] + 40
