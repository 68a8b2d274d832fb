"""Banding and acceptance against the plain sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import dedup



def distance(a, b):
    return bin((a ^ b) % 2**64).count("1")


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def near_values(rng, n):
    """Values in tight groups, so that many pairs are near and buckets are crowded."""
    values = []
    while len(values) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            v = center
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                v ^= 1 << bit
            values.append(signed(v))
    return values[:n]


@pytest.mark.parametrize(("limit", "threshold"), [(256, 3), (8, 3), (4, 1)])
def test_near_pairs_equal_brute_force(spark, limit, threshold):
    values = near_values(random.Random(limit), 120)
    df = spark.createDataFrame([(v,) for v in values], "simhash long")
    got = {(r.a, r.b, r.distance) for r in dedup.near_pairs(df, threshold=threshold, bucket_limit=limit).collect()}
    distinct = sorted(set(values))
    want = {
        (a, b, distance(a, b))
        for i, a in enumerate(distinct)
        for b in distinct[i + 1 :]
        if distance(a, b) <= threshold
    }
    assert got == want and want


def test_near_pairs_with_known_values(spark):
    rng = random.Random(5)
    values = near_values(rng, 100)
    mine, known = values[:50] + [7], values[50:] + [7] + values[:5]
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "simhash long")
    got = {(r.a, r.b) for r in dedup.near_pairs(frame(mine), frame(known), bucket_limit=16).collect()}
    assert got == {(a, b) for a in mine for b in known if distance(a, b) <= 3}


def sequential(items, history, as_of_hour=None, window=72):
    """Items one by one: the rule the parallel version has to equal."""
    accepted, stored = [], []
    for h in history:
        stored.append((h, h["hour"] > as_of_hour - window))
    for item in sorted(items, key=lambda i: i["ord"]):
        conflict = any(
            s["content_hash"] == item["content_hash"]
            or s["canonical_url"] == item["canonical_url"]
            or (item["guid"] is not None and (s["source_id"], s["guid"]) == (item["source_id"], item["guid"]))
            or (recent and distance(s["simhash"], item["simhash"]) <= 3)
            for s, recent in stored
        )
        if not conflict:
            accepted.append(item["ord"])
            stored.append((item, True))
    return accepted


def random_rows(rng, n, first=0):
    pool = near_values(rng, max(4, n // 2))
    rows = []
    for i in range(n):
        simhash = rng.choice(pool)
        rows.append(
            {
                "ord": first + i,
                "source_id": rng.randint(0, 2),
                "guid": rng.choice([None, *(f"g{k}" for k in range(n // 2))]),
                "canonical_url": f"u{rng.randint(0, n)}",
                "content_hash": f"h{simhash}",
                "simhash": simhash,
                "hour": rng.randint(0, 200),
            }
        )
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(
        [(r["ord"], r["source_id"], r["guid"], r["canonical_url"], r["content_hash"], r["simhash"], r["hour"]) for r in rows],
        "ord long, source_id int, guid string, canonical_url string, content_hash string, simhash long, hour int",
    )
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours="hour")
    return df.withColumn("fetched_at", at).drop("hour")


@pytest.mark.parametrize("seed", [0, 1000])
def test_acceptance_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 70)
    history = random_rows(rng, 15, first=1000)
    decided = dedup.decide(
        frame(spark, rows), frame(spark, history), "2024-01-09 08:00:00"
    )
    got = sorted(r.ord for r in decided.filter("accepted").collect())
    want = sequential(rows, history, as_of_hour=200)
    assert got == want and 0 < len(want) < len(rows)
    assert decided.count() == len(rows)


def test_rejected_items_block_nobody(spark):
    def row(order, url, simhash, guid=None, source=1):
        return {"ord": order, "source_id": source, "guid": guid, "canonical_url": url, "content_hash": f"h{simhash}", "simhash": simhash, "hour": 1}

    rows = [
        row(1, "a", 0b000),
        row(2, "b", 0b111),  # near the first
        row(3, "c", 0b111111),  # near the second only
        row(4, "d", 0xFFFF << 40, "g", source=1),
        row(5, "e", (1 << 50) - 1, "g", source=2),  # same guid elsewhere
        row(6, "f", 0xFF << 30, "g", source=1),
        row(7, "h", -1),
        row(8, "i", -1, None),  # two texts without tokens are equal, too
    ]
    decided = dedup.decide(frame(spark, rows))
    assert sorted(r.ord for r in decided.filter("accepted").collect()) == [1, 3, 4, 5, 7]


def test_old_history_counts_for_hashes_only(spark):
    base = {"source_id": 1, "guid": None, "hour": 0}
    history = [{**base, "ord": 100, "canonical_url": "x", "content_hash": "same", "simhash": 5}]
    rows = [
        {**base, "ord": 1, "canonical_url": "a", "content_hash": "same", "simhash": 1 << 60},
        {**base, "ord": 2, "canonical_url": "b", "content_hash": "other", "simhash": 5},
    ]
    decided = dedup.decide(frame(spark, rows), frame(spark, history), "2024-01-04 00:00:00")
    assert [r.ord for r in decided.filter("accepted").collect()] == [2]


def test_hot_group_of_copies(spark):
    """A third of all rows share one text: one stays, nothing is lost elsewhere."""
    n = 3000
    hot = F.col("id") % 3 == 0
    rows = spark.range(n).select(
        F.col("id").alias("ord"),
        F.lit(1).alias("source_id"),
        F.lit(None).cast("string").alias("guid"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical_url"),
        F.when(hot, "copy").otherwise(F.col("id").cast("string")).alias("content_hash"),
        F.when(hot, 0).otherwise(F.xxhash64("id")).alias("simhash"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"),
    )
    decided = dedup.decide(rows)
    assert decided.filter("accepted").count() == n - n // 3 + 1
    assert decided.filter("accepted and content_hash = 'copy'").first().ord == 0


def test_skewed_joins_are_split(spark):
    """The lookups rely on Spark splitting a hot key; make sure it does."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        items = spark.range(0, 40000, 1, 8).select(
            F.col("id").alias("ord"),
            F.lit(1).alias("source_id"),
            F.lit(None).cast("string").alias("guid"),
            F.col("id").cast("string").alias("canonical_url"),
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("content_hash"),
        )
        stored = spark.createDataFrame([("hot",)], "content_hash string")
        known = dedup.known_items(items, stored, "hash")
        assert known.count() == 40000 - 13334
        known.collect()
        assert "skew=true" in known._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [3, 4])
def test_acceptance_in_steps_equals_sequential(spark, seed):
    rows = random_rows(random.Random(seed), 90)
    fresh = dedup.written(frame(spark, rows), "test-fresh")
    got = sorted(r.ord for r in dedup._accept_in_steps(fresh, 3, step_rows=10).collect())
    assert len(dedup._step_bounds(fresh, 10)) >= 2
    assert got == sequential(rows, [], as_of_hour=200)


def test_crowded_near_values_do_not_form_all_pairs(spark, monkeypatch):
    """All values lie near the first: later steps drop them without a pair."""
    formed, plain = [], dedup.near_pairs

    def watched(values, known=None, *args, **options):
        pairs = plain(values, known, *args, **options)
        if known is None:
            formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(dedup, "near_pairs", watched)
    rows = spark.range(65).select(
        F.col("id").alias("ord"), F.lit(1).alias("source_id"), F.lit(None).cast("string").alias("guid"),
        F.col("id").cast("string").alias("canonical_url"), F.col("id").cast("string").alias("content_hash"),
        F.expr("if(id = 0, 0L, shiftleft(1L, cast(id - 1 as int)))").alias("simhash"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"),
    )
    won = dedup._accept_in_steps(dedup.written(rows, "test-fresh"), 3, step_rows=8)
    assert [r.ord for r in won.collect()] == [0]
    assert sum(formed) < 65 * 64 / 2 / 8


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    """The driver holds a plan per step; none repeats the steps before it."""
    scans, write = {}, dedup.written

    def counted(df, name, *options):
        scans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, name, *options)

    look = dedup.lookup
    monkeypatch.setattr(dedup, "written", counted)
    monkeypatch.setattr(dedup, "lookup", lambda rows, keys, *a: look(rows, counted(keys, "lookup"), *a))
    rows = random_rows(random.Random(3), 60)
    assert dedup.decide(frame(spark, rows)).filter("accepted").count()
    assert max(scans["dedup-round"]) <= 4 and max(scans["lookup"]) <= 8
