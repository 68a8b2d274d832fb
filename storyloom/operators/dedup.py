"""Exact and near duplicate removal that honours arrival order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.dates import hours_before
from storyloom.functions.hashing import hamming
from storyloom.settings import DEDUP_WINDOW_HOURS, HAMMING_THRESHOLD
from storyloom.tables import lookup, written

# Values of a bucket that are compared with each other.  It changes speed only: a split
# copies a bucket's rows once per block, so with a low limit rows grow faster than the input.
BUCKET_LIMIT = 1_024
# Rows of the first step of acceptance; each further step is as large as all before it.
STEP_ROWS = 65_536


def recent(articles: DataFrame, as_of: datetime | str, hours: float) -> DataFrame:
    """Articles fetched within the look-back; a plain filter that reaches the scan."""
    kind = articles.schema["fetched_at"].dataType
    return articles.filter(F.col("fetched_at") > hours_before(as_of, hours, kind))


# --- exact keys ---------------------------------------------------------------


def exact_keys(*kinds: str) -> Column:
    """Keys that may occur once only, as text: content hash, URL, (source, guid)."""
    keys = {
        "hash": F.concat(F.lit("h"), F.col("content_hash")),
        "url": F.concat(F.lit("u"), F.col("canonical_url")),
        # Null without a guid, so such items never collide here.
        "guid": F.concat(F.lit("g"), F.col("source_id").cast("string"), F.lit("|"), F.col("guid")),
    }
    return F.array_compact(F.array(*(keys[k] for k in kinds or keys)))


def known_items(items: DataFrame, history: DataFrame, *kinds: str, order: str = "ord") -> DataFrame:
    """Order values of items that share an exact key with a stored article.

    The batch picks its keys out of one narrow pass over the history, so the
    history is never shuffled while the keys of the batch fit a broadcast.  Both
    key lists are written, see ``storyloom.tables.lookup``.
    """
    wanted = items.select(order, F.explode(exact_keys(*kinds)).alias("key"))
    stored = history.select(F.explode(exact_keys(*kinds)).alias("key"))
    taken = lookup(stored, wanted.select("key").distinct(), "key").distinct()
    return lookup(wanted, taken, "key").select(order).distinct()


def new_items(items: DataFrame, history: DataFrame, *kinds: str, order: str = "ord") -> DataFrame:
    """Items without an exact key (hash, url, guid; default all) in the history."""
    return items.join(known_items(items, history, *kinds, order=order), order, "left_anti")


# --- near duplicates ----------------------------------------------------------


def near_pairs(
    values: DataFrame,
    known: DataFrame | None = None,
    threshold: int = HAMMING_THRESHOLD,
    bucket_limit: int = BUCKET_LIMIT,
    exists: bool = False,
) -> DataFrame:
    """Pairs (a, b) of distinct simhash values at most ``threshold`` bits apart.

    With ``exists`` only the values ``a`` that have any ``b``: no pair is formed.

    Without ``known``: pairs a < b within ``values``.  With it: a from
    ``values``, b from ``known``, equal values included.

    Exact by the pigeonhole rule: of threshold + 1 bit blocks one must agree, so
    values only meet in buckets of equal blocks.  A bucket with more than
    ``bucket_limit`` values is split the same way over its remaining bits, until
    no bucket is large: no task ever sees a large group.
    """
    rows = values.select(F.col("simhash").alias("value")).distinct().withColumn("known", F.lit(False))
    if known is not None:
        rows = rows.unionByName(
            known.select(F.col("simhash").alias("value")).distinct().withColumn("known", F.lit(True))
        )
    rows = rows.withColumns(
        {"path": F.lit(0), "bits": F.lit(0).cast("bigint"), "rest": F.col("value")}
    )
    bucket = ["path", "bits"]
    blocks = max(threshold + 1, 2)
    free_bits, found = 64, None
    while True:
        rows = written(_split_buckets(rows, free_bits, blocks), "simhash-buckets")
        free_bits -= free_bits // blocks
        large = rows.groupBy(*bucket).count().filter(F.col("count") > bucket_limit).select(*bucket)
        again = free_bits >= blocks and not large.isEmpty()
        if again:
            large = written(large, "simhash-large-buckets")
        small = rows.join(large, bucket, "left_anti") if again else rows
        pairs = _bucket_pairs(small, bucket, threshold, mirrored=known is None, exists=exists)
        found = pairs if found is None else found.unionByName(pairs)
        if not again:
            return found.distinct()
        rows = rows.join(large, bucket, "left_semi")


def _split_buckets(rows: DataFrame, free_bits: int, blocks: int) -> DataFrame:
    """One row per block of the free bits: that block joins the bucket key.

    Blocks differ in width by at most the remainder; the narrowest decides how
    many bits the next round can count on, so every block takes that width.
    """
    width = free_bits // blocks
    rest, choices = F.col("rest"), []
    for block in range(blocks):
        offset = block * width
        chunk = F.shiftrightunsigned(rest, offset).bitwiseAND((1 << width) - 1)
        below = rest.bitwiseAND((1 << offset) - 1)
        end = offset + width
        if end < free_bits:
            above = F.shiftleft(F.shiftrightunsigned(rest, end), offset)
            left = below.bitwiseOR(above)
        else:
            left = below
        choices.append(
            F.struct(
                (F.col("path") * blocks + block).alias("path"),
                F.shiftleft(F.col("bits"), width).bitwiseOR(chunk).alias("bits"),
                left.alias("rest"),
            )
        )
    split = rows.select("value", "known", F.explode(F.array(*choices)).alias("next"))
    return split.select("value", "known", "next.path", "next.bits", "next.rest")


def _bucket_pairs(
    rows: DataFrame, bucket: list, threshold: int, mirrored: bool, exists: bool = False
) -> DataFrame:
    # The work of a bucket is far above its bytes, by which Spark would pack buckets into few tasks.
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    a = rows.filter(~F.col("known")).repartition(tasks, *bucket).select(*bucket, F.col("value").alias("a"))
    other = rows if mirrored else rows.filter("known")
    b = other.select(*bucket, F.col("value").alias("b"))
    distance = hamming(F.col("a"), F.col("b"))
    if exists:
        other_bucket = [F.col(c).alias(f"other_{c}") for c in bucket]
        b = b.select(*other_bucket, "b")
        near = distance <= threshold
        for c in bucket:
            near = near & (F.col(c) == F.col(f"other_{c}"))
        return a.join(b, near, "left_semi").select("a")
    pairs = a.join(b, bucket).filter(distance <= threshold)
    if mirrored:
        pairs = pairs.filter(F.col("a") < F.col("b"))
    return pairs.select("a", "b", distance.alias("distance"))


def near_known(items: DataFrame, known: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """Items whose simhash is within the threshold of any known one."""
    hits = near_pairs(items, known, threshold, exists=True).select(F.col("a").alias("simhash")).distinct()
    return lookup(items, hits, "simhash")


# --- acceptance in arrival order ------------------------------------------------


def decide(
    items: DataFrame,
    history: DataFrame | None = None,
    as_of: datetime | str | None = None,
    window_hours: float = DEDUP_WINDOW_HOURS,
    threshold: int = HAMMING_THRESHOLD,
) -> DataFrame:
    """Add ``accepted`` to each item, as if items were taken one by one by ``ord``.

    An item is accepted unless it conflicts with a stored article or with an
    earlier *accepted* item: equal content hash, canonical URL or (source,
    guid), or a near simhash.  A rejected item blocks nobody.

    The keys of ``items`` are computed once and written; write ``items`` itself
    first if its other columns are dear.
    """
    keys = items.select("ord", "content_hash", "canonical_url", "source_id", "guid", "simhash")
    keys = written(keys, "dedup-keys")
    if history is not None:
        taken = known_items(keys, history)
        lookback = recent(history, as_of, window_hours)
        near = near_known(keys, lookback, threshold).select("ord")
        fresh = written(keys.join(taken.unionByName(near), "ord", "left_anti"), "dedup-fresh")
    else:
        fresh = keys
    accepted = _accept_in_steps(fresh, threshold).withColumn("accepted", F.lit(True))
    return items.join(accepted, "ord", "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(False))
    )


def _accept_in_steps(fresh: DataFrame, threshold: int, step_rows: int = STEP_ROWS) -> DataFrame:
    """Accepted order values of a written table, found over ranges of ``ord`` of doubling size.

    Of a range, rows that conflict with what earlier ranges accepted go first, without
    forming pairs.  Near pairs are formed among the rest only: where near values are many,
    all pairs grow with the square of the rows, but accepted values are few.
    """
    bounds = _step_bounds(fresh, step_rows)
    kept = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        # Rows without an order value stay in the first range.
        part = fresh
        if low is not None:
            part = part.filter(F.col("ord") > low)
        if high is not None:
            part = part.filter((F.col("ord") <= high) | F.lit(low is None) & F.col("ord").isNull())
        if kept is not None:
            taken = known_items(part, kept).unionByName(near_known(part, kept, threshold).select("ord"))
            part = written(part.join(taken, "ord", "left_anti"), "dedup-step")
        won = _accept(part, threshold)
        if not bounds:
            return won
        won = written(part.join(won, "ord", "left_semi"), "dedup-kept")
        kept = won if kept is None else kept.unionByName(won)
    return kept.select("ord").distinct()


def _step_bounds(fresh: DataFrame, step_rows: int) -> list:
    """Ends of the ranges but the last; their places change speed, not results."""
    rows = fresh.count()
    if rows <= 2 * step_rows or not isinstance(fresh.schema["ord"].dataType, T.NumericType):
        return []
    shares, size = [], step_rows
    while 2 * size <= rows:
        shares.append(size / rows)
        size *= 2
    return sorted(set(fresh.approxQuantile("ord", shares, 0.2 * shares[0])))


def _accept(fresh: DataFrame, threshold: int) -> DataFrame:
    """Lowest-order-first independent set over shared keys and near simhashes.

    Pairs of rows are never formed: a row is in when it is the first live row
    of each of its keys (and of all near simhash keys); then all live rows of
    those keys are out.  Both steps see one aggregated row per key.

    Every round settles at least the first row of each chain of conflicts, and
    works on the keys of rows that are not settled yet.
    """
    simhash_key = F.concat(F.lit("s"), F.col("simhash").cast("string"))
    rows = fresh.select("ord", F.explode(F.concat(exact_keys(), F.array(simhash_key))).alias("key"))
    pairs = near_pairs(fresh, threshold=threshold)
    name = {side: F.concat(F.lit("s"), F.col(side).cast("string")) for side in "ab"}
    near = written(
        pairs.select(name["a"].alias("key"), name["b"].alias("near_key")).unionByName(
            pairs.select(name["b"].alias("key"), name["a"].alias("near_key"))
        ),
        "dedup-near",
    )

    # Keys of one row without near keys decide nothing.
    contested = (
        rows.groupBy("key").count().filter("count > 1").select("key")
        .unionByName(near.select("key").distinct())
        .distinct()
    )
    live = lookup(rows, contested, "key")
    sizes = live.groupBy("ord").agg(F.count("*").alias("keys"))
    live = written(live.join(sizes, "ord"), "dedup-live")
    accepted = fresh.select("ord").join(live.select("ord").distinct(), "ord", "left_anti")

    while True:
        if live.isEmpty():
            return accepted
        first = live.groupBy("key").agg(F.min(F.struct("ord", "keys")).alias("first"))
        near_first = (
            near.join(first.withColumnRenamed("key", "near_key"), "near_key")
            .groupBy("key")
            .agg(F.min("first").alias("near_first"))
        )
        leading = (
            first.join(near_first, "key", "left")
            .filter(F.col("near_first").isNull() | (F.col("first.ord") < F.col("near_first.ord")))
            .select("key", "first.ord", "first.keys")
        )
        # Written, as plans would hold the steps above once per mention, which the driver pays for.
        leading = written(leading, "dedup-leading")
        complete = leading.groupBy("ord", "keys").count().filter("count = keys").select("ord")
        won = written(leading.join(complete, "ord", "left_semi").select("key", "ord"), "dedup-won")
        winners, closed = won.select("ord").distinct(), won.select("key")
        closed = closed.unionByName(
            near.join(closed, "key", "left_semi").select(F.col("near_key").alias("key"))
        )
        out = lookup(live, closed.distinct(), "key").select("ord").distinct()
        # The next round reads one written table; a winner is out of the race as well.
        state = written(
            live.join(winners.withColumn("won", F.lit(True)), "ord", "left").join(
                out.withColumn("out", F.lit(True)), "ord", "left"
            ),
            "dedup-round",
        )
        accepted = accepted.unionByName(state.filter("won").select("ord").distinct())
        live = state.filter("out is null").select("ord", "key", "keys")

