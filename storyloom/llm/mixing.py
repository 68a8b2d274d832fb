"""Mixing sources to target weights by weighted fair queueing (op 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import WORD, running_total, table, word_count
from storyloom.tables import lookup, written

SHARES = (5, 2, 1)
BUDGET = 1.5
PASSES = 2
BUCKET_ROWS = 20_000

# What tells rows apart.  No part is ever null, so units can be joined.
UNIT = ["no_id", "id", "no_source", "source_name", "text_hash", "copy"]


def units(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """One row per row of ``docs`` with its size in words and a key of its own.

    Rows equal in id, source and text differ in ``copy`` only; as they are
    interchangeable, so are their keys.
    """
    cols = [
        "doc_id",
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_name"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        word_count(F.col("text")).alias("size"),
        *([F.struct("*").alias("row")] if keep_row else []),
    ]
    same = Window.partitionBy(*UNIT[:-1]).orderBy("size")
    return docs.select(*cols).withColumn("copy", F.row_number().over(same))


def source_targets(
    rows: DataFrame, shares: tuple = SHARES, budget: float = BUDGET, passes: int = PASSES
) -> DataFrame:
    """Rank, size, weight and target in words of every source.

    Sources in code point order, null last, take the shares in turn.  A target
    stops at ``passes`` times the size of its source; what is above is shared
    again by weight until no target is above.
    """
    sizes = rows.groupBy("no_source", "source_name").agg(F.sum("size").alias("source_size"))
    ranked = running_total(sizes, ["no_source", "source_name"], F.lit(1), "rank")
    turn = F.pmod(F.col("rank"), F.lit(len(shares))).cast("int")
    weights = F.array(*(F.lit(float(s)) for s in shares))
    ranked = written(ranked.withColumn("weight", weights[turn]), "mix-sources")

    most = F.col("source_size") * float(passes)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = most <= F.col("weight") * level
        held, free = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        next_level = (total * budget - (held or 0.0)) / free if free else level
        if next_level <= level:
            break
        level = next_level
    return ranked.withColumn("target", F.least(most, F.col("weight") * level))


def mix(
    rows: DataFrame,
    targets: DataFrame,
    passes: int = PASSES,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The mix, one row per time a document is taken, with its place in words.

    Each pass shuffles the documents of a source anew.  An entry's virtual
    finish time is the words its source has served so far, divided by the target
    of the source; so all sources end at time 1, where the budget is spent.
    There the documents in service are cut to the words served.  A global range
    sort by finish time gives ``position``, the words of the mix before the entry.

    A source is shared out to hash buckets of about ``bucket_rows`` rows, so a
    source that holds most rows is no task's burden; only one sum per bucket is
    put in order.  Documents without words are entries of no words in the first
    pass.
    """
    buckets = rows.count() // bucket_rows + 1
    keys = ["no_source", "source_name"]
    known = targets.select(*keys, "rank", "source_size", "target")
    entries = lookup(rows.select(*UNIT, "size"), known, keys, "inner")
    entries = entries.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    entries = entries.filter((F.col("pass") == 0) | (F.col("pass") * F.col("source_size") < F.col("target")))
    order = F.xxhash64(F.lit(seed), "pass", *UNIT)
    bucket = F.shiftright(F.shiftrightunsigned(F.col("draw"), 40) * buckets, 24)
    entries = entries.withColumn("draw", order).withColumn("bucket", bucket)

    part = ["rank", "pass", "bucket"]
    sums = written(entries.groupBy(*part).agg(F.sum("size").alias("words")), "mix-buckets")
    before = Window.partitionBy("rank").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*part).orderBy("draw", *UNIT).rowsBetween(Window.unboundedPreceding, 0)
    served = entries.withColumn("served", F.sum("size").over(within)).join(written(starts, "mix-starts"), part)
    served = served.withColumn("served", F.col("start") + F.col("served"))
    left = F.floor("target") - (F.col("served") - F.col("size"))
    served = served.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    finish = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("served") / F.col("target")))
    served = served.withColumn("finish", F.coalesce(finish, F.lit(0.0)))
    taken = served.filter((F.col("words") > 0) | ((F.col("size") == 0) & (F.col("pass") == 0)))
    taken = taken.select(*UNIT, "rank", "pass", "draw", "size", "words", "finish")
    return running_total(taken, ["finish", "rank", "pass", "draw", *UNIT], F.col("words"), "position")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in mix order, with the columns of ``docs``.

    A document comes once per time it is taken.  One that the end of the budget
    cuts keeps its first words, joined by single spaces; ``n_chars``, where there
    is one, follows.  Documents without words stay once.
    """
    rows = units(docs, keep_row=True)
    sized = written(rows.drop("row"), "mix-units")
    entries = mix(sized, source_targets(sized), **options)
    entries = entries.select(*UNIT, "words", "position")
    joined = rows.join(written(entries, "mix-entries"), UNIT)
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    cut = F.col("words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " "))
    text = text.otherwise(F.col("row.text"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length(text)).otherwise(out["n_chars"])
        out["n_chars"] = out["n_chars"].cast(docs.schema["n_chars"].dataType)
    kept = joined.select(*(c.alias(n) for n, c in out.items()), F.col("position").alias("_position"))
    return kept.repartitionByRange("_position").sortWithinPartitions("_position").drop("_position")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of ``documents``, and its source's target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(units(docs), "mix-units")
    targets = source_targets(rows)
    entries = mix(rows, targets).groupBy(*UNIT).agg(
        F.sum("words").alias("taken"), F.min("position").alias("first_at")
    )
    keys = ["no_source", "source_name"]
    sized = lookup(rows, targets.select(*keys, "source_size", "target"), keys, "inner")
    return sized.join(entries, UNIT, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_at"
    )
