"""Story rows kept up to date by sums that can be added to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.embed import mean_vector, merge_sums, vector_sums
from storyloom.tables import lookup, written


def touched_stories(state: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """New rows of the stories that ``members`` (id, story_id, seeded, at, title, embedding) join.

    ``state`` holds one row per story: id, title, first_seen_at, article_count, first_at,
    first_id, first_title, sums, counts, updated_at.  Only rows of touched stories are
    taken from it; count, earliest member and vector sums are added to, so no earlier
    member is read again.  A story keeps its title; one without takes that of its seed,
    else of its earliest member.
    """
    members = written(members, "story-members")
    first = F.min(F.struct("at", "id", "title"))
    facts = written(
        members.groupBy(F.col("story_id").alias("id")).agg(
            F.count("*").alias("more"),
            first.alias("first"),
            F.max(F.when(F.col("seeded"), F.struct("at", "title"))).alias("seed"),
        ),
        "story-facts",
    )
    old = written(lookup(state, facts.select("id"), "id"), "story-old")
    new_sums = vector_sums(members.select(F.col("story_id").alias("id"), "embedding"), "id")
    sums = merge_sums(old.filter("sums is not null").select("id", "sums", "counts").unionByName(new_sums), "id")
    was = old.drop("sums", "counts").select("id", *(F.col(c).alias(f"old_{c}") for c in old.columns if c not in ("id", "sums", "counts")))
    earlier = F.struct(F.col("old_first_at").alias("at"), F.col("old_first_id").alias("id"), F.col("old_first_title").alias("title"))
    earliest = F.least(F.when(F.col("old_first_id").isNotNull(), earlier), F.col("first"))
    joined = facts.join(was, "id", "left").join(sums, "id", "left").withColumn("first", earliest)
    return joined.select(
        "id",
        F.coalesce("old_title", "seed.title", "first.title").alias("title"),
        F.coalesce("old_first_seen_at", "seed.at", "first.at").alias("first_seen_at"),
        (F.coalesce("old_article_count", F.lit(0)) + F.col("more")).alias("article_count"),
        F.col("first.at").alias("first_at"),
        F.col("first.id").alias("first_id"),
        F.col("first.title").alias("first_title"),
        "sums",
        "counts",
        F.lit(as_of).cast("timestamp").alias("updated_at"),
    )


def story_rows(state: DataFrame) -> DataFrame:
    """Rows of the stories table: the centroid is the mean of all members."""
    return state.select(
        "id",
        "title",
        F.lit(None).cast("string").alias("summary"),
        mean_vector(F.col("sums"), F.col("counts")).alias("centroid"),
        F.col("article_count").cast("int").alias("article_count"),
        "first_seen_at",
        "updated_at",
    )
