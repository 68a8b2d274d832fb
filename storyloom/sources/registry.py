"""The table of feeds: upsert, fetch state and listing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.dates import moment


def upsert_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add feeds by ``feed_url``; a feed that exists only changes its name.

    ``incoming`` has ord, name, feed_url, site_url.  Its last name wins, all
    else comes from its first row.  New feeds get the hash of the address as id.
    """
    new = incoming.groupBy("feed_url").agg(
        F.max_by("name", "ord").alias("new_name"),
        F.min_by("site_url", "ord").alias("new_site_url"),
    )
    fresh = {
        "id": F.xxhash64("feed_url"),
        "name": F.col("new_name"),
        "site_url": F.col("new_site_url"),
        "active": F.lit(True),
    }
    is_new = F.col("_known").isNull()
    columns = []
    for name in sources.columns:
        if name == "name":
            value = F.coalesce("new_name", "name")
        elif name in fresh:
            value = F.when(is_new, fresh[name].cast(sources.schema[name].dataType)).otherwise(F.col(name))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    known = sources.withColumn("_known", F.lit(True))
    return known.join(new, "feed_url", "full_outer").select(*columns)


def update_fetch_state(
    sources: DataFrame, fetches: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Fold triaged fetches (ordered by ``seq``) into the feed table.

    Validators keep their old value where the new one is null or the fetch
    failed; the error is always replaced by that of the last fetch.
    """
    ok = F.col("outcome") == "fetched"

    def last_known(name: str):
        usable = ok & F.col(name).isNotNull()
        return F.max_by(name, F.when(usable, F.col("seq"))).alias(f"new_{name}")

    state = fetches.groupBy(F.col("source_id").alias("id")).agg(
        last_known("etag"),
        last_known("last_modified"),
        F.max_by(F.struct("error"), "seq").alias("last"),
    )
    fetched = F.col("last").isNotNull()
    now = moment(as_of, sources.schema["last_fetched_at"].dataType)
    changed = {
        "etag": F.coalesce("new_etag", "etag"),
        "last_modified": F.coalesce("new_last_modified", "last_modified"),
        "last_error": F.when(fetched, F.col("last.error")).otherwise(F.col("last_error")),
        "last_fetched_at": F.when(fetched, now).otherwise(F.col("last_fetched_at")),
    }
    return sources.join(state, "id", "left").select(
        *(changed.get(c, F.col(c)).alias(c) for c in sources.columns)
    )


def list_sources(sources: DataFrame, active_only: bool = False) -> DataFrame:
    rows = sources.filter("active") if active_only else sources
    return rows.orderBy("name", "id")
