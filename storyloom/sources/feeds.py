"""Landed feed responses: triage and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.dates import parse_date
from storyloom.functions.text import trim_space

# Elements that may come several times are arrays, of which the first counts.  A
# string holds nested markup as it stands.
_RSS_ITEM = """
    title string, link string, guid struct<_VALUE: string, _isPermaLink: string>,
    author array<string>, `dc:creator` array<string>, description string, `content:encoded` string,
    pubDate string, `dc:date` string
"""
# One schema for both kinds: a body is parsed once, and fields of the other kind stay null.
_FEED = f"""
    channel struct<item: array<struct<{_RSS_ITEM}>>>,
    item array<struct<{_RSS_ITEM}>>,
    entry array<struct<
        title: string, id: string, published: string, updated: string,
        link: array<struct<_href: string, _rel: string>>,
        author: array<struct<name: string>>,
        content: string,
        summary: string>>,
    _corrupt_record string
"""
# The field must be the last one: as the first it would empty the items of sound bodies.
_PARSING = {"columnNameOfCorruptRecord": "_corrupt_record"}
_FEED_ROOT = r"(?i)<(rss|rdf:rdf|feed)[\s>]"


def parsed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Add ``feed``: the body parsed, whatever its kind; null for one that is no feed at all.

    Everything after reads this one column.  The explode of a single value keeps filters on
    it from being moved below, where the body would be parsed again for each of them.
    """
    if "feed" in bodies.columns:
        return bodies
    xml = F.col(body)
    is_feed = F.coalesce(xml, F.lit("")).rlike(_FEED_ROOT)
    feed = F.when(is_feed, F.from_xml(xml, _FEED, _PARSING))
    return bodies.select("*", F.explode(F.array(feed)).alias("feed"))


def triage(fetches: DataFrame) -> DataFrame:
    """Name the outcome of each fetch: not_modified, error or fetched.

    A body that does not parse is an error of its source, so the validators that
    came with it are not kept and the next poll fetches it again.  The parsed body is
    kept as ``feed`` for ``feed_items``.
    """
    fetches, status = parsed(fetches), F.col("status")
    broken = F.col("feed").isNull() | F.col("feed._corrupt_record").isNotNull()
    error = F.when(
        status >= 400,
        F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" fetching "), F.col("feed_url")),
    ).when((status != 304) & broken, "not a feed")
    return fetches.withColumn("error", error).withColumn(
        "outcome",
        F.when(status == 304, "not_modified").when(F.col("error").isNotNull(), "error").otherwise("fetched"),
    )


def feed_items(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of every RSS or Atom body; items without a link or guid go.

    All columns of ``bodies`` but the body are kept.  ``position`` is the place
    of the item in its feed.  A ``feed`` column, as triage leaves it, is not parsed again.
    """
    kept = [c for c in bodies.columns if c not in (body, "feed")]
    feed = F.col("feed")
    items = F.coalesce(_atom_items(feed), _rss_items(feed))
    rows = parsed(bodies, body).select(*kept, F.posexplode(items).alias("position", "item"))
    item = F.col("item")
    return (
        rows.withColumn("url", trim_space(F.coalesce(item["link"], item["guid"], F.lit(""))))
        .filter(F.col("url") != "")
        .select(
            *kept,
            "position",
            item["guid"].alias("guid"),
            "url",
            trim_space(F.coalesce(item["title"], F.lit("(untitled)"))).alias("title"),
            item["author"].alias("author"),
            F.coalesce(item["content"], F.lit("")).alias("content"),
            parse_date(item["date"]).alias("published_at"),
        )
    )


def _item(**fields: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in fields.items()))


def _rss_items(feed: Column) -> Column:
    return F.transform(
        F.coalesce(feed["channel"]["item"], feed["item"]),
        lambda i: _item(
            link=i["link"],
            guid=i["guid"]["_VALUE"],
            title=i["title"],
            author=F.coalesce(F.get(i["dc:creator"], F.lit(0)), F.get(i["author"], F.lit(0))),
            content=F.coalesce(i["content:encoded"], i["description"]),
            date=F.coalesce(i["pubDate"], i["dc:date"]),
        ),
    )


def _atom_items(feed: Column) -> Column:
    def page(links: Column) -> Column:
        usable = F.filter(
            links, lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate"
        )
        return F.get(usable, F.lit(0))["_href"]

    return F.transform(
        feed["entry"],
        lambda e: _item(
            link=page(e["link"]),
            guid=e["id"],
            title=e["title"],
            author=F.get(e["author"], F.lit(0))["name"],
            content=F.coalesce(e["content"], e["summary"]),
            date=F.coalesce(e["published"], e["updated"]),
        ),
    )
