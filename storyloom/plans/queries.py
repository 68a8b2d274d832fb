"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import functions as fn
from storyloom import hooks
from storyloom.functions.dates import moment
from storyloom.operators import alerts as al
from storyloom.operators import articles as ar
from storyloom.operators import cluster as cl
from storyloom.operators import dedup as dd
from storyloom.operators import embed as em
from storyloom.operators import search as se
from storyloom.operators.stored_index import StoredIndex, store_index
from storyloom.plans import fixtures as fx
from storyloom.plans import oracles as o
from storyloom.plans import views as vw
from storyloom.sources import feeds, registry
from storyloom.streaming import poll
from storyloom.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEARCHES = {
    "words": "thble thing",
    "phrase": '"thble thing" OR attion',
    "negated": "thtion -ering",
    "only negated": "-thing -worthless",
    "plural": "things OR worthless thing -the",
    "stopwords": "the and",
    "blank": "   ",
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


# --- sources and sinks ----------------------------------------------------------


@query(
    "s01_feed_items",
    f"""WITH {o.ITEMS}
    SELECT CAST(source_id AS BIGINT) AS source_id, ord AS seq,
        CASE WHEN ord % 2 = 0 THEN url ELSE 'id' || ord END AS guid, trim(url) AS url,
        trim(title) AS title, CASE WHEN ord % 2 = 0 THEN 'c' ELSE 'a' END || ord AS author,
        CASE WHEN ord % 20 = 11 THEN '<div>hello <b>w' || ord || '</b></div>' ELSE {o.norm("content")} END AS content,
        {o.after("ord * 10")} AS published_at
    FROM items WHERE ord % 10 NOT IN (3, 7, 9) AND ord % 20 NOT IN (1, 2, 14)""",
)
def s01(spark, folder):
    bodies = fx.triaged(spark, folder).filter("outcome = 'fetched'").select("source_id", "seq", "feed")
    return feeds.feed_items(bodies).select(
        "source_id", "seq", "guid", "url", "title", "author",
        fn.normalize_whitespace(F.col("content")).alias("content"), ntz("published_at"),
    )


@query("s02_triage", f"WITH {o.FETCHES} SELECT source_id, seq, status, outcome, error FROM outcomes")
def s02(spark, folder):
    return fx.triaged(spark, folder).select("source_id", "seq", "status", "outcome", "error")


@query(
    "s03_upsert_sources",
    f"""WITH {o.SOURCES},
    new AS (
        SELECT 'https://src' || (page_id % 25) || '.example.com/rss' AS feed_url,
            arg_max('feed' || page_id, page_id) AS new_name,
            arg_min('https://site' || page_id || '.example.com', page_id) AS new_site
        FROM pages GROUP BY 1)
    SELECT feed_url, coalesce(new_name, name) AS name,
        CASE WHEN s.id IS NULL THEN new_site ELSE site_url END AS site_url,
        CASE WHEN s.id IS NULL THEN true ELSE active END AS active, etag
    FROM sources s FULL JOIN new USING (feed_url)""",
)
def s03(spark, folder):
    number = F.col("page_id").cast("string")
    incoming = fx.table(spark, folder, "pages").select(
        F.col("page_id").alias("ord"),
        F.concat(F.lit("feed"), number).alias("name"),
        F.concat(F.lit("https://src"), (F.col("page_id") % 25).cast("string"), F.lit(".example.com/rss")).alias("feed_url"),
        F.concat(F.lit("https://site"), number, F.lit(".example.com")).alias("site_url"),
    )
    result = registry.upsert_sources(fx.sources(spark, folder), incoming)
    return result.select("feed_url", "name", "site_url", "active", "etag")


@query(
    "s04_fetch_state",
    f"""WITH {o.SOURCES}, {o.FETCHES},
    state AS (
        SELECT source_id AS id, arg_max(etag, seq) FILTER (outcome = 'fetched' AND etag IS NOT NULL) AS e,
            arg_max(last_modified, seq) FILTER (outcome = 'fetched' AND last_modified IS NOT NULL) AS m,
            arg_max(coalesce(error, ''), seq) AS err
        FROM outcomes GROUP BY 1)
    SELECT s.id, coalesce(e, etag) AS etag, m AS last_modified,
        CASE WHEN f.id IS NULL THEN last_error ELSE nullif(err, '') END AS last_error,
        CASE WHEN f.id IS NOT NULL THEN TIMESTAMP '2024-03-01' END AS last_fetched_at
    FROM sources s LEFT JOIN state f USING (id)""",
)
def s04(spark, folder):
    state = registry.update_fetch_state(
        fx.sources(spark, folder), fx.triaged(spark, folder), "2024-03-01 00:00:00"
    )
    return state.select("id", "etag", "last_modified", "last_error", "last_fetched_at")


@query("s05_list_sources", f"WITH {o.SOURCES} SELECT id, name, feed_url FROM sources WHERE active ORDER BY name")
def s05(spark, folder):
    return registry.list_sources(fx.sources(spark, folder), active_only=True).select("id", "name", "feed_url")


def _item_rows(spark, folder):
    return ar.article_rows(fx.raw_items(spark, folder))


@query(
    "s06_insert_if_absent",
    f"""WITH {o.ITEMS}, rows AS (
        SELECT ord, source_id, guid, {o.canonical("trim(url)")} AS canonical_url FROM items)
    SELECT ord, canonical_url, guid FROM rows i WHERE (ord // 50) % 3 <> 0 AND NOT EXISTS (
        SELECT 1 FROM rows h WHERE (h.ord // 50) % 3 = 0 AND (h.canonical_url = i.canonical_url
            OR (h.source_id = i.source_id AND h.guid = i.guid)))""",
)
def s06(spark, folder):
    rows = _item_rows(spark, folder)
    fresh = dd.new_items(rows.filter("ord div 50 % 3 <> 0"), rows.filter("ord div 50 % 3 = 0"), "url", "guid")
    return fresh.select("ord", "canonical_url", "guid")


@query(
    "s07_article_rows",
    f"""WITH {o.ITEMS},
    plain AS (SELECT * EXCLUDE (content), {o.norm(o.strip("content"))} AS content FROM items),
    texts AS (SELECT ord, title || ' ' || content AS text FROM plain),
    {o.simhashes("sims", "texts", "ord", "text")}
    SELECT ord, source_id, guid, {o.canonical("trim(url)")} AS canonical_url, title, content,
        {o.excerpt("content")} AS excerpt, published_at,
        sha256(lower({o.norm("title || chr(10) || content")})) AS content_hash, simhash
    FROM plain JOIN sims USING (ord)""",
)
def s07(spark, folder):
    return _item_rows(spark, folder).select(
        "ord", "source_id", "guid", "canonical_url", "title", "content", "excerpt", "published_at",
        "content_hash", "simhash",
    )


_ITEM_KEYS = f"""
    plain AS (SELECT *, {o.norm(o.strip("content"))} AS body FROM items),
    texts AS (SELECT ord, title || ' ' || body AS text FROM plain),
    {o.simhashes("sims", "texts", "ord", "text")},
    item_keys AS MATERIALIZED (
        SELECT ord, source_id, guid, {o.canonical("trim(url)")} AS canonical_url,
            sha256(lower({o.norm("title || chr(10) || body")})) AS content_hash, simhash
        FROM plain JOIN sims USING (ord))"""

_STATS_SQL = f"""WITH RECURSIVE {o.ITEMS}, {o.SOURCES}, {o.FETCHES}, {_ITEM_KEYS},
    arrived AS (SELECT * FROM item_keys WHERE ord % 10 NOT IN (3, 7, 9) AND ord % 20 NOT IN (1, 2, 14)), {o.accepted("arrived")},
    fate AS (SELECT source_id, list_contains(acc, n) AS ok FROM numbered CROSS JOIN taken),
    happened AS (
        SELECT id AS source_id, 'source' AS event FROM sources WHERE active
        UNION ALL SELECT source_id, outcome FROM outcomes
        UNION ALL SELECT source_id, CASE WHEN ok THEN 'inserted' ELSE 'duplicate' END FROM fate)
    SELECT /*key*/ count(*) FILTER (event = 'source') AS sources,
        count(*) FILTER (event = 'fetched') AS fetched,
        count(*) FILTER (event = 'not_modified') AS not_modified,
        count(*) FILTER (event = 'inserted') AS inserted,
        count(*) FILTER (event = 'duplicate') AS duplicates,
        count(*) FILTER (event = 'error') AS errors
    FROM happened /*group*/"""


def _ingested(spark, folder):
    arrived = _item_rows(spark, folder).filter("ord % 10 not in (3, 7, 9) and ord % 20 not in (1, 2, 14)")
    fetches = fx.triaged(spark, folder)
    return fx.sources(spark, folder), fetches, dd.decide(arrived)


@query("s08_ingest_stats", _STATS_SQL)
def s08(spark, folder):
    return ar.ingest_stats(*_ingested(spark, folder))


@query(
    "s08_ingest_stats_by_source",
    _STATS_SQL.replace("/*key*/", "CAST(source_id AS BIGINT) AS source_id,").replace(
        "/*group*/", "GROUP BY source_id"
    ),
)
def s08b(spark, folder):
    return ar.ingest_stats_by_source(*_ingested(spark, folder))


# --- scalars --------------------------------------------------------------------


@query("t01_strip_html", f"SELECT page_id, {o.strip('html')} AS text FROM pages")
def t01(spark, folder):
    return fx.texts(spark, folder, "pages").select("page_id", fn.strip_html(F.col("html")).alias("text"))


@query(
    "t02_decode_entities",
    f"""SELECT page_id, {o.entities("html")} AS text,
        chr(CAST(page_id % 40000 + 8000 AS INT)) || 'x' || chr(CAST(65 + page_id % 26 AS INT)) AS numbers
    FROM pages""",
)
def t02(spark, folder):
    page = F.col("page_id")
    numeric = F.concat(
        F.lit("&#"), (page % 40000 + 8000).cast("string"), F.lit(";x&#"), (page % 26 + 65).cast("string"), F.lit(";")
    )
    return fx.texts(spark, folder, "pages").select(
        "page_id", fn.decode_entities(F.col("html")).alias("text"), fn.decode_entities(numeric).alias("numbers")
    )


@query("t03_normalize_whitespace", f"SELECT doc_id, {o.norm('text')} AS text FROM documents")
def t03(spark, folder):
    return fx.texts(spark, folder, "documents").select("doc_id", fn.normalize_whitespace(F.col("text")).alias("text"))


@query("t04_tokenize", f"SELECT doc_id, array_to_string({o.tokens('text')}, ' ') AS tokens FROM documents")
def t04(spark, folder):
    joined = F.array_join(fn.tokenize(F.col("text")), " ").alias("tokens")
    return fx.texts(spark, folder, "documents").select("doc_id", joined)


@query("t05_content_tokens", f"SELECT doc_id, array_to_string({o.content_tokens('text')}, ' ') AS tokens FROM documents")
def t05(spark, folder):
    joined = F.array_join(fn.content_tokens(F.col("text")), " ").alias("tokens")
    return fx.texts(spark, folder, "documents").select("doc_id", joined)


@query("t06_excerpt", f"SELECT page_id, {o.excerpt('html')} AS excerpt FROM pages")
def t06(spark, folder):
    return fx.texts(spark, folder, "pages").select("page_id", fn.excerpt(F.col("html")).alias("excerpt"))


@query("t07_canonical_url", f"SELECT page_id, {o.canonical('trim(url)')} AS canonical_url FROM pages")
def t07(spark, folder):
    return fx.texts(spark, folder, "pages").select("page_id", fn.canonical_url(F.col("url")).alias("canonical_url"))


@query("t08_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def t08(spark, folder):
    return fx.texts(spark, folder, "documents").select("doc_id", fn.content_hash(F.col("text")).alias("content_hash"))


@query(
    "t09_fnv1a64",
    f"""WITH vocab AS (SELECT DISTINCT unnest({o.tokens("text")}) AS token FROM documents),
    hashed AS (SELECT token, {o.fnv("token")} AS h FROM vocab)
    SELECT token, {o.signed("h")} AS hash FROM hashed""",
)
def t09(spark, folder):
    words = fx.texts(spark, folder, "documents").select(F.explode(fn.tokenize(F.col("text"))).alias("token"))
    return words.distinct().select("token", fn.fnv1a64(F.col("token")).alias("hash"))


@query(
    "t10_simhash",
    f"WITH {o.simhashes('sims', 'documents', 'doc_id', 'text')} SELECT doc_id, simhash FROM sims",
)
def t10(spark, folder):
    return fx.texts(spark, folder, "documents").select("doc_id", fn.simhash(F.col("text")).alias("simhash"))


@query(
    "t11_hamming",
    """SELECT l_orderkey, l_linenumber, CAST(bit_count(xor(
        CAST(l_orderkey AS BIGINT) * 1000003, CAST(l_partkey AS BIGINT) * -999983)) AS INT) AS distance
    FROM lineitem""",
)
def t11(spark, folder):
    a = F.col("l_orderkey").cast("bigint") * 1000003
    b = F.col("l_partkey").cast("bigint") * -999983
    return fx.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", fn.hamming(a, b).alias("distance"))


@query(
    "t13_parse_date",
    """SELECT event_id, CASE event_id % 6
            WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR
            WHEN 4 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE END AS parsed
    FROM events""",
)
def t13(spark, folder):
    ts, kind = F.col("ts"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(kind == 1, F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(kind == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 3, F.concat(F.date_format(ts, "d MMM yyyy HH:mm"), F.lit(" EST")))
        .when(kind == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")))
        .otherwise(F.col("props"))
    )
    parsed = fn.parse_date(text).cast("timestamp_ntz").alias("parsed")
    return fx.table(spark, folder, "events").select("event_id", parsed)


@query(
    "t14_effective_time",
    f"""WITH {o.ARTICLES} SELECT id, coalesce(published_at, fetched_at) AS "at" FROM articles""",
)
def t14(spark, folder):
    return fx.articles(spark, folder).select("id", fn.effective_time().alias("at"))


@query(
    "t15_normalize_query",
    f"""SELECT conv_id, turn, left(regexp_replace(text, '^{o._SPACE}+|{o._SPACE}+$', '', 'g'), 500) AS query
    FROM conversations""",
)
def t15(spark, folder):
    return fx.table(spark, folder, "conversations").select("conv_id", "turn", fn.normalize_query(F.col("text")).alias("query"))


# --- de-duplication -------------------------------------------------------------


@query(
    "d01_exact_by_hash",
    f"""WITH {o.ARTICLES} SELECT id, content_hash FROM articles b WHERE id % 2 = 1
        AND content_hash NOT IN (SELECT content_hash FROM articles WHERE id % 2 = 0)""",
)
def d01(spark, folder):
    rows = fx.articles(spark, folder)
    fresh = dd.new_items(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), "hash", order="id")
    return fresh.select("id", "content_hash")


_SIMS = o.simhashes("sims", "articles", "id", "content")


@query(
    "d02_look_back",
    f"""WITH {o.ARTICLES}, {_SIMS} SELECT id, simhash FROM articles JOIN sims USING (id)
        WHERE fetched_at > (SELECT now FROM present) - INTERVAL 72 HOUR""",
)
def d02(spark, folder):
    rows = fx.articles(spark, folder)
    return dd.recent(rows, fx.latest_fetch(spark, folder), 72).select("id", "simhash")


@query(
    "d03_near_pairs",
    f"""WITH {o.ARTICLES}, {_SIMS}, v AS (SELECT DISTINCT simhash AS s FROM sims)
    SELECT a.s AS a, b.s AS b, CAST(bit_count(xor(a.s, b.s)) AS INT) AS distance
    FROM v a JOIN v b ON a.s < b.s WHERE bit_count(xor(a.s, b.s)) <= 3""",
)
def d03(spark, folder):
    return dd.near_pairs(fx.articles(spark, folder).select("simhash"))


@query(
    "d03_near_known",
    f"""WITH {o.ARTICLES}, {_SIMS}, j AS (SELECT id, simhash, fetched_at FROM articles JOIN sims USING (id))
    SELECT id, simhash FROM j b WHERE id % 2 = 1 AND EXISTS (
        SELECT 1 FROM j k WHERE k.id % 2 = 0 AND bit_count(xor(k.simhash, b.simhash)) <= 3
            AND k.fetched_at > (SELECT now FROM present) - INTERVAL 72 HOUR)""",
)
def d03_known(spark, folder):
    rows = fx.articles(spark, folder)
    known = dd.recent(rows.filter("id % 2 = 0"), fx.latest_fetch(spark, folder), 72)
    return dd.near_known(rows.filter("id % 2 = 1"), known).select("id", "simhash")


def _unique_sql(condition: str) -> str:
    return f"""WITH {o.ITEMS}, rows AS (
        SELECT ord, source_id, guid, {o.canonical("trim(url)")} AS canonical_url FROM items)
    SELECT ord FROM rows i WHERE (ord // 50) % 3 <> 0
        AND NOT EXISTS (SELECT 1 FROM rows h WHERE (h.ord // 50) % 3 = 0 AND {condition})"""


@query(
    "d04_unique_url",
    f"""WITH {o.ITEMS}, spelled AS (
        SELECT ord, trim(url) AS url FROM items UNION ALL
        SELECT ord + 1000000000, regexp_replace(trim(url), '^(https?)://(www\\.)?', '\\1://WWW.') || '#again'
        FROM items WHERE (ord // 50) % 3 = 0 AND ord % 4 = 0),
    rows AS (SELECT ord, {o.canonical("url")} AS canonical_url FROM spelled)
    SELECT ord FROM rows i WHERE (ord >= 1000000000 OR (ord // 50) % 3 <> 0)
        AND NOT EXISTS (SELECT 1 FROM rows h WHERE h.ord < 1000000000 AND (h.ord // 50) % 3 = 0
            AND h.canonical_url = i.canonical_url)""",
)
def d04(spark, folder):
    items = fx.raw_items(spark, folder)
    history = items.filter("ord div 50 % 3 = 0")
    # Items of the history come again under another spelling of their address.
    other = F.concat(F.regexp_replace(F.trim("url"), r"^(https?)://(www\.)?", "$1://WWW."), F.lit("#again"))
    again = history.filter("ord % 4 = 0").withColumns({"ord": F.col("ord") + 1_000_000_000, "url": other})
    incoming = items.filter("ord div 50 % 3 <> 0").unionByName(again)
    return dd.new_items(ar.article_rows(incoming), ar.article_rows(history), "url").select("ord")


@query("d05_unique_guid", _unique_sql("h.source_id = i.source_id AND h.guid = i.guid"))
def d05(spark, folder):
    rows = _item_rows(spark, folder)
    return dd.new_items(rows.filter("ord div 50 % 3 <> 0"), rows.filter("ord div 50 % 3 = 0"), "guid").select("ord")


@query(
    "d06_accept_items",
    f"""WITH RECURSIVE {o.ITEMS}, {_ITEM_KEYS}, {o.accepted("item_keys")}
    SELECT ord, list_contains(acc, n) AS accepted FROM numbered CROSS JOIN taken""",
)
def d06(spark, folder):
    return dd.decide(_item_rows(spark, folder)).select("ord", "accepted")


_ARTICLE_KEYS = f"""{o.ARTICLES}, {_SIMS}, keyed AS MATERIALIZED (
    SELECT id AS ord, source_id, guid, canonical_url, content_hash, simhash, fetched_at
    FROM articles JOIN sims USING (id))"""


@query(
    "d06_accept_articles",
    f"""WITH RECURSIVE {_ARTICLE_KEYS}, {o.accepted("keyed")}
    SELECT ord, list_contains(acc, n) AS accepted FROM numbered CROSS JOIN taken""",
)
def d06_articles(spark, folder):
    rows = fx.articles(spark, folder).withColumnRenamed("id", "ord")
    return dd.decide(rows).select("ord", "accepted")


@query(
    "d06_accept_with_history",
    f"""WITH RECURSIVE {_ARTICLE_KEYS},
    stored AS (SELECT * FROM keyed WHERE ord % 5 = 0),
    fresh AS (SELECT * FROM keyed b WHERE ord % 5 <> 0 AND NOT EXISTS (
        SELECT 1 FROM stored h WHERE h.content_hash = b.content_hash
            OR h.canonical_url = b.canonical_url
            OR (h.source_id = b.source_id AND h.guid = b.guid)
            OR (bit_count(xor(h.simhash, b.simhash)) <= 3
                AND h.fetched_at > (SELECT now FROM present) - INTERVAL 72 HOUR))),
    {o.accepted("fresh")}
    SELECT k.ord, coalesce(list_contains(acc, n), false) AS accepted
    FROM keyed k LEFT JOIN numbered USING (ord) CROSS JOIN taken WHERE k.ord % 5 <> 0""",
)
def d06_history(spark, folder):
    rows = fx.articles(spark, folder).withColumnRenamed("id", "ord")
    batch, stored = rows.filter("ord % 5 <> 0"), rows.filter("ord % 5 = 0")
    return dd.decide(batch, stored, fx.latest_fetch(spark, folder)).select("ord", "accepted")


# --- embeddings -----------------------------------------------------------------


def _places(rows: DataFrame, *keys: str) -> DataFrame:
    # The outer form, because a filter on the vector would compute it twice.
    places = rows.select(*keys, F.posexplode_outer("embedding").alias("idx", "w")).filter("w <> 0")
    return places.withColumn("w", F.round(F.col("w").cast("double"), 6))


_W = "round(CAST(w AS DOUBLE), 6) AS w"


@query(
    "e01_hash_embedding",
    f"WITH {o.ARTICLES}, {o.EMBEDDED} SELECT id, CAST(idx AS INT) AS idx, {_W} FROM sparse",
)
def e01(spark, folder):
    rows = fx.articles(spark, folder)
    return _places(rows.select("id", em.hash_embedding(em.article_text()).alias("embedding")), "id")


@query(
    "e02_backfill",
    f"""WITH {o.ARTICLES}, {o.EMBEDDED} SELECT id, CAST(idx AS INT) AS idx, {_W} FROM sparse WHERE id % 2 = 1
        UNION ALL SELECT id, 0, 1.0 FROM articles WHERE id % 2 = 0""",
)
def e02(spark, folder):
    unit = F.array(F.lit(1.0), *[F.lit(0.0)] * 383).cast("array<float>")
    rows = fx.articles(spark, folder).withColumn("embedding", F.when(F.col("id") % 2 == 0, unit))
    return _places(em.backfill_embeddings(rows), "id")


@query(
    "e03_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def e03(spark, folder):
    a = fx.table(spark, folder, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    sim = F.round(em.cosine_similarity(F.col("embedding"), F.col("other")), 6)
    return a.join(b, "vec_id").select("vec_id", sim.alias("sim"))


@query(
    "e04_centroid",
    f"""WITH members AS (SELECT label AS story_id, embedding FROM embeddings), {o.CENTROIDS}
    SELECT story_id AS label, CAST(idx AS INT) AS idx, round(CAST(x AS DOUBLE), 5) AS w FROM means""",
)
def e04(spark, folder):
    rows = em.centroids(fx.table(spark, folder, "embeddings"), "label")
    places = rows.select("label", F.posexplode("centroid").alias("idx", "w"))
    return places.withColumn("w", F.round(F.col("w").cast("double"), 5))


@query(
    "e05_reembed_all",
    f"""WITH {o.ARTICLES}, {o.EMBEDDED}
    SELECT id, true AS detached, CAST(idx AS INT) AS idx, {_W} FROM sparse""",
)
def e05(spark, folder):
    rows = em.reembed_all(fx.placed_articles(spark, folder))
    return _places(rows.withColumn("detached", F.col("story_id").isNull()), "id", "detached")


# --- clustering -----------------------------------------------------------------


def _last_vector(spark, folder) -> str:
    rows = fx.vectors(spark, folder)
    return rows.agg(F.max("fetched_at").cast("string")).first()[0]


def _embedded(spark, folder) -> DataFrame:
    rows = fx.articles(spark, folder).select(
        "id", "story_id", "title", "content", "published_at", "fetched_at", "embedding"
    )
    return em.backfill_embeddings(rows)


@query(
    "c01_nearest_clustered",
    f"""WITH {o.GIVEN_VECS}, {o.forest("c.story_id IS NOT NULL AND c.fetched_at > (SELECT max(fetched_at) FROM vecs) - INTERVAL 72 HOUR", 0.3)}
    SELECT id, parent_id, parent_story, round(sim, 6) AS sim FROM best""",
)
def c01(spark, folder):
    best = cl.nearest_clustered(
        fx.vectors(spark, folder), _last_vector(spark, folder), window_hours=72, threshold=0.3
    )
    return best.select("id", "parent_id", "parent_story", F.round("sim", 6).alias("sim"))


@query("c02_cluster_articles", f"{o.CLUSTERED} SELECT id, story_id, seeded FROM assigned")
def c02(spark, folder):
    return cl.assign_stories(_embedded(spark, folder), fx.latest_fetch(spark, folder))


@query("c02_cluster_more_vectors", f"{o.CLUSTERED_GIVEN} SELECT id, story_id, seeded FROM assigned")
def c02_vectors(spark, folder):
    rows = fx.vectors(spark, folder)
    return cl.assign_stories(rows, _last_vector(spark, folder), threshold=0.3)


@query("c02_created_and_joined", f"{o.CLUSTERED} SELECT count(*) FILTER (seeded) AS created, count(*) FILTER (NOT seeded) AS joined FROM assigned")
def c02_counts(spark, folder):
    return cl.cluster_counts(cl.assign_stories(_embedded(spark, folder), fx.latest_fetch(spark, folder)))


@query(
    "c03_seed_stories",
    f"""{o.CLUSTERED} SELECT v.id, v.title, CAST(1 AS INT) AS article_count, v."at" AS first_seen_at
    FROM assigned JOIN vecs v USING (id) WHERE seeded""",
)
def c03(spark, folder):
    rows, now = _embedded(spark, folder), fx.latest_fetch(spark, folder)
    seeds = cl.seed_stories(rows, cl.assign_stories(rows, now), now)
    return seeds.select("id", "title", "article_count", "first_seen_at")


@query(
    "c04_recompute_story",
    f"""WITH {o.ARTICLES}, {o.STORIES},
    facts AS (
        SELECT placed_story AS id, CAST(count(*) AS INT) AS n,
            arg_min(title, (coalesce(published_at, fetched_at), id)) AS first_title
        FROM articles WHERE placed_story IS NOT NULL GROUP BY 1)
    SELECT s.id, coalesce(s.title, first_title) AS title, n AS article_count, now AS updated_at
    FROM stories s JOIN facts f USING (id) CROSS JOIN present""",
)
def c04(spark, folder):
    stories = cl.recompute_stories(
        fx.stories(spark, folder), fx.placed_articles(spark, folder), fx.latest_fetch(spark, folder)
    )
    return stories.select("id", "title", "article_count", "updated_at")


@query(
    "c04_story_centroids",
    f"""WITH {o.GIVEN_VECS}, members AS (SELECT * FROM vecs WHERE story_id IS NOT NULL), {o.CENTROIDS}
    SELECT story_id AS id, CAST(idx AS INT) AS idx, round(CAST(x AS DOUBLE), 5) AS w FROM means""",
)
def c04_centroids(spark, folder):
    members = fx.vectors(spark, folder).withColumn("title", F.lit("t"))
    blank = members.filter("story_id is not null").select(F.col("story_id").alias("id")).distinct().select(
        "id",
        F.lit("t").alias("title"),
        F.lit(None).cast("array<float>").alias("centroid"),
        F.lit(0).alias("article_count"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    stories = cl.recompute_stories(blank, members, _last_vector(spark, folder))
    places = stories.select("id", F.posexplode("centroid").alias("idx", "w"))
    return places.withColumn("w", F.round(F.col("w").cast("double"), 5))


@query(
    "c05_assign",
    f"""WITH {o.ARTICLES} SELECT id, coalesce(CAST(quality AS BIGINT), placed_story) AS story_id
    FROM articles LEFT JOIN labels ON doc_id = id""",
)
def c05(spark, folder):
    given = fx.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("story_id")
    )
    rows = fx.placed_articles(spark, folder).select("id", "story_id")
    return cl.apply_assignments(rows, given)


_NO_WINDOW = """(c."at" < a."at" OR (c."at" = a."at" AND c.id < a.id))"""


@query(
    "c06_recluster",
    f"""WITH RECURSIVE {o.ARTICLES}, {o.EMBEDDED}, {o.TEXT_VECS}, {o.forest(_NO_WINDOW)}, {o.STORY_WALK}
    SELECT id, story_id FROM assigned""",
)
def c06(spark, folder):
    rows = fx.placed_articles(spark, folder)
    now = fx.latest_fetch(spark, folder)
    placed, _ = cl.recluster(rows, now, window_hours=None)
    return placed.select("id", "story_id")


@query(
    "c06_recluster_window",
    f"{o.CLUSTERED} SELECT a.id, c.story_id FROM articles a LEFT JOIN assigned c ON c.id = a.id",
)
def c06_window(spark, folder):
    """As the polling cycle does it: within the look-back, which bounds the work per article."""
    placed, _ = cl.recluster(fx.placed_articles(spark, folder), fx.latest_fetch(spark, folder))
    return placed.select("id", "story_id")


@query(
    "c07_embed_and_cluster",
    f"""{o.CLUSTERED} SELECT s.id, s.title, CAST(count(*) AS INT) AS article_count, s."at" AS first_seen_at
    FROM assigned a JOIN vecs s ON s.id = a.story_id GROUP BY s.id, s.title, s."at" """,
)
def c07(spark, folder):
    _, stories = cl.embed_and_cluster(fx.articles(spark, folder), None, fx.latest_fetch(spark, folder))
    return stories.select("id", "title", "article_count", "first_seen_at")


# --- search ---------------------------------------------------------------------


def _each_search(build: Callable[[str], DataFrame]) -> DataFrame:
    parts = [build(text).withColumn("qid", F.lit(name)) for name, text in SEARCHES.items()]
    return reduce(DataFrame.unionByName, parts)


_SEARCH = f"WITH {o.ARTICLES}, {o.INDEX}, {o.query_list(SEARCHES)}, {o.matching('queries')}, {o.RANKED}"


@query(
    "q01_postings",
    f"""WITH {o.ARTICLES}, {o.INDEX}
    SELECT lex, article_id, count(*) FILTER (pos < tn) AS title_tf, count(*) FILTER (pos >= tn) AS body_tf,
        string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
    FROM lexed GROUP BY lex, article_id""",
)
def q01(spark, folder):
    index = se.postings(fx.articles(spark, folder))
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query("q01_labelled", f"WITH {o.ARTICLES}, {o.INDEX} SELECT * FROM labelled")
def q01_labelled(spark, folder):
    return se.labelled_postings(se.postings(fx.articles(spark, folder)))


_STORED: dict[tuple[str, ...], StoredIndex] = {}


def _stored_index(spark, folder) -> StoredIndex:
    """One stored index per application and set of document files, which all searches read."""
    files = sorted(fx.table(spark, folder, "documents").inputFiles())
    key = (spark.sparkContext.applicationId, folder, *files)
    if key not in _STORED:
        _STORED[key] = store_index(se.postings(fx.articles(spark, folder)), new_path(spark, "stored-index"))
    return _STORED[key]


@query("q02_match", f"{_SEARCH} SELECT qid, article_id FROM hits")
def q02(spark, folder):
    rows, index = fx.articles(spark, folder), _stored_index(spark, folder)
    return _each_search(lambda text: se.matches(index, rows, text).select("article_id"))


@query("q03_rank", f"{_SEARCH} SELECT qid, article_id, round(rank, 6) AS rank FROM ranked")
def q03(spark, folder):
    rows, index = fx.articles(spark, folder), _stored_index(spark, folder)
    return _each_search(
        lambda text: se.matches(index, rows, text).select("article_id", F.round("rank", 6).alias("rank"))
    )


@query(
    "q04_total",
    f"{_SEARCH} SELECT q.qid, count(article_id) AS total FROM queries q LEFT JOIN hits h ON h.qid = q.qid GROUP BY q.qid",
)
def q04(spark, folder):
    rows, index = fx.articles(spark, folder), _stored_index(spark, folder)
    return _each_search(lambda text: se.total_matches(index, rows, text))


_MARKED = "'<mark>' || p || '</mark>'"


@query(
    "q05_headline",
    f"""WITH {o.ARTICLES},
    cut AS MATERIALIZED (SELECT id, regexp_split_to_array(trim(content), '\\s+') AS ps FROM articles),
    piece AS MATERIALIZED (
        SELECT id, len(ps) AS n, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM cut),
    hit AS MATERIALIZED (
        SELECT DISTINCT id, n, i FROM (SELECT id, n, i, {o.words_of("p")} AS ws FROM piece) x,
            LATERAL ({o.lexeme_rows("id AS found", "(SELECT x.id, x.ws)")}) l
        WHERE list_contains(['thing', 'worthless', 'thble'], l.lex)),
    spans AS MATERIALIZED (
        SELECT id, b, count(*) AS hits FROM (
            SELECT DISTINCT id, greatest(least(i - 5, n - 30), 0) AS b FROM hit) s
        JOIN hit h USING (id) WHERE h.i >= b AND h.i < b + 30 GROUP BY id, b),
    one AS (SELECT id, min((-hits, b)) AS x FROM spans GROUP BY id),
    two AS (
        SELECT s.id, min((-s.hits, s.b)) AS x FROM spans s JOIN one USING (id)
        WHERE abs(s.b - one.x[2]) >= 30 GROUP BY s.id),
    shown AS (SELECT id, x[2] AS b FROM one UNION ALL SELECT id, x[2] FROM two),
    lines AS (
        SELECT s.id, b, string_agg(CASE WHEN h.i IS NULL THEN p ELSE {_MARKED} END, ' ' ORDER BY q.i) AS line
        FROM shown s JOIN piece q ON q.id = s.id AND q.i >= b AND q.i < b + 30
        LEFT JOIN hit h ON h.id = q.id AND h.i = q.i GROUP BY s.id, b)
    SELECT c.id, coalesce(
        (SELECT string_agg(line, ' ... ' ORDER BY b) FROM lines l WHERE l.id = c.id), array_to_string(ps[1:10], ' ')) AS headline
    FROM cut c""",
)
def q05(spark, folder):
    rows = fx.articles(spark, folder)
    return rows.select("id", se.headline(F.col("content"), ["thing", "worthless", "thble"]).alias("headline"))


@query(
    "q06_page",
    f"""{_SEARCH} SELECT a.id, a.title, s.name AS source_name, round(r.rank, 6) AS rank
    FROM ranked r JOIN articles a ON a.id = r.article_id
    JOIN (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS source_id, source AS name FROM documents) s
        USING (source_id)
    WHERE r.qid = 'phrase'
    ORDER BY r.rank DESC, coalesce(published_at, fetched_at) DESC, a.id LIMIT 25 OFFSET 5""",
)
def q06(spark, folder):
    rows = fx.articles(spark, folder)
    index = _stored_index(spark, folder)
    page = se.search(index, rows, fx.sources(spark, folder), SEARCHES["phrase"], limit=25, offset=5)
    return page.select("id", "title", "source_name", F.round("rank", 6).alias("rank"))


# --- alerts ---------------------------------------------------------------------


@query(
    "a01_alerts",
    f"""WITH {o.ALERTS} SELECT id, query, 'inbox' AS channel, active, created_at FROM alerts
    UNION ALL SELECT 1000000 + conv_id, left(text, 40), 'inbox', true, TIMESTAMP '2024-03-01'
    FROM conversations WHERE turn = 0""",
)
def a01(spark, folder):
    new = fx.table(spark, folder, "conversations").filter("turn = 0").select(
        (F.col("conv_id") + 1000000).alias("id"),
        F.lit("talk").alias("name"),
        F.substring("text", 1, 40).alias("query"),
    )
    alerts = al.add_alerts(fx.alerts(spark, folder), new, "2024-03-01 00:00:00")
    return al.list_alerts(alerts).select("id", "query", "channel", "active", "created_at")


_ALERT_HITS = f"""WITH {o.ARTICLES}, {o.INDEX}, {o.present_window(72)}, {o.ALERTS}, {o.EARLIER_MATCHES},
    saved AS (SELECT id AS qid, query FROM alerts WHERE active), {o.matching("saved", "recent")}"""


@query(
    "a02_run_alerts",
    f"""{_ALERT_HITS} SELECT qid AS alert_id, article_id, now AS matched_at, false AS notified
    FROM hits h CROSS JOIN present WHERE NOT EXISTS (
        SELECT 1 FROM matches m WHERE m.alert_id = h.qid AND m.article_id = h.article_id)""",
)
def a02(spark, folder):
    return al.run_alerts(
        fx.alerts(spark, folder),
        fx.articles(spark, folder),
        fx.earlier_matches(spark, folder),
        fx.latest_fetch(spark, folder),
        hours=72,
    )


@query(
    "a03_last_run",
    f"""WITH {o.ALERTS} SELECT id, active, CASE WHEN active THEN TIMESTAMP '2024-03-01' END AS last_run_at
    FROM alerts""",
)
def a03(spark, folder):
    return al.stamp_runs(fx.alerts(spark, folder), "2024-03-01 00:00:00").select("id", "active", "last_run_at")


_NAMED = "(SELECT id AS source_id, name AS source_name FROM sources)"


@query(
    "a04_matches_of_alert",
    f"""WITH {o.ARTICLES}, {o.SOURCES}, {o.EARLIER_MATCHES}
    SELECT a.id, a.title, source_name, matched_at FROM matches m JOIN articles a ON a.id = m.article_id
    JOIN {_NAMED} USING (source_id)
    WHERE alert_id = 0 ORDER BY matched_at DESC, a.id LIMIT 50""",
)
def a04(spark, folder):
    rows = al.alert_matches(
        fx.earlier_matches(spark, folder), fx.articles(spark, folder), fx.sources(spark, folder), 0
    )
    return rows.select("id", "title", "source_name", "matched_at")


@query(
    "a05_latest_matches",
    f"""WITH {o.ARTICLES}, {o.SOURCES}, {o.EARLIER_MATCHES}, top AS (
        SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY matched_at DESC, article_id) AS place
        FROM matches)
    SELECT alert_id, CAST(place AS INT) AS place, a.id, a.title, source_name, matched_at
    FROM top JOIN articles a ON a.id = article_id JOIN {_NAMED} USING (source_id) WHERE place <= 10""",
)
def a05(spark, folder):
    rows = al.latest_matches(
        fx.earlier_matches(spark, folder), fx.articles(spark, folder), fx.sources(spark, folder)
    )
    return rows.select("alert_id", "place", "id", "title", "source_name", "matched_at")


# --- views ----------------------------------------------------------------------


@query(
    "v01_recent_articles",
    f"""WITH {o.ARTICLES}, {o.SOURCES}
    SELECT a.id, a.title, source_name, coalesce(published_at, fetched_at) AS "at"
    FROM articles a JOIN {_NAMED} USING (source_id) ORDER BY "at" DESC, a.id LIMIT 50 OFFSET 20""",
)
def v01(spark, folder):
    rows = vw.recent_articles(fx.articles(spark, folder), fx.sources(spark, folder), 50, 20)
    return rows.select("id", "title", "source_name", "at")


@query(
    "v02_article_by_id",
    f"""WITH {o.ARTICLES}, {o.SOURCES} SELECT a.id, a.title, a.content, source_name
    FROM articles a JOIN {_NAMED} USING (source_id) WHERE a.id = 77""",
)
def v02(spark, folder):
    rows = vw.article_by_id(fx.articles(spark, folder), fx.sources(spark, folder), 77)
    return rows.select("id", "title", "content", "source_name")


@query("v03_counts", f"""WITH {o.ARTICLES}, {o.STORIES} SELECT 'articles' AS kind, count(*) AS n FROM articles
    UNION ALL SELECT 'stories', count(*) FROM stories WHERE article_count > 0""")
def v03(spark, folder):
    articles = vw.count_articles(fx.articles(spark, folder)).select(F.lit("articles").alias("kind"), "n")
    stories = vw.count_stories(fx.stories(spark, folder)).select(F.lit("stories").alias("kind"), "n")
    return articles.unionByName(stories)


_STORY_LIST = f"""WITH {o.ARTICLES}, {o.STORIES},
    facts AS (
        SELECT placed_story AS id, count(DISTINCT source_id) AS source_count,
            max(coalesce(published_at, fetched_at)) AS latest_at,
            arg_max({o.excerpt("content")}, (coalesce(published_at, fetched_at), id)) AS excerpt
        FROM articles WHERE placed_story IS NOT NULL GROUP BY 1)
    SELECT s.id, s.title, article_count, source_count, latest_at, excerpt
    FROM stories s LEFT JOIN facts USING (id) WHERE article_count > 0"""


@query("v04_story_list", _STORY_LIST)
def v04(spark, folder):
    rows = vw.list_stories(fx.stories(spark, folder), fx.placed_articles(spark, folder), limit=None)
    return rows.select("id", "title", "article_count", "source_count", "latest_at", "excerpt")


@query("v04_story_page", f"{_STORY_LIST} ORDER BY latest_at DESC NULLS LAST, s.id LIMIT 30 OFFSET 30")
def v04_page(spark, folder):
    rows = vw.list_stories(fx.stories(spark, folder), fx.placed_articles(spark, folder), 30, 30)
    return rows.select("id", "title", "article_count", "source_count", "latest_at", "excerpt")


@query(
    "v05_story_by_id",
    f"WITH {o.ARTICLES}, {o.STORIES} SELECT id, title, article_count, first_seen_at FROM stories WHERE id = 70",
)
def v05(spark, folder):
    return vw.story_by_id(fx.stories(spark, folder), 70).select("id", "title", "article_count", "first_seen_at")


@query(
    "v06_timeline",
    f"""WITH {o.ARTICLES}, {o.SOURCES}
    SELECT a.id, a.title, source_name, coalesce(published_at, fetched_at) AS "at"
    FROM articles a JOIN {_NAMED} USING (source_id) WHERE placed_story = 70 ORDER BY "at", a.id""",
)
def v06(spark, folder):
    rows = vw.story_articles(fx.placed_articles(spark, folder), fx.sources(spark, folder), 70)
    return rows.select("id", "title", "source_name", "at")


@query(
    "v06_story_sources",
    f"""WITH {o.ARTICLES}, {o.SOURCES}
    SELECT placed_story AS story_id, source_name, min(coalesce(published_at, fetched_at)) AS first_at
    FROM articles JOIN {_NAMED} USING (source_id) WHERE placed_story IS NOT NULL GROUP BY 1, 2""",
)
def v06_sources(spark, folder):
    return vw.story_sources(fx.placed_articles(spark, folder), fx.sources(spark, folder))


@query(
    "v07_home_feed",
    f"""SELECT 'story' AS kind, id, title, excerpt, latest_at AS "at" FROM ({_STORY_LIST})
    ORDER BY "at" DESC NULLS LAST, id LIMIT 30""",
)
def v07(spark, folder):
    return vw.home_feed(fx.stories(spark, folder), fx.placed_articles(spark, folder), fx.sources(spark, folder))


@query(
    "v07_home_feed_without_stories",
    f"""WITH {o.ARTICLES}
    SELECT 'article' AS kind, id, title, {o.excerpt("content")} AS excerpt,
        coalesce(published_at, fetched_at) AS "at"
    FROM articles ORDER BY "at" DESC, id LIMIT 30 OFFSET 30""",
)
def v07_fallback(spark, folder):
    none = fx.stories(spark, folder).filter("article_count < 0")
    return vw.home_feed(none, fx.articles(spark, folder), fx.sources(spark, folder), page=2)


@query(
    "v08_lead_summary",
    f"""WITH {o.ARTICLES}, leads AS (
        SELECT placed_story AS story_id, arg_min(title || '. ' || content, (coalesce(published_at, fetched_at), id)) AS t
        FROM articles WHERE placed_story IS NOT NULL GROUP BY 1)
    SELECT story_id, {o.excerpt("t", 400)} AS summary FROM leads""",
)
def v08(spark, folder):
    return vw.lead_summaries(fx.placed_articles(spark, folder))


# --- streaming and hooks --------------------------------------------------------


POLLS = 3


def _poll(spark, folder) -> poll.PollCycle:
    """Land the pages in ranges of arrival and run the cycle over one after another."""
    landed = new_path(spark, "landed-items")
    items = fx.raw_items(spark, folder)
    items = items.withColumns(
        {
            "source_id": F.col("source_id").cast("bigint"),
            "published_at": F.col("published_at").cast("timestamp"),
            "fetched_at": F.col("fetched_at").cast("timestamp"),
        }
    )
    last = items.agg(F.max("ord")).first()[0] or 0
    for batch in range(POLLS):
        # Files are taken in order of their age.
        one = items.filter(F.floor(F.col("ord") * POLLS / (last + 1)) == batch).repartition(1)
        one.write.option("parquet.block.size", 8 << 20).mode("append").parquet(landed)
    cycle = poll.PollCycle(spark, new_path(spark, "news-store"), fx.alerts(spark, folder))
    stream = poll.read_items(spark, landed, max_files=1)
    cycle.start(stream, new_path(spark, "poll-progress")).awaitTermination()
    return cycle


# The cycle item by item: batches are ranges of arrival; a window ends with its batch.
_POLL = f"""WITH RECURSIVE {o.ITEMS}, {_ITEM_KEYS}, {o.ALERTS},
    polled AS MATERIALIZED (
        SELECT k.*, i.title, p.body, i.published_at, {o.after("k.ord * 10 + 30")} AS fetched_at,
            floor(k.ord * {POLLS} / ((SELECT max(ord) FROM items) + 1)) AS batch
        FROM item_keys k JOIN items i USING (ord) JOIN plain p USING (ord)),
    arrivals AS MATERIALIZED (SELECT *, max(fetched_at) OVER (PARTITION BY batch) AS batch_end FROM polled),
    {o.accepted("arrivals", "(i.batch = j.batch OR i.fetched_at > j.batch_end - INTERVAL 72 HOUR)")},
    articles AS MATERIALIZED (
        SELECT ord, ('0x' || substr(sha256(canonical_url), 1, 15))::BIGINT AS id, canonical_url, title, body AS content,
            coalesce(published_at, fetched_at) AS "at", fetched_at, batch, batch_end
        FROM numbered CROSS JOIN taken WHERE list_contains(acc, n)),
    {o.EMBEDDED},
    unit AS MATERIALIZED (
        SELECT id, CAST(NULL AS BIGINT) AS story_id, "at", fetched_at, batch, batch_end, CAST(embedding AS DOUBLE[]) AS v,
            sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len
        FROM articles JOIN dense USING (id)),
    best AS MATERIALIZED (
        SELECT id, parent_id, CAST(NULL AS BIGINT) AS parent_story FROM (
            SELECT a.id, c.id AS parent_id, round(list_dot_product(a.v, c.v) / (a.len * c.len), 9) AS sim,
                row_number() OVER (PARTITION BY a.id ORDER BY
                    round(list_dot_product(a.v, c.v) / (a.len * c.len), 9) DESC, c.batch = a.batch, c."at", c.id) AS rn
            FROM unit a JOIN unit c ON c.fetched_at > a.batch_end - INTERVAL 72 HOUR AND (c.batch < a.batch
                OR (c.batch = a.batch AND (c."at" < a."at" OR (c."at" = a."at" AND c.id < a.id))))
            WHERE a.len > 0 AND c.len > 0)
        WHERE rn = 1 AND sim >= 0.62),
    {o.STORY_WALK},
    {o.INDEX}, saved AS (SELECT id AS qid, query FROM alerts WHERE active), {o.matching("saved")},
    sizes AS (SELECT story_id, count(*) AS story_size FROM assigned GROUP BY 1),
    alerted AS (SELECT article_id, count(*) AS alerts FROM hits JOIN articles ON id = article_id
        WHERE fetched_at > batch_end - INTERVAL 72 HOUR GROUP BY 1)"""


@query(
    "r01_poll_cycle",
    f"""{_POLL} SELECT a.ord, a.canonical_url, a.title, s.story_id, CAST(story_size AS INT) AS story_size, alerts
    FROM articles a JOIN assigned s USING (id) JOIN sizes USING (story_id)
    LEFT JOIN alerted ON article_id = a.id""",
)
def r01(spark, folder):
    cycle = _poll(spark, folder)
    sizes = cycle.stories().select(F.col("id").alias("story_id"), F.col("article_count").alias("story_size"))
    rows = cycle.articles().join(cycle.assignments().select("id", "story_id"), "id", "left").join(sizes, "story_id", "left")
    counts = cycle.matches().groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("alerts"))
    return rows.join(counts, "id", "left").select("ord", "canonical_url", "title", "story_id", "story_size", "alerts")


@query(
    "r01_stories",
    f"""{_POLL} SELECT s.story_id AS id, seed.title, story_size AS article_count, seed."at" AS first_seen_at,
        (SELECT max(batch_end) FROM articles JOIN assigned m USING (id) WHERE m.story_id = s.story_id) AS updated_at
    FROM sizes s JOIN articles seed ON seed.id = s.story_id""",
)
def r01_stories(spark, folder):
    """Story rows as the cycle keeps them, from sums it added to batch by batch."""
    stories = _poll(spark, folder).stories().filter("size(centroid) = 384")
    return stories.select("id", "title", F.col("article_count").cast("bigint").alias("article_count"), ntz("first_seen_at"), ntz("updated_at"))


@query(
    "r01_last_runs",
    f"""WITH {o.ITEMS}, {o.ALERTS}
    SELECT id, CASE WHEN active THEN (SELECT {o.after("max(ord) * 10 + 30")} FROM items) END AS last_run_at FROM alerts""",
)
def r01_last_runs(spark, folder):
    return _poll(spark, folder).alert_table().select("id", ntz("last_run_at"))


@query(
    "r02_rerun_alerts",
    f"""{_ALERT_HITS} SELECT alert_id, article_id FROM matches
    UNION SELECT qid, article_id FROM hits""",
)
def r02(spark, folder):
    alerts, rows = fx.alerts(spark, folder), fx.articles(spark, folder)
    now = fx.latest_fetch(spark, folder)
    recorded = fx.earlier_matches(spark, folder)
    for _ in range(2):
        recorded = recorded.unionByName(al.run_alerts(alerts, rows, recorded, now, hours=72))
    return recorded.select("alert_id", "article_id")


@query(
    "r03_streaming_prefilter",
    """SELECT text_hash FROM (SELECT DISTINCT sha256(text) AS text_hash FROM documents)""",
)
def r03(spark, folder):
    # Fetch times lie inside one look-back here, so exactly the first copy stays.
    schema = fx.table(spark, folder, "documents").schema
    # A table is one file or a folder of files; a stream takes either as a pattern only.
    documents = spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")
    stream = documents.select(
        F.sha2("text", 256).alias("text_hash"), moment(fx.EPOCH, T.TimestampType()).alias("fetched_at")
    )
    out = new_path(spark, "prefiltered")
    poll.drop_recent_repeats(stream, ["text_hash"]).writeStream.format("parquet").option(
        "path", out
    ).option("checkpointLocation", new_path(spark, "prefilter-progress")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(out).select("text_hash")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _length_and_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [float(len(t)), float(t.count(" "))])


@query(
    "u01_embedder_hook",
    f"""WITH {o.ARTICLES}, t AS (SELECT id, title || chr(10) || content AS x FROM articles)
    SELECT id, CAST(length(x) AS DOUBLE) AS chars, CAST(length(x) - length(replace(x, ' ', '')) AS DOUBLE) AS spaces
    FROM t""",
)
def u01(spark, folder):
    embed = em.embedder("lengths", lengths=_length_and_words)
    rows = em.backfill_embeddings(fx.articles(spark, folder), embed)
    v = F.col("embedding")
    return rows.select("id", v[0].cast("double").alias("chars"), v[1].cast("double").alias("spaces"))


def _word_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {
                "article_id": batch["article_id"],
                "subject": batch["title"],
                "predicate": "chars",
                "object": batch["content"].str.len().astype(str),
                "confidence": 0.5,
            }
        )


@query(
    "u02_fact_hook",
    f"""WITH {o.ARTICLES} SELECT id AS article_id, title AS subject, 'chars' AS predicate,
        CAST(length(content) AS VARCHAR) AS object, 0.5::DOUBLE AS confidence FROM articles""",
)
def u02(spark, folder):
    facts = hooks.extract_facts(fx.articles(spark, folder), _word_facts)
    return facts.withColumn("confidence", F.col("confidence").cast("double"))


@query(
    "u03_summary_hook",
    f"""WITH {o.ARTICLES} SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE placed_story END AS story_id,
        string_agg(left(title, 10), '; ' ORDER BY coalesce(published_at, fetched_at), id) AS summary
    FROM articles WHERE id % 3 = 0 OR placed_story IS NOT NULL GROUP BY 1""",
)
def u03(spark, folder):
    # Every third article belongs to one large story.
    rows = fx.placed_articles(spark, folder)
    rows = rows.withColumn("story_id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("story_id")))
    return hooks.summarize_in_parts(rows, lambda pairs: "; ".join(title[:10] for title, _ in pairs), "; ".join)
