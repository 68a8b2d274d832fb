"""Saved searches: all of them against all new articles in one job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.dates import moment
from storyloom.operators.dedup import recent
from storyloom.operators.search import postings, query_units
from storyloom.settings import ALERT_WINDOW_HOURS
from storyloom.tables import lookup, page_rows, written


def add_alerts(alerts: DataFrame, new: DataFrame, as_of: datetime | str) -> DataFrame:
    """Append saved searches (id, name, query, optional channel and target)."""
    defaults = {
        "channel": F.lit("inbox"),
        "target": F.lit(None),
        "active": F.lit(True),
        "last_run_at": F.lit(None),
        "created_at": moment(as_of, alerts.schema["created_at"].dataType),
    }
    columns = []
    for field in alerts.schema.fields:
        value = F.col(field.name) if field.name in new.columns else defaults[field.name]
        if field.name == "channel" and field.name in new.columns:
            value = F.coalesce(value, F.lit("inbox"))
        columns.append(value.cast(field.dataType).alias(field.name))
    return alerts.unionByName(new.select(*columns))


def list_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("created_at").desc(), F.col("id").desc())


def alert_lexemes(alerts: DataFrame) -> DataFrame:
    """One row per lexeme of every active alert's query, which is read whole.

    Only the web search box cuts what is typed, see ``normalize_query``.
    """
    units = alerts.filter("active").select(
        F.col("id").alias("alert_id"), F.inline(query_units(F.col("query")))
    )
    start = F.array_min(F.transform("lexemes", lambda w: w["off"]))
    return units.select(
        "alert_id", "conj", "clause", "negated", start.alias("start"),
        F.size("lexemes").alias("width"), F.inline("lexemes"),
    ).withColumn("off", F.col("off") - F.col("start")).drop("start")


def alert_hits(index: DataFrame, articles: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert_id, article_id) of every match.

    Each alternative of each alert is tried only on articles that hold its
    rarest required lexeme; the others are looked up for those candidates.  A
    frequent word therefore never meets all alerts that mention it.  Alternatives
    of negations only hold everywhere but where one of their clauses hits.
    """
    words = written(alert_lexemes(alerts), "alert-lexemes")
    used = lookup(index.select("lex", "article_id", "positions"), words.select("lex").distinct(), "lex")
    used = written(used, "alert-postings")
    frequency = used.groupBy("lex").agg(F.count("*").alias("df"))
    words = written(words.join(frequency, "lex", "left").fillna(0, ["df"]), "alert-words")
    required = words.groupBy("alert_id", "conj").agg(
        F.min(F.when(~F.col("negated"), F.struct("df", "lex"))).alias("rarest")
    )
    tried = (
        required.filter("rarest.df > 0")
        .select("alert_id", "conj", F.col("rarest.lex").alias("lex"))
        .join(used.select("lex", "article_id"), "lex")
        .select("alert_id", "conj", "article_id")
        .join(words.drop("df"), ["alert_id", "conj"])
    )
    found = (
        _clauses(tried, used)
        .select("alert_id", "conj", "article_id", (F.col("holds") != F.col("negated")).alias("ok"))
        .groupBy("alert_id", "conj", "article_id")
        .agg(F.min("ok").alias("ok"))
        .filter("ok")
        .select("alert_id", "article_id")
    )
    # One row per saved search of that kind, a part of a small table.
    negations = required.filter("rarest is null").select("alert_id", "conj").orderBy("alert_id", "conj").collect()
    if negations:
        found = found.unionByName(_without(negations, words, used, articles))
    return found.distinct()


def _clauses(tried: DataFrame, used: DataFrame) -> DataFrame:
    """Whether each clause tried on an article holds there: all its lexemes point to one common start.

    Both aggregations of the caller and this one use the one shuffle by alternative and article.
    """
    looked_up = tried.join(used, ["article_id", "lex"], "left").select(
        "alert_id", "conj", "article_id", "clause", "negated", "width",
        F.transform("positions", lambda p: p - F.col("off")).alias("starts"),
    )
    by_article = looked_up.repartition("alert_id", "conj", "article_id")
    clauses = by_article.groupBy("alert_id", "conj", "article_id", "clause", "negated", "width").agg(
        F.collect_list("starts").alias("starts")
    )
    common = F.aggregate(
        F.slice("starts", F.lit(2), F.size("starts")), F.get("starts", F.lit(0)), lambda a, b: F.array_intersect(a, b)
    )
    holds = (F.size("starts") == F.col("width")) & (F.coalesce(F.size(common), F.lit(0)) > 0)
    return clauses.withColumn("holds", holds)


def _without(negations: list, words: DataFrame, used: DataFrame, articles: DataFrame) -> DataFrame:
    """Matches of alternatives of negations only: the complement of what their clauses hit.

    The hits are found from the rarest lexeme of each clause and gathered per article;
    each article then takes all these alternatives but those.  No article is tried
    against an alternative, and the only join with all articles is over their ids.
    """
    name = F.concat_ws(":", "alert_id", "conj")
    every = F.split(F.lit(",".join(f"{r.alert_id}:{r.conj}" for r in negations)), ",")
    clause = ["alert_id", "conj", "clause"]
    own = words.filter(F.array_contains(every, name))
    rarest = own.groupBy(*clause).agg(F.min(F.struct("df", "lex")).alias("rarest")).filter("rarest.df > 0")
    started = rarest.select(*clause, F.col("rarest.lex").alias("lex")).join(used.select("lex", "article_id"), "lex")
    single = own.filter("width = 1").select(*clause)
    alone = started.join(single, clause, "left_semi").select("alert_id", "conj", "article_id")
    phrases = started.drop("lex").join(own.filter("width > 1").drop("df"), clause)
    hit = _clauses(phrases, used).filter("holds").select("alert_id", "conj", "article_id").unionByName(alone)
    blocked = hit.groupBy("article_id").agg(F.collect_set(name).alias("blocked"))
    left = articles.select(F.col("id").alias("article_id")).join(blocked, "article_id", "left")
    kept = F.array_except(every, F.coalesce("blocked", F.array().cast("array<string>")))
    kind = words.schema["alert_id"].dataType
    return left.select(F.explode(kept).alias("name"), "article_id").select(
        F.split_part("name", F.lit(":"), F.lit(1)).cast(kind).alias("alert_id"), "article_id"
    )


def run_alerts(
    alerts: DataFrame,
    articles: DataFrame,
    matches: DataFrame,
    as_of: datetime | str,
    hours: float = ALERT_WINDOW_HOURS,
    index: DataFrame | None = None,
) -> DataFrame:
    """New matches of active alerts among articles fetched within the window.

    ``index`` is a stored index of just the articles in the window; without it
    one is made.
    """
    window = recent(articles, as_of, hours)
    if index is None:
        index = postings(window)
    kind = matches.schema["matched_at"].dataType
    return (
        alert_hits(index, window, alerts)
        .join(matches, ["alert_id", "article_id"], "left_anti")
        .select(
            "alert_id",
            "article_id",
            moment(as_of, kind).alias("matched_at"),
            F.lit(False).alias("notified"),
        )
    )


def stamp_runs(alerts: DataFrame, as_of: datetime | str) -> DataFrame:
    """Note the run on every active alert, with or without a hit."""
    now = moment(as_of, alerts.schema["last_run_at"].dataType)
    return alerts.withColumn("last_run_at", F.when(F.col("active"), now).otherwise(F.col("last_run_at")))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "site_url")
    return rows.join(named, "source_id")


def alert_matches(
    matches: DataFrame, articles: DataFrame, sources: DataFrame, alert_id: int, limit: int = 50
) -> DataFrame:
    """Articles matched by one alert, newest match first."""
    order = [F.col("matched_at").desc(), F.col("id")]
    chosen = matches.filter(F.col("alert_id") == alert_id).select(
        F.col("article_id").alias("id"), "matched_at"
    )
    page = chosen.join(articles.select("id", "fetched_at"), "id").orderBy(*order).limit(limit)
    return _with_source(page_rows(articles, page), sources).orderBy(*order)


def latest_matches(
    matches: DataFrame, articles: DataFrame, sources: DataFrame, per_alert: int = 10
) -> DataFrame:
    """The newest matches of every alert.

    The rank filter is applied before the shuffle too, so an alert with very
    many matches sends at most ``per_alert`` rows per task.
    """
    top = matches.selectExpr(
        "*",
        "row_number() over (partition by alert_id order by matched_at desc, article_id) as place",
    ).filter(F.col("place") <= per_alert)
    rows = top.withColumnRenamed("article_id", "id").join(articles, "id")
    return _with_source(rows, sources)
