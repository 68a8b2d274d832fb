"""Ranked text search with words, phrases, OR and negation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.binding import let
from storyloom.functions.dates import effective_time
from storyloom.operators.stored_index import StoredIndex
from storyloom.tables import page_rows

# Weight of a title and of a body occurrence.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
# Text that the index is made of at a time; its arrays take about 20 times as much.
SLICE_BYTES = 2 << 20

# English words the index leaves out (the public Snowball list).
SEARCH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too
    very s t can will just don should now
    """.split()
)


# --- lexemes and the index ------------------------------------------------------


def lexeme(token: Column) -> Column:
    """Plural endings removed by the three rules of Harman's S-stemmer."""
    return (
        F.when(~token.endswith("s"), token)
        .when(token.rlike("[^ea]ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("[^aeo]es$"), F.regexp_replace(token, "s$", ""))
        .when(token.rlike("[^us]s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def lexemes(text: Column) -> Column:
    """All words of a text in order; words that are not indexed are null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(
        words, lambda w: F.when((F.length(w) > 1) & ~w.isin(*SEARCH_STOPWORDS), lexeme(w))
    )


def _indexed(words: pa.Array) -> pa.Array:
    """The same for an Arrow array of lower-cased words: lexemes, or null."""
    ends = pc.ends_with(words, "s")
    plurals = words.filter(ends)
    rules = pa.StructArray.from_arrays(
        [pc.match_substring_regex(plurals, p) for p in ("[^ea]ies$", "[^aeo]es$", "[^us]s$")], names=["y", "es", "s"]
    )
    cut = pc.utf8_slice_codeunits(plurals, 0, -1)
    cut = pc.case_when(rules, pc.replace_substring_regex(plurals, "ies$", "y"), cut, cut, plurals)
    left_out = pc.or_(pc.less(pc.utf8_length(words), 2), pc.is_in(words, value_set=pa.array(SEARCH_STOPWORDS)))
    return pc.if_else(left_out, pa.scalar(None, pa.string()), pc.replace_with_mask(words, ends, cut))


def postings(articles: DataFrame, *carried: str) -> DataFrame:
    """Inverted index: lex, article_id, title_tf, body_tf, sorted positions, carried columns.

    Positions count every word of title then body.  The words of an article are
    sorted and cut into runs where its row is read, so nothing is shuffled.  An article
    with a null title or content has no postings.
    """
    kinds = {name: articles.schema[name].dataType for name in ("id", *carried)}
    schema = T.StructType(
        [
            T.StructField("lex", T.StringType()),
            T.StructField("article_id", kinds["id"]),
            T.StructField("title_tf", T.IntegerType()),
            T.StructField("body_tf", T.IntegerType()),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
            *(T.StructField(name, kinds[name]) for name in carried),
        ]
    )
    texts = articles.select(
        "id", *carried, _spaced(F.col("title")).alias("_title"), _spaced(F.col("content")).alias("_body")
    )
    return texts.filter("_title is not null and _body is not null").mapInArrow(_postings, schema)


def _spaced(text: Column) -> Column:
    """The words of a lower-cased text, each two with one space between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = sum(pc.binary_length(batch.column(c)).to_numpy() for c in ("_title", "_body"))
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(ends):
            held = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, held + SLICE_BYTES, side="right")))
            yield _runs(batch.slice(start, end - start))
            start = end


def _runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row per article and lexeme."""
    title, body = (pc.split_pattern(batch.column(c), " ") for c in ("_title", "_body"))
    words, article, body_word = [], [], []
    for k, lists in enumerate((title, body)):
        flat = lists.flatten()
        full = pc.binary_length(flat).to_numpy() > 0
        words.append(flat.filter(pa.array(full)))
        article.append(pc.list_parent_indices(lists).to_numpy()[full])
        body_word.append(np.full(len(article[-1]), k))
    article, body_word = np.concatenate(article), np.concatenate(body_word)
    # Articles in order, of each the title first; places count all words of an article.
    order = np.argsort(2 * article + body_word, kind="stable")
    article, body_word = article[order], body_word[order]
    place = np.arange(len(article)) - np.searchsorted(article, article)

    # Words are looked at once each, and numbered by their lexemes.
    coded = pa.concat_arrays(words).dictionary_encode()
    known = _indexed(coded.dictionary).dictionary_encode()
    lex = known.indices.fill_null(-1).to_numpy().astype(np.int64)[coded.indices.to_numpy()[order]]
    known = known.dictionary

    kept = np.flatnonzero(lex >= 0)
    key = article[kept] * max(len(known), 1) + lex[kept]
    # Places stay in order within a run.
    by_key = np.argsort(key, kind="stable")
    kept, key = kept[by_key], key[by_key]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    bounds = np.append(first, len(key))
    in_body = np.add.reduceat(body_word[kept], first) if len(first) else first
    own = pa.array(article[kept[first]])
    columns = {
        "lex": known.take(pa.array(lex[kept[first]])),
        "article_id": batch.column("id").take(own),
        "title_tf": pa.array((np.diff(bounds) - in_body).astype(np.int32)),
        "body_tf": pa.array(in_body.astype(np.int32)),
        "positions": pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)), pa.array(place[kept].astype(np.int32))
        ),
    }
    for name in batch.schema.names[1:-2]:
        columns[name] = batch.column(name).take(own)
    return pa.RecordBatch.from_pydict(columns)


def labelled_postings(index: DataFrame) -> DataFrame:
    """The index by label: A for the title, B for the body."""
    labels = F.array(
        F.struct(F.lit("A").alias("label"), F.col("title_tf").alias("tf")),
        F.struct(F.lit("B").alias("label"), F.col("body_tf").alias("tf")),
    )
    return index.select("lex", "article_id", F.inline(labels)).filter("tf > 0")


# --- queries ------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """Lexemes with their offsets from the first word; several form a phrase."""

    negated: bool
    lexemes: tuple[tuple[int, str], ...]


_UNIT = r'-?"[^"]*"?|[^\s"]+'


def query_units(query: Column) -> Column:
    """Split queries into (conj, clause, negated, lexemes) structs, in the JVM.

    Words and quoted phrases of a ``conj`` all have to match; ``or`` starts the
    next one.  Units without an indexed word disappear.
    """
    pieces = F.regexp_extract_all(query, F.lit(_UNIT), 0)

    def unit(piece: Column, place: Column) -> Column:
        earlier = F.slice(pieces, 1, place)
        return F.struct(
            F.size(F.filter(earlier, lambda e: F.lower(e) == "or")).alias("conj"),
            place.alias("clause"),
            piece.startswith("-").alias("negated"),
            F.filter(
                F.transform(
                    lexemes(piece), lambda w, i: F.struct(i.alias("off"), w.alias("lex"))
                ),
                lambda x: x["lex"].isNotNull(),
            ).alias("lexemes"),
            (F.lower(piece) == "or").alias("is_or"),
        )

    return F.filter(
        F.transform(pieces, unit), lambda u: ~u["is_or"] & (F.size(u["lexemes"]) > 0)
    )


def parse_query(spark, query: str) -> list[list[Clause]]:
    """One search string as alternatives of clauses (a few values, on the driver)."""
    text = query.strip()[:500]
    row = spark.range(1).select(query_units(F.lit(text)).alias("units")).first()
    conjs: dict[int, list[Clause]] = {}
    for unit in row.units:
        start = unit.lexemes[0].off
        words = tuple((w.off - start, w.lex) for w in unit.lexemes)
        conjs.setdefault(unit.conj, []).append(Clause(unit.negated, words))
    return list(conjs.values())


# --- search -------------------------------------------------------------------


def matches(index: DataFrame | StoredIndex, articles: DataFrame, query: str) -> DataFrame:
    """(article_id, rank) of all articles that match.

    Of a stored index only the parts and row groups with the query's own lexemes
    are read.  One aggregation per article evaluates the whole condition and the rank.
    """
    return _matches(index, articles, parse_query(index.sparkSession, query))


def _postings_of(index: DataFrame | StoredIndex, words: set[str]) -> DataFrame:
    if isinstance(index, StoredIndex):
        return index.postings(words)
    return index.filter(F.col("lex").isin(*words))


def _matches(index: DataFrame | StoredIndex, articles: DataFrame, alternatives: list[list[Clause]]) -> DataFrame:
    everything = {w for conj in alternatives for c in conj for _, w in c.lexemes}
    ranked = {w for conj in alternatives for c in conj if not c.negated for _, w in c.lexemes}
    needs_all = any(all(c.negated for c in conj) for conj in alternatives)
    if not alternatives:
        return articles.limit(0).select(F.col("id").alias("article_id"), F.lit(0.0).alias("rank"))

    names = {word: f"w{i}" for i, word in enumerate(sorted(everything))}
    phrases = {w for conj in alternatives for c in conj if len(c.lexemes) > 1 for _, w in c.lexemes}
    scored = F.when(F.col("lex").isin(*ranked), _posting_rank()) if ranked else F.lit(0.0)
    # Rounded, so that equal ranks are equal whatever the order of summation.
    columns = [F.round(F.sum(scored), 6).alias("rank")]
    for word, name in names.items():
        here = F.col("lex") == word
        columns.append(F.count_if(here).alias(name))
        if word in phrases:
            columns.append(F.first(F.when(here, F.col("positions")), ignorenulls=True).alias(f"{name}p"))
    found = _postings_of(index, everything).groupBy("article_id").agg(*columns)
    if needs_all:
        # Articles without any of the words may match a pure negation.
        found = articles.select(F.col("id").alias("article_id")).join(found, "article_id", "left")

    def clause_hit(clause: Clause) -> Column:
        present = [F.coalesce(F.col(names[w]), F.lit(0)) > 0 for _, w in clause.lexemes]
        hit = reduce(Column.__and__, present)
        if len(clause.lexemes) > 1:
            (_, first), *rest = clause.lexemes
            adjacent = F.exists(
                F.col(f"{names[first]}p"),
                lambda p: reduce(
                    Column.__and__,
                    [F.array_contains(F.col(f"{names[w]}p"), p + off) for off, w in rest],
                ),
            )
            hit = hit & F.coalesce(adjacent, F.lit(False))
        return ~hit if clause.negated else hit

    condition = reduce(
        Column.__or__,
        [reduce(Column.__and__, [clause_hit(c) for c in conj]) for conj in alternatives],
    )
    return found.filter(condition).select("article_id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def _posting_rank() -> Column:
    def part(tf: str, weight: float) -> Column:
        return F.when(F.col(tf) > 0, weight * (1 + F.ln(F.col(tf)))).otherwise(0.0)

    return part("title_tf", TITLE_WEIGHT) + part("body_tf", BODY_WEIGHT)


def search(
    index: DataFrame | StoredIndex,
    articles: DataFrame,
    sources: DataFrame,
    query: str,
    limit: int = 25,
    offset: int = 0,
) -> DataFrame:
    """One page of hits, best first, then newest: article, source, rank, headline.

    The ranking works on the index and on the times of the articles and runs at
    once; bodies are read for its page only.
    """
    alternatives = parse_query(index.sparkSession, query)
    times = articles.select("id", "fetched_at", effective_time().alias("at"))
    order = [F.col("rank").desc(), F.col("at").desc(), F.col("id")]
    page = (
        _matches(index, articles, alternatives)
        .withColumnRenamed("article_id", "id")
        .join(times, "id")
        .orderBy(*order)
        .offset(offset)
        .limit(limit)
    )
    words = sorted({w for conj in alternatives for c in conj if not c.negated for _, w in c.lexemes})
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "site_url")
    return (
        page_rows(articles, page)
        .join(named, "source_id")
        .withColumn("headline", headline(F.col("content"), words))
        .orderBy(*order)
    )


def total_matches(index: DataFrame | StoredIndex, articles: DataFrame, query: str) -> DataFrame:
    return matches(index, articles, query).agg(F.count("*").alias("total"))


def headline(
    text: Column, words: list[str], fragments: int = 2, max_words: int = 30, min_words: int = 10
) -> Column:
    """Up to two fragments around hits, hits in ``<mark>`` tags.

    A fragment starts a few words before a hit and spans ``max_words``.  The
    fragment with most hits is taken first, then the best one that does not
    overlap it; they are shown in text order.  Without a hit the beginning of
    the text is shown.  ``words`` are lexemes.
    """
    wanted = F.array(*map(F.lit, words)).cast("array<string>")

    def is_hit(piece: Column) -> Column:
        return F.exists(
            lexemes(piece), lambda w: F.coalesce(F.array_contains(wanted, w), F.lit(False))
        )

    def render(pieces: Column) -> Column:
        hits = F.filter(
            F.transform(pieces, lambda p, i: F.when(is_hit(p), i)), lambda i: i.isNotNull()
        )
        return let(hits, lambda h: _fragments(pieces, h, fragments, max_words, min_words))

    return let(F.split(F.trim(text), r"\s+", -1), render)


def _fragments(
    pieces: Column, hits: Column, fragments: int, max_words: int, min_words: int
) -> Column:
    lead = min_words // 2

    def window(start: Column, place: Column) -> Column:
        begin = F.greatest(F.least(start - lead, F.size(pieces) - max_words), F.lit(0))
        # Hits are different places in order, so those of a window lie within that many
        # entries of this one: the work is linear in the hits.
        around = F.slice(hits, F.greatest(place + 1 - max_words, F.lit(1)), F.lit(2 * max_words))
        count = F.size(F.filter(around, lambda h: (h >= begin) & (h < begin + max_words)))
        return F.struct((-count).alias("order"), begin.alias("begin"))

    ranked = F.array_sort(F.transform(hits, window))
    chosen = F.aggregate(
        ranked,
        F.array().cast("array<int>"),
        lambda done, w: F.when(
            (F.size(done) < fragments)
            & F.forall(done, lambda d: F.abs(d - w["begin"]) >= max_words),
            F.concat(done, F.array(w["begin"])),
        ).otherwise(done),
    )

    def marked(begin: Column, length: int) -> Column:
        return F.array_join(
            F.transform(
                F.slice(pieces, begin + 1, length),
                lambda p, i: F.when(
                    F.array_contains(hits, begin + i), F.concat(F.lit("<mark>"), p, F.lit("</mark>"))
                ).otherwise(p),
            ),
            " ",
        )

    shown = F.array_join(
        F.transform(F.array_sort(chosen), lambda begin: marked(begin, max_words)), " ... "
    )
    return F.when(F.size(hits) == 0, F.array_join(F.slice(pieces, 1, min_words), " ")).otherwise(shown)
