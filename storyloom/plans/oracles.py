"""The same results in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

from storyloom.functions.text import EMBEDDING_STOPWORDS
from storyloom.functions.urls import TRACKING_PARAMS
from storyloom.operators.search import SEARCH_STOPWORDS

_SPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", "<[^>]+>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return entities(x)


def entities(x: str) -> str:
    for pattern, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;|&apos;", "''"),
    ):
        x = f"regexp_replace({x}, '(?i){pattern}', '{char}', 'g')"
    return x


def tokens(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: length(t) > 1)"
    )


def content_tokens(x: str) -> str:
    return (
        f"list_filter({tokens(x)}, lambda t: length(t) >= 3 "
        f"AND NOT list_contains([{_words(EMBEDDING_STOPWORDS)}], t))"
    )


def excerpt(x: str, n: int = 280) -> str:
    clean = norm(strip(x))
    return (
        f"CASE WHEN length({clean}) <= {n} THEN {clean} "
        f"ELSE regexp_replace(left({clean}, {n - 1}), ' [^ ]*$', '') || '…' END"
    )


def after(minutes: str) -> str:
    return f"(TIMESTAMP '2024-01-01' + to_minutes(CAST({minutes} AS INT)))"


def fnv(word: str) -> str:
    units = f"list_transform(string_split({word}, ''), lambda c: CAST(unicode(c) AS HUGEINT))"
    return (
        f"list_reduce({units}, lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616, "
        "CAST(14695981039346656037 AS HUGEINT))"
    )


def signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x} - 18446744073709551616 ELSE {x} END AS BIGINT)"


def simhashes(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name(key, simhash)`` over all rows of ``source``."""
    sums = ", ".join(
        f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN n ELSE -n END) > 0 AS b{b}" for b in range(64)
    )
    total = " + ".join(f"(CASE WHEN b{b} THEN CAST({1 << b} AS HUGEINT) ELSE 0 END)" for b in range(64))
    return f"""
    {name}_tok AS (SELECT {key} AS k, {tokens(text)} AS t FROM {source}),
    {name}_feat AS (
        SELECT k, f, count(*) AS n FROM (
            SELECT k, unnest(t) AS f FROM {name}_tok
            UNION ALL
            SELECT k, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))
            FROM {name}_tok)
        GROUP BY k, f),
    {name}_vocab AS MATERIALIZED (
        SELECT f, CAST({fnv('f')} AS UBIGINT) AS h FROM (SELECT DISTINCT f FROM {name}_feat)),
    {name}_bits AS (
        SELECT k, {sums} FROM {name}_feat JOIN {name}_vocab USING (f) GROUP BY k),
    {name}_sum AS (SELECT k, {total} AS u FROM {name}_bits),
    {name} AS MATERIALIZED (
        SELECT t.k AS {key}, coalesce({signed('u')}, 0) AS simhash
        FROM {name}_tok t LEFT JOIN {name}_sum s ON s.k = t.k)"""


ITEMS = f"""items AS (
    SELECT page_id AS ord, CAST(page_id % 20 AS INT) AS source_id,
        CASE WHEN page_id % 5 <> 0 THEN 'g' || (page_id % 200) END AS guid, url,
        regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, html AS content,
        CASE WHEN page_id % 10 <> 0 THEN {after('page_id * 10')} END AS published_at
    FROM pages)"""

ARTICLES = f"""articles AS (
    SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS source_id,
        CASE WHEN doc_id % 3 <> 0 THEN 'g' || (doc_id % 400) END AS guid,
        'https://' || source || '.example.com/a/' || doc_id AS canonical_url,
        left(split_part(text, chr(10), 1), 80) AS title, text AS content,
        CASE WHEN doc_id % 7 <> 0
            THEN {after('doc_id * 5')} - to_hours(CAST(doc_id % 5 AS INT)) END AS published_at,
        {after('doc_id * 5')} AS fetched_at,
        sha256(lower({norm('text')})) AS content_hash,
        CASE WHEN doc_id % 11 <> 0 THEN doc_id - doc_id % 7 END AS placed_story
    FROM documents),
    present AS (SELECT max(fetched_at) AS now FROM articles)"""

SOURCES = """sources AS (
    SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name,
        'https://' || source || '.example.com/rss' AS feed_url,
        'https://' || source || '.example.com' AS site_url,
        CAST(substr(source, 4) AS BIGINT) % 7 <> 6 AS active,
        CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0
            THEN 'old' || substr(source, 4) END AS etag,
        CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 = 0 THEN 'old error' END AS last_error
    FROM documents)"""

FETCHES = """fetches AS (
    SELECT CAST(page_id % 20 AS BIGINT) AS source_id, page_id AS seq,
        CASE page_id % 10 WHEN 3 THEN 304 WHEN 7 THEN 404 WHEN 9 THEN 500 ELSE 200 END AS status,
        CASE WHEN page_id % 4 <> 1 THEN 'e' || page_id END AS etag,
        CASE WHEN page_id % 3 = 0 THEN 'm' || page_id END AS last_modified
    FROM pages),
    outcomes AS (
        SELECT *, CASE WHEN status = 304 THEN 'not_modified' WHEN status >= 400 OR seq % 20 IN (1, 2)
                THEN 'error' ELSE 'fetched' END AS outcome,
            CASE WHEN status >= 400 THEN 'HTTP ' || status || ' fetching https://src' || source_id
                || '.example.com/rss' WHEN status = 200 AND seq % 20 IN (1, 2) THEN 'not a feed' END AS error
        FROM fetches)"""

STORIES = """stories AS (
    SELECT a.id, CASE WHEN a.id % 2 = 0 THEN a.title END AS title,
        CAST(CASE WHEN a.id % 21 = 0 THEN 0 ELSE n END AS INT) AS article_count,
        a.fetched_at AS first_seen_at
    FROM articles a JOIN (
        SELECT placed_story, count(*) AS n FROM articles WHERE placed_story IS NOT NULL GROUP BY 1
    ) s ON s.placed_story = a.id)"""

EARLIER_MATCHES = f"""matches AS (
    SELECT CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 17 END AS BIGINT) AS alert_id,
        doc_id AS article_id, {after('doc_id % 50')} AS matched_at
    FROM documents)"""

ALERTS = f"""alert_words AS (
    SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS w,
        regexp_split_to_array(text, '\\s+')[3:5] AS raw FROM benchmark),
    alerts AS (
    SELECT item_id AS id, item_id % 5 <> 4 AS active, {after('item_id')} AS created_at,
        CASE
            WHEN item_id % 12 = 0 THEN repeat('qqzzxx OR ', 80) || coalesce(w[1], 'none')
            WHEN item_id % 12 = 6 THEN repeat(coalesce(w[1], 'none') || ' ', 130) || '-' || coalesce(w[2], 'none')
            WHEN item_id % 12 = 7 THEN repeat('qqzzxx OR ', 80) || '"' || array_to_string(raw, ' ') || '"'
            ELSE CASE item_id % 6
            WHEN 0 THEN coalesce(w[1], 'none') || ' ' || coalesce(w[2], 'none')
            WHEN 1 THEN '"' || array_to_string(raw, ' ') || '"'
            WHEN 2 THEN coalesce(w[1], 'none') || ' OR ' || coalesce(w[2], 'none') || ' ' || coalesce(w[3], 'none')
            WHEN 3 THEN coalesce(w[1], 'none') || ' -' || coalesce(w[2], 'none')
            WHEN 4 THEN '-' || coalesce(w[1], 'none') || ' -' || coalesce(w[2], 'none')
            ELSE '  the and  ' END END AS query
    FROM alert_words)"""


def canonical(u: str) -> str:
    host = f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '')"
    path = f"rtrim(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')"
    pairs = (
        f"list_sort(list_transform(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), "
        "lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT starts_with(lower(p), 'mc_') "
        f"AND NOT list_contains([{_words(TRACKING_PARAMS)}], lower(split_part(p, '=', 1)))), "
        "lambda p: {'k': split_part(p, '=', 1), 'v': split_part(p, '=', 2)}))"
    )
    query = f"array_to_string(list_transform({pairs}, lambda s: s.k || '=' || s.v), '&')"
    return (
        f"lower(regexp_extract({u}, '^([A-Za-z]+):', 1)) || '://' || {host} || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"
    )


# --- order-dependent acceptance: one recursion step per item ----------------------


def accepted(rows: str, near: str = "TRUE") -> str:
    """CTEs ending in ``taken(acc)``: the accepted ords of ``rows`` taken one by one.

    ``near`` limits which earlier items i a near item j is held against.
    """
    return f"""
    numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM {rows}),
    earlier AS MATERIALIZED (
        SELECT j.n, list(i.n) FILTER (i.n IS NOT NULL) AS before, any_value(j.ord) AS ord
        FROM numbered j LEFT JOIN numbered i ON i.n < j.n AND (
            i.content_hash = j.content_hash OR i.canonical_url = j.canonical_url
            OR (i.source_id = j.source_id AND i.guid = j.guid)
            OR (bit_count(xor(i.simhash, j.simhash)) <= 3 AND {near}))
        GROUP BY j.n),
    steps AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS acc
        UNION ALL
        SELECT e.n, CASE WHEN list_has_any(s.acc, coalesce(e.before, [])) THEN s.acc
            ELSE list_append(s.acc, e.n) END
        FROM steps s JOIN earlier e ON e.n = s.n + 1),
    taken AS (SELECT arg_max(acc, n) AS acc FROM steps)"""


# --- vectors ----------------------------------------------------------------------

EMBEDDED = f"""
    etok AS (SELECT id, unnest({content_tokens("title || chr(10) || content")}) AS tok FROM articles),
    evocab AS MATERIALIZED (
        SELECT tok, ('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2])::BIGINT % 384 AS idx,
            CASE WHEN ('0x' || m[9:10])::INT % 2 = 0 THEN 1 ELSE -1 END AS sign
        FROM (SELECT tok, md5(tok) AS m FROM (SELECT DISTINCT tok FROM etok))),
    esum AS MATERIALIZED (
        SELECT id, idx, sum(sign) AS s FROM etok JOIN evocab USING (tok) GROUP BY id, idx HAVING s <> 0),
    enorm AS (SELECT id, sqrt(sum(s * s)) AS n FROM esum GROUP BY id),
    sparse AS MATERIALIZED (
        SELECT id, idx, CAST(s / n AS FLOAT) AS w FROM esum JOIN enorm USING (id)),
    dense AS MATERIALIZED (
        SELECT a.id, list(CAST(coalesce(w, 0) AS FLOAT) ORDER BY r.range) AS embedding
        FROM articles a CROSS JOIN range(384) r LEFT JOIN sparse s ON s.id = a.id AND s.idx = r.range
        GROUP BY a.id)"""


def forest(where: str, threshold: float = 0.62) -> str:
    """CTEs from ``vecs(id, story_id, at, fetched_at, embedding)`` to ``best``.

    ``where`` limits candidates c of a row a.
    """
    return f"""
    unit AS MATERIALIZED (
        SELECT id, story_id, "at", fetched_at, CAST(embedding AS DOUBLE[]) AS v,
            sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len
        FROM vecs),
    pairs AS (
        SELECT a.id, c.id AS parent_id, c.story_id AS parent_story, c."at",
            round(list_dot_product(a.v, c.v) / (a.len * c.len), 9) AS sim
        FROM unit a JOIN unit c ON a.id <> c.id AND {where}
        WHERE a.story_id IS NULL AND a.len > 0 AND c.len > 0),
    best AS MATERIALIZED (
        SELECT id, parent_id, parent_story, sim FROM (
            SELECT *, row_number() OVER (
                PARTITION BY id ORDER BY sim DESC, parent_story IS NULL, "at", parent_id) AS rn
            FROM pairs)
        WHERE rn = 1 AND sim >= {threshold})"""


STORY_WALK = """
    walk AS (
        SELECT u.id, u.id AS at_id, CAST(NULL AS BIGINT) AS story FROM unit u WHERE u.story_id IS NULL
        UNION ALL
        SELECT w.id, coalesce(b.parent_id, w.at_id),
            CASE WHEN b.id IS NULL THEN w.at_id ELSE b.parent_story END
        FROM walk w LEFT JOIN best b ON b.id = w.at_id WHERE w.story IS NULL),
    assigned AS MATERIALIZED (
        SELECT w.id, w.story AS story_id, b.id IS NULL AS seeded
        FROM walk w LEFT JOIN best b ON b.id = w.id WHERE w.story IS NOT NULL)"""

C2_WHERE = """(c."at" < a."at" OR (c."at" = a."at" AND c.id < a.id))
    AND c.fetched_at > (SELECT max(fetched_at) FROM vecs) - INTERVAL 72 HOUR"""

TEXT_VECS = """vecs AS MATERIALIZED (
    SELECT a.id, CAST(NULL AS BIGINT) AS story_id, coalesce(published_at, fetched_at) AS "at",
        fetched_at, embedding, title
    FROM articles a JOIN dense USING (id))"""

GIVEN_VECS = f"""vecs AS MATERIALIZED (
    SELECT vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 40 END AS story_id,
        {after('vec_id * 10')} AS "at", {after('vec_id * 10')} AS fetched_at, embedding
    FROM embeddings)"""

CLUSTERED = f"WITH RECURSIVE {ARTICLES}, {EMBEDDED}, {TEXT_VECS}, {forest(C2_WHERE)}, {STORY_WALK}"
# The given vectors have members of stories already; those may be joined at any time.
JOINABLE = f"(c.story_id IS NOT NULL OR {C2_WHERE.split('AND c.fetched_at')[0]}) AND c.fetched_at {C2_WHERE.split('AND c.fetched_at')[1]}"
CLUSTERED_GIVEN = f"WITH RECURSIVE {GIVEN_VECS}, {forest(JOINABLE, 0.3)}, {STORY_WALK}"

CENTROIDS = """
    means AS (
        SELECT story_id, idx, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS x FROM (
            SELECT story_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS idx FROM members)
        GROUP BY story_id, idx)"""


# --- search -----------------------------------------------------------------------


def _lexeme(t: str) -> str:
    return (
        f"CASE WHEN regexp_matches({t}, '[^ea]ies$') THEN regexp_replace({t}, 'ies$', 'y') "
        f"WHEN regexp_matches({t}, '[^aeo]es$') THEN regexp_replace({t}, 's$', '') "
        f"WHEN regexp_matches({t}, '[^us]s$') THEN regexp_replace({t}, 's$', '') ELSE {t} END"
    )


def words_of(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def lexeme_rows(select: str, source: str) -> str:
    """Rows of (…, pos, lex) for a word list ``ws`` in ``source``."""
    return f"""SELECT {select}, pos, {_lexeme('w')} AS lex FROM (
        SELECT *, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM {source})
        WHERE length(w) > 1 AND NOT list_contains([{_words(SEARCH_STOPWORDS)}], w)"""


INDEX = f"""
    lists AS (SELECT id, {words_of('title')} AS tw, {words_of('content')} AS bw FROM articles),
    joined AS (SELECT id, list_concat(tw, bw) AS ws, len(tw) AS tn FROM lists),
    lexed AS MATERIALIZED ({lexeme_rows('id AS article_id, tn', 'joined')}),
    labelled AS MATERIALIZED (
        SELECT lex, article_id, CASE WHEN pos < tn THEN 'A' ELSE 'B' END AS label, count(*) AS tf
        FROM lexed GROUP BY ALL)"""


def matching(queries: str, universe: str = "articles") -> str:
    """CTEs from ``queries(qid, query)`` to ``hits(qid, article_id)``."""
    return f"""
    pieces AS (
        SELECT qid, unnest(p) AS piece, unnest(range(len(p))) AS clause FROM (
            SELECT qid, regexp_extract_all({norm('query')}, '-?"[^"]*"?|[^\\s"]+') AS p
            FROM {queries})),
    placed AS (
        SELECT *, sum(CASE WHEN lower(piece) = 'or' THEN 1 ELSE 0 END)
            OVER (PARTITION BY qid ORDER BY clause) AS conj FROM pieces),
    piece_words AS (
        SELECT qid, conj, clause, starts_with(piece, '-') AS negated, {words_of('piece')} AS ws
        FROM placed WHERE lower(piece) <> 'or'),
    wanted AS MATERIALIZED ({lexeme_rows('qid, conj, clause, negated', 'piece_words')}),
    clauses AS MATERIALIZED (
        SELECT qid, conj, clause, negated, min(pos) AS start, count(*) AS width
        FROM wanted GROUP BY ALL),
    clause_hits AS (
        SELECT DISTINCT qid, conj, clause, article_id FROM (
            SELECT w.qid, w.conj, w.clause, l.article_id, l.pos - w.pos AS base,
                count(DISTINCT w.pos) AS n
            FROM wanted w JOIN lexed l USING (lex) GROUP BY ALL)
        JOIN clauses USING (qid, conj, clause) WHERE n = width),
    verdicts AS (
        SELECT c.qid, c.conj, u.id AS article_id,
            bool_and(CASE WHEN c.negated THEN h.article_id IS NULL ELSE h.article_id IS NOT NULL END) AS ok
        FROM clauses c CROSS JOIN (SELECT id FROM {universe}) u
        LEFT JOIN clause_hits h ON h.qid = c.qid AND h.conj = c.conj AND h.clause = c.clause
            AND h.article_id = u.id
        GROUP BY ALL),
    hits AS MATERIALIZED (SELECT DISTINCT qid, article_id FROM verdicts WHERE ok)"""


RANKED = """
    positive AS (SELECT DISTINCT qid, lex FROM wanted WHERE NOT negated),
    ranked AS MATERIALIZED (
        SELECT h.qid, h.article_id,
            round(coalesce(sum(CASE WHEN label = 'A' THEN 1.0 WHEN label = 'B' THEN 0.4 END * (1 + ln(tf))), 0), 6) AS rank
        FROM hits h LEFT JOIN (SELECT * FROM positive JOIN labelled USING (lex)) p
            ON p.qid = h.qid AND p.article_id = h.article_id
        GROUP BY ALL)"""


def query_list(queries: dict[str, str]) -> str:
    rows = ", ".join(f"('{name}', '{text}')" for name, text in queries.items())
    return f"queries AS (SELECT * FROM (VALUES {rows}) q(qid, query))"


def present_window(hours: int) -> str:
    return f"recent AS (SELECT * FROM articles WHERE fetched_at > (SELECT now FROM present) - INTERVAL {hours} HOUR)"
