"""Search and alerts against a plain evaluation per article."""

import random
import re
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyloom.operators import alerts as al
from storyloom.operators import search as se
from storyloom.operators import stored_index
from storyloom.operators.stored_index import store_index

TEXTS = {
    1: ("Interest rates rise", "The bank raised interest rates. Rates of interest matter."),
    2: ("Inflation", "Inflation slows while rates hold."),
    3: ("Cats and dogs", "Stories about cities, buses and glass."),
    4: ("A story of the bus", "One city. Interest"),
    5: ("", "rates"),
    6: ("Bank of England", "of the and"),
}
QUERIES = [
    "interest rates",
    '"interest rates"',
    '"rates of interest"',
    '"bus one city"',  # runs over the border of title and body
    "inflation OR cats",
    "rates -interest",
    "-rates -cat",
    "inflation or -rates",
    '-"interest rates" bank',
    "story",
    "the",
    "",
    "bank-raised",
    '"unclosed rates',
    "city -",
    "OR rates",
]


def stem(w):
    if re.search("[^ea]ies$", w):
        return w[:-3] + "y"
    if re.search("[^aeo]es$", w) or re.search("[^us]s$", w):
        return w[:-1]
    return w


def words(text):
    out = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    return [stem(w) if len(w) > 1 and w not in se.SEARCH_STOPWORDS else None for w in out]


def plain_match(text, query):
    document, conjs = words(text[0]) + words(text[1]), [[]]
    for piece in re.findall(r'-?"[^"]*"?|[^\s"]+', query):
        if piece.lower() == "or":
            conjs.append([])
            continue
        wanted = [(i, w) for i, w in enumerate(words(piece)) if w]
        if wanted:
            hit = any(
                all(0 <= s + i < len(document) and document[s + i] == w for i, w in wanted)
                for s in range(-10, len(document))
            )
            conjs[-1].append(hit != piece.startswith("-"))
    return any(c and all(c) for c in conjs)


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(i, i % 2, t, c) for i, (t, c) in TEXTS.items()]
    df = spark.createDataFrame(rows, "id long, source_id long, title string, content string")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))
    return df.withColumns({"published_at": F.lit(None).cast("timestamp_ntz"), "fetched_at": at}).cache()


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(0, "even", "e"), (1, "odd", "o")], "id long, name string, site_url string")


def expected(query):
    return {i for i, text in TEXTS.items() if plain_match(text, query)}


def test_matches(articles):
    index = se.postings(articles).cache()
    for query in QUERIES:
        got = {r.article_id for r in se.matches(index, articles, query).collect()}
        assert got == expected(query), query
    assert se.total_matches(index, articles, "rates").first().total == len(expected("rates"))


def test_alerts_equal_single_searches(spark, articles):
    alerts = spark.createDataFrame(
        [(i, q, True) for i, q in enumerate(QUERIES)] + [(99, "rates", False)], "id long, query string, active boolean"
    )
    none = spark.createDataFrame([], "alert_id long, article_id long, matched_at timestamp_ntz, notified boolean")
    found = al.run_alerts(alerts, articles, none, "2024-01-01 06:30:00", hours=24)
    got = {(r.alert_id, r.article_id) for r in found.collect()}
    assert got == {(i, a) for i, q in enumerate(QUERIES) for a in expected(q)}
    # A second run adds nothing; a narrow window sees late articles only.
    assert al.run_alerts(alerts, articles, found, "2024-01-01 06:30:00", hours=24).isEmpty()
    late = al.run_alerts(alerts, articles, none, "2024-01-01 06:30:00", hours=2)
    assert {(r.alert_id, r.article_id) for r in late.collect()} == {p for p in got if p[1] >= 5}


def test_no_product_of_articles_and_alerts(spark, articles):
    alerts = spark.createDataFrame([(1, "-rates", True), (2, "-cat -dog", True), (3, "rates", True)], "id long, query string, active boolean")
    plan = al.alert_hits(se.postings(articles), articles, alerts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Articles meet the hits of negations once, over their ids.
    assert plan.count("array_except") >= 1


def test_pages(articles, sources):
    index = se.postings(articles)
    every = [r.id for r in se.search(index, articles, sources, "rates OR city OR bank", limit=10).collect()]
    assert set(every) == expected("rates OR city OR bank")
    assert every[0] == 1
    page = se.search(index, articles, sources, "rates OR city OR bank", limit=2, offset=2)
    assert [r.id for r in page.collect()] == every[2:4]
    assert se.search(index, articles, sources, "   ").isEmpty()
    past = se.search(index, articles, sources, "rates", offset=50)
    assert past.isEmpty()


def test_headline(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    text = f"{filler} rates {filler} rates, Rate {filler} rates {filler}"
    rows = spark.createDataFrame([(text,), ("nothing here at all",)], "t string")
    hit, miss = [r.h for r in rows.select(se.headline(F.col("t"), ["rate"]).alias("h")).collect()]
    assert miss == "nothing here at all"
    parts = hit.split(" ... ")
    assert len(parts) == 2 and all(10 <= len(p.split()) <= 30 for p in parts)
    assert sum(p.count("<mark>") for p in parts) == 3
    assert "<mark>rates,</mark> <mark>Rate</mark>" in hit


def scanned(df):
    """Files and rows that the scan of an executed plan without shuffles has read."""
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    # A scan of no partition at all is planned as an empty table.
    return tuple(metrics.apply(n).value() if metrics.contains(n) else 0 for n in ("numFiles", "numOutputRows"))


def test_searches_of_a_stored_index(articles, sources, tmp_path):
    stored = store_index(se.postings(articles), str(tmp_path / "index"), rows_per_part=6)
    for query in QUERIES:
        got = {r.article_id for r in se.matches(stored, articles, query).collect()}
        assert got == expected(query), query
    plain = se.postings(articles)
    for query in ("rates OR city OR bank", '"interest rates"'):
        wanted = se.search(plain, articles, sources, query).drop("fetched_at").collect()
        assert se.search(stored, articles, sources, query).drop("fetched_at").collect() == wanted


def test_parts_follow_each_other(spark, tmp_path):
    """A lexeme of a third of all postings is cut like any other."""
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "common").otherwise(F.concat(F.lit("w"), F.lpad((F.col("id") % 500).cast("string"), 4, "0"))).alias("lex"),
        F.col("id").alias("article_id"), F.lit(0).alias("title_tf"), F.lit(1).alias("body_tf"), F.array(F.lit(1)).alias("positions"),
    )
    stored = store_index(rows, str(tmp_path / "index"), rows_per_part=300)
    parts = stored.parts().orderBy("first", "last").collect()
    assert 8 <= len(parts) <= 10 and sum(r.rows for r in parts) == 3_000
    assert all(a.last <= b.first for a, b in zip(parts, parts[1:]))
    assert max(r.rows for r in parts) < 700
    assert sum(r.first == r.last == "common" for r in parts) >= 2
    for name in tmp_path.glob("index/postings/part=*/*.parquet"):
        read = pq.read_table(name)
        keys = list(zip(read["lex"].to_pylist(), read["article_id"].to_pylist()))
        assert keys == sorted(keys)
    found = stored.postings(["w0007"])
    files, read = scanned(found)
    assert files <= 2 and read < 700
    assert sorted(r.article_id for r in found.collect()) == [n for n in range(3_000) if n % 500 == 7 and n % 3]
    assert stored.postings(["common"]).count() == 1_000
    # Beyond both ends, between two lexemes and without any.
    for words in (["a"], ["zz"], ["w0007x"], []):
        assert stored.postings(words).count() == 0
    assert scanned(stored.postings(["zz"]))[0] == 0


def test_row_groups_are_skipped(spark, tmp_path, monkeypatch):
    """Of one file of many row groups, those of other lexemes are not read."""
    monkeypatch.setattr(stored_index, "ROW_GROUP_BYTES", 64 << 10)
    rows = spark.range(200_000).select(
        F.concat(F.lit("w"), F.lpad((F.col("id") % 1_000).cast("string"), 4, "0")).alias("lex"),
        F.col("id").alias("article_id"), F.xxhash64("id").alias("noise"),
    )
    stored = store_index(rows, str(tmp_path / "index"))
    (name,) = tmp_path.glob("index/postings/part=*/*.parquet")
    groups = pq.ParquetFile(name).metadata
    holding = 0
    for n in range(groups.num_row_groups):
        facts = groups.row_group(n).column(0).statistics
        holding += facts.min <= "w0500" <= facts.max
    assert groups.num_row_groups > 10 and holding <= 2
    files, read = scanned(stored.postings(["w0500"]))
    assert files == 1 and 200 <= read < 200_000 * 3 / groups.num_row_groups


def test_empty_index(spark, articles, tmp_path):
    stored = store_index(se.postings(articles.limit(0)), str(tmp_path / "index"))
    assert stored.postings(["rate"]).count() == 0
    assert se.matches(stored, articles.limit(0), "rates").count() == 0


def test_postings_are_those_of_the_lexemes(spark, monkeypatch):
    """The index made of Arrow batches holds what the column expression gives, whatever the slices."""
    odd = ["", "  ", "ies ties series skies", "es is us bus class Class's glasses goes shoes trees", "s ss as x yes",
           "It is a THE\u0130\u0131 \u00c9t\u00e9s na\u00efve-words e\u0301s \U00010400s \u0663\u0664 a1s", "rates rate Rates RATE"]
    rows = [(i, t, b) for i, (t, b) in enumerate((t, b) for t in [*odd, None] for b in [*odd, None])]
    articles = spark.createDataFrame(rows, "id bigint, title string, content string").withColumn("more", F.array("id"))
    wanted = {}
    words = articles.select("id", F.size(se.lexemes(F.col("title"))).alias("n"), F.concat(se.lexemes(F.col("title")), se.lexemes(F.col("content"))).alias("w"))
    for row in words.collect():
        for place, lex in enumerate(row.w or []):
            if lex is not None:
                entry = wanted.setdefault((lex, row.id), [0, 0, []])
                entry[place >= row.n] += 1
                entry[2].append(place)
    got = se.postings(articles, "more").collect()
    assert {(r.lex, r.article_id): [r.title_tf, r.body_tf, r.positions] for r in got} == wanted
    assert len(got) == len(wanted) and all(r.more == [r.article_id] for r in got)

    texts = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "_title": ["a rate", "", " city"], "_body": ["rates of", " ", "bank rate "]})
    whole = pa.Table.from_batches(se._postings([texts])).to_pylist()
    monkeypatch.setattr(se, "SLICE_BYTES", 1)
    parts = list(se._postings([texts]))
    assert len(parts) == 3
    key = lambda r: (r["lex"], r["article_id"])
    assert sorted(pa.Table.from_batches(parts).to_pylist(), key=key) == sorted(whole, key=key)


def plain_headline(text, wanted, fragments=2, max_words=30, min_words=10):
    pieces = re.split(r"\s+", text.strip(" "))
    hits = [i for i, p in enumerate(pieces) if set(words(p)) & wanted]
    if not hits:
        return " ".join(pieces[:min_words])
    begins = sorted({max(0, min(h - min_words // 2, len(pieces) - max_words)) for h in hits})
    ranked = sorted((-sum(b <= h < b + max_words for h in hits), b) for b in begins)
    chosen = []
    for _, b in ranked:
        if len(chosen) < fragments and all(abs(b - c) >= max_words for c in chosen):
            chosen.append(b)
    marked = [f"<mark>{p}</mark>" if i in set(hits) else p for i, p in enumerate(pieces)]
    return " ... ".join(" ".join(marked[b : b + max_words]) for b in sorted(chosen))


def test_headlines_equal_all_windows(spark):
    draw = random.Random(4)
    texts = [
        " ".join(draw.choice(["rate", "Rates,", "x", "y", "bank-rates", "é"] + ["w"] * spread) for _ in range(size))
        for spread in (0, 10, 60) for size in (0, 1, 9, 31, 62, 300)
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = dict(rows.select("id", se.headline(F.col("t"), ["rate"])).collect())
    assert got == {i: plain_headline(t, {"rate"}) for i, t in enumerate(texts)}


def test_headline_of_many_hits_is_linear(spark):
    def seconds(size):
        rows = spark.createDataFrame([(" ".join(["rate"] * size),)], "t string")
        started = time.time()
        (h,) = rows.select(se.headline(F.col("t"), ["rate"])).first()
        assert h.count("<mark>") == 60
        return time.time() - started

    seconds(100)
    # All pairs of hits would be 2.5 x 10^9 comparisons.
    assert seconds(50_000) < 20
