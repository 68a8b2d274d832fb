"""Edge rows of every scalar, and properties over generated input."""

import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.functions import hashing
from storyloom import functions as fn
from storyloom.operators.embed import cosine_similarity, embedder, hash_embedding


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, function, cases, kind="string"):
    assert apply(spark, function, list(cases), kind) == list(cases.values())


def test_strip_html(spark):
    check(
        spark,
        fn.strip_html,
        {
            "a<script>x < y </b></script>b": "a b",
            "a<SCRIPT src='x'>1</script >b</script>c": "a c",
            "a<script>open <b>x": "a open  x",
            "a<scripted>b</script>": "a b ",
            "<style>p{}\n</style>z": " z",
            "<!-- a > b -->": "  b -->",
            "&amp;lt;b&amp;gt;": "<b>",
            None: "",
        },
    )


def test_decode_entities(spark):
    check(
        spark,
        fn.decode_entities,
        {
            "&#38;#60;": "&#60;",
            "&#128512;x": "😀x",
            "&#99999999;": "&#99999999;",
            "&#99999999999999999999;": "&#99999999999999999999;",
            "&#55296;": "&#55296;",
            "&copy; &APOS; &#39; &nbsp;": "&copy; ' '  ",
            "x&#65;&#66;y&#67;": "xAByC",
            "&#x41;": "&#x41;",
            "$1 \\ &quot;": '$1 \\ "',
        },
    )


def test_white_space_and_tokens(spark):
    check(spark, fn.normalize_whitespace, {" a﻿　 b\t\n": "a b", "": "", "​x": "​x"})
    check(
        spark,
        fn.tokenize,
        {
            "a_b Ab-CD x 42 é": ["ab", "cd", "42"],
            "cafés": ["cafe"],
            "\U0001d400 \U0001f600 x": ["\U0001d400"],
            "": [],
        },
    )
    check(
        spark,
        fn.content_tokens,
        {"The said people vote ok in 2024": ["vote", "2024"], "a\U0001d400b": ["a\U0001d400b"], "x\U0001d400": ["x\U0001d400"]},
    )


@pytest.mark.parametrize("size", [279, 280, 281])
def test_excerpt_border(spark, size):
    text = ("word " * 100)[: size - 1] + "x"
    (got,) = apply(spark, fn.excerpt, [text])
    if size <= 280:
        assert got == text
    else:
        assert got == text[:279].rsplit(" ", 1)[0] + "…"


def test_excerpt_oddities(spark):
    check(
        spark,
        lambda c: fn.excerpt(c, 10),
        {"x" * 30: "x" * 9 + "…", "&lt;b&gt;hi&lt;/b&gt; you": "<b>hi</b>…", "<p>short</p>": "short"},
    )
    # Text that decodes to a tag loses it when stripped a second time.
    twice = apply(spark, lambda c: fn.excerpt(fn.strip_html(c), 20), ["&lt;b&gt;hi&lt;/b&gt;"])
    assert twice == ["hi"]


URLS = {
    "HTTP://WWW.Example.com:80/a/?b=2&a=1#x": "http://example.com/a?a=1&b=2",
    "https://example.com:443": "https://example.com/",
    "https://x.com:8080/p//": "https://x.com:8080/p",
    "https://x.com//": "https://x.com/",
    "not a url": "not a url",
    " https://a.b/c?UTM_Source=1&ref=2&mc_x=1&z=%20a+b&a-b=1&a=1&a=0 ": "https://a.b/c?a=0&a=1&a-b=1&z=+a+b",
    "mailto:Me@x.com": "mailto:Me@x.com",
    "https://x.com/a b/é?q=é": "https://x.com/a%20b/%C3%A9?q=%C3%A9",
    "https://user:p@X.com/": "https://user:p@x.com/",
    "https:x.com/y": "https://x.com/y",
    "https://x.com/a/../b/./c/..": "https://x.com/b",
    "http://x.com:99999/": "http://x.com:99999/",
    "http://x.com:443/": "http://x.com:443/",
    "https://x.com/?a": "https://x.com/?a=",
    "https://x.com/?a=%zz&": "https://x.com/?a=%25zz",
    "https://x.com/?a=b=c": "https://x.com/?a=b%3Dc",
    "https://[::1]:443/x/": "https://[::1]/x",
    "https://": "https://",
    "https://m.x.com/x": "https://m.x.com/x",
    "": "",
}


def test_canonical_url(spark):
    check(spark, fn.canonical_url, URLS)


url_text = st.builds(
    "{}://{}{}{}".format,
    st.sampled_from(["http", "HTTPS", "https"]),
    st.sampled_from(["www.a.com", "b.org:443", "C.net:8080"]),
    st.text("/ab.%", max_size=6).map(lambda p: "/" + p),
    st.text("?&=+ab%u_m#", max_size=10),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(url_text, min_size=20, max_size=20))
def test_canonical_url_is_idempotent(spark, urls):
    once = apply(spark, fn.canonical_url, urls)
    assert apply(spark, fn.canonical_url, once) == once


def test_parse_date(spark):
    cases = {
        "Mon, 01 Jan 2024 10:20:30 GMT": datetime(2024, 1, 1, 10, 20, 30),
        "Tue, 2 Jan 2024 10:20:30 +0200": datetime(2024, 1, 2, 8, 20, 30),
        "2024-01-01T10:20:30Z": datetime(2024, 1, 1, 10, 20, 30),
        "2024-01-01T10:20:30.5+02:00": datetime(2024, 1, 1, 8, 20, 30, 500000),
        "1 Feb 2024 10:20 EST": datetime(2024, 2, 1, 15, 20),
        "Wednesday, 3 JAN 2024 01:02:03 PST": datetime(2024, 1, 3, 9, 2, 3),
        "2024-01-05": datetime(2024, 1, 5),
        "2024-13-45": None,
        "": None,
        "garbage": None,
        None: None,
    }
    check(spark, lambda c: fn.parse_date(c).cast("timestamp_ntz"), cases)


def test_normalize_query(spark):
    check(spark, fn.normalize_query, {"  a b \n": "a b", "x" * 600: "x" * 500})


# --- hashes, against plain sequential versions -----------------------------------


def fnv(token):
    state, raw = 0xCBF29CE484222325, token.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        state = ((state ^ (raw[i] | raw[i + 1] << 8)) * 0x100000001B3) % 2**64
    return state


def to_signed(value):
    return value - 2**64 if value >= 2**63 else value


def slow_simhash(tokens):
    features = tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:])]
    hashes = [fnv(f) for f in features]
    bits = [b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0]
    return to_signed(sum(1 << b for b in bits))


def test_fnv1a64(spark):
    words = ["", "a", "hello", "héllo", "😀x", "a_b", "ﬁn"]
    assert apply(spark, fn.fnv1a64, words) == [to_signed(fnv(w)) for w in words]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("abé😀", min_size=1, max_size=6), max_size=8), min_size=1, max_size=30))
def test_simhash_tokens(spark, lists):
    assert apply(spark, fn.simhash_tokens, lists, "array<string>") == [slow_simhash(t) for t in lists]


def test_simhash_of_texts(spark):
    assert apply(spark, fn.simhash, ["", "!", None]) == [0, 0, 0]
    a, b = apply(spark, fn.simhash, ["one two three", "three two one"])
    assert a != b


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), min_size=5))
def test_hamming_is_symmetric(spark, pairs):
    rows = spark.createDataFrame(pairs, "a long, b long")
    got = rows.select("a", "b", fn.hamming(F.col("a"), F.col("b")).alias("d"), fn.hamming(F.col("b"), F.col("a")).alias("e"))
    for r in got.collect():
        assert r.d == r.e == bin((r.a ^ r.b) % 2**64).count("1")


# --- embeddings -------------------------------------------------------------------


def test_hash_embedding(spark):
    import hashlib

    def slow(words, dim):
        vector = [0.0] * dim
        for w in words:
            h = hashlib.md5(w.encode()).digest()
            vector[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] % 2 == 0 else -1
        norm = sum(x * x for x in vector) ** 0.5 or 1.0
        return [x / norm for x in vector]

    texts = ["market rates rise, market falls", "the and", None, "öffnung zürich"]
    got = apply(spark, lambda c: hash_embedding(c, 16), texts)
    assert got[2] is None
    for vector, words in ((got[0], ["market", "rates", "rise", "market", "falls"]), (got[1], []), (got[3], ["öffnung", "zürich"])):
        assert vector == pytest.approx(slow(words, 16), abs=1e-6)


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    first, second = [r.s for r in rows.select(cosine_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert first == pytest.approx(0.5**0.5)
    assert second is None


def test_unknown_embedder_falls_back():
    with pytest.warns(UserWarning):
        assert callable(embedder("nothing like it"))


def test_word_lists():
    from storyloom.functions.text import EMBEDDING_STOPWORDS
    from storyloom.operators.search import SEARCH_STOPWORDS

    for words in (EMBEDDING_STOPWORDS, SEARCH_STOPWORDS):
        assert len(set(words)) == len(words)
        assert all(re.fullmatch("[a-z]+", w) for w in words)


def test_kernels_do_not_depend_on_slices(spark, monkeypatch):
    lists = [["alpha", "beta"] * n for n in (0, 1, 3, 40)] + [None, ["gamma"], [], ["alpha"] * 500]
    tokens = pa.array(lists, pa.list_(pa.string()))
    whole = hashing._simhash_slice(tokens).to_pylist()
    worked = []
    plain = hashing._simhash_slice
    monkeypatch.setattr(hashing, "_simhash_slice", lambda part: worked.append(len(part)) or plain(part))
    monkeypatch.setattr(hashing.list_slices, "__defaults__", (100, 3))
    parts = hashing.list_slices(tokens)
    assert [x for p in parts for x in p.to_pylist()] == lists and len(parts) > 2
    assert all(len(p) == 1 or (len(p) <= 3 and sum(len(x or []) for x in p.to_pylist()) <= 100) for p in parts)
    assert hashing.simhash_tokens.func(tokens).to_pylist() == whole and len(worked) == len(parts)
