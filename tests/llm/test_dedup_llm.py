"""Exact, line, substring and SimHash dedup against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from storyloom.llm.exact import exact_dedup, exact_groups
from storyloom.llm.lines import NEAR_CHARS, line_dedup
from storyloom.llm.simhash import allocate, fingerprint_of, near_dedup, near_groups, near_links
from storyloom.llm.components import components
from storyloom.llm.substring import spans_of, starts_of, substring_dedup
from tests.llm.samples import TEXTS, documents


def test_exact_groups_keep_the_largest_id_and_one_row_of_repeats(spark):
    got = exact_groups(documents(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row.text").collect()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    assert len(got) == len(TEXTS)
    kept = defaultdict(int)
    for r in got:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        kept[r.text or ""] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_dedup_splits_a_crowded_text(spark):
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.col("id").cast("string")).alias("text")
    )
    kept = {r.doc_id for r in exact_dedup(docs).collect()}
    assert kept == {*range(0, 3_000, 3), 2_999}
    sizes = exact_groups(docs).filter("text_sha256 = sha2('copy', 256)").select("group_size", "keep_id").distinct().collect()
    assert [tuple(r) for r in sizes] == [(2_000, 2_999)]


def test_exact_normalisation_and_empty_table(spark):
    docs = documents(spark)
    loose = exact_groups(docs, normalise=F.lower).filter("doc_id in (1, 2)")
    assert {r.keep_id for r in loose.collect()} == {2}
    empty = exact_dedup(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def plain_lines(texts):
    """Lines dropped per (id, text), by comparing every line with all earlier ones."""
    units = sorted({(i if i is not None else -1, t) for i, t in texts if t is not None}, key=lambda u: u[0])
    lines = [(u, p, line.strip(" ")) for u in units for p, line in enumerate(u[1].split("\n"))]
    dropped = defaultdict(set)
    seen = []
    for unit, place, line in lines:
        if not line:
            continue
        if any(old == line or (min(len(old), len(line)) >= NEAR_CHARS and one_edit(old, line)) for old in seen):
            dropped[unit].add(place)
        seen.append(line)
    return dropped


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :]
    return True


LINE_TEXTS = [(i, t) for i, t in TEXTS if i != 10] + [
    (20, "abcdefghijklmnopqrstuvwxyz"),
    (21, "abcdefghijklmnopqrstuvwxy"),
    (22, "abcdefghijklmopqrstuvwxyz\nabcdefghijklmnopqrstuvwxyZ"),
    (23, "bcdefghijklmnopqrstuvwxyz"),
    (24, "abcdefghijklmnopqrstuvwx\nXabcdefghijklmnopqrstuvwxyzX"),
    (25, "w" * 400 + "1" + "v" * 300),
    (26, "w" * 400 + "2" + "v" * 300),
    (27, "w" * 400 + "v" * 300 + "\n" + "w" * 399 + "v" * 299),
]


def test_line_dedup_equals_the_plain_rule(spark):
    docs = documents(spark, LINE_TEXTS)
    dropped = plain_lines(LINE_TEXTS)
    got = line_dedup(docs).select("row.doc_id", F.col("row.text").alias("old"), "text", "n_lines", "n_dropped").collect()
    assert len(got) == len(LINE_TEXTS)
    for r in got:
        if r.old is None:
            assert r.text is None and r.n_lines == 0
            continue
        gone = dropped[(r.doc_id if r.doc_id is not None else -1, r.old)]
        lines = r.old.split("\n")
        assert r.text == "\n".join(line for p, line in enumerate(lines) if p not in gone), r.doc_id
        assert (r.n_lines, r.n_dropped) == (len(lines), len(gone))


def test_line_dedup_of_nothing(spark):
    assert line_dedup(documents(spark).limit(0)).count() == 0


def test_spans_cover_whole_sentences():
    text = "One two. Three four five, six.\nSeven eight! " + "Nine ten. " * 5
    starts = starts_of(text)
    assert "".join(text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])) == text
    for first, end, words in spans_of(text, 3, 5):
        assert end - first >= 3 and len(words.split()) >= 5
    assert spans_of("", 3, 5) == [] and spans_of("too short.", 3, 5) == []


def test_substring_dedup_removes_later_passages_only(spark):
    passage = "the quick fox, which was brown, jumped over some lazy dogs; it then ran away, and slept for hours. It woke late, " * 2
    own = {i: f"document {i} begins here with words of number {i}." for i in range(6)}
    texts = [(i, f"{own[i]} before it {passage}and after it comes more of {i}." if i in (1, 3, 4) else own[i]) for i in own]
    got = {r.doc_id: r for r in substring_dedup(documents(spark, texts)).select("row.doc_id", "text", "removed", "sources").collect()}
    assert got[1].removed == 0 or "quick fox" in got[1].text
    for i in (3, 4):
        assert "lazy dogs" not in got[i].text and own[i] in got[i].text and f"more of {i}." in got[i].text
        assert got[i].sources == [1]
    for i in (0, 2, 5):
        assert got[i].text == own[i] and got[i].removed == 0 and got[i].sources is None


def test_substring_dedup_of_awkward_texts(spark):
    got = substring_dedup(documents(spark)).select("row.doc_id", F.col("row.text").alias("old"), "text").collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 10)}
    assert by_id[4].text is None and by_id[5].text == "" and by_id[9].text == "x" * 50_000
    assert by_id[7].text.startswith("a fairly common sentence") and len(by_id[7].text) < 300
    assert by_id[8].text.strip() == "tail"
    assert substring_dedup(documents(spark).limit(0)).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    for text in ("", "a", "A b", "a b c", "a b c d e a b c", "É é É x y z", "w " * 500):
        assert fingerprint_of(text.encode().lower().split()) == plain_fingerprint(text)
    prints = [plain_fingerprint(t) for _, t in TEXTS]
    group = list(range(len(TEXTS)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            if (a ^ b).bit_count() <= 2:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    ids = {g: min((TEXTS[i][0] for i in range(len(TEXTS)) if group[i] == g and TEXTS[i][0] is not None), default=None) for g in group}
    wanted = sorted(((i, p, ids[g]) for (i, _), p, g in zip(TEXTS, prints, group)), key=str)
    docs = documents(spark)
    got = near_groups(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=str) == wanted
    assert {ids[group[i]] for i in (0, 1)} == {1} and {ids[group[i]] for i in (3, 4, 5)} == {4}
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    firsts = {g for g in ids.values()}
    assert {r.doc_id for r in kept.collect()} == firsts
    assert near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("per_key", [200, 4_096])
def test_links_of_a_dense_ball_are_complete(spark, per_key):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    ball = [values[0] ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (120, 2))]
    values = np.unique(np.concatenate([values, np.array(ball)])).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "value long")
    got = {(r.a, r.b) for r in near_links(frame, pairs_per_key=per_key).collect()}
    bits = values.view(np.uint64)
    wanted = {
        (int(values[i]), int(values[j]))
        for i in range(len(values))
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 2)
        if values[i] < values[j]
    }
    assert got == wanted and len(wanted) > 300


def test_thresholds_cost_least():
    costs = [[0, 5, 50, 500], [0, 9, 10, 11], [0, 100, 200, 300]]
    total, chosen = allocate(costs, 2)
    assert total == min(
        costs[0][a] + costs[1][b] + costs[2][c] for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3
    )
    assert sum(t + 1 for t in chosen) == 3


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(200, 260)} == {5} and got[300] == 299
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
