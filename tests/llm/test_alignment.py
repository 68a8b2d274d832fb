"""Token alignment against all pairs of byte ranges, with the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm.alignment import (
    PAIR_ROWS, Aligner, _chunk_rows, _chunks, _slices, align, alignment_figures, alignments,
    default_tokenizers,
)
from storyloom.llm.bpe import byte_letters
from tests.llm.samples import LONG, TEXTS, documents

ODD = [
    "▁ holds the mark itself", "<s> <|endoftext|> <unk> <0x41> </s>", " lead", "tail  ", "\n\n\t x", "a\x00b", "日本語 текст 😀 é é",
    "unlikelyword" * 40, "  " * 300, "don't they'll 1234567 ½", "�", "a", " ",
]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(*(open(path, "rb").read() for path in default_tokenizers()))


def library_tokens(text):
    """Ids and bytes of both tokenizers, as their libraries give them; none where bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = default_tokenizers()
    a, b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    if not text:
        return [], []
    value = {letter: n for n, letter in enumerate(byte_letters())}
    sides = [[(n, bytes(value[c] for c in a.id_to_token(n))) for n in a.encode(" " + text, add_special_tokens=False).ids]]
    pieces = [(n, b.id_to_piece(n)) for n in b.encode(text)]
    sides.append([(n, bytes([int(p[3:5], 16)]) if b.is_byte(n) else p.replace("▁", " ").encode()) for n, p in pieces])
    if any(b"".join(raw for _, raw in side) != (" " + text).encode() for side in sides):
        return [], []
    return sides


def plain(text):
    """n_a, n_b, groups and linked id pairs by comparing every token with every token."""
    a, b = library_tokens(text)

    def ranges(side):
        ends = np.cumsum([0] + [len(raw) for _, raw in side]).tolist()
        return [(n, s, e) for (n, _), s, e in zip(side, ends, ends[1:])]

    a, b = ranges(a), ranges(b)
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = []
    for low, high in zip([0] + cuts, cuts):
        sides = [",".join(str(n) for n, s, e in side if low <= s and e <= high) for side in (a, b)]
        groups.append("|".join(sides))
    links = [(n, m) for n, s, e in a for m, u, v in b if s < v and u < e]
    return len(a), len(b), groups, links


@pytest.mark.parametrize("texts", [[t for _, t in TEXTS if t is None or len(t) < 4_000] + ODD])
def test_figures_equal_all_pairs(spark, texts):
    rows = [(n, t) for n, t in enumerate(texts)] + [(1, texts[1]), (None, "a row without an id")]
    wanted = [(i, *plain(t)) for i, t in rows]
    counts = Counter(pair for *_, links in wanted for pair in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    expected = Counter(
        (
            i, n_a, n_b, len(groups), len(links),
            sum(counts[pair] == most[pair[1]] for pair in links), sum(counts[pair] for pair in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for i, n_a, n_b, groups, links in wanted
    )
    got = Counter(tuple(r) for r in alignment_figures(documents(spark, rows).repartition(3)).collect())
    assert got == expected


def test_whole_alignments(spark):
    rows = [(n, t) for n, t in enumerate(ODD)]
    for r in alignments(documents(spark, rows)).collect():
        n_a, n_b, groups, links = plain(ODD[r.doc_id])
        starts = zip([0, *r.a_cuts], [0, *r.b_cuts], r.a_cuts, r.b_cuts)
        made = ["|".join(",".join(map(str, x)) for x in (r.a_ids[s:e], r.b_ids[t:f])) for s, t, e, f in starts]
        assert (len(r.a_ids), len(r.b_ids), made) == (n_a, n_b, groups)
        assert [(r.a_ids[i], r.b_ids[j]) for i, j in zip(r.a_links, r.b_links)] == links


def test_awkward_rows(spark):
    got = alignment_figures(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_a > 0) == (r.groups_sha256 != "") and r.n_links >= max(r.n_a, r.n_b, r.n_groups)
        assert r.n_best <= r.n_links <= r.count_sum
    assert alignment_figures(documents(spark).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400)), st.integers(401, 500))
def test_runs_and_groups_of_any_ends(a, b, last):
    a, b = sorted(a | {last}), sorted(b | {last})
    cut_a, cut_b, link_a, link_b = align(np.array(a), np.array(b))
    assert [a[i - 1] for i in cut_a] == [b[i - 1] for i in cut_b] == sorted(set(a) & set(b))
    plain_links = [
        (i, j) for i in range(len(a)) for j in range(len(b))
        if ([0] + a)[i] < b[j] and ([0] + b)[j] < a[i]
    ]
    assert list(zip(link_a.tolist(), link_b.tolist())) == plain_links


def test_both_readers_of_the_vocabulary_agree(aligner):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizers()[0])
    library.encode_special_tokens = True
    texts = [t for _, t in TEXTS if t] + ODD + ["x" * 5_000, LONG]
    texts += ["".join(map(chr, range(s, s + 512))) for s in range(0, 0xD800, 512)]
    assert aligner.first.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_slices_cover_all_texts_once():
    texts = [None, "a" * 10, "", "b" * 300, "c" * 5, "d" * 96]
    for chars in (1, 50, 100, 10_000):
        parts = [texts[s] for s in _slices(texts, chars)]
        assert sum(parts, []) == texts
        assert all(len(p) == 1 or sum(len(t or "") for t in p) <= chars for p in parts)
    assert list(_slices([], 10)) == []


def test_no_row_between_grows_with_its_chunk(spark):
    """A reader holds some thousand rows of a table, so a row is no longer than its document."""
    rows = [(n, f"{n} words {n * 7} of text {'ab' * (n % 9)} number {n}") for n in range(2_000)] + [(None, None), (5, "")]
    held = _chunks(documents(spark, rows), None).collect()
    of_texts = [r for r in held if r.place is not None]
    assert len({r.chunk for r in held}) < len(of_texts) == len(rows)
    assert max(len(r.place) for r in of_texts) < 100


def test_pairs_of_a_chunk_are_cut_into_rows():
    rng = np.random.default_rng(4)
    sizes = [0, 7, 3 * PAIR_ROWS, 0, 60]
    pairs = [np.sort(rng.choice(10**9, n, replace=False)) for n in sizes]
    times = [rng.integers(1, 9, n) for n in sizes]
    texts = {n: list(range(5)) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"digest": list("abcde")}
    first, *others = [b.to_pylist() for b in _chunk_rows(3, texts | {"size": sizes, "pair": pairs, "times": times})]
    listed = [r for batch in others for r in batch]
    assert [r["first"] for r in listed] == list(range(0, sum(len(r["pair"]) for r in listed), PAIR_ROWS))
    assert len(listed) > 2 and all(len(r["pair"]) == len(r["total"]) <= PAIR_ROWS for r in listed)
    known, totals = (sum((r[n] for r in listed), []) for n in ("pair", "total"))
    wanted = Counter()
    for p, t in zip(pairs, times):
        wanted.update(dict(zip(p.tolist(), t.tolist())))
    assert dict(zip(known, totals)) == wanted
    assert [[known[p] for p in r["place"]] for r in first] == [p.tolist() for p in pairs]
    assert [r["times"] for r in first] == [t.tolist() for t in times] and {r["chunk"] for r in first + listed} == {3}
