"""Personal data: patterns against plain matching, the tagger against its definition and unseen rows."""

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.llm.personal import (
    CARD, EMAIL, IP, KINDS, PHONE, STRIDE, WINDOW, Finder, base_spans, find_personal, fit_tagger, passes_luhn,
    personal_spans, reconciled, span_digests, spans_in, training_set, windows_of,
)
from storyloom.llm.tagger import OUTSIDE, Tagger, legal_moves, symbols_of
from tests.llm.samples import TEXTS, documents

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == IP and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == CARD and not (13 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == PHONE and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


@settings(max_examples=1500, deadline=None)
@given(st.text("ab@.+-_ ()019é٣\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["a@b.co", "@", "x@y", "x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111",
     "4111-1111-1111-1112", "4111111111111111 5500000000000004", "+1 (017) 555-7713", "+1 (017) 555-7713 12", "+123", " ", "-", "é"]
), max_size=6))
def test_base_spans_of_joined_pieces(pieces):
    text = "".join(pieces)
    assert base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+" * 300_000, "a@" * 100_000, "1 " * 150_000):
        assert base_spans(text) == [] or "1.1.1.1" in text
    assert base_spans("9" * 5_000 + ".1.1.1") == []


@given(st.text("0123456789", min_size=1, max_size=25))
def test_luhn(digits):
    assert passes_luhn(digits) == plain_luhn(digits)


def test_windows_cover_every_sign():
    for size, places in ((0, []), (5, [2]), (48, [0, 47]), (49, [48]), (97, [96]), (500, [10, 250, 499]), (500, range(500))):
        letters = ["é"] * size
        for p in places:
            letters[p] = "7"
        starts, rows = windows_of("".join(letters))
        for p in places:
            holding = [s for s in starts.tolist() if s <= p < s + WINDOW]
            wanted = {s for s in (p // STRIDE * STRIDE, p // STRIDE * STRIDE - STRIDE) if s >= 0 and (s == 0 or s + STRIDE < size)}
            assert set(holding) == wanted and holding
        for s, row in zip(starts.tolist(), rows):
            inside = symbols_of("".join(letters)[s : s + WINDOW])
            assert row[: len(inside)].tolist() == inside.tolist() and (row[len(inside) :] == OUTSIDE).all()


def test_runs_of_labels():
    labels = np.array([[1, 2, 2, 0, 3, 1], [0, 0, 5, 6, 6, 6], [0] * 6, [7, 7, 8, 0, 0, 1]], np.int8)
    got = list(zip(*(x.tolist() for x in spans_in(labels))))
    assert got == [(0, 0, 0, 3), (0, 1, 4, 5), (0, 0, 5, 6), (1, 2, 2, 6), (3, 3, 0, 1), (3, 3, 1, 3), (3, 0, 5, 6)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(
    st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(1, 6)).map(lambda x: (x[0], x[1], x[1] + x[2])),
    st.integers(1, 50), max_size=8,
))
def test_reconciled_spans_have_the_greatest_weight(votes):
    got = reconciled(votes)
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
    best = 0
    for size in range(len(votes) + 1):
        for some in itertools.combinations(sorted(votes, key=lambda x: (x[1], x[2])), size):
            if all(a[2] <= b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(votes[x] for x in some))
    assert sum(votes[x] for x in got) == best


def test_loss_and_decoding_equal_all_label_paths():
    tagger = Tagger(1, hidden=3, dtype=np.float64)
    rng = np.random.default_rng(1)
    windows = rng.integers(0, OUTSIDE, (5, 4))
    move, first = legal_moves(1)
    scores = tagger.emissions(tagger.states(windows)[0])
    labels = np.array([[0, 1, 2, 0], [1, 2, 2, 2], [0, 0, 0, 0], [1, 1, 0, 1], [0, 0, 1, 2]])
    decoded = tagger.decode(windows)
    value = 0.0
    for w in range(5):
        paths = {}
        for path in itertools.product(range(3), repeat=4):
            if first[path[0]] and all(move[a, b] for a, b in zip(path, path[1:])):
                steps = sum(tagger.parts["move"][a, b] for a, b in zip(path, path[1:]))
                paths[path] = steps + tagger.parts["first"][path[0]] + sum(scores[t, w, x] for t, x in enumerate(path))
        assert tuple(decoded[w]) == max(paths, key=paths.get)
        value += np.log(sum(np.exp(s) for s in paths.values())) - paths[tuple(labels[w])]
    assert abs(tagger.loss(windows, labels)[0] - value / 5) < 1e-9


def test_gradient_equals_differences():
    tagger = Tagger(2, hidden=3, dtype=np.float64)
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 130, (4, 7))
    labels = np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 0, 0, 0, 0], [0] * 7, [3, 1, 2, 0, 1, 1, 2]])
    grad = tagger.loss(windows, labels)[1]
    for name, part in tagger.parts.items():
        places = [tuple(rng.integers(0, s) for s in part.shape) for _ in range(10)]
        if name == "symbols":
            places = [(d, windows[i, 2], k) for d in range(2) for i in range(4) for k in (0, 4, 11)]
        for place in places:
            kept = part[place]
            sides = []
            for step in (1e-5, -1e-5):
                part[place] = kept + step
                sides.append(tagger.loss(windows, labels)[0])
            part[place] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - grad[name][place]) < 1e-7


def corpus(seed, size):
    """Texts with one kind each in turn, and clean ones with other numbers; cards fail their check."""
    draw = random.Random(seed)
    words = "of the rain over hills and near old towns where nobody spoke about it again".split()
    rows = []
    for n in range(size):
        line = draw.choices(words, k=60)
        digits = "".join(draw.choice("0123456789") for _ in range(15))
        card = next(digits + d for d in "0123456789" if passes_luhn(digits + d))
        wrong = digits + str((int(card[-1]) + 1) % 10)
        put = [
            f"{draw.choice(words)}.{draw.randrange(99)}@mail{draw.randrange(9)}.example.com",
            ".".join(str(draw.randrange(256)) for _ in range(4)),
            card,
            f"+1 ({draw.randrange(1000):03d}) 555-{draw.randrange(10_000):04d}",
            wrong,
            f"in {draw.randrange(1900, 2030)} it cost {draw.randrange(5_000)}.50",
            f'key = "{hashlib.md5(str(n).encode()).hexdigest()}"',
            "",
        ][n % 8]
        line.insert(draw.randrange(60), put)
        rows.append((n, " ".join(line)))
    return rows


def test_unseen_rows(spark):
    tagger = fit_tagger(documents(spark, corpus(1, 400)).select("text"))
    rows = corpus(2, 400)
    got = {r.doc_id: r for r in personal_spans(documents(spark, rows), tagger).collect()}
    caught = clean = 0
    for n, text in rows:
        assert [(KINDS.index(k), s, e) for k, s, e in got[n].base] == plain_spans(text)
        caught += n % 8 == 4 and any(x.kind == "card" and x.end - x.start == 16 for x in got[n].added)
        clean += n % 8 >= 5 and not got[n].base and not got[n].added
    assert caught >= 45 and clean >= 145


def test_decoding_only_windows_with_signs_loses_nothing(spark):
    tagger = Tagger(4, seed=11)
    finder, texts = Finder(tagger), [t for _, t in corpus(5, 40)]
    for text in texts:
        size = len(text)
        starts = [s for s in range(0, size, STRIDE) if s == 0 or s + STRIDE < size]
        rows = np.full((len(starts), WINDOW), OUTSIDE, np.uint8)
        for row, s in zip(rows, starts):
            row[: min(WINDOW, size - s)] = symbols_of(text[s : s + WINDOW])
        votes = {}
        for w, kind, begin, end in zip(*(x.tolist() for x in spans_in(tagger.decode(rows)))):
            s, base = begin + starts[w], starts[w]
            e = min(base + end, size)
            if (begin == 0 and base) or (end == WINDOW and base + WINDOW < size) or s >= e:
                continue
            if not re.search("[0-9@]", text[s:e]):
                continue
            margin = min(begin if base else WINDOW, WINDOW - end if base + WINDOW < size else WINDOW)
            votes[kind, s, e] = votes.get((kind, s, e), 0) + 1 + margin
        some = {x: n for x, n in finder.decoded([text])[0].items() if re.search("[0-9@]", text[x[1] : x[2]])}
        assert some == votes


def test_awkward_rows(spark):
    rows = TEXTS + [(50, "write to a@b.co or 1.2.3.4, é+1 (017) 555-7713"), (51, "4111 1111 1111 1111 " * 500), (51, "a@b.co")]
    docs = documents(spark, rows).withColumn("base", F.lit("clash")).withColumn("spans", F.lit(None))
    got = span_digests(find_personal(docs, epochs=1)).collect()
    assert len(got) == len(rows)
    wanted = {}
    for i, t in rows:
        spans = plain_spans(t or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        wanted.setdefault(i, []).append((line, tuple(sum(k == n for k, _, _ in spans) for n in range(4))))
    for r in got:
        counts = (r.n_email, r.n_ip, r.n_card, r.n_phone)
        lines = [x for x, c in wanted[r.doc_id] if hashlib.sha256(x.encode()).hexdigest() == r.base_sha256 and c == counts]
        assert lines and (not lines[0] or set(lines[0].split(",")) <= set(r.spans.split(",")))
    assert find_personal(docs.limit(0)).count() == 0
    assert fit_tagger(documents(spark, [(1, "no numbers"), (2, None), (3, "only 7")]).select("text")) is None


def test_training_windows_are_labelled():
    windows, labels = training_set([("mail a@b.co now", [(EMAIL, 5, 11)]), ("the year 1999 went by", [])])
    assert windows.shape == labels.shape and windows.shape[1] == WINDOW
    assert labels[0, :12].tolist() == [0] * 5 + [1] + [2] * 5 + [0] and not labels[1].any()
    assert {n for n in range(9)} == set(np.unique(labels).tolist())
