"""Personal data in texts: fixed patterns, and a character tagger for what they miss (op 11).

The tagger learns from spans that the patterns find in a bounded sample of documents and
from variants of them (other digits, separators, formats), so it also marks what fails
an exact check: a card number with a wrong digit, two numbers run together, a phone
number without its plus.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.llm.tagger import OUTSIDE, Tagger, begin_of, symbols_of
from storyloom.tables import spread

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Windows overlap by half: a span of at most STRIDE characters lies whole in one of them.
WINDOW, STRIDE = 96, 48
# Documents, by smallest hash of the text, and windows per document that the tagger learns from.
TRAIN_DOCUMENTS, WINDOWS_PER_DOCUMENT = 3_000, 4
# Windows learned from, half of them without a span, and passes over them.
TRAIN_WINDOWS, EPOCHS = 1_600, 10
# Windows that go through the network together; more would start threads for each product.
BATCH_WINDOWS = 256
# Characters of text whose windows are held together.
BATCH_CHARS = 2_000_000

# The patterns of the base kinds; an address is looked for from its @ sign.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its first digit fails at all others, so it is tried once.
ADDRESS = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_NUMBER = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CARD_DIGITS, PHONE_DIGITS, SHORT_PHONE, LARGEST_PART = (13, 19), (9, 15), 7, 255


def passes_luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, its digits added; the sum ends in 0."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as allowed, so a long word is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        # What lies left of this @ can begin no later address.
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it passes) of every match of a pattern."""
    found = [(EMAIL, s, e, True) for s, e in _emails(text)]
    for m in ADDRESS.finditer(text):
        parts = m.group().split(".")
        # Compared without their zeros, as a number may have thousands of digits.
        sound = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= LARGEST_PART for p in parts)
        found.append((IP, *m.span(), sound))
    for m in CARD_NUMBER.finditer(text):
        digits = "".join(DIGITS.findall(m.group()))
        found.append((CARD, *m.span(), CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and passes_luhn(digits)))
    for m in PHONE_NUMBER.finditer(text):
        size = sum(map(len, DIGITS.findall(m.group())))
        found.append((PHONE, *m.span(), PHONE_DIGITS[0] <= size <= PHONE_DIGITS[1]))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the matches that pass, by kind, then start."""
    return [(k, s, e) for k, s, e, sound in candidates(text) if sound]


# --- windows --------------------------------------------------------------------


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and symbols of the windows that hold a digit or an @.

    A span without either is none of the kinds, so the other windows cannot add one.
    """
    symbols = symbols_of(text)
    signs = np.flatnonzero(((symbols >= 48) & (symbols <= 57)) | (symbols == 64))
    if not len(signs):
        return np.zeros(0, np.int64), np.zeros((0, WINDOW), np.uint8)
    number = np.unique(np.concatenate([signs // STRIDE, signs // STRIDE - 1]))
    # The last window that begins within a text may be covered by the one before it.
    starts = number[(number >= 0) & ((number == 0) | (number * STRIDE + STRIDE < len(symbols)))] * STRIDE
    place = starts[:, None] + np.arange(WINDOW)
    padded = np.append(symbols, np.uint8(OUTSIDE))
    return starts, padded[np.minimum(place, len(symbols))]


def spans_in(labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window, kind, start and end of every run of begin and inside labels."""
    rows, time = labels.shape
    edge = np.zeros((rows, 1), labels.dtype)
    wide = np.concatenate([labels, edge], axis=1)
    begin = np.flatnonzero(wide.ravel() % 2 == 1)
    # A run ends before the next label that is not inside.
    stops = np.flatnonzero((wide.ravel() == 0) | (wide.ravel() % 2 == 1))
    end = stops[np.searchsorted(stops, begin, "right")]
    return begin // (time + 1), wide.ravel()[begin] // 2, begin % (time + 1), end - begin // (time + 1) * (time + 1)


def plausible(kind: int, piece: str) -> bool:
    """Whether a decoded span has the parts of its kind."""
    if piece[0].isspace() or piece[-1].isspace():
        return False
    runs = DIGITS.findall(piece)
    digits = sum(map(len, runs))
    if kind == EMAIL:
        return "@" in piece[1:-1]
    if kind == IP:
        return len(runs) == 4 and all(len(r) <= 3 for r in runs)
    if kind == CARD:
        return CARD_DIGITS[0] <= digits <= CARD_DIGITS[1] and not any(c.isalpha() for c in piece)
    return SHORT_PHONE <= digits <= PHONE_DIGITS[1] and not any(c.isalpha() for c in piece)


def reconciled(votes: dict[tuple[int, int, int], int]) -> list[tuple[int, int, int]]:
    """The spans of greatest total weight of which no two overlap, by start.

    Weights are whole numbers; of equal totals, that with the earlier last span wins.
    """
    spans = sorted(votes, key=lambda x: (x[2], x[1], x[0]))
    ends = [e for _, _, e in spans]
    best, taken = [0], []
    for n, (kind, start, end) in enumerate(spans):
        before = int(np.searchsorted(ends[:n], start, "right"))
        gain = best[before] + votes[kind, start, end]
        taken.append((before, gain > best[n]))
        best.append(max(best[n], gain))
    chosen, n = [], len(spans)
    while n:
        before, take = taken[n - 1]
        if take:
            chosen.append(spans[n - 1])
        n = before if take else n - 1
    return chosen[::-1]


class Finder:
    """Adds the spans that a fitted tagger decodes; without a tagger, base spans only."""

    def __init__(self, tagger: Tagger | None):
        self.tagger = tagger

    def decoded(self, texts: list[str]) -> list[dict[tuple[int, int, int], int]]:
        """Votes for each decoded span of each text, more the further it is from a window's edges."""
        votes: list[dict] = [{} for _ in texts]
        if self.tagger is None:
            return votes
        made = [windows_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s, _ in made])
        starts = np.concatenate([s for s, _ in made])
        rows = np.concatenate([w for _, w in made])
        for at in range(0, len(rows), BATCH_WINDOWS):
            labels = self.tagger.decode(rows[at : at + BATCH_WINDOWS])
            for w, kind, begin, end in zip(*(x.tolist() for x in spans_in(labels))):
                text, base = int(owner[at + w]), int(starts[at + w])
                size = len(texts[text])
                start, stop = base + begin, min(base + end, size)
                # A span cut by an edge within the text is whole in the next window.
                if (begin == 0 and base) or (end == WINDOW and base + WINDOW < size) or start >= stop:
                    continue
                margin = min(begin if base else WINDOW, WINDOW - end if base + WINDOW < size else WINDOW)
                key = (kind, start, stop)
                votes[text][key] = votes[text].get(key, 0) + 1 + margin
        return votes

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """Base spans and added spans of each text; an added one touches no base span."""
        found, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars < BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            part = texts[start:end]
            for text, votes in zip(part, self.decoded(part)):
                base = base_spans(text)
                free = {
                    x: n for x, n in votes.items()
                    if plausible(x[0], text[x[1] : x[2]]) and not any(s < x[2] and x[1] < e for _, s, e in base)
                }
                found.append((base, reconciled(free)))
            start = end
        return found


# --- learning -------------------------------------------------------------------


def examples_of(text: str, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A few windows of a text with their base spans.

    Windows that touch a match which failed its check are left out: whether that is
    personal data is what the tagger shall say.
    """
    draw = random.Random(seed)
    found = candidates(text)
    anchors = [s for _, s, _, sound in found if sound]
    others = [m.start() for m in re.finditer(r"[0-9]+|@", text)]
    chosen = draw.sample(anchors, min(len(anchors), WINDOWS_PER_DOCUMENT // 2))
    chosen += draw.sample(others, min(len(others), WINDOWS_PER_DOCUMENT - len(chosen)))
    made = []
    for anchor in chosen:
        start = max(0, anchor - draw.randrange(WINDOW - STRIDE))
        stop = min(len(text), start + WINDOW)
        inside = [x for x in found if x[1] < stop and start < x[2]]
        passing = [x for x in inside if x[3]]
        doubtful = any(
            sum(map(len, DIGITS.findall(text[s:e]))) >= SHORT_PHONE and not any(p[1] < e and s < p[2] for p in passing)
            for _, s, e, sound in inside
            if not sound
        )
        cut = any(s < start or e > stop for _, s, e, _ in passing)
        # A number that is part of two passing matches has no one label.
        crossed = any(a is not b and a[1] < b[2] and b[1] < a[2] for a in passing for b in passing)
        if not doubtful and not cut and not crossed:
            made.append((text[start:stop], [(k, s - start, e - start) for k, s, e, _ in passing]))
    return made


def _digits(draw: random.Random, form: str) -> str:
    return "".join(str(draw.randrange(10)) if c == "d" else c for c in form)


def variant(kind: int, piece: str, draw: random.Random) -> str:
    """Another piece of personal data of the kind, like ``piece`` or in another format."""
    if kind == EMAIL:
        local, _, domain = piece.rpartition("@")
        local = re.sub("[0-9]", lambda _: str(draw.randrange(10)), local)
        at = draw.choice(("@", "@", "@", " @ ", "@ "))
        return local + at + draw.choice((domain, domain, domain.replace(".", " . "), domain.rpartition(".")[0]))
    if kind == IP:
        return draw.choice((".", ".", ".", " . ", ". ")).join(str(draw.randrange(256)) for _ in range(4))
    if kind == CARD:
        plain = "d" * draw.choice((13, 14, 15, 16, 16, 16, 16, 17, 18, 19))
        gap = draw.choice((" ", "-", ".", "_", "  "))
        return _digits(draw, draw.choice((plain, plain, gap.join(["dddd"] * 4), gap.join(["dddd", "dddddd", "ddddd"]))))
    forms = ("+d (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "+dd ddd ddd dddd", "+d-ddd-ddd-dddd", "ddd.ddd.dddd", "00dd ddd ddddddd")
    return _digits(draw, draw.choice(forms))


def other_number(draw: random.Random) -> str:
    """Digits that are no personal data: counts, dates, times, versions, long and hexadecimal numbers."""
    forms = ("d", "dd", "ddd", "dddd", "ddddd", "dddddd", "d.dd", "d,ddd", "dd:dd", "dddd-dd-dd", "dd.dd.dddd", "d.d.d", "dd%", "dddddddd")
    pick = draw.randrange(len(forms) + 3)
    if pick < len(forms):
        return _digits(draw, forms[pick])
    if pick == len(forms):
        return _digits(draw, "d" * draw.randrange(21, 40))
    return "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice((8, 16, 32, 40))))


def training_set(examples: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels: the sampled windows, and windows with a span or number put in."""
    draw = random.Random(seed)
    known = [(k, t[s:e]) for t, spans in examples for k, s, e in spans]
    samples: list[list[str]] = [[p for k, p in known if k == kind] for kind in range(len(KINDS))]
    bare = [t for t, spans in examples if not spans]
    made = list(examples[: TRAIN_WINDOWS // 2])
    contexts = [re.sub("[0-9@+]", "", t) for t, _ in examples]
    while contexts and len(made) < TRAIN_WINDOWS:
        context = draw.choice(contexts)
        at = context.rfind(" ", 0, draw.randrange(1, WINDOW - STRIDE + 1)) + 1
        if draw.random() < 0.3:
            piece, spans = other_number(draw), []
        else:
            piece, spans = "", []
            for _ in range(draw.choice((1, 1, 1, 2))):
                kind = draw.choice([k for k in range(len(KINDS)) if k != EMAIL or samples[EMAIL]])
                one = variant(kind, draw.choice(samples[EMAIL]) if kind == EMAIL else "", draw)
                piece += " " * bool(piece)
                spans.append((kind, at + len(piece), at + len(piece) + len(one)))
                piece += one
        text = context[:at] + piece + draw.choice((" ", " ", ", ", ". ", ")")) + context[at:]
        if all(e <= WINDOW for _, _, e in spans):
            made.append((text[:WINDOW], spans))
    for text in bare[: TRAIN_WINDOWS // 8]:
        made.append((re.sub("[0-9]", lambda _: str(draw.randrange(10)), text), []))
    windows = np.full((len(made), WINDOW), OUTSIDE, np.uint8)
    labels = np.zeros((len(made), WINDOW), np.int64)
    for row, (text, spans) in enumerate(made):
        windows[row, : len(text)] = symbols_of(text)[:WINDOW]
        for kind, start, end in spans:
            labels[row, start:end] = begin_of(kind) + 1
            labels[row, start] = begin_of(kind)
    return windows, labels


def sampled_examples(texts: DataFrame, documents: int = TRAIN_DOCUMENTS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of at most ``documents`` different texts with a digit or an @, those of least hash.

    The hash of the last one is found first, so texts of that sample only are shuffled, and
    repeated texts count once.
    """
    signed = texts.filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("hash"))
    least = signed.select("hash").distinct().orderBy("hash").limit(documents)
    last = least.agg(F.max("hash")).first()[0]
    if last is None:
        return []
    sample = signed.filter(F.col("hash") <= last).groupBy("hash").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = [(h, n, *x) for h, t in rows for n, x in enumerate(examples_of(t, h))]
            spans = pa.array([[v for s in x[3] for v in s] for x in found], pa.list_(pa.int32()))
            columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32())]
            columns += [pa.array([x[2] for x in found], pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "n", "text", "spans"])

    rows = sample.mapInArrow(cut, "hash bigint, n int, text string, spans array<int>").orderBy("hash", "n").collect()
    return [(r.text, [tuple(r.spans[i : i + 3]) for i in range(0, len(r.spans), 3)]) for r in rows]


def fit_tagger(texts: DataFrame, documents: int = TRAIN_DOCUMENTS, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger fitted on the driver to a bounded sample; None where no span is there to learn from."""
    examples = sampled_examples(texts, documents)
    if not any(spans for _, spans in examples):
        return None
    tagger = Tagger(len(KINDS))
    tagger.fit(*training_set(examples), epochs)
    return tagger


# --- operator -------------------------------------------------------------------


def personal_spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, base, added of every row: arrays of (kind, start, end) in code points.

    ``base`` holds the pattern matches that pass their checks, by kind and start; ``added``
    what the tagger finds beside them, by start.  A null text is empty and has none; repeated
    rows and ids stay as they are; an empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            spans = finder.spans(batch.column(1).fill_null("").to_pylist())
            columns = [batch.column(0)]
            for side in range(2):
                columns.append(
                    pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x[side]] for x in spans], item)
                )
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "added"])

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    item_type = "array<struct<kind: string, start: int, end: int>>"
    return rows.mapInArrow(found, f"doc_id bigint, base {item_type}, added {item_type}")


def find_personal(docs: DataFrame, **options) -> DataFrame:
    """``personal_spans`` with a tagger fitted to ``docs`` itself."""
    return personal_spans(docs, fit_tagger(docs.select("text"), **options))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    order = F.array(*map(F.lit, KINDS))

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def keyed(x):
        return F.struct(F.array_position(order, x["kind"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    every = F.array_sort(F.transform(F.concat("base", "added"), keyed))
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(every).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``; counts are those of the base spans."""
    return span_digests(find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")))
