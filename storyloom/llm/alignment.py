"""Alignment of the tokens of two tokenizers by diagonal run skipping (op 13).

Both tokenizers cut the same bytes, so a token is known by where it ends.  As long as
both cut alike, end i of one equals end i + shift of the other; such stretches are
jumped by probes of doubling width.  Where the ends part, the two lists are walked
until they meet again, which closes one irregular group and sets the next shift.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.hashing import flat_lists
from storyloom.llm.bpe import byte_letters
from storyloom.llm.common import table
from storyloom.tables import lookup, spread, written

# Characters of text that are aligned together, and that share one list of id pairs.
BATCH_CHARS = 250_000
CHUNK_CHARS = 4_000_000
# What a row counts besides its text, so that a chunk of empty texts ends as well.
ROW_CHARS = 32
# Id pairs in a row of a chunk, and bytes of a row group of chunks, which readers hold unpacked.
PAIR_ROWS, GROUP_BYTES = 4_096, 8 << 20

# How byte-level vocabularies of this kind cut a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# What stands for a space in a piece, and in how many places a byte piece is written.
SPACE, BYTE_DIGITS = "▁", 6


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two arrays of token ends over the same bytes.

    ``a`` and ``b`` rise strictly and have the same last value.  Returned are, per group,
    how many tokens of either side end with it, and per pair of overlapping tokens the
    place of either, in order.
    """
    starts, shifts, counts, odd_a, odd_b = _walk(a.tolist(), b.tolist())
    start, shift, count = (np.array(x, np.int64) for x in (starts, shifts, counts))
    first = np.cumsum(count) - count
    even_a = np.arange(count.sum()) + np.repeat(start - first, count)
    link_a = np.concatenate([even_a, np.array(odd_a, np.int64)])
    link_b = np.concatenate([even_a + np.repeat(shift, count), np.array(odd_b, np.int64)])
    # Each link lies beyond the one before on one side or on both.
    order = np.argsort(link_a + link_b, kind="stable")
    link_a, link_b = link_a[order], link_b[order]
    closing = a[link_a] == b[link_b]
    return link_a[closing] + 1, link_b[closing] + 1, link_a, link_b


def _walk(a: list[int], b: list[int]) -> tuple[list[int], ...]:
    """One-to-one stretches as (start in a, shift, length), and the links of irregular groups."""
    starts, shifts, counts, odd_a, odd_b = [], [], [], [], []
    i = shift = 0
    size = len(a)
    while i < size:
        x, j = a[i], i + shift
        y = b[j]
        if x == y:
            start, width = i, 1
            i += 1
            # Twice as far each time while the shift holds ...
            while i < size and a[i : i + width] == b[i + shift : i + shift + width]:
                i, width = i + width, 2 * width
            # ... then half as far, down to the last token before it breaks.
            while width > 1 and i < size:
                width //= 2
                if a[i : i + width] == b[i + shift : i + shift + width]:
                    i += width
            i = min(i, size)
            starts.append(start)
            shifts.append(shift)
            counts.append(i - start)
            continue
        while x != y:
            odd_a.append(i)
            odd_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        odd_a.append(i)
        odd_b.append(j)
        i += 1
        shift = j + 1 - i
    return starts, shifts, counts, odd_a, odd_b


class BytePairs:
    """Byte-level BPE; special tokens in a text are plain text."""

    def __init__(self, spec: bytes):
        import tiktoken

        loaded = json.loads(spec)
        special = {t["content"] for t in loaded["added_tokens"]}
        byte_of = {letter: value for value, letter in enumerate(byte_letters())}
        vocabulary = {t: n for t, n in loaded["model"]["vocab"].items() if t not in special}
        ranks = {bytes(map(byte_of.__getitem__, t)): n for t, n in vocabulary.items()}
        # Ids of such a vocabulary are in the order of its merges, which is all an encoder needs.
        self.encoding = tiktoken.Encoding("byte-pairs", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.tokens[number] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


class Pieces:
    """Sentence pieces with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)])
            if self.model.is_byte(i) and len(p) == BYTE_DIGITS
            else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Aligned:
    """Texts aligned together: ids, groups and links lie end to end, text after text."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    # Where each text begins in each of these, one more at the end.
    a_at: np.ndarray
    b_at: np.ndarray
    group_at: np.ndarray
    link_at: np.ndarray


class Aligner:
    """Both tokenizers; lives once in each Python worker."""

    def __init__(self, first: bytes, second: bytes):
        self.first, self.second = BytePairs(first), Pieces(second)
        self.sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in (self.first, self.second)]
        self.width = len(self.second.tokens)
        names_a = [str(n) for n in range(len(self.first.tokens))]
        names_b = [str(n) for n in range(self.width)]
        # Each id with what follows it within a group, at the end of its side, and after the group.
        self.names = np.array(
            [n + "," for n in names_a] + [n + "|" for n in names_a] + [n + "," for n in names_b] + [n + ";" for n in names_b],
            object,
        )

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of every text; none for a text that is null, empty or not what its tokens spell."""
        asked = [n for n, t in enumerate(texts) if t]
        spaced = [" " + texts[n] for n in asked]
        found: tuple[list, list] = ([[]] * len(texts), [[]] * len(texts))
        pairs = zip(self.first.encode(spaced), self.second.encode([texts[n] for n in asked]))
        spell_a, spell_b = self.first.tokens.__getitem__, self.second.tokens.__getitem__
        for n, text, (a, b) in zip(asked, spaced, pairs):
            raw = text.encode()
            if b"".join(map(spell_a, a)) == raw and b"".join(map(spell_b, b)) == raw:
                found[0][n], found[1][n] = a, b
        return found

    def batch(self, texts: list[str | None]) -> Aligned:
        sides = self.tokens(texts)
        ids, ends, at = [], [], []
        for lists, sizes in zip(sides, self.sizes):
            at.append(np.cumsum([0, *map(len, lists)]))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(at[-1][-1])))
            # Texts follow each other, and every border between two is an end on both sides.
            ends.append(np.cumsum(sizes[ids[-1]]))
        cut_a, cut_b, link_a, link_b = align(*ends)
        group_at, link_at = np.searchsorted(cut_a, at[0], "right"), np.searchsorted(link_a, at[0])
        return Aligned(*ids, cut_a, cut_b, link_a, link_b, *at, group_at, link_at)

    def pairs(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair and how often, for the different id pairs of the links of each text."""
        text = np.repeat(np.arange(len(found.link_at) - 1), np.diff(found.link_at))
        linked = found.a[found.link_a] * self.width + found.b[found.link_b]
        span = len(self.first.tokens) * self.width
        keys, times = np.unique(text * span + linked, return_counts=True)
        return keys // span, keys % span, times

    def written_groups(self, found: Aligned) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        count_a, count_b = len(self.first.tokens), self.width
        begin_a, begin_b = (np.concatenate(([0], c[:-1])) for c in (found.cut_a, found.cut_b))
        line = np.empty(len(found.a) + len(found.b), np.int64)
        # A token is preceded by those of its side and by the other side's of earlier groups (B: and its own).
        of_a = np.repeat(np.arange(len(found.cut_a)), found.cut_a - begin_a)
        of_b = np.repeat(np.arange(len(found.cut_b)), found.cut_b - begin_b)
        code_a, code_b = found.a.copy(), found.b + 2 * count_a
        code_a[found.cut_a - 1] += count_a
        code_b[found.cut_b - 1] += count_b
        line[np.arange(len(found.a)) + begin_b[of_a]] = code_a
        line[np.arange(len(found.b)) + found.cut_a[of_b]] = code_b
        names, at = self.names[line].tolist(), (found.a_at + found.b_at).tolist()
        return ["".join(names[s:e])[:-1] for s, e in zip(at, at[1:])]


_aligners: dict[str, Aligner] = {}


def _aligner(shared) -> Aligner:
    key, first, second = shared.value
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(first, second)
    return _aligners[key]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _shared(spark: SparkSession, paths: tuple[str, str] | None):
    """Both files, a few MB in all, read by the driver and broadcast."""
    files = []
    for path in paths or default_tokenizers():
        with open(path, "rb") as file:
            files.append(file.read())
    return spark.sparkContext.broadcast((hashlib.sha256(b"|".join(files)).hexdigest(), *files))


def _slices(texts: list[str | None], chars: int) -> Iterator[slice]:
    """Runs of texts of about ``chars`` characters; a longer text is one of its own."""
    start = held = 0
    for end, text in enumerate(texts):
        size = len(text or "")
        if end > start and held + size > chars:
            yield slice(start, end)
            start, held = end, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The whole alignment of each document.

    doc_id; a_ids, b_ids: its tokens; a_cuts, b_cuts: per group, how many tokens of either
    side end with it; a_links, b_links: the places of the tokens of each overlapping pair.
    """
    shared = _shared(docs.sparkSession, paths)
    names = ("a_ids", "b_ids", "a_cuts", "b_cuts", "a_links", "b_links")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices(texts, BATCH_CHARS):
                x = aligner.batch(texts[part])
                begin = [np.repeat(s[:-1], np.diff(x.group_at)) for s in (x.a_at, x.b_at)]
                start = [np.repeat(s[:-1], np.diff(x.link_at)) for s in (x.a_at, x.b_at)]
                columns = [
                    batch.column(0)[part.start : part.stop],
                    _lists(x.a, x.a_at),
                    _lists(x.b, x.b_at),
                    _lists(x.cut_a - begin[0], x.group_at),
                    _lists(x.cut_b - begin[1], x.group_at),
                    _lists(x.link_a - start[0], x.link_at),
                    _lists(x.link_b - start[1], x.link_at),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(made, ", ".join(["doc_id bigint", *(f"{n} array<int>" for n in names)]))


_CHUNK = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, "
    "place array<int>, times array<int>, first int, pair array<bigint>, total array<bigint>"
)
_CHUNK_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("digest", pa.string())]
    + [(n, pa.list_(pa.int32())) for n in ("place", "times")]
    + [("first", pa.int32())]
    + [(n, pa.list_(pa.int64())) for n in ("pair", "total")]
)


def _chunk_rows(number: int, held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of a chunk, then rows of its different id pairs, ``PAIR_ROWS`` in each.

    ``place`` refers to the pairs of the chunk; ``first`` is the place of the first one of a row.
    """

    def batch(rows: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = np.full(rows, number, np.int64)
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _CHUNK_SCHEMA]
        return pa.RecordBatch.from_arrays(arrays, schema=_CHUNK_SCHEMA)

    times = np.concatenate(held["times"])
    known, place = np.unique(np.concatenate(held["pair"]), return_inverse=True)
    totals = np.bincount(place, weights=times, minlength=len(known)).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(held["size"])))
    facts = {n: held[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "digest")}
    yield batch(len(at) - 1, **facts, place=_lists(place, at), times=_lists(times, at))
    for low in range(0, len(known), PAIR_ROWS):
        part = slice(low, low + PAIR_ROWS)
        ends = np.array([0, len(known[part])], np.int32)
        pair, total = (pa.ListArray.from_arrays(pa.array(ends), pa.array(v[part])) for v in (known, totals))
        yield batch(1, first=[low], pair=pair, total=total)


def _chunks(docs: DataFrame, paths: tuple[str, str] | None) -> DataFrame:
    """Chunks of neighbouring documents: a row of figures per document, and rows of the chunk's id pairs.

    The different pairs of a chunk are listed once; a document refers to them by place.
    No row grows with its chunk, as readers hold some thousand rows of a table at once.
    """
    shared = _shared(docs.sparkSession, paths)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        # Unique within the table: it is written before anything refers to it.
        number, chars = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices(texts, BATCH_CHARS):
                x = aligner.batch(texts[part])
                text, pair, times = aligner.pairs(x)
                written_out = [g.encode() for g in aligner.written_groups(x)]
                facts = {
                    "doc_id": batch.column(0)[part.start : part.stop].to_pylist(),
                    "n_a": np.diff(x.a_at).tolist(),
                    "n_b": np.diff(x.b_at).tolist(),
                    "n_groups": np.diff(x.group_at).tolist(),
                    "n_links": np.diff(x.link_at).tolist(),
                    "digest": [hashlib.sha256(g).hexdigest() if g else "" for g in written_out],
                    "size": np.bincount(text, minlength=part.stop - part.start).tolist(),
                    "pair": [pair],
                    "times": [times],
                }
                for name, values in facts.items():
                    held.setdefault(name, []).extend(values)
                chars += sum(len(t or "") + ROW_CHARS for t in texts[part])
                if chars >= CHUNK_CHARS:
                    yield from _chunk_rows(number, held)
                    number, chars, held = number + 1, 0, {}
        if held:
            yield from _chunk_rows(number, held)

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(made, _CHUNK)


def pair_counts(chunks: DataFrame, width: int) -> DataFrame:
    """pair, count (links that hold it, over all documents), best (highest of its B id)."""
    listed = chunks.select(F.inline(F.arrays_zip("pair", "total")))
    counts = written(listed.groupBy("pair").agg(F.sum("total").alias("count")), "alignment-counts")
    of_b = counts.withColumn("b", F.col("pair") % width)
    # One row per B id: at most the size of a vocabulary.
    most = of_b.groupBy("b").agg(F.max("count").alias("most"))
    return lookup(of_b, most, "b", "inner").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


_FIGURES = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)


def _figures(chunk: pa.Table, facts: pa.Table) -> pa.Table:
    """Sums of counts over the links of each document of one chunk."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    columns: list[list] = [[] for _ in names]
    if len(chunk):
        place = facts.column("of_place").to_numpy()
        count, best = (np.zeros(len(place), np.int64) for _ in range(2))
        count[place] = facts.column("count").to_numpy()
        best[place] = facts.column("best").to_numpy()

        starts, places = flat_lists(chunk.column("place").combine_chunks())
        times = flat_lists(chunk.column("times").combine_chunks())[1].to_numpy().astype(np.int64)
        places = places.to_numpy()

        def summed(of_pair: np.ndarray) -> pa.Array:
            total = np.concatenate(([0], np.cumsum(of_pair[places] * times)))
            return pa.array(total[starts[1:]] - total[starts[:-1]])

        columns = [chunk.column(n) for n in names[:5]] + [summed(best), summed(count), chunk.column("digest")]
    types = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, types)], names=names)


def alignment_figures(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: numbers of tokens, groups and links, sums over the links, digest of the groups.

    Texts that are null, empty or not spelled by their tokens have zeros and ''.  Repeated
    rows count as often as they occur, ids may be null or repeat, an empty table gives an
    empty result; no other column is read.
    """
    spark = docs.sparkSession
    chunks = written(_chunks(docs, paths), "alignment-chunks", {"parquet.block.size": GROUP_BYTES})
    counts = pair_counts(chunks, _width(spark, paths))
    listed = chunks.select(F.col("chunk").alias("of_chunk"), "first", F.posexplode("pair").alias("of_place", "pair"))
    listed = listed.select("of_chunk", (F.col("first") + F.col("of_place")).alias("of_place"), "pair")
    facts = lookup(listed, counts, "pair", "inner").select("of_chunk", "of_place", "count", "best")
    rows = chunks.filter("place is not null").drop("first", "pair", "total")
    return rows.groupBy("chunk").cogroup(facts.groupBy("of_chunk")).applyInArrow(_figures, _FIGURES)


def _width(spark: SparkSession, paths: tuple[str, str] | None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=(paths or default_tokenizers())[1]).vocab_size()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over every whole text; see ``alignment_figures``."""
    return alignment_figures(table(spark, sf_dir, "documents").select("doc_id", "text"))
