"""BPE encoding and decoding with a public vocabulary (op 1).

Encoding equals that of a byte-level BPE with word ends: special tokens are taken
out of the raw text first, the rest is brought to NFC and lower case and cut
into words; a word's bytes are merged in order of rank.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import table

# Longer words keep their ranks in a heap: scanning is quadratic.
SHORT_WORD = 128
# Distinct pieces of text whose ids a worker remembers; beyond, it starts anew.
CACHED_PIECES = 300_000
# Bytes of text that are cut and merged together, and tokens that are decoded together.
BATCH_CHARS = 1_000_000
BATCH_TOKENS = 500_000
# White space that no piece can hold tells special tokens from text that looks like one.
MARK = "\u3000"
NEVER = np.iinfo(np.int64).max
ID_BYTES = 4

# Contractions that are words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary.

    Printable Latin-1 bytes stand for themselves, others for 256 onwards.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _class(kind: str) -> str:
    """Body of a character class: all characters of a Unicode property."""
    runs: list[list[int]] = []
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    for letter in regex.findall(rf"\p{{{kind}}}", everything):
        if runs and runs[-1][1] == ord(letter) - 1:
            runs[-1][1] += 1
        else:
            runs.append([ord(letter), ord(letter)])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def slices(sizes: np.ndarray, most: int) -> list[slice]:
    """Runs of rows of at most about ``most`` in all; a larger row is one of its own."""
    cuts, held = [0], 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            cuts.append(row)
            held = 0
        held += size
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)]) if a < b]


class Codec:
    """Vocabulary, merges and word cutting; lives once in each Python worker."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids = {**model["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(m): rank for rank, m in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        names = [""] * (max(self.ids.values()) + 1)
        for token, number in self.ids.items():
            names[number] = token
        self.names = pa.array(names)
        self.letters = byte_letters()
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        letter, digit = _class("L"), _class("N")
        self.words = re.compile(
            "|".join([*CONTRACTIONS, f"[{letter}]+", f"[{digit}]", f"[^{space}{letter}{digit}]+"])
        )
        self.gaps = re.compile(f"[{space}]+")
        self.cuts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        # Characters that str.split takes for white space and the vocabulary does not.
        self.odd = re.compile("[\\x1c-\\x1f]")
        # Ids are held as bytes, four each: a fraction of the memory of tuples, and joined at once.
        self.special_pieces = {MARK + t: _packed([number]) for t, number in self.special.items()} | {"": b""}
        self.known = dict(self.special_pieces)
        self.byte_ids = np.array([self.ids[c] for c in self.letters], np.int32)
        self.last_ids = np.array([self.ids[c + self.end] for c in self.letters], np.int32)
        keyed = sorted((self.ids[a] << 32 | self.ids[b], rank) for (a, b), rank in self.ranks.items())
        self.pair_keys, self.pair_ranks = np.array(keyed, np.int64).reshape(-1, 2).T.copy()
        self.merged_ids = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NEVER if it is not merged."""
        wanted = left.astype(np.int64) << 32 | right
        place = np.searchsorted(self.pair_keys, wanted)
        place[place == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[place] == wanted, self.pair_ranks[place], NEVER)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of one length in bytes, all merged in step.

        A row of ``parts`` holds what lies between the boundaries of a word, a
        row of ``ranks`` the rank of the pair at each boundary.  In every step
        each word loses the boundary of its leftmost least rank, and the ranks on
        either side are looked up anew.
        """
        size = len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        parts = self.byte_ids[raw]
        parts[:, -1] = self.last_ids[raw[:, -1]]
        ranks = self.rank_of(parts[:, :-1], parts[:, 1:])
        found = [b""] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            least = ranks.min(axis=1, initial=NEVER)
            done = least == NEVER
            raw, width = parts[done].tobytes(), ID_BYTES * parts.shape[1]
            for place, row in enumerate(rows[done].tolist()):
                found[row] = raw[place * width : (place + 1) * width]
            rows, parts, ranks, least = rows[~done], parts[~done], ranks[~done], least[~done]
            if not len(rows):
                break
            line, at, bounds = np.arange(len(rows)), ranks.argmin(axis=1), ranks.shape[1]
            parts[line, at] = self.merged_ids[least]
            parts = parts[np.arange(bounds + 1) != at[:, None] + 1].reshape(len(rows), bounds)
            ranks = ranks[np.arange(bounds) != at[:, None]].reshape(len(rows), bounds - 1)
            for side in (at - 1, at):
                near = (side >= 0) & (side < bounds - 1)
                r, c = line[near], side[near]
                ranks[r, c] = self.rank_of(parts[r, c], parts[r, c + 1])
        return found

    def merge_all(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word."""
        return {w: tuple(np.frombuffer(ids, np.int32).tolist()) for w, ids in self.merge_packed(words).items()}

    def merge_packed(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of each word."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        found = {}
        for word in words:
            raw = word.encode()
            if len(raw) > SHORT_WORD:
                parts = [self.letters[b] for b in raw]
                parts[-1] += self.end
                found[word] = _packed([self.ids[p] for p in self.merge_long(parts)])
            else:
                by_size.setdefault(len(raw), []).append((word, raw))
        for group in by_size.values():
            found.update(zip([w for w, _ in group], self.merge_short([raw for _, raw in group])))
        return found

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same merges for a long word: a heap of pairs and links between live parts."""
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        ranks = self.ranks
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since was pushed again under its new rank.
            if j >= size or ranks.get((parts[i], parts[j])) != least:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < size:
                    pair = ranks.get((parts[left], parts[after[left]]))
                    if pair is not None:
                        heapq.heappush(heap, (pair, left))
        return [p for p in parts if p]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of new pieces, which stand between white space."""
        # A piece of letters only is one word.
        whole = {p for p in pieces if p.isalpha()}
        mixed = {p: self.words.findall(p) for p in pieces - whole}
        ids = self.merge_packed(whole.union(*mixed.values()))
        self.known.update({p: ids[p] for p in whole})
        for piece, inside in mixed.items():
            self.known[piece] = b"".join([ids[w] for w in inside])

    def pieces(self, text: str) -> str:
        """A text cut at white space, as one line; a special token is a piece marked MARK."""
        if "<|" in text:
            cut = [MARK + p if i % 2 else self.plain(p) for i, p in enumerate(self.cuts.split(text))]
            return " ".join([p for p in cut if p])
        return self.plain(text)

    def plain(self, text: str) -> str:
        # The lower case of each character by itself: no final sigma.
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.odd.search(lower):
            return self.gaps.sub(" ", lower).strip(" ")
        return " ".join(lower.split())

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; only one slice of the texts is held as Python strings at a time."""
        # Millions of small strings, none in a cycle: walking them is all a collection would do.
        gc.disable()
        try:
            made = [
                self.encode_batch(texts[part].to_pylist())
                for part in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), BATCH_CHARS)
            ]
        finally:
            gc.enable()
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))

    def decode(self, lists: pa.Array) -> pa.StringArray:
        """Tokens of each list, joined by spaces; the tokens of one slice are held at a time."""
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        made = []
        for part in slices(lengths, BATCH_TOKENS):
            ends = pa.array(np.cumsum([0, *lengths[part]], dtype=np.int32))
            tokens = self.names.take(pc.list_flatten(lists[part]))
            made.append(pc.binary_join(pa.ListArray.from_arrays(ends, tokens), " "))
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    def encode_batch(self, texts: list[str]) -> pa.ListArray:
        """Look each distinct piece up once, then lay its ids down wherever it occurs."""
        cut = pc.split_pattern(pa.array([self.pieces(t) for t in texts], pa.string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > CACHED_PIECES:
            self.known = dict(self.special_pieces)
        self.learn({p for p in distinct if p not in self.known})
        ids = [self.known[p] for p in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
        flat = np.frombuffer(b"".join(ids), np.int32)
        begin, length = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        total = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(total[-1]) + np.repeat(begin - total[:-1], length)
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat[place]))


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    key, spec = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(json.loads(spec))
    return _codecs[key]


class Bpe:
    """Column functions that encode and decode with the vocabulary at ``path``.

    The driver reads the file (a few MB) and broadcasts it; executors need no copy.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            spec = file.read()
        key = hashlib.sha256(spec.encode()).hexdigest()
        self.shared = shared = spark.sparkContext.broadcast((key, spec))

        @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
        def encode(texts: pa.Array) -> pa.Array:
            return _codec(shared).encode(texts.fill_null(""))

        @F.arrow_udf(T.StringType())
        def decode(lists: pa.Array) -> pa.Array:
            return _codec(shared).decode(lists)

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Token ids; a null or empty text has none."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Tokens joined by spaces, special ones included; null or no ids give ''."""
        return self._decode(ids)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every row of ``docs``, repeated rows and null ids too.

    A null or empty text has no ids and decodes to ''; an empty table gives an empty
    result; no other column is read.  A task sends results on slice by slice, so what it
    holds is bounded by a batch of texts and the results of one slice.
    """
    shared = Bpe(docs.sparkSession, vocabulary or default_vocabulary()).shared

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for part in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), BATCH_CHARS):
                ids = codec.encode(texts[part])
                columns = [batch.column(0)[part], ids, codec.decode(ids)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(coded, f"doc_id {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every whole text; see ``encode_documents``."""
    return digests(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
