"""Hash scalars: exact content hash, FNV-1a and SimHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import tokenize

# FNV-1a for 64 bits.  The prime is 2**40 + 435.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
# Tokens and texts that a kernel works on at a time; its arrays take some hundred bytes a token.
SLICE_TOKENS, SLICE_LISTS = 1 << 17, 1 << 10


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fnv1a64(token: Column) -> Column:
    """FNV-1a over UTF-16 code units, as a signed 64-bit integer.

    Long arithmetic may not wrap under ANSI rules, so the state is two 32-bit
    halves: a multiplication by 2**40 + 435 is one by 435 plus a shift.
    """
    low32 = 0xFFFFFFFF
    units = F.regexp_extract_all(
        F.hex(F.encode(token, "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1
    )
    start = F.struct(
        F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"),
        F.lit(FNV_OFFSET & low32).cast("bigint").alias("lo"),
    )

    def step(state: Column, unit: Column) -> Column:
        low = state["lo"].bitwiseXOR(F.conv(unit, 16, 10).cast("bigint"))
        carry = F.shiftright(low * 435, 32) + F.shiftleft(low, 8)
        return F.struct(
            (state["hi"] * 435 + carry).bitwiseAND(low32).alias("hi"),
            (low * 435).bitwiseAND(low32).alias("lo"),
        )

    return F.aggregate(
        units, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"])
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash(text: Column) -> Column:
    """SimHash of the tokens and neighbouring token pairs of a text."""
    return simhash_tokens(tokenize(text))


@F.arrow_udf(T.LongType())
def simhash_tokens(tokens: pa.Array) -> pa.Array:
    """SimHash per token list of an Arrow batch; no tokens give 0.

    A document is hashed where it is read: nothing is exploded or shuffled.  Batches
    are worked off in slices, so memory does not follow their length.
    """
    return pa.concat_arrays([_simhash_slice(part) for part in list_slices(tokens)])


def _simhash_slice(tokens: pa.Array) -> pa.Array:
    starts, words = flat_lists(tokens)
    counts = np.diff(starts)
    if len(words) == 0:
        return pa.array(np.zeros(len(counts), dtype=np.int64))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    units, begin, sizes = _code_units(coded.dictionary)
    blank = np.full(len(sizes), FNV_OFFSET, dtype=np.uint64)
    word_hashes = _fnv_continue(blank, units, begin, sizes)

    # A pair starts at every token that is not the last of its list.  Its hash
    # is the first word's hash continued over an underscore and the second word.
    last = np.zeros(len(words), dtype=bool)
    last[starts[1:][counts > 0] - 1] = True
    lead = np.flatnonzero(~last)
    second = codes[lead + 1]
    joined = (word_hashes[codes[lead]] ^ np.uint64(ord("_"))) * np.uint64(FNV_PRIME)
    pair_hashes = _fnv_continue(joined, units, begin[second], sizes[second])
    pair_starts = starts - np.concatenate(([0], np.cumsum(counts > 0)))
    return pa.array(
        _majority_bits(
            [(word_hashes[codes], starts), (pair_hashes, pair_starts)],
            features=counts + np.maximum(counts - 1, 0),
        )
    )


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list array; a null list counts as empty."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), pc.list_flatten(lists)


def list_slices(lists: pa.Array, most: int = SLICE_TOKENS, most_lists: int = SLICE_LISTS) -> list[pa.Array]:
    """Views of successive lists with at most ``most`` values in all; a longer list is alone."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    parts, start = [], 0
    while start < len(ends):
        held = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, held + most, side="right")))
        end = min(end, start + most_lists)
        parts.append(lists.slice(start, end - start))
        start = end
    return parts or [lists]


def _code_units(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-16 code units of all words, with the begin and size of each word."""
    encoded = [w.encode("utf-16-le") for w in words.to_pylist()]
    sizes = np.fromiter((len(e) // 2 for e in encoded), np.int64, len(encoded))
    units = np.frombuffer(b"".join(encoded), dtype="<u2").astype(np.uint64)
    return units, np.cumsum(sizes) - sizes, sizes


def _fnv_continue(
    state: np.ndarray, units: np.ndarray, begin: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """Feed one word into each running FNV-1a state, a character column at a time."""
    if len(state) == 0:
        return state
    # Longest first, so that those still being fed are always a prefix.
    order = np.argsort(-sizes, kind="stable")
    state, begin, ascending = state[order], begin[order], -sizes[order]
    for position in range(int(-ascending[0])):
        live = int(np.searchsorted(ascending, -position, side="left"))
        state[:live] = (state[:live] ^ units[begin[:live] + position]) * np.uint64(FNV_PRIME)
    result = np.empty_like(state)
    result[order] = state
    return result


def _majority_bits(parts: list, features: np.ndarray) -> np.ndarray:
    """Set each bit that more than half of a document's features have set."""
    two_lanes = np.uint64(0x0000000100000001)
    result = np.zeros(len(features), dtype=np.uint64)
    for bit in range(32):
        # Two 32-bit counters per sum: one for this bit, one for bit + 32.
        ones = np.zeros(len(features), dtype=np.uint64)
        for hashes, starts in parts:
            filled = starts[1:] > starts[:-1]
            if filled.any():
                lanes = (hashes >> np.uint64(bit)) & two_lanes
                ones[filled] += np.add.reduceat(lanes, starts[:-1][filled])
        low = (ones & np.uint64(0xFFFFFFFF)).astype(np.int64)
        high = (ones >> np.uint64(32)).astype(np.int64)
        result |= (2 * low > features).astype(np.uint64) << np.uint64(bit)
        result |= (2 * high > features).astype(np.uint64) << np.uint64(bit + 32)
    return result.view(np.int64)
