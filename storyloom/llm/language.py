"""Language-model scores by logistic context mixing (op 7).

Frequent words are coded as paths of a Huffman tree, other words are spelled
after an escape.  Every bit is predicted from counts in several hashed contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import fold, table
from storyloom.tables import written

HELD_FOLDS = 7
HELD = 2
# Of the folds that are learned from, this one fits weights while the others fill the
# tables; then its counts are added.
MIX_FOLD = 6
MIX_ROUNDS = 3
# Words with a code of their own; a size of the model, as are the slots of a table.
CODED = 1 << 17
SLOT_BITS = 20
FREQUENT = 256
PREDICTORS = 4
# Bits this far from the root, and farther, share weights.
MOST_GATE = 15
CONFIDENCES = 8
# Log odds are held in steps of a 2,000th, up to 12 either way.
ODDS_STEPS, MOST_ODDS = 2_000.0, 24_000
BUCKETS = 48
RATE = 0.02
STEP_BITS = 2_048
# Bits and tokens worked on at a time: their arrays take some ten MB, and calls are few.
PIECE_BITS = 16 * STEP_BITS
PIECE_TOKENS = 16_384
LAYER_TOKENS = 65_536
PIECE_WORDS = 500
# Slots gathered before they are counted.
COUNTED_BITS = 1 << 20
COUNTED_WORDS = 300_000
BATCH_CHARS = 1_500_000
BLOCK = 8_192
# Bits whose probabilities, each above 3e-6, are multiplied in a double without underflow.
LONGEST_PRODUCT = 50
# What is left of a refined probability after as many bits in one step.
KEPT = 0.995 ** np.arange(STEP_BITS + 1)
SPREAD, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes know ASCII only, as the rule wants.  b'' is the end token."""
    return [*(text or "").encode().lower().split(), b""]


def token_lists(texts: pa.Array) -> pa.ListArray:
    """The same words for every text of a column, in Arrow."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = lists.flatten().cast(pa.binary())
    full = pc.binary_length(flat).to_numpy() > 0
    seen = np.concatenate(([0], np.cumsum(full)))
    ends = np.cumsum(np.diff(seen[lists.offsets.to_numpy()]) + 1)
    index = np.full(int(ends[-1]) if len(ends) else 0, len(flat))
    words = np.ones(len(index), bool)
    words[ends - 1] = False
    index[words] = np.flatnonzero(full)
    tokens = pa.concat_arrays([flat, pa.array([b""], pa.binary())]).take(pa.array(index))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), tokens)


def slots(context: np.ndarray, node: np.ndarray, which: int) -> np.ndarray:
    return hashed(spun(context, which), node.astype(np.uint64) * ODD)


def spun(context: np.ndarray, which: int) -> np.ndarray:
    """The share of a context in a hash, which is taken once for all nodes that it meets."""
    return (context.astype(np.uint64) * SPREAD + np.uint64(which)) * ODD


def hashed(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slots of spun contexts, one per node; ``node`` holds the nodes times ODD."""
    mixed = context + node
    mixed ^= mixed >> np.uint64(29)
    mixed *= SPREAD
    mixed >>= np.uint64(64 - SLOT_BITS)
    return mixed.view(np.int64)


class Code:
    """Huffman code of words; the last symbol is the escape."""

    def __init__(self, words: pa.Array, counts: np.ndarray, escapes: int):
        self.words = words
        self.counts = np.append(counts, 0).astype(np.int64)
        self.escape = len(words)
        symbols = len(words) + 1
        parent, side = huffman(np.append(counts, max(escapes, 1)).astype(np.int64))
        # All symbols climb together; the order of the bits does not matter.
        self.sizes = np.zeros(symbols, np.int64)
        for symbol, _ in self.climb(parent, symbols):
            self.sizes[symbol] += 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        # Node and bit of every step of all paths, side by side.
        self.paths = np.empty(int(self.sizes.sum()), np.int32)
        for step, (symbol, at) in enumerate(self.climb(parent, symbols)):
            self.paths[self.starts[symbol] + step] = 2 * (parent[at] - symbols) + side[at]

    @staticmethod
    def climb(parent: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per step the symbols that are not at the root yet, and where they are."""
        at = symbol = np.arange(symbols, dtype=np.int32)
        while True:
            live = parent[at] >= 0
            at, symbol = at[live], symbol[live]
            if not len(at):
                return
            yield symbol, at
            at = parent[at]

    def symbols(self, tokens: pa.Array) -> np.ndarray:
        found = pc.index_in(tokens, value_set=self.words)
        return found.fill_null(self.escape).to_numpy().astype(np.int64)

    def contexts(self, symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Per token: nothing, the word before, the two before, the last frequent word.

        ``first`` is where the token's document starts; nothing before it counts.
        """
        place = np.arange(len(symbols))
        shifted = [np.where(place - d >= first, symbols[np.maximum(place - d, 0)], self.escape + 1) for d in (1, 2)]
        common = np.where((symbols < FREQUENT) & (self.counts[symbols] > 0), place, -1)
        last = np.concatenate(([-1], np.maximum.accumulate(common)[:-1])) if len(place) else place
        topic = np.where(last >= first, symbols[last], self.escape + 1)
        return [np.zeros_like(symbols), shifted[0] + 1, (shifted[0] + 1) * 1_000_003 + shifted[1], topic + 1]

    @cached_property
    def plain_slots(self) -> np.ndarray:
        """Slots of all steps without a context, the first predictor's; built where bits are met."""
        found, size = np.empty(len(self.paths), np.int32), 1 << 16
        for at in range(0, len(found), size):
            node = (self.paths[at : at + size] >> 1).astype(np.uint64)
            found[at : at + size] = slots(np.zeros_like(node), node, 0)
        return found

    def bits_of(self, symbols: np.ndarray, contexts: list[np.ndarray]):
        """Slots per predictor, gate, bit and token of every bit."""
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        token = np.repeat(np.arange(len(symbols)), sizes)
        place = np.arange(len(token))
        step = np.repeat(self.starts[symbols] - (ends - sizes), sizes) + place
        path = self.paths.take(step)
        node = (path >> 1).astype(np.uint64) * ODD
        found = np.empty((PREDICTORS, len(token)), np.int64)
        found[0] = self.plain_slots.take(step)
        for k in range(1, PREDICTORS):
            found[k] = hashed(spun(contexts[k], k).take(token), node)
        gate = np.minimum(np.repeat(ends - 1, sizes) - place, MOST_GATE)
        return found, gate, (path & 1).astype(np.int8), token

    @cached_property
    def rank(self) -> np.ndarray:
        """Place of each symbol among all, those with the most bits first; built where bits are met."""
        rank = np.empty(len(self.sizes), np.int64)
        rank[np.argsort(-self.sizes, kind="stable")] = np.arange(len(rank))
        return rank

    @cached_property
    def layered(self) -> list[np.ndarray]:
        """The steps of all paths by their distance from the root: places in ``paths``, by rank."""
        last = np.empty(len(self.sizes), np.int32)
        last[self.rank] = self.starts + self.sizes - 1
        live = len(last) - np.cumsum(np.bincount(self.sizes))
        return [last[:n] - layer for layer, n in enumerate(live[:-1].tolist())]

    @cached_property
    def layered_paths(self) -> list[np.ndarray]:
        return [self.paths.take(steps) for steps in self.layered]

    def layers(self, ranks: np.ndarray, contexts: list[np.ndarray]):
        """Bits of tokens by their distance from the root, the farthest first: (layer, ranks, path, slots).

        Tokens come sorted by the rank of their symbols: those that reach a layer are the
        first, and equal paths lie together.  ``slots`` gives those of each predictor with a
        context.  All arrays but ``ranks`` are overwritten by what comes next.
        """
        spins = [spun(contexts[k], k) for k in range(1, PREDICTORS)]
        paths, nodes, mixed, spare = (np.empty(len(ranks), t) for t in (np.int32, np.uint64, np.uint64, np.uint64))

        def slots_of(node: np.ndarray) -> Iterator[np.ndarray]:
            some, rest = mixed[: len(node)], spare[: len(node)]
            for spin in spins:
                np.add(spin[: len(node)], node, out=some)
                np.right_shift(some, np.uint64(29), out=rest)
                some ^= rest
                some *= SPREAD
                some >>= np.uint64(64 - SLOT_BITS)
                yield some.view(np.int64)

        for layer in range(len(self.layered) - 1, -1, -1):
            live = int(np.searchsorted(ranks, len(self.layered[layer])))
            if live:
                path, node = paths[:live], nodes[:live]
                self.layered_paths[layer].take(ranks[:live], out=path, mode="clip")
                np.right_shift(path, 1, out=node, casting="unsafe")
                node *= ODD
                yield layer, ranks[:live], path, slots_of(node)


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: root) and side of every node of the tree; nodes follow the symbols.

    The two lightest nodes are joined, of equal ones those with the smallest number.
    Joined nodes come in order of weight, so two queues are enough.
    """
    symbols = len(weights)
    parent, side = np.full(2 * symbols, -1, np.int32), np.zeros(2 * symbols, np.int8)
    order = np.argsort(weights, kind="stable")
    leaves, joined = weights[order].tolist(), []
    leaf = inner = 0
    for top in range(symbols, 2 * symbols - 1):
        weight = 0
        for branch in (0, 1):
            if inner == len(joined) or leaf < symbols and leaves[leaf] <= joined[inner]:
                node, weight = order[leaf], weight + leaves[leaf]
                leaf += 1
            else:
                node, weight = symbols + inner, weight + joined[inner]
                inner += 1
            parent[node], side[node] = top, branch
        joined.append(weight)
    return parent, side


def spelled_bits(words: list[bytes]):
    """The same for words spelled byte by byte, each with a space as its end."""
    line = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 1 for w in words])
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(line))
    before = [np.where(place - d >= first, line[np.maximum(place - d, 0)] + 1, 0) for d in (1, 2, 3, 4)]
    context = np.zeros_like(line)
    steps = np.arange(8)
    node = ((1 << steps) | (line[:, None] >> (8 - steps))).ravel().astype(np.uint64) * ODD
    found = np.empty((PREDICTORS, len(node)), np.int64)
    for k, b in enumerate(before):
        context = context * 257 + b
        found[k] = hashed(np.repeat(spun(context, 16 + k), 8), node)
    bits = (line[:, None] >> (7 - steps) & 1).astype(np.int8)
    gate = np.tile(steps, len(line)) + 8 * (np.repeat(place - first, 8) > 0)
    return found, gate, bits.ravel(), np.repeat(np.arange(len(words)), lengths * 8)


def confidence(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and trust of counts (slot, bit)."""
    odds = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4))
    trust = np.minimum(np.ceil(np.log2(counts.sum(axis=1) + 1)), CONFIDENCES - 1)
    return np.round(np.clip(odds, -12, 12) * ODDS_STEPS).astype(np.int16), trust.astype(np.uint8)


class Mixer:
    """Tables of counts as log odds, gated weights, and a refinement of the result."""

    def __init__(self, counts: np.ndarray, more: np.ndarray | None = None):
        """``counts`` per predictor, slot and bit, plus ``more`` of them; wide one predictor at a time."""
        odds, trust = np.empty(counts.shape[:2], np.int16), np.empty(counts.shape[:2], np.uint8)
        for k in range(len(counts)):
            own = counts[k].astype(np.int64)
            if more is not None:
                own += more[k]
            odds[k], trust[k] = confidence(own)
        self.take(odds, trust)

    @classmethod
    def of_tables(cls, odds: np.ndarray, trust: np.ndarray) -> Mixer:
        """A mixer over tables (predictor, slot) that were made elsewhere."""
        mixer = cls.__new__(cls)
        mixer.take(odds, trust)
        return mixer

    def take(self, odds: np.ndarray, trust: np.ndarray) -> None:
        self.odds, self.trust = odds, trust
        self.weights = np.full((16, PREDICTORS, CONFIDENCES), 0.3, np.float64)
        self.weights[:, :, 0] = 0.0
        self.refined = np.tile(sigmoid(self.centres()), (16, 1))

    @cached_property
    def packed(self) -> np.ndarray:
        """Log odds and place among weights, so that a bit looks a slot up once; built where bits are met."""
        place = np.arange(len(self.odds))[:, None] * CONFIDENCES + self.trust
        return self.odds * np.int32(PREDICTORS * CONFIDENCES) + place.astype(np.int32)

    @cached_property
    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of log odds and trust that occur, as one number each, and the pair of every slot.

        Few counts give few pairs and many counts one trust, so two bytes a slot are
        enough, and slots that are met stay in the caches.
        """
        span = 2 * MOST_ODDS + 1
        met = np.zeros(CONFIDENCES * span, bool)
        for odds, trust in zip(self.odds, self.trust):
            met[trust * np.int32(span) + odds + MOST_ODDS] = True
        pairs = np.flatnonzero(met)
        place = (np.cumsum(met) - 1).astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
        of_slot = np.empty(self.odds.shape, place.dtype)
        for found, odds, trust in zip(of_slot, self.odds, self.trust):
            found[:] = place[trust * np.int32(span) + odds + MOST_ODDS]
        return pairs, of_slot

    def shares(self) -> np.ndarray:
        """What a pair of log odds and trust adds to the odds of a bit, per gate and predictor."""
        trust, odds = np.divmod(self.kinds[0], 2 * MOST_ODDS + 1)
        return np.ascontiguousarray((self.weights / ODDS_STEPS)[:, :, trust] * (odds - MOST_ODDS))

    def start_from(self, flat: np.ndarray) -> None:
        """Take weights and refinement from one array."""
        weights, refined = flat[: self.weights.size], flat[self.weights.size :]
        self.weights = weights.reshape(self.weights.shape).copy()
        self.refined = refined.reshape(self.refined.shape).copy()

    def with_tables(self, odds: np.ndarray, trust: np.ndarray) -> Mixer:
        """The same weights and refinement over other tables."""
        mixer = Mixer.of_tables(odds, trust)
        mixer.weights, mixer.refined = self.weights, self.refined
        return mixer

    @staticmethod
    def centres() -> np.ndarray:
        return (np.arange(BUCKETS) + 0.5) * 24.0 / BUCKETS - 12.0

    @cached_property
    def of_kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and trust of each pair."""
        trust, odds = np.divmod(self.kinds[0], 2 * MOST_ODDS + 1)
        return (odds - MOST_ODDS) / ODDS_STEPS, trust

    def inputs(self, found: np.ndarray, gate: np.ndarray):
        kinds = np.empty((len(found), len(gate)), self.kinds[1].dtype)
        for table, s, kind in zip(self.kinds[1], found, kinds):
            table.take(s, out=kind, mode="clip")
        kinds = kinds.astype(np.int64)
        odds, trust = self.of_kinds
        weight = trust.take(kinds)
        weight += np.arange(PREDICTORS)[:, None] * CONFIDENCES
        weight += gate * (PREDICTORS * CONFIDENCES)
        return odds.take(kinds), weight

    def mix(self, odds: np.ndarray, weight: np.ndarray, gate: np.ndarray):
        """Probability of a one by the weights, and its cell of the refinement."""
        z = self.weights.ravel().take(weight)
        z *= odds
        z = z.sum(axis=0)
        np.maximum(z, -11.99, out=z)
        np.minimum(z, 11.99, out=z)
        cell = ((z + 12.0) * (BUCKETS / 24.0)).astype(np.int64)
        cell += gate * BUCKETS
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1.0
        return np.divide(1.0, z, out=z), cell

    def cost(self, found: np.ndarray, gate: np.ndarray, bits: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability given to each bit, or to each run of them.

        Runs begin at ``starts``, none is empty.
        """
        if not len(bits):
            return np.zeros(0)
        own = PREDICTORS * CONFIDENCES
        weights, gates = self.weights.ravel() / ODDS_STEPS, (gate * own).astype(np.int32)
        z = np.zeros(len(gate))
        for table, s in zip(self.packed, found):
            seen = table.take(s, mode="clip")
            part = weights.take((seen & (own - 1)) + gates)
            seen >>= own.bit_length() - 1
            part *= seen
            z += part
        p = self.chances(z, self.refined.ravel(), bits, gate * BUCKETS, np.empty_like(z), np.empty(len(z), np.int64))
        if starts is None:
            return np.log10(p, out=p)
        if np.diff(starts, append=len(p)).max() > LONGEST_PRODUCT:
            return np.add.reduceat(np.log10(p), starts)
        return np.log10(np.multiply.reduceat(p, starts))

    def word_costs(self, code: Code, shares: np.ndarray, plain: list[np.ndarray], symbols: np.ndarray, contexts: list):
        """log10 of the probability given to each token: as ``cost``, layer by layer.

        ``shares`` are this mixer's, ``plain`` the odds of its first predictor.
        """
        ranks = code.rank[symbols]
        order = np.argsort(ranks)
        long = len(plain) > LONGEST_PRODUCT
        whole = np.zeros(len(symbols)) if long else np.ones(len(symbols))
        odds, part, spare = (np.empty(len(symbols)) for _ in range(3))
        kinds = np.empty(len(symbols), self.kinds[1].dtype)
        for layer, some, path, slots in code.layers(ranks[order], [c[order] for c in contexts]):
            z, more, kind, gate = odds[: len(some)], part[: len(some)], kinds[: len(some)], min(layer, MOST_GATE)
            place = spare[: len(some)].view(np.int64)
            plain[layer].take(some, out=z, mode="clip")
            for table, own, found in zip(self.kinds[1][1:], shares[gate, 1:], slots):
                table.take(found, out=kind, mode="clip")
                place[:] = kind
                own.take(place, out=more, mode="clip")
                z += more
            path &= 1
            p = self.chances(z, self.refined[gate], path, None, more, place)
            if long:
                whole[: len(p)] += np.log10(p)
            else:
                whole[: len(p)] *= p
        costs = np.empty(len(symbols))
        costs[order] = whole if long else np.log10(whole)
        return costs

    def plain_odds(self, code: Code, shares: np.ndarray) -> list[np.ndarray]:
        """What the first predictor, which knows no context, adds to the odds: per layer, by rank."""
        kind = self.kinds[1][0].take(code.plain_slots)
        return [shares[min(layer, MOST_GATE), 0].take(kind.take(steps)) for layer, steps in enumerate(code.layered)]

    @staticmethod
    def chances(z: np.ndarray, refined: np.ndarray, bits: np.ndarray, first: np.ndarray | None, part: np.ndarray, cell: np.ndarray):
        """Probability given to each bit, in place of its odds ``z``; the last two are room to work in.

        ``first`` is where the refinement of a bit's gate starts in ``refined``.
        """
        np.maximum(z, -11.99, out=z)
        np.minimum(z, 11.99, out=z)
        np.add(z, 12.0, out=part)
        part *= BUCKETS / 24.0
        np.copyto(cell, part, casting="unsafe")
        if first is not None:
            cell += first
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1.0
        np.divide(1.0, z, out=z)
        refined.take(cell, out=part, mode="clip")
        z += part
        z *= 0.5
        # 1 - p where the bit is 0.
        z -= bits == 0
        return np.abs(z, out=z)

    def learn(self, found: np.ndarray, gate: np.ndarray, bits: np.ndarray) -> None:
        """Online: predict some bits, then move weights down the coding cost and refine."""
        weights, refined = self.weights.ravel(), self.refined.ravel()
        for at in range(0, len(bits), STEP_BITS):
            part = slice(at, at + STEP_BITS)
            odds, weight = self.inputs(found[:, part], gate[part])
            p, cell = self.mix(odds, weight, gate[part])
            real = bits[part].astype(float)
            np.subtract(real, p, out=p)
            odds *= p
            weight = weight.ravel()
            slope = np.bincount(weight, odds.ravel(), len(weights))
            uses = np.maximum(np.bincount(weight, minlength=len(weights)), 1.0)
            slope *= RATE
            slope /= np.sqrt(uses, out=uses)
            weights += slope
            ones = np.bincount(cell, real, len(refined))
            uses = np.bincount(cell, minlength=len(refined))
            share = 1.0 - KEPT.take(uses)
            ones /= np.maximum(uses, 1)
            ones -= refined
            ones *= share
            refined += ones
            np.maximum(refined, 1e-6, out=refined)
            np.minimum(refined, 1 - 1e-6, out=refined)

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Slices of a stream of batches that are not long, with the tokens of their texts."""
    for batch in batches:
        texts, start = batch.column("text"), 0
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars < BATCH_CHARS):
                chars += int(sizes[end])
                end += 1
            yield batch.slice(start, end - start), token_lists(texts.slice(start, end - start))
            start = end


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: how often each token occurs, counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = pa.array([], pa.binary()), np.empty(0, np.int64)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held, pa.array(times)], names=["word", "n"])

        for _, lists in text_batches(batches):
            words, more = pc.value_counts(lists.values).flatten()
            # Encoding keeps words in order of their first occurrence; sums in doubles are exact here.
            met = pa.concat_arrays([held, words]).dictionary_encode()
            held, times = met.dictionary, np.concatenate([times, more.to_numpy()])
            times = np.bincount(met.indices.to_numpy(), times, len(held)).astype(np.int64)
            if len(held) > COUNTED_WORDS:
                yield flush()
                held, times = pa.array([], pa.binary()), np.empty(0, np.int64)
        yield flush()

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def flat_symbols(code: Code, lists: pa.ListArray | list[list[bytes]]):
    """Symbols of all tokens, where each one's document starts, and tokens per document."""
    if not isinstance(lists, pa.ListArray):
        lists = pa.array(lists, pa.list_(pa.binary()))
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return code.symbols(lists.values), np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


COUNTS = "block int, counts binary"


def summed(streams, frame: DataFrame) -> DataFrame:
    """Counts per predictor, slot and bit over all of ``frame``, as a written table of blocks.

    ``streams`` makes slots and bits out of batches.  A task adds up tables of its
    own and sends the blocks that are not all zero; blocks meet by number.
    """
    names = ["block", "counts"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((PREDICTORS, 2 << SLOT_BITS), np.int64)
        gathered, full, first = np.empty((PREDICTORS, COUNTED_BITS), np.int32), 0, 0

        def count() -> None:
            for own, met in zip(tables[first:], gathered[first:]):
                own += np.bincount(met[:full], minlength=len(own))

        for found, bits, *times in streams(batches):
            if times:
                for own, met in zip(tables, found):
                    # Sums in doubles are exact here.
                    own += np.bincount(met * 2 + bits, times[0], len(own)).astype(np.int64)
                continue
            first = PREDICTORS - len(found)
            for at in range(0, len(bits), COUNTED_BITS):
                part = slice(at, at + COUNTED_BITS)
                size = len(bits[part])
                if full + size > COUNTED_BITS:
                    count()
                    full = 0
                some = gathered[first:, full : full + size]
                np.multiply(found[:, part], 2, out=some, casting="unsafe")
                some += bits[part]
                full += size
        count()
        del gathered
        blocks = tables.reshape(-1, BLOCK)
        for start in range(0, len(blocks), 64):
            some = [start + i for i in np.flatnonzero(blocks[start : start + 64].any(axis=1)).tolist()]
            counts = pa.array([blocks[i].astype(np.int32).tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), counts], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = block_sums(batches)
        if sums:
            counts = pa.array([np.minimum(v, 1 << 30).astype(np.int32).tobytes() for v in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), counts], names=names)

    return written(frame.mapInArrow(local, COUNTS).repartition("block").mapInArrow(merge, COUNTS), "lm-counts")


def block_sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, np.int32)
            sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
    return sums


def odds_tables(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and trust (predictor, slot) of blocks of counts, of which a number may come twice.

    The tasks add the counts up; the driver gets three bytes a slot, whatever the input.
    """
    names = ["block", "odds", "trust"]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in block_sums(batches).items():
            odds, trust = (pa.array([x.tobytes()], pa.binary()) for x in confidence(own.reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), odds, trust], names=names)

    odds = np.zeros(((PREDICTORS << (SLOT_BITS + 1)) // BLOCK, BLOCK // 2), np.int16)
    trust = np.zeros(odds.shape, np.uint8)
    made = counts.repartition("block").mapInArrow(tables, "block int, odds binary, trust binary")
    for batch in made.toArrow().to_batches():
        for block, some, sure in zip(*batch.columns):
            odds[block.as_py()] = np.frombuffer(some.as_buffer(), np.int16)
            trust[block.as_py()] = np.frombuffer(sure.as_buffer(), np.uint8)
    return odds.reshape(PREDICTORS, -1), trust.reshape(PREDICTORS, -1)


def fit(shared, frame: DataFrame, learn, rounds: int = MIX_ROUNDS) -> None:
    """Fit the weights and the refinement of the broadcast mixer to all rows of ``frame``.

    Per round every partition goes through its rows online, from where the last
    round ended; the results are averaged by the number of rows.
    """
    mixer = shared.value
    for _ in range(rounds):
        start = np.concatenate([mixer.weights.ravel(), mixer.refined.ravel()])

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own = shared.value
            own.start_from(start)
            rows = learn(own, batches)
            ends = np.concatenate([own.weights.ravel(), own.refined.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([ends.tolist()])], names=["rows", "ends"])

        each = frame.mapInArrow(local, "rows bigint, ends array<double>").filter("rows > 0")
        each = each.select("rows", F.posexplode("ends").alias("place", "end"))
        mean = F.sum(F.col("end") * F.col("rows")) / F.sum("rows")
        for r in each.groupBy("place").agg(mean.alias("end")).collect():
            start[r["place"]] = r["end"]
        mixer.start_from(start)


def token_blocks(code: Code, symbols: np.ndarray, first: np.ndarray, tokens: int = PIECE_TOKENS):
    """Bits of a run of tokens, some tokens at a time: (from, found, gate, bits, token)."""
    contexts = code.contexts(symbols, first)
    for at in range(0, len(symbols), tokens):
        part = slice(at, at + tokens)
        yield at, *code.bits_of(symbols[part], [c[part] for c in contexts])


def layer_bits(code: Code, symbols: np.ndarray, first: np.ndarray):
    """Slots, of the predictors with a context, and bits of a run of tokens, layer by layer."""
    contexts = code.contexts(symbols, first)
    for at in range(0, len(symbols), LAYER_TOKENS):
        ranks = code.rank[symbols[at : at + LAYER_TOKENS]]
        order = np.argsort(ranks)
        own = [c[at : at + LAYER_TOKENS][order] for c in contexts]
        for _, some, path, slots in code.layers(ranks[order], own):
            found = np.empty((PREDICTORS - 1, len(some)), np.int32)
            for row, met in zip(found, slots):
                row[:] = met
            yield found, path & 1


def word_costs(code: Code, mixer: Mixer, shares: np.ndarray, plain: list, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the probability given to each of a run of tokens, some tokens at a time."""
    contexts, costs = code.contexts(symbols, first), np.empty(len(symbols))
    for at in range(0, len(symbols), LAYER_TOKENS):
        part = slice(at, at + LAYER_TOKENS)
        costs[part] = mixer.word_costs(code, shares, plain, symbols[part], [c[part] for c in contexts])
    return costs


def step_blocks(code: Code, symbols: np.ndarray, first: np.ndarray, tokens: int = 1 << 16):
    """The same bits, cut at whole steps of what is learned: (found, gate, bits).

    Steps begin anew every ``tokens`` tokens.
    """
    contexts = code.contexts(symbols, first)
    for at in range(0, len(symbols), tokens):
        ends = np.cumsum(code.sizes[symbols[at : at + tokens]])
        for low in range(0, int(ends[-1]), PIECE_BITS):
            high = min(low + PIECE_BITS, int(ends[-1]))
            begin, end = np.searchsorted(ends, [low, high - 1], side="right").tolist()
            part = slice(at + begin, at + end + 1)
            found, gate, bits, _ = code.bits_of(symbols[part], [c[part] for c in contexts])
            skip = low - (int(ends[begin - 1]) if begin else 0)
            own = slice(skip, skip + high - low)
            yield found[:, own], gate[own], bits[own]


class Model:
    """Everything that scoring needs, of a size set by parameters."""

    def __init__(self, spark: SparkSession, docs: DataFrame, vocab: DataFrame):
        """``docs`` (text, part) are those to learn from; part is their fold."""
        self.total, self.distinct, once = vocab.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)
        ).first()
        # The least count whose words all have room among the coded ones.
        kinds = sorted(vocab.groupBy("n").count().collect(), key=lambda r: -r["n"])
        room, self.least = CODED, 1 << 62
        for r in kinds:
            room -= r["count"]
            if room < 0:
                break
            self.least = r["n"]
        coded = vocab.filter(F.col("n") >= self.least).select("word", "n").toArrow()
        coded = coded.take(pc.sort_indices(coded, sort_keys=[("n", "descending"), ("word", "ascending")])).combine_chunks()
        counts = coded.column("n").to_numpy()
        self.escapes = self.total - int(counts.sum())
        words = pa.concat_arrays([pa.array([], pa.binary()), *coded.column("word").chunks])
        self.code = Code(words, counts, self.escapes + once)
        # The driver keeps nothing that it is done with.
        del coded, counts, words, kinds
        # Good and Turing: words seen once stand for words not seen.
        self.seen = min(self.escapes / max(self.escapes + once, 1), 0.999)
        code = spark.sparkContext.broadcast(self.code)

        def word_bits(batches):
            own, met = code.value, np.zeros(len(code.value.sizes))
            for _, lists in text_batches(batches):
                symbols, first, _ = flat_symbols(own, lists)
                met += np.bincount(symbols, minlength=len(met))
                yield from layer_bits(own, symbols, first)
            # Without a context every occurrence of a word counts the same bits.
            for at in range(0, len(own.paths), COUNTED_BITS):
                part = slice(at, at + COUNTED_BITS)
                yield own.plain_slots[None, part], own.paths[part] & 1, np.repeat(met, own.sizes)[part]

        def tail_bits(batches):
            for batch in batches:
                words = batch.column("word").to_pylist()
                for at in range(0, len(words), PIECE_WORDS):
                    found, _, bits, _ = spelled_bits(words[at : at + PIECE_WORDS])
                    yield found, bits

        # Every different word teaches spelling, so that small inputs do as well.
        tail = vocab.filter(F.length("word") > 0).select("word")
        kept = F.pmod(F.crc32("word"), F.lit(8)) == 0
        tables = summed(word_bits, docs.filter(F.col("part") != MIX_FOLD).select("text"))
        spelled = summed(tail_bits, tail.filter(~kept))
        words, letters = (spark.sparkContext.broadcast(Mixer.of_tables(*odds_tables(t))) for t in (tables, spelled))

        def fit_words(mixer, batches):
            rows = 0
            for _, lists in text_batches(batches):
                rows += len(lists)
                symbols, first, _ = flat_symbols(code.value, lists)
                for found, gate, bits in step_blocks(code.value, symbols, first):
                    mixer.learn(found, gate, bits)
            return rows

        def fit_letters(mixer, batches):
            rows = 0
            for batch in batches:
                spelling = batch.column("word").to_pylist()
                rows += len(spelling)
                for at in range(0, len(spelling), 1_000):
                    found, gate, bits, _ = spelled_bits(spelling[at : at + 1_000])
                    mixer.learn(found, gate, bits)
            return rows

        sample = written(docs.filter(F.col("part") == MIX_FOLD).select("text"), "lm-mix")
        spellings = tail.filter(kept)
        fit(words, sample, fit_words)
        fit(letters, spellings, fit_letters)
        # With the weights known, the rows that fitted them teach contexts as well.
        self.words = words.value.with_tables(*odds_tables(tables.unionByName(summed(word_bits, sample))))
        self.letters = letters.value.with_tables(*odds_tables(spelled.unionByName(summed(tail_bits, spellings))))
        for done in (code, words, letters):
            done.destroy()

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word by its letters."""
        costs = []
        for at in range(0, len(words), PIECE_WORDS):
            part = words[at : at + PIECE_WORDS]
            found, gate, bits, word = spelled_bits(part)
            letters = self.letters.cost(found, gate, bits, np.arange(0, len(bits), 8))
            costs.append(np.bincount(word[::8], letters, len(part)))
        return np.concatenate(costs) if costs else np.empty(0)


def escaped(lists: pa.ListArray, document: np.ndarray, marked: np.ndarray) -> pa.ListArray:
    """Per document its words at the marked tokens, counted."""
    places = np.flatnonzero(marked)
    words = lists.values.take(pa.array(places)).dictionary_encode()
    kinds = max(len(words.dictionary), 1)
    pairs, times = np.unique(document[places] * kinds + words.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(lists) + 1) * kinds)
    fields = [words.dictionary.take(pa.array(pairs % kinds)), pa.array(times.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "times"]))


SCORED = (
    "doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
    "rare array<struct<word:binary,times:int>>"
)


def spelled_words(model: Model, shared, vocab: DataFrame, scored: DataFrame) -> DataFrame:
    """word, n, spelled: the count and the cost of the letters of every word without a code.

    A word is spelled once, however many documents and tasks have it.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = pa.array(shared.value.spell(batch.column("word").to_pylist()), pa.float32())
            yield pa.RecordBatch.from_arrays([*batch.columns, costs], names=["word", "n", "spelled"])

    # Rows that were learned from have no other words than those counted.
    met = scored.filter("held_out").select(F.explode("rare.word").alias("word")).distinct()
    new = met.join(vocab, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"))
    words = vocab.filter(F.col("n") < model.least).select("word", "n").unionByName(new)
    return written(words.mapInArrow(spell, "word binary, n bigint, spelled float"), "lm-spelled")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text counts as empty: it is its end token.  Rows with a null id are
    learned from.  With nothing to learn from, only the end and the letters of
    untrained tables are left.

    Words are counted in full: frequent ones come to every task with their code,
    the others meet their counts in a join.  Such a word costs its escape and then
    a mixture of its share among escaped words and its spelling.
    """
    part = fold(F.col("doc_id"), HELD_FOLDS).alias("part")
    parted = docs.select("doc_id", "text", part)
    known = parted.filter(F.col("part") != HELD)
    vocab = written(vocabulary(known), "lm-vocabulary")
    model = Model(docs.sparkSession, known.select("text", "part"), vocab)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base_of = np.log10((m.code.counts + 1.0) / (m.total + m.distinct + 1.0))
        shares = m.words.shares()
        plain = m.words.plain_odds(m.code, shares)
        for batch, lists in text_batches(batches):
            symbols, first, sizes = flat_symbols(m.code, lists)
            document = np.repeat(np.arange(len(lists)), sizes)
            cost = word_costs(m.code, m.words, shares, plain, symbols, first)
            coded = symbols != m.code.escape
            base = np.bincount(document, np.where(coded, base_of[symbols], 0.0), len(lists))
            known_words = np.bincount(document, coded, len(lists))
            columns = [
                batch.column("doc_id"),
                pa.array(batch.column("part").to_numpy(zero_copy_only=False) == HELD),
                pa.array(sizes),
                pa.array(known_words.astype(np.int64)),
                pa.array(base),
                pa.array(np.bincount(document, cost, len(lists))),
                escaped(lists, document, symbols == m.code.escape),
            ]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = parted.mapInArrow(score, SCORED.format(kind=kind))
    # The number of a row holds because the table is written before it is used.
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("one")).select("row", "one.*")
    n = F.col("n")
    share = model.seen * n / max(model.escapes, 1) + (1.0 - model.seen) * F.pow(F.lit(10.0), "spelled")
    plain = F.log10(F.lit(1.0 - model.seen)) + F.col("spelled")
    costs = rare.join(spelled_words(model, shared, vocab, scored), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((n + 1) / (model.total + model.distinct + 1.0))).alias("rare_base"),
        # A long word's own probability may be too small for a double; its logarithm is not.
        F.sum(F.col("times") * F.when(n > 0, F.log10(share)).otherwise(plain)).alias("rare_score"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    none = F.lit(0.0)
    return scored.drop("rare").join(costs, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", none)).alias("score"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and base score of every whole text of ``documents``."""
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
