"""Counts of the language model stay with the tasks; tokens and code follow the plain rules."""

import heapq
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.llm import language
from storyloom.llm.language import Code, Mixer, huffman, odds_tables, spelled_bits, step_blocks, summed, token_blocks
from storyloom.llm.language import token_lists, words_of


def test_counts_reach_the_driver_as_odds_only(spark):
    words = [f"w{i}".encode() for i in range(300)]

    def bits(batches):
        for batch in batches:
            found, _, bits, _ = spelled_bits(batch.column("word").to_pylist())
            yield found, bits

    parts = [spark.createDataFrame([(w,) for w in some], "word binary") for some in (words, words[:100])]
    counts = [summed(bits, p.repartition(3)) for p in parts]
    assert all(isinstance(c, DataFrame) for c in counts)
    plain = np.zeros((language.PREDICTORS, 1 << language.SLOT_BITS, 2), np.int64)
    for some in (words, words[:100]):
        found, _, bit, _ = spelled_bits(some)
        for k, s in enumerate(found):
            np.add.at(plain[k], (s, bit), 1)
    odds, trust = odds_tables(counts[0].unionByName(counts[1]))
    whole = Mixer(plain)
    assert (odds == whole.odds).all() and (trust == whole.trust).all()


def test_arrow_tokens_are_the_plain_words():
    odd = ["", None, " ", " a", "a ", "A\x1cB\x1dc x\u0085y", "É É\x0b\x0cq\r\n\tZ", "\x00 a\x00b", "  \n ", " x  y "]
    texts = pa.array(odd)
    assert token_lists(texts).to_pylist() == [words_of(t) for t in odd]
    assert token_lists(texts.slice(3, 4)).to_pylist() == [words_of(t) for t in odd[3:7]]


def test_two_queues_make_the_tree_of_a_heap():
    draw = random.Random(3)
    for size in [1, 2, 3, *[draw.randint(2, 40) for _ in range(50)]]:
        weights = [draw.randint(1, 6) for _ in range(size)]
        heap, top = [(w, i) for i, w in enumerate(weights)], size
        heapq.heapify(heap)
        parent, side = [-1] * (2 * size), [0] * (2 * size)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = top
            side[j] = 1
            heapq.heappush(heap, (a + b, top))
            top += 1
        got = huffman(np.array(weights))
        assert got[0].tolist() == parent and got[1].tolist() == side


def test_pieces_cut_at_steps_are_the_same_bits():
    code = Code(pa.array([b"a", b"b", b"c", b""], pa.binary()), np.array([900, 400, 300, 50]), 7)
    symbols = np.random.default_rng(2).integers(0, 5, 70_000)
    first = np.zeros(len(symbols), np.int64)
    whole = [np.concatenate(x, axis=-1) for x in zip(*[(f, g, b) for _, f, g, b, _ in token_blocks(code, symbols, first)])]
    cut = list(step_blocks(code, symbols, first))
    assert all((np.concatenate(x, axis=-1) == y).all() for x, y in zip(zip(*cut), whole))
    # Only the last piece of 65,536 tokens, and of all, is not of whole steps.
    assert sum(len(b) % language.STEP_BITS > 0 for _, _, b in cut) <= 2
