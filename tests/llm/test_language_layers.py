"""Bits taken layer by layer cost and count what they do token by token; words are spelled once."""

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import language
from storyloom.llm.language import Code, Mixer, escaped, layer_bits, scores, token_blocks, word_costs


def some_code():
    rng = np.random.default_rng(5)
    words = pa.array([f"w{i}".encode() for i in range(400)], pa.binary())
    code = Code(words, np.sort(rng.integers(1, 5_000, 400))[::-1], 9)
    symbols = rng.integers(0, 401, 5_000)
    return code, symbols, np.zeros(len(symbols), np.int64)


@pytest.mark.parametrize("longest", [50, 3])
def test_layers_cost_what_tokens_do(monkeypatch, longest):
    monkeypatch.setattr(language, "LONGEST_PRODUCT", longest)
    monkeypatch.setattr(language, "LAYER_TOKENS", 700)
    code, symbols, first = some_code()
    mixer = Mixer(np.random.default_rng(6).integers(0, 90, (4, 1 << 20, 2)))
    blocks = list(token_blocks(code, symbols, first))
    for _, found, gate, bits, _ in blocks:
        mixer.learn(found, gate, bits)
    plain = np.concatenate([mixer.cost(f, g, b, np.flatnonzero(np.diff(t, prepend=-1))) for _, f, g, b, t in blocks])
    shares = mixer.shares()
    got = word_costs(code, mixer, shares, mixer.plain_odds(code, shares), symbols, first)
    assert got == pytest.approx(plain, rel=1e-9)


def test_layers_hold_the_same_bits(monkeypatch):
    monkeypatch.setattr(language, "LAYER_TOKENS", 700)
    code, symbols, first = some_code()
    plain = [(f[1:], b) for _, f, _, b, _ in token_blocks(code, symbols, first)]
    both = [
        sorted(zip(*np.concatenate([f for f, _ in some], axis=1).tolist(), np.concatenate([b for _, b in some]).tolist()))
        for some in (plain, list(layer_bits(code, symbols, first)))
    ]
    assert both[0] == both[1]


def test_escaped_words_are_counted_by_document():
    lists = pa.array([[b"a", b"b", b"a", b""], [b""], [b"b", b"c", b"b", b""]], pa.list_(pa.binary()))
    document, marked = np.repeat(np.arange(3), [4, 1, 4]), np.array([1, 1, 1, 0, 0, 1, 0, 1, 0], bool)
    got = [{r["word"]: r["times"] for r in rows} for rows in escaped(lists, document, marked).to_pylist()]
    assert got == [{b"a": 2, b"b": 1}, {}, {b"b": 2}]
    assert escaped(lists, document, np.zeros(9, bool)).to_pylist() == [[], [], []]


def test_a_word_without_a_code_is_spelled_once(spark, monkeypatch):
    monkeypatch.setattr(language, "CODED", 2)
    tables, write = {}, language.written

    def written(df, name):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(language, "written", written)
    docs = spark.createDataFrame([(i, f"same rare words {i % 9}") for i in range(60)], "doc_id long, text string")
    assert scores(docs.repartition(4)).count() == 60
    words = [bytes(r["word"]) for r in tables["lm-spelled"].collect()]
    assert len(words) == len(set(words)) and set(words) >= {str(i).encode() for i in range(9)}
