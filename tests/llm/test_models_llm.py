"""Toxicity, quality, language model, neighbours, mixing, BPE and the pipeline."""

import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import language
from storyloom.llm.bpe import SHORT_WORD, Bpe, Codec, default_vocabulary, encode_documents
from storyloom.llm.language import HELD, HELD_FOLDS, Code, Mixer, scores, spelled_bits, words_of
from storyloom.llm.mixing import mix, mixed_documents, source_targets, units
from storyloom.llm.neighbours import nearest
from storyloom.llm.quality import isotonic, quality
from storyloom.llm.registry import ORACLES, QUERIES
from storyloom.llm.toxicity import fit_chain, sigmoid, toxicity, without_toxic
from tests.llm.samples import TEXTS, documents, labels

tokenizers = pytest.importorskip("tokenizers")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    with open(default_vocabulary(), encoding="utf-8") as file:
        return Codec(json.load(file))


ODD = [
    "a<|endoftext|>b", "<|ENDOFTEXT|>x <|startoftext|> ", "ΣΑΣ Σ", "don't I'll we've'S x's 'tis", "²³½ Ⅷ 123 ४५",
    "\x1c!\x1c!\x1da", "İstanbul", "é　x y", "👩‍👩‍👧 ok", "$" * 700, "ab" * 400, "é" * 300, "\x00\x85﻿",
    "日本語テスト 中文字符", "　<|endoftext|>", "Á é", "tab\tnew\nline\r\n",
]


def test_bpe_equals_the_library(spark, codec):
    library = tokenizers.Tokenizer.from_file(default_vocabulary())
    texts = [t or "" for _, t in TEXTS] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode_documents(docs).collect():
        wanted = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == wanted, texts[r.doc_id][:40]
        assert r.decoded == library.decode(wanted, skip_special_tokens=False)


def test_long_words_merge_as_short_ones_do(codec):
    rng = np.random.default_rng(2)
    for _ in range(200):
        word = "".join(rng.choice(list("abcdeéthin"), rng.integers(1, 40)))
        parts = [codec.letters[b] for b in word.encode()]
        parts[-1] += codec.end
        long = tuple(codec.ids[p] for p in codec.merge_long(parts))
        assert len(word.encode()) <= SHORT_WORD and codec.merge_all({word})[word] == long


def test_bpe_of_null_lists_and_no_rows(spark):
    bpe = Bpe(spark, default_vocabulary())
    one = spark.sql("SELECT CAST(NULL AS array<int>) AS ids").select(bpe.decode(F.col("ids")).alias("d")).first()
    assert one.d == ""
    assert encode_documents(documents(spark).limit(0)).count() == 0


def check_mix(rows, sources):
    """Targets by hand, then every source near its own and no row above twice its size."""
    total, passes = sum(r["size"] for r in rows), 2
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    targets, open_, left = {}, set(names), 1.5 * total
    while open_:
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= passes * sources[s]]
        if not full:
            targets |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in full:
            targets[s] = float(passes * sources[s])
        left -= sum(targets[s] for s in full)
        open_ -= set(full)
    return targets


def test_mix_meets_its_targets_and_reruns_agree(spark):
    texts = [(i, "w " * (i % 17)) for i in range(400)]
    docs = documents(spark, texts)
    rows = units(docs)
    targets = source_targets(rows)
    sizes = {(None if r.no_source else r.source_name): r.source_size for r in targets.collect()}
    wanted = check_mix([r.asDict() for r in rows.collect()], sizes)
    for r in targets.collect():
        assert math.isclose(r.target, wanted[None if r.no_source else r.source_name], rel_tol=1e-9)
    entries = mix(rows, targets, bucket_rows=50).orderBy("position", "finish", "pass", "id").collect()
    taken, by_row = Counter(), Counter()
    for r in entries:
        taken[None if r.no_source else r.source_name] += r.words
        by_row[int(r.id)] += r.words
        assert r.words <= r.size
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= 1
    assert all(by_row[i] <= 2 * (i % 17) for i, _ in texts)
    at = 0
    for r in entries:
        assert r.position == at
        at += r.words
    again = mix(rows, targets, bucket_rows=7).select("id", "pass", "words", "position").collect()
    assert sum(r.words for r in again) == at
    assert {(r.id, r["pass"], r.words) for r in again} == {(r.id, r["pass"], r.words) for r in entries}


def test_mixed_documents_of_awkward_rows(spark):
    docs = documents(spark)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.schema["text"] == docs.schema["text"]
    rows = mixed.collect()
    whole = Counter((r.doc_id, r.text) for r in docs.collect())
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert all(len(r.text) == r.n_chars for r in cut) and len(cut) <= 4
    for (i, t), n in Counter((r.doc_id, r.text) for r in rows).items():
        if (i, t) in whole:
            assert n <= 2 * whole[i, t]
    assert {r.doc_id for r in rows} >= {4, 5, 6}
    assert mixed_documents(docs.limit(0)).count() == 0


def toxic_table(spark, n=400):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words, 30))
        if toxic:
            text += f" vileness{words[i % 400]} Horrid!"
        texts.append((i, text))
        marks.append((i, 1, int(toxic)))
    return documents(spark, texts), labels(spark, marks)


def test_toxicity_finds_inflected_words_on_unseen_rows(spark):
    docs, marks = toxic_table(spark)
    got = toxicity(docs, marks.filter("doc_id < 300")).filter("doc_id >= 300").collect()
    assert len(got) == 100
    assert all(r.toxic == (r.doc_id % 4 == 0) and 0 <= r.p_toxic <= 1 for r in got)
    kept = without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 300


def test_toxicity_without_labels_or_rows(spark):
    docs, none = documents(spark), labels(spark, [])
    got = toxicity(docs, none).collect()
    assert len(got) == len(TEXTS) and not any(r.toxic for r in got)
    odd = labels(spark, [(1, None, 1), (None, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 1), (7, 1, None)])
    assert toxicity(docs, odd).count() == len(TEXTS)
    assert toxicity(docs.limit(0), odd).count() == 0


def test_chain_passes_earlier_probabilities_on():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 3)).astype(float)
    first = x[:, 0]
    chain = fit_chain(x[:, :1], np.column_stack([first, first]), np.arange(600) % 4, [{}])
    assert chain.links[1, 0] > 0.5 and chain.links[0].sum() == 0
    assert sigmoid(np.array([-1e9, 0, 1e9])).tolist() == [pytest.approx(0), 0.5, pytest.approx(1)]


def test_quality_on_held_out_rows(spark):
    docs = documents(spark, [(i, "SPAM!! " * 40 if i % 3 == 0 else f"plain words, number {i}, said once. " * (1 + i % 5)) for i in range(300)])
    got = quality(docs, labels(spark, [(i, int(i % 3 != 0), 0) for i in range(300)])).collect()
    for r in got:
        held = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == int(r.doc_id % 3 != 0)


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    assert {r.score for r in quality(docs, labels(spark, [])).collect()} == {0.5}
    got = quality(docs, labels(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 0, 0), (7, None, 1), (9, 0, 1), (9, 1, 1)])).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert quality(docs.limit(0), labels(spark, [(1, 1, 0)])).count() == 0


def test_isotonic_curve_never_falls():
    knots, shares = isotonic([(0, 10, 1), (1, 10, 5), (2, 10, 3), (5, 10, 9)])
    assert (np.diff(knots) > 0).all() and (np.diff(shares) >= 0).all()
    assert shares[1] == pytest.approx((8 + 0.5) / 21)


def test_scores_of_awkward_rows_match_plain_counts(spark):
    docs = documents(spark)
    got = scores(docs).collect()
    assert len(got) == len(TEXTS)
    counts = Counter()
    for i, t in TEXTS:
        if i is None or zlib.crc32(str(i).encode()) % HELD_FOLDS != HELD:
            counts.update(words_of(t))
    total, kinds = sum(counts.values()), len(counts)
    plain = defaultdict(list)
    for i, t in TEXTS:
        tokens = words_of(t)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        plain[i].append((len(tokens), sum(counts[w] > 0 for w in tokens), pytest.approx(base)))
    for r in got:
        assert (r.n_tokens, r.n_known, r.base_score) in plain[r.doc_id]
        assert r.train_tokens == total and r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % HELD_FOLDS == HELD)
    assert scores(docs.limit(0)).count() == 0


def test_bits_of_spellings_are_a_distribution():
    """Over all words of up to one byte plus end, probabilities of what may follow sum to 1."""
    mixer = Mixer(np.zeros((4, 1 << 20, 2), np.int32))
    words = [bytes([b]) for b in range(256)]
    found, gate, bits, word = spelled_bits(words)
    first = np.arange(len(bits)) % 16 < 8
    cost = np.bincount(word[first], mixer.cost(found, gate, bits)[first])
    assert (10**cost).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("longest", [50, 3])
def test_cost_of_runs_is_the_sum_over_their_bits(monkeypatch, longest):
    """By products or by logarithms, with learned weights and tables that are not even."""
    monkeypatch.setattr(language, "LONGEST_PRODUCT", longest)
    rng = np.random.default_rng(3)
    mixer = Mixer(rng.integers(0, 50, (4, 1 << 20, 2)).astype(np.int32))
    found, gate = rng.integers(0, 1 << 20, (4, 5_000)), rng.integers(0, 16, 5_000)
    bits = rng.integers(0, 2, 5_000).astype(np.int8)
    mixer.learn(found, gate, bits)
    # The plain way: mix, refine, and one logarithm a bit.
    p, cell = mixer.mix(*mixer.inputs(found, gate), gate)
    p = (p + mixer.refined.ravel()[cell]) / 2
    plain = np.log10(np.where(bits == 1, p, 1 - p))
    starts = np.unique(np.append(0, rng.integers(0, 5_000, 700)))
    assert mixer.cost(found, gate, bits) == pytest.approx(plain, rel=1e-9)
    assert mixer.cost(found, gate, bits, starts) == pytest.approx(np.add.reduceat(plain, starts), rel=1e-9)
    none = np.empty(0, np.int64)
    assert len(mixer.cost(found[:, :0], none, none, none)) == 0


def test_slots_without_a_context_are_those_of_the_first_predictor():
    code = Code(pa.array([b"", b"a", b"b", b"c"], pa.binary()), np.array([9, 5, 2, 1]), 3)
    symbols = np.array([1, 4, 0, 3, 3, 2, 0])
    contexts = code.contexts(symbols, np.zeros(len(symbols), np.int64))
    found, _, _, token = code.bits_of(symbols, contexts)
    path = np.concatenate([code.paths[code.starts[s] : code.starts[s] + code.sizes[s]] for s in symbols])
    for k, context in enumerate(contexts):
        assert found[k].tolist() == language.slots(context[token], path >> 1, k).tolist()


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=8).tolist() for _ in range(300)]
    rows = list(enumerate(vectors))
    rows += [(1_000 + i, vectors[0]) for i in range(400)]
    rows += [(2_000, None), (2_020, [0.0] * 8), (2_040, [float("nan")] + [1.0] * 7), (2_060, [1.0] * 7 + [None])]
    rows += [(2_080, [float("inf")] * 8), (2_100, [1.0] * 3), (2_120, []), (2_140, [-0.0, 5.0] + [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("hash", F.lit("clash"))
    got = defaultdict(list)
    for r in nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    plain = {i: np.float32(v).astype(float) for i, v in rows if v and len(v) == 8 and None not in v}
    plain = {i: v for i, v in plain.items() if np.isfinite(v).all() and v.any()}
    asked = {i for i in plain if i % 20 == 0}
    assert set(got) == asked
    for q in asked:
        best = sorted(((-float(v @ plain[q]), i) for i, v in plain.items() if i != q), key=lambda x: (round(x[0], 9), x[1]))
        assert [x[1] for x in got[q]] == [i for _, i in best[:20]]
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert np.allclose([x[2] for x in got[q]], [-s for s, _ in best[:20]])
    assert nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = nearest(frame.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_neighbours_recall_of_scattered_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4_000, 16)) * rng.uniform(0.5, 2.0, (4_000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest(frame, F.col("vec_id") % 100 == 0, least_candidates=8_000).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 4_000, 100):
        near = x @ x[q]
        near[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-near)[:20].tolist()))
    assert hits / (40 * 20) >= 0.9


def test_pipeline_stages(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == documents(spark).columns, name
    docs = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    rows = docs.collect()
    assert {r.doc_id for r in rows} <= {i for i, _ in TEXTS}
    assert all(r.n_tokens >= 0 and len(r.ids_sha256) == 64 for r in rows)


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_mixer_adds_tables_up_by_predictor():
    rng = np.random.default_rng(5)
    one, more = (rng.integers(0, 1 << 30, (4, 64, 2)).astype(np.int32) for _ in range(2))
    whole, by_parts = Mixer(one.astype(np.int64) + more), Mixer(one, more)
    assert (whole.odds == by_parts.odds).all() and (whole.trust == by_parts.trust).all()
