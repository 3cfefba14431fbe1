import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skyweave.llm import hmm
from skyweave.llm.hmm import Model, scored
from skyweave.llm.queries import QUERIES


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, modulus=10):
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % modulus:
            counts.update(tokens(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        held = i is not None and zlib.crc32(str(i).encode()) % modulus == 0
        out.append((i, held, len(own), sum(counts[w] > 0 for w in own), n, base))
    return out


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-7)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)


def random_model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    return Model(rows(states), rows(states, states), rows(states, symbols).T)


def paths(model, seq):
    k = len(model.start)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for (a, b), s in zip(zip(path, path[1:]), seq[1:]):
            p *= model.step[a, b] * model.emit[s, b]
        yield path, p


def test_forward_and_expected_counts_sum_over_all_paths():
    model = random_model()
    seqs = [[1, 2, 3, 4, 0], [2, 2, 0], [4, 0], [0]]
    sizes = np.array([len(s) for s in seqs])
    codes = np.concatenate(seqs)
    want = [math.log10(sum(p for _, p in paths(model, s))) for s in seqs]
    assert np.allclose(model.log10(codes, sizes), want)
    start, moved, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for _, p in paths(model, s))
        for path, p in paths(model, s):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moved[a, b] += p / total
            for k, symbol in zip(path, s):
                emitted[symbol, k] += p / total
    for a, b in zip(model.expected(codes, sizes), (start, moved, emitted)):
        assert np.allclose(a, b)


def test_scaled_emissions_and_long_sequences_change_nothing():
    """Against a plain forward-backward in double precision that rescales at every place."""
    model, rng = random_model(4, 9, 3), np.random.default_rng(5)
    sizes = np.array([700, 701 - 2, 50, 50, 7, 1])
    codes = rng.integers(0, 9, sizes.sum())
    want = [np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4))]
    logs, at = [], 0
    for n in sizes:
        seq, at = codes[at : at + n], at + n
        alpha, beta, scale = np.zeros((n, 4)), np.ones((n, 4)), np.zeros(n)
        for t in range(n):
            now = model.emit[seq[t]] * (model.start if t == 0 else alpha[t - 1] @ model.step)
            scale[t] = now.sum()
            alpha[t] = now / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = model.step @ (model.emit[seq[t + 1]] * beta[t + 1]) / scale[t + 1]
            want[1] += np.outer(alpha[t], model.emit[seq[t + 1]] * beta[t + 1]) * model.step / scale[t + 1]
        want[0] += alpha[0] * beta[0]
        np.add.at(want[2], seq, alpha * beta)
        logs.append(np.log10(scale).sum())
    assert np.allclose(model.log10(codes, sizes), logs, rtol=1e-12)
    factors = 10.0 ** rng.uniform(-9, 9, 9)
    for emit in (model.emit, model.emit * factors[:, None]):
        got = Model(model.start, model.step, emit).expected(codes, sizes)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(got, want))
    single = Model(*(x.astype(np.float32) for x in (model.start, model.step, model.lean()[0])))
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(single.expected(codes, sizes), want))


def test_single_precision_that_runs_out_falls_back_to_double():
    """Each step costs a factor of 1e-15, so that four of them leave single precision."""
    step = np.array([[1 - 1e-15, 1e-15], [1e-15, 1 - 1e-15]])
    emit = np.array([[1.0, 1e-15], [1e-15, 1.0]])
    model = Model(np.array([0.5, 0.5]), step, emit)
    codes, sizes = np.array([0, 1] * 40), np.array([80])
    single = Model(*(x.astype(np.float32) for x in (model.start, step, emit)))
    got = single.expected(codes, sizes)
    assert all(np.isfinite(x).all() for x in got)
    assert np.isclose(got[0].sum(), 1) and np.isclose(got[1].sum(), 79) and np.isclose(got[2].sum(), 80)


def test_encoded_texts_keep_every_symbol(spark, make, sample, edges):
    rows = sample[:40] + edges
    counts = Counter(w for _, t in rows for w in hmm.tokens_of(t))
    top = sorted(counts, key=lambda w: (-counts[w], w))[:50]
    words = hmm.Vocabulary({w: i for i, w in enumerate(top)}, np.array([counts[w] for w in top]), len(rows), 1, 1, 30)
    coded = hmm.encoded(hmm.id_text(make(rows)), spark.sparkContext.broadcast(words)).collect()
    place = {w: i + 2 for i, w in enumerate(top[:30])}
    want = [(i, [*(place.get(w, hmm.OTHER) for w in hmm.tokens_of(t)), hmm.END]) for i, t in rows]
    got = [(r.doc_id, np.frombuffer(r.codes, np.uint16).tolist()) for r in coded]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("symbols,dictionary", [(5, 20), (100000, 100000), (0, 0), (30, 30)])
def test_base_matches_brute_force(make, sample, edges, symbols, dictionary):
    rows = sample[:80] + edges
    got = scored(make(rows), states=2, symbols=symbols, dictionary=dictionary, sample=20, sample_rounds=1, full_rounds=1)
    compare(got.collect(), brute(rows))


def test_probabilities_sum_to_one(make):
    """Words with symbols, rare known words and one unseen word share all the mass."""
    rows = [(i, t) for i, t in enumerate(["a a b c", "a b", "b a d", "c", "a e f"] * 3)]
    seen = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    probe = [(1000 + k, w) for k, w in enumerate([*seen, "unseen"])]
    held = [(i, t) for i, t in probe if zlib.crc32(str(i).encode()) % 10 == 0]
    free = iter(i for i in range(2000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0)
    probe = [(next(free), t) for _, t in probe] + [(next(free), "")]
    got = scored(make(rows + probe), states=2, symbols=2, dictionary=3, sample=5, sample_rounds=1, full_rounds=1)
    ids = {i for i, _ in probe}
    ones = sum(10**r.score for r in got.collect() if r.doc_id in ids)
    longer = scored(make(rows + [(next(free), f"{a} {b}") for a in [*seen, "unseen"] for b in [*seen, "unseen"]]), states=2, symbols=2, dictionary=3, sample=5, sample_rounds=1, full_rounds=1)
    assert 0 < ones < 1 and held is not None
    assert ones + sum(10**r.score for r in longer.collect() if r.doc_id >= 2000) < 1


def test_empty(make):
    assert scored(make([])).count() == 0


def test_query_beats_the_base_on_held_out_texts(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_hidden_markov_scores"](spark, sf).collect()
    compare(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)


def test_every_round_reads_all_learning_texts(make, monkeypatch):
    """Also where there are more texts than the former sample of 1,500 held."""
    rows = [(i, f"a b{i % 7}") for i in range(3000)]
    read = []

    def counted(learning, model, vocabulary, symbols):
        read.append(learning.count())
        return model

    monkeypatch.setattr(hmm, "baum_welch_round", counted)
    scored(make(rows), states=2)
    assert read == [sum(zlib.crc32(str(i).encode()) % 10 > 0 for i, _ in rows)] * hmm.FULL_ROUNDS
