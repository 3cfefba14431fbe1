import itertools
import random
import zlib

import numpy as np
import pytest

from skyweave.llm.langid import Languages, fit_languages, identified, language_spans, narrowed, viterbi
from skyweave.llm.lockstep import Lockstep, bounded_groups
from skyweave.llm.queries import QUERIES


def brute_value(scores, path, switch):
    return sum(scores[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("switch", [0.0, 0.5, 2.0, 50.0])
def test_viterbi_is_best_over_all_paths(switch):
    rng = np.random.default_rng(4)
    lengths = np.array([7, 5, 5, 2, 1, 1])
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    path, at = viterbi(scores, lengths, switch), 0
    for n in lengths:
        own = scores[at : at + n]
        best = max(brute_value(own, p, switch) for p in itertools.product(range(3), repeat=int(n)))
        assert abs(brute_value(own, path[at : at + n].tolist(), switch) - best) < 1e-9
        at += n


def test_lockstep_layout():
    lengths = np.array([4, 2, 2, 1])
    steps = Lockstep(lengths)
    assert [b - a for a, b in steps.steps()] == [4, 3, 1, 1]
    later, before = steps.previous()
    assert (steps.order[later] - steps.order[before] == 1).all()
    groups = list(bounded_groups(np.array([3, 0, 9, 1, 4]), 5))
    assert [g.tolist() for g in groups] == [[2], [4], [0, 3]]


def test_query_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)


def test_odd_rows(make, edges):
    rows = identified(make(edges)).collect()
    assert len(rows) == len(edges) and {r.lang_pred for r in rows} == {"und"} and {r.score for r in rows} == {0.0}
    assert identified(make([])).count() == 0


def test_spans_and_scripts(spark):
    rng = random.Random(2)
    kinds = {"en": "the of and ing tion er".split(), "de": "sch ung ein der ich keit".split(), "ru": "при ого ение ста".split()}
    word = lambda lang: "".join(rng.choice(kinds[lang]) for _ in range(3))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    docs = [(i, text(lang, 40), lang) for i, lang in enumerate(list(kinds) * 30)]
    learning = narrowed(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    model = fit_languages(learning, per_language=25)
    assert isinstance(model, Languages) and model.names == ["de", "en", "ru"]
    parts = [("en", text("en", 30)), ("ru", text("ru", 20)), ("de", text("de", 30))]
    mixed = " ".join(p for _, p in parts)
    probe = spark.createDataFrame([(1, mixed), (2, None), (3, "½ 12 _ !")], "doc_id long, text string")
    spans = sorted(tuple(r)[1:] for r in language_spans(probe, model).collect() if r.doc_id == 1)
    assert [s[2] for s in spans] == ["en", "ru", "de"]
    assert mixed[spans[1][0] : spans[1][1]] == parts[1][1]


def test_odd_rows_on_a_trained_model(spark, sf, make, edges):
    """Null, blank, short, long, mixed and repeated rows beside the rows that train the model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.lang for r in docs.select("lang").distinct().collect() if r.lang}
    rows = [r for r in identified(docs.unionByName(make(edges).select(*docs.columns))).collect() if r.doc_id is None or r.doc_id > 9000]
    assert len(rows) == len(edges)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        assert r.lang_pred in known | {"und"} and 0 <= r.score <= 1
    assert all(by_id[i] == [("und", 0.0)] for i in (9001, 9002, 9003))
    assert len(set(by_id[9008])) == 1 and by_id[9007][0] == by_id[9008][0] and by_id[9007][0][0] in known
    assert by_id[None][0][0] in known
