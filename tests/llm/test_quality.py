import re
from collections import Counter

import numpy as np

from skyweave.llm.queries import QUERIES
from skyweave.llm.quality import covered_by_repeats, fit_platt, quality_verdicts


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_rules_match_brute_force(spark, make, sample, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = sample + edges + [(1, "a b\na b\n \n \nc|<>\x0b\x0c" + " w" * 30), (2, "x\x1cy\x85z q")]
    got = quality_verdicts(make(rows), labels).collect()
    want = []
    for i, t in rows:
        r = brute_rules(t)
        failed = r[0] < 20 or 100 * r[4] > 30 * r[0]
        want.append((i, *r, failed, None, not failed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality_verdicts(make([]), labels).count() == 0


def test_repeats_of_short_texts():
    assert covered_by_repeats([b"a"] * 8) == 0
    assert covered_by_repeats([b"a"] * 9) == 9


def test_classifier_tells_held_out_quality(spark, sf, make, edges):
    sf = sf.replace("0.001", "0.01")
    verdicts = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, sf).collect()}
    assert len(verdicts) == 1000
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r.doc_id: r.quality for r in labels.filter("crc32(cast(doc_id as string)) % 3 = 0").collect()}
    model = quality_verdicts(docs, labels.filter("crc32(cast(doc_id as string)) % 3 > 0"))
    seen = {r.doc_id: r.kept for r in model.collect()}
    good = [seen[i] for i, q in held.items() if q == 1]
    bad = [seen[i] for i, q in held.items() if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


def test_odd_labels(spark, make, edges):
    labels = spark.createDataFrame([(9007, None), (None, 1), (9008, 5), (9006, 1), (9006, 0)], "doc_id long, quality int")
    rows = quality_verdicts(make(edges), labels).collect()
    assert len(rows) == len(edges)


def test_calibration_follows_the_shares():
    rng = np.random.default_rng(0)
    margins = rng.normal(size=4000) * 30
    truth = (rng.random(4000) < 1 / (1 + np.exp(-(0.1 * margins - 1)))).astype(float)
    slope, shift = fit_platt(margins, truth)
    assert abs(slope - 0.1) < 0.02 and abs(shift + 1) < 0.2
    apart = np.r_[np.full(300, 25.0), np.full(100, -25.0)]
    slope, shift = fit_platt(apart, (apart > 0).astype(float))
    assert 0.95 < 1 / (1 + np.exp(-(25 * slope + shift))) < 0.9999


def test_odd_rows_on_a_trained_model(spark, sf, make, edges):
    """The classifier is trained on the labelled rows of the smallest table and meets every odd row."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_verdicts(docs.unionByName(make(edges).select(*docs.columns)), labels).collect()
    odd = [r for r in rows if r.doc_id is None or r.doc_id > 9000]
    assert len(odd) == len(edges) and any(r.kept for r in rows) and not all(r.kept for r in rows)
    for r in odd:
        text = next(t for i, t in edges if i == r.doc_id)
        words = brute_rules(text)[0]
        assert r.n_words == words and not (r.kept and r.base_failed) and (words >= 20 or not r.kept)
    assert len({tuple(r) for r in odd if r.doc_id == 9008}) == 1
