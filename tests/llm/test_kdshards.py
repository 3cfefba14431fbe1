import zlib
from collections import defaultdict

import pytest

from skyweave.llm.kdshards import kd_shards, sharded
from skyweave.llm.queries import QUERIES


def check(rows, docs, shards):
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for members in per.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return [sum(r["size"] for r in per[s]) for s in range(shards)]


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_bytes_are_near_equal(make, sample, shards):
    sizes = check(sharded(make(sample), shards).collect(), sample, shards)
    largest = max(len((t or "").encode()) + 1 for _, t in sample)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_ties_and_odd_rows(make, edges):
    docs = edges + [(i, "the same text") for i in range(10**12, 10**12 + 900)] + [(2**61, "x"), (-(2**61), "y")]
    sizes = check(sharded(make(docs), 8).collect(), docs, 8)
    assert max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) + 1 for _, t in docs)


def torn(rows, docs):
    """Texts in several shards, with their bytes."""
    texts, shards = dict(docs), defaultdict(set)
    weight = defaultdict(int)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
        weight[texts[r.doc_id]] += r["size"]
    return {t: weight[t] for t, found in shards.items() if len(found) > 1}


def test_equal_texts_stay_together(spark):
    """Whatever their source and language; groups of half a shard are pinned, larger ones than a shard cut."""
    sizes = [1, 1, 1, 2, 3, 9, 40, 300, 900, 1100, 2500]
    docs = [(i, f"text {i % 7 ** 3} of {i}") for i in range(6000)]
    docs += [(10_000 + 5000 * g + k, f"copy of text {g:04d}"[: 12 + g]) for g, n in enumerate(sizes) for k in range(n)]
    full = [(i, t, f"s{i % 5}", f"l{i % 3}") for i, t in docs]
    rows = sharded(spark.createDataFrame(full, "doc_id long, text string, source string, lang string"), 8).collect()
    bytes_ = check(rows, docs, 8)
    shard = sum(bytes_) / 8
    assert max(bytes_) - min(bytes_) <= 0.03 * shard
    assert all(w > shard for w in torn(rows, docs).values())


def brute(places, shards, first=0):
    """The tree in plain Python, for texts that are all different: place -> shard."""
    if shards == 1 or not places:
        return {p: first for p in places}
    wide = [max(p[d] for p in ALL) - min(p[d] for p in ALL) or 1 for d in range(3)]
    dim = max(range(3), key=lambda d: ((max(p[d] for p in places) - min(p[d] for p in places)) / wide[d], -d))
    goal, below = -(-sum(p[0] for p in places) * (shards // 2) // shards), 0
    order = sorted(places, key=lambda p: (p[dim], p[3]))
    for at, p in enumerate(order):
        if below + p[0] >= goal:
            at += below + p[0] - goal <= goal - below
            break
        below += p[0]
    half = shards // 2
    return {**brute(order[:at], half, first), **brute(order[at:], shards - half, first + half)}


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_tree_matches_brute_force(spark, shards):
    global ALL
    full = [(i, f"{i} " + "x" * (i * i % 97), f"s{i * 7 % 5}", f"l{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(full, "doc_id long, text string, source string, lang string")
    code = lambda t: zlib.crc32(t.encode())
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) h").collect()}
    ALL = [(len(t) + 1, code(s), code(lang), hashes[i]) for i, t, s, lang in full]
    want = brute(ALL, shards)
    got = {hashes[r.doc_id]: r.shard for r in kd_shards(docs, shards=shards).collect()}
    assert got == {p[3]: s for p, s in want.items()}


def test_leaves_reach_the_target(make, sample):
    rows = kd_shards(make(sample), target_bytes=40_000).collect()
    per = defaultdict(int)
    for r in rows:
        per[r.shard] += r["size"]
    total = sum(per.values())
    assert len(per) == -(-total // 40_000)
    largest = max(r["size"] for r in rows)
    assert max(per.values()) <= 40_000 + 4 * largest


def test_few_rows(make):
    assert sharded(make([]), 8).count() == 0
    for docs in ([(1, None)], [(1, "a"), (1, "a"), (2, "b")]):
        check(sharded(make(docs), 8).collect(), docs, 8)


def test_query(spark, sf, sample):
    sizes = check(QUERIES["op2_kd_tree_shards"](spark, sf).collect(), sample, 8)
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) for _, t in sample)
