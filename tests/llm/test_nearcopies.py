import random
import re

import pytest

from skyweave.llm.nearcopies import near_copy_groups
from skyweave.llm.simhash import one_of_each_group

AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, bound=(4, 5)):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both, either = len(a & sets[j]), len(a | sets[j])
            if both * bound[1] >= either * bound[0]:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def changed(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def planted():
    """Copies with one to nine changed words of 200, chains of copies, and a common passage."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for group in range(12):
        words = [f"g{group}w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(9):
            rows.append((len(rows), " ".join(changed(rng, words, rng.randrange(10)))))
        for _ in range(4):
            words = changed(rng, words, 3)
            rows.append((len(rows), " ".join(words)))
    for k in range(30):
        rows.append((len(rows), " ".join([*passage, *(f"own{k}n{i}" for i in range(rng.randrange(5, 40)))])))
    return rows


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_every_pair_at_the_bound_is_linked(make, sample, edges, bucket):
    rows = planted() + sample[:60] + edges
    got = near_copy_groups(make(rows), bucket=bucket).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(rows)


def test_stage_keeps_one_of_each_group(make):
    rows = planted()
    assert {r.doc_id for r in one_of_each_group(make(rows)).collect()} == {c for _, c in brute(rows)}


def test_fingerprints_link_first_and_a_group_of_copies_forms_few_pairs(make, monkeypatch):
    from skyweave.llm import nearcopies as nc

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(changed(rng, words, 4))) for k in range(60)]
    linked, pairs = [], []
    links, verified = nc.near_links, nc._verified
    monkeypatch.setattr(nc, "near_links", lambda *a: linked.append(1) or links(*a))
    monkeypatch.setattr(nc, "_verified", lambda t, p, *a: pairs.append(p.count()) or verified(t, p, *a))
    got = near_copy_groups(make(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(rows)
    # All pairs would be 1770.
    assert linked and sum(pairs) < 600


def test_sketches_never_part_sets_at_the_bound():
    import numpy as np

    from skyweave.llm.nearcopies import _sketch

    rng = np.random.default_rng(1)
    for size in (1, 40, 500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.r_[a[: len(a) * 8 // 10], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)])
        bits = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in _sketch(a) ^ _sketch(b))
        assert bits <= len(np.setxor1d(a, b))


def test_a_crowded_bucket_meets_centres_until_few_candidates_are_left(make, monkeypatch):
    from fractions import Fraction

    from skyweave.llm import nearcopies as nc

    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(changed(rng, words, 1)) for _ in range(100)]
    sets = [(1, key, len(own), len(own) - 1, key, nc._sketch(own).tolist()) for key, own in nc._sets(texts, 5)]
    docs = make(list(enumerate(texts)))
    placed = docs.sparkSession.createDataFrame(sets, "token bigint, key bigint, n int, rest int, root bigint, sketch array<bigint>")
    monkeypatch.setattr(nc, "CENTRES", 4)
    placed, links = nc._more_centres(docs, placed, 5, Fraction(4, 5), 16)
    # All pairs are links: 4,950.
    assert placed.select("key").distinct().count() == len({k for _, k, *_ in sets})
    assert placed.select("root").distinct().count() == 1 and links.count() < 400
