import random
import re

import pytest
import xxhash

from skyweave.llm.queries import QUERIES
from skyweave.llm.simhash import near_links, simhash_groups


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, max_bits=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(a ^ b).count("1") <= max_bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def expected(rows, max_bits=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    comp = brute_components({p for _, p in prints}, max_bits)
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return sorted(((i, p, least.get(comp[p])) for i, p in prints), key=str)


def got(df):
    return sorted(((r.doc_id, r.bits % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_matches_brute_force(make, sample, edges):
    rows = sample + edges + [(7, "")]
    assert got(simhash_groups(make(rows))) == expected(rows)


def test_query_digest(spark, sf, sample):
    rows = QUERIES["op3_simhash_groups"](spark, sf).collect()
    want = {(i, f"{p:016x}", c) for i, p, c in expected(sample)}
    assert {tuple(r) for r in rows} == want


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("bucket", [0, 4, 64])
def test_links_have_the_same_closure_for_every_bucket_size(spark, max_bits, bucket):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for c in centres for _ in range(60)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = near_links(spark.createDataFrame([(s,) for s in signed.values()], "bits long"), max_bits, bucket).collect()
    back = {s: p for p, s in signed.items()}
    assert all(bin(back[a] ^ back[b]).count("1") <= max_bits for a, b in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(back[a]), find(back[b])
        root[max(a, b)] = min(a, b)
    want = brute_components(prints, max_bits)
    assert {p: find(p) for p in prints} == {p: want[p] for p in prints}


def test_empty(make):
    assert simhash_groups(make([])).count() == 0
