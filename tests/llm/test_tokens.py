import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skyweave.llm.bestfit import packed_documents, packing_plan
from skyweave.llm.queries import QUERIES, vocabulary
from skyweave.llm.tokens import encoder, spliced_count, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def noise(rng, n):
    parts = ["a", "é", "漢", "🙂", " ", "  ", "\n", "\t", "1", "'s", "'", "!", " ", "　", " ", "\x1f", "<|endoftext|>", "Word", "ing"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_ids_equal_the_library(library, sample):
    own, rng = encoder(vocabulary()), random.Random(1)
    for text in [t for _, t in sample[:60]] + [noise(rng, 80) for _ in range(400)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text).tolist() == ids
        assert int(own.width[ids].sum()) == len(text.encode())


@pytest.mark.parametrize("chunk,overlap", [(8, 1), (16, 4), (64, 8), (200, 50)])
def test_splicing_equals_the_library(library, chunk, overlap):
    own, rng = encoder(vocabulary()), random.Random(chunk)
    texts = [noise(rng, n) for n in range(0, 300, 7)] + ["漢字" * 200, "x" * 700, " " * 500, "9" * 300, "\n" * 90 + "a b"]
    for text in texts:
        assert spliced_count(own, text, chunk, overlap) == size(library, text)


def test_counts(make, sample, edges, library):
    rows = sample[:50] + edges
    got = token_counts(make(rows), vocabulary(), limit=300, chunk=512, overlap=16).collect()
    want = [(i, len((t or "").encode()), size(library, t), size(library, t) > 300) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(make([]), vocabulary()).count() == 0


def test_query_counts(spark, sf, sample, library):
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    assert got == {i: (size(library, t), size(library, t) > 1024) for i, t in sample}


def check_packing(rows, docs, library, capacity):
    places, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want[i] += [
            (k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(make, sample, edges, library, capacity):
    docs = sample + edges
    rows = packed_documents(make(docs), vocabulary(), capacity).collect()
    used, least = check_packing(rows, docs, library, capacity)
    assert used <= 1.03 * least + 1


def test_query_packing(spark, sf, sample, library):
    used, least = check_packing(QUERIES["op5_best_fit_packing"](spark, sf).collect(), sample, library, 1024)
    assert used <= least + 2


def test_packing_of_nothing(make):
    assert packed_documents(make([]), vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    rng = random.Random(3)
    counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(40)}
    limits = {"max_docs": 5, "max_attention": 4096 // 2 + 4096 // 2}
    runs = sorted(packing_plan(counts, 64, rule=rule, **limits))
    bins, placed = defaultdict(list), 0
    for j, (length, rank, first, offset) in enumerate(runs):
        same = j + 1 < len(runs) and runs[j + 1][0] == length
        n = (runs[j + 1][1] if same else counts[length]) - rank
        placed += n
        for k in range(n):
            bins[first + k].append((offset, length))
    assert placed == sum(counts.values())
    for taken in bins.values():
        assert len(taken) <= 5 and sum(n * n for _, n in taken) <= 4096
        assert [o for o, _ in sorted(taken)] == [sum(n for _, n in sorted(taken)[:i]) for i in range(len(taken))]
        assert sum(n for _, n in taken) <= 64
