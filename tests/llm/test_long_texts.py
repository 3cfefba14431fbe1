"""Texts of several megabytes, one of them without white space."""

import zlib

from skyweave.llm.hmm import scored
from skyweave.llm.kdshards import sharded

LETTERS = "".join(f"{i * i:x}" for i in range(400_000))
WORDS = " ".join(f"w{i * i % 997}" for i in range(500_000))


def test_hidden_markov_scores(make):
    rows = [(1, WORDS), (2, LETTERS), (3, "w1 w4"), (4, None)]
    got = {r.doc_id: r for r in scored(make(rows), states=2, full_rounds=2).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3, 4)] == [500_001, 2, 3, 1]
    assert all(r.n_known == r.n_tokens and r.base_score < 0 and r.score < 0 for r in got.values() if not r.held_out)


def test_shards(make):
    rows = [(1, LETTERS), (2, LETTERS), (3, WORDS), (4, "a")]
    got = {r.doc_id: r for r in sharded(make(rows), 2).collect()}
    assert {i: (r["size"], r.text_crc32) for i, r in got.items()} == {i: (len(t) + 1, zlib.crc32(t.encode())) for i, t in rows}
