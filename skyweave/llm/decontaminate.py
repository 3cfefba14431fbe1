"""Benchmark decontamination with a generalised suffix automaton of the items.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any
character beyond ASCII.  A window is ``window`` consecutive words of one item;
an item of fewer words (but not none) is one window.  The automaton holds every
run of words of every item.  A document is streamed through it word by word and
the length of the longest match that ends at each word is tracked: a match of a
window's length marks its words.

The items are a stated query set.  They are read in blocks of ``BLOCK_WORDS``
words; for the marks each block is one more step over the texts that adds its own, the
cut takes all blocks in one step.  The plan carries the items of all blocks, so the
benchmark has to fit into the driver, and a task holds an automaton per block.

Null texts have no words.  Null item ids take part in the marks, not in the ids.
Repeated rows and rows without an id are marked each on its own.  An empty table
gives no rows; without items nothing is marked.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyweave.llm.texts import id_text, map_batches, prepare, texts_of

#: Words of one item window.
WINDOW = 10
#: Words of the items that one pass over the texts looks for.
BLOCK_WORDS = 200_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of many word sequences, with the items behind each match.

    ``items`` are ``(position in the block, words)``.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set[int]] = {}
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items]
        for i, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
                owners.setdefault(last, set()).add(i)
        # A state's items are those that end in it or below it in the link tree.
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if state in owners and self.link[state] > 0 and self.length[self.link[state]] >= window:
                owners.setdefault(self.link[state], set()).update(owners[state])
        self.owners = owners
        #: For each state: the short items that end there, by length; whole items only.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, codes in coded:
            if 0 < len(codes) < window:
                state = 0
                for code in codes:
                    state = self.next[state][code]
                self.short.setdefault(state, []).append((len(codes), i))
        self.least = min([window, *[n for s in self.short.values() for n, _ in s]])
        self._found: dict[tuple[int, int], tuple[int, frozenset[int]]] = {}

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            old = self.next[last][code]
            if self.length[old] == self.length[last] + 1:
                return old
            return self._clone(last, code, old)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = new
            last = self.link[last]
        if last >= 0:
            old = self.next[last][code]
            exact = self.length[old] == self.length[last] + 1
            self.link[new] = old if exact else self._clone(last, code, old)
        return new

    def _clone(self, last: int, code: int, old: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.length.append(self.length[last] + 1)
        while last >= 0 and self.next[last].get(code) == old:
            self.next[last][code] = copy
            last = self.link[last]
        self.link[old] = copy
        return copy

    def _windows(self, state: int, matched: int) -> tuple[int, frozenset[int]]:
        """Longest window that ends here, and the items with a window that ends here."""
        reach, found, at = 0, set(), state
        if matched >= self.window:
            while self.length[self.link[at]] >= self.window:
                at = self.link[at]
            reach = self.window
            found |= self.owners.get(at, set())
        at = state
        while at > 0:
            for n, item in self.short.get(at, ()):
                if n <= matched:
                    reach = max(reach, n)
                    found.add(item)
            at = self.link[at]
        return reach, frozenset(found)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Marked runs of words ``(begin, end)`` (overlapping, in order) and items seen."""
        known = np.fromiter(map(self.vocabulary.get, words, _minus_ones()), np.int64, len(words))
        inside = np.r_[False, known >= 0, False]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = turns[::2], turns[1::2]
        long = ends - begins >= self.least
        runs, items = [], set()
        step, link, length, found = self.next, self.link, self.length, self._found
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            state, matched = 0, 0
            for at, code in enumerate(known[begin:end].tolist(), begin):
                while state and code not in step[state]:
                    state = link[state]
                    matched = length[state]
                if code in step[state]:
                    state = step[state][code]
                    matched += 1
                if matched >= self.least:
                    key = (state, min(matched, self.window))
                    hit = found.get(key)
                    if hit is None:
                        hit = found[key] = self._windows(state, matched)
                    if hit[0]:
                        runs.append((at + 1 - hit[0], at + 1))
                        items |= hit[1]
        return runs, items


def _minus_ones():
    while True:
        yield -1


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, tuple[bytes, ...]], ...], window: int) -> Automaton:
    return Automaton([(i, list(words)) for i, words in items], window)


@lru_cache(maxsize=1)
def _automata(blocks: tuple[tuple[tuple[int, tuple[bytes, ...]], ...], ...], window: int) -> list[Automaton]:
    """The automata of all blocks, of which the worker keeps one set."""
    return [Automaton([(i, list(words)) for i, words in block], window) for block in blocks]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def _blocks(benchmark: DataFrame, block_words: int):
    """The items, ``(item_id, words)``, in blocks of a bounded number of words."""
    block, size = [], 0
    for row in id_text(benchmark, "item_id").toLocalIterator():
        words = tuple(words_of(row.text))
        if words:
            block.append((row.doc_id, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(runs: list[tuple[int, int]]) -> list[int]:
    """Disjoint marked runs as a flat list of begins and ends."""
    out: list[int] = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


MARKS = "doc_id bigint, text string, n_words bigint, hits array<int>, items array<bigint>"


def _unmarked(docs: DataFrame) -> DataFrame:
    return id_text(docs).selectExpr(
        "doc_id", "text", "0L as n_words", "cast(array() as array<int>) as hits", "cast(array() as array<bigint>) as items"
    )


def _marker(block: tuple, window: int):
    indexed = tuple((i, words) for i, (_, words) in enumerate(block))
    ids = [item for item, _ in block]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _automaton(indexed, window)
        counts, hits, items = [], [], []
        for text, hit, item in zip(texts_of(batch), batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
            words = words_of(text)
            runs, seen = own.scan(words)
            counts.append(len(words))
            hits.append(_merged([*zip(hit[::2], hit[1::2]), *runs]) if runs else hit)
            items.append(item + [ids[i] for i in seen if ids[i] is not None])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text"),
                pa.array(counts, pa.int64()),
                pa.array(hits, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.int64())),
            ],
            names=["doc_id", "text", "n_words", "hits", "items"],
        )

    return run


def marked_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text, n_words, hits, items``: marked word runs (begins and ends) and item ids."""
    prepare(docs.sparkSession)
    out, blocks = _unmarked(docs), 0
    for block in _blocks(benchmark, block_words):
        out = map_batches(out, _marker(tuple(block), window), MARKS)
        blocks += 1
    if not blocks:
        out = map_batches(out, _marker((), window), MARKS)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``n_words, n_hit, n_items, items_sha256, contaminated``.

    ``items_sha256`` digests the distinct item ids, sorted as strings.
    """
    marks = marked_words(docs, benchmark, window, block_words).select("doc_id", "n_words", "hits", "items")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [sum(h[1::2]) - sum(h[::2]) for h in batch.column("hits").to_pylist()]
        items = [sorted({str(i) for i in x}) for x in batch.column("items").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([h > 0 for h in hit]),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return map_batches(marks, run, schema)


def without_spans(text: str, hits: list[int], min_words: int) -> str:
    """``text`` without the marked runs of at least ``min_words`` words."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    parts, at = [], 0
    for begin, end in zip(hits[::2], hits[1::2]):
        if end - begin >= min_words:
            parts.append(raw[at : places[begin][0]])
            at = places[end - 1][1]
    return b"".join([*parts, raw[at:]]).decode()


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    min_span: int = 1,
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with marked spans of at least ``min_span`` words cut out of the text.

    Documents of which more than ``max_coverage`` is marked are dropped.  All
    columns stay; ``n_chars`` follows a changed text.  The marks of all blocks
    are gathered on the whole text before anything is cut.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    blocks = tuple(tuple((i, words) for i, (_, words) in enumerate(block)) for block in _blocks(benchmark, block_words))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # One step for all blocks and the cut: each step would keep a Python process of its own in every task.
        automata = _automata(blocks, window)
        texts, keep = batch.column(text_col).to_pylist(), []
        for i, text in enumerate(texts):
            words = words_of(text)
            hits = _merged([r for own in automata for r in own.scan(words)[0]])
            covered = sum(hits[1::2]) - sum(hits[::2])
            keep.append(not hits or covered <= max_coverage * len(words))
            if hits and keep[-1]:
                texts[i] = without_spans(text, hits, min_span)
        columns = {name: batch.column(name) for name in names}
        columns[text_col] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            sizes = [
                n if m == t else len(m)
                for n, m, t in zip(columns["n_chars"].to_pylist(), texts, batch.column(text_col).to_pylist())
            ]
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
