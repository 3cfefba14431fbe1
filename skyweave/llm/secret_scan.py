"""Secret scan: fixed patterns plus a guess-cost model for credential values.

The fixed patterns give the base spans.  Besides, every value that stands in a
credential context (``pwd: ...``, ``passphrase is ...``) is split by dynamic
programming into known words, dates, repeats, keyboard walks and brute-force
characters, so that the decimal logarithm of the guesses is least.  A value that
still costs ``min_cost`` or more and lies in no base span is added as ``guess``.

The known words are those of the corpus itself, ranked by the number of texts
that hold them (values in a credential context do not count), besides a short
fixed list; at most ``DICTIONARY`` words, which every task holds.

Positions are code points, ends are exclusive.  A null text is empty.  Letters are
folded one by one: those whose lower case is several characters stay as they are.
Repeated rows and rows without an id are scanned each on its own; an empty table
gives no rows and no known words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.texts import free_memory, id_text, map_batches, prepare, texts_of
from skyweave.session import cut_lineage

KINDS = ("assign", "access", "hex", "guess")
#: Decimal logarithm of the guesses from which a value counts as a secret.
MIN_COST = 8.0
#: Words of the corpus that every task holds, and the texts that have to hold such a word.
DICTIONARY, LEAST_TEXTS = 50_000, 2
#: Distinct words that a task counts before it passes them on; Spark adds the parts up before they are moved.
FLUSH = 100_000
#: Steps of a doubling of the count at which the list may end.
STEPS = 16
#: Cost of a sign that joins two letters, as in a compound word.
JOINT = 0.3
#: Characters of one walk or repeat; longer ones are several, so that the cost of a value is linear work.
LONGEST_PART = 64

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)"""
    r"""["']?\s*(?:[:=]>?|\bis\b)\s*["'`]?([^\s"'`<>,;]+)""",
    re.I | re.A,
)
#: One of these stands in every text that ``ASSIGN`` or ``CONTEXT`` can match.
CUES = ("pass", "pwd", "secret", "token", "credential", "key")

# Frequent parts of passwords, most frequent first.
COMMON_WORDS = (
    "password pass qwerty admin welcome login letmein monkey dragon master hello freedom whatever love secret "
    "shadow sunshine princess football baseball superman batman trustno iloveyou ninja azerty starwars summer "
    "winter spring autumn flower cheese computer internet service test guest user root default changeme temp "
    "server system manager office company account access token private public example sample demo hidden value "
    "none null true false empty unknown required optional string number your here key the and for with this that "
    "reset change please enter required forgot new old good bad day night time year home house family friend"
).split()
# Rows of a common keyboard, the digits and the alphabet.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv")
# Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!", "oleastasi")

#: Letters of the longest known word.
WORD_LETTERS = 32
WORD = re.compile(rf"[^\W\d_]{{2,{WORD_LETTERS}}}")

_RANK = {w: i for i, w in reversed(list(enumerate(COMMON_WORDS, 1)))}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
_DATE_LENGTHS = (4, 8, 10)


def told_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n``: how many texts hold a word, in parts of ``FLUSH`` words and those of one more text at most."""
    counts: Counter[str] = Counter()

    def told():
        return pa.RecordBatch.from_pydict({"word": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for text in texts_of(batch):
            low = (text or "").lower()
            if any(cue in low for cue in CUES):
                low = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], low)
            counts.update(set(WORD.findall(low)))
            if len(counts) > FLUSH:
                yield told()
                counts.clear()
    if counts:
        yield told()
    # What stays with the worker counts besides what the next step takes.
    counts.clear()
    free_memory()


def word_ranks(texts: DataFrame) -> dict[str, int]:
    """Ranks of the most frequent words by the number of rows of ``text`` that hold them."""
    counted = texts.select("text").mapInArrow(told_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))
    counted = cut_lineage(counted.filter(F.col("c") >= LEAST_TEXTS))
    step = F.floor(F.log2("c") * STEPS).cast("int")
    taken, bound = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True):
        taken += r.v
        if taken > DICTIONARY:
            break
        bound = r.step
    ranks = dict(_RANK)
    if bound is not None:
        top = sorted((-r.c, r.word) for r in counted.filter(step >= bound).collect())
        for i, (_, word) in enumerate(top, 1):
            ranks[word] = min(i, ranks.get(word, i))
    return ranks


def folded(value: str) -> str:
    """Lower case, character by character: one whose lower case is longer stays as it is."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _walk_runs(value: str) -> list[int]:
    """For each place, the length of the longest keyboard walk that begins there."""
    steps = {(a, b) for row in WALKS for s in (row, row[::-1]) for a, b in zip(s, s[1:])}
    runs = [1] * len(value)
    for i in range(len(value) - 2, -1, -1):
        if (value[i], value[i + 1]) in steps:
            runs[i] = runs[i + 1] + 1
    return runs


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """Least decimal logarithm of the guesses over all segmentations of ``value``."""
    rank, n = words or _RANK, len(value)
    longest = WORD_LETTERS
    low = folded(value)
    plain = low.translate(LEET)
    walks = _walk_runs(low)
    best = [0.0] + [math.inf] * n

    def offer(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for i in range(n):
        here = best[i]
        joins = value[i] in "-'’/" and 0 < i < n - 1 and value[i - 1].isalpha() and value[i + 1].isalpha()
        offer(i + 1, here + (JOINT if joins else 1.0))
        for end in range(i + 2, min(n, i + longest) + 1):
            found = rank.get(low[i:end]) or rank.get(plain[i:end])
            if found:
                shape = value[i:end]
                turned = 0.0 if shape in (shape.lower(), shape.capitalize(), shape.upper()) else (end - i) * 0.3
                leet = 0.3 if low[i:end] != plain[i:end] else 0.0
                offer(end, here + math.log10(found + 1) + turned + leet + 0.3)
        for size in _DATE_LENGTHS:
            if i + size <= n and _DATE.fullmatch(low, i, i + size):
                offer(i + size, here + math.log10(150 if size == 4 else 150 * 366))
        for end in range(i + 3, i + min(walks[i], LONGEST_PART) + 1):
            offer(end, here + math.log10(40 * (end - i)))
        for unit in (1, 2, 3, 4):
            part, end = low[i : i + unit], i + unit
            while end + unit <= min(n, i + LONGEST_PART) and low[end : end + unit] == part:
                end += unit
                if end - i >= 3:
                    offer(end, here + unit + math.log10((end - i) // unit))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(
    text: str, taken: list[tuple[int, int, int]], min_cost: float, words: dict[str, int] | None = None
) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(cue in low for cue in CUES):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        inside = any(a <= start and end <= b for a, _, b in taken)
        if not inside and guess_cost(m[1], words) >= min_cost:
            out.append((start, 3, end))
    return out


def _told(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found_secrets(docs: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, all spans."""
    prepare(docs.sparkSession)
    rows = id_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, told = [], [], []
        for text in texts_of(batch):
            base = base_spans(text or "")
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
            digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
            told.append(_told(sorted(base + guess_spans(text or "", base, min_cost, shared.value))))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(digests), pa.array(told)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_batches(rows, run, schema)


def redacted(
    text: str, min_cost: float = MIN_COST, mark: str = "[SECRET]", words: dict[str, int] | None = None
) -> str:
    """``text`` with every span replaced; overlapping spans become one mark."""
    base = base_spans(text)
    parts, at = [], 0
    reach = -1
    for start, _, end in sorted(base + guess_spans(text, base, min_cost, words)):
        if start >= reach:
            parts += [text[at:start], mark]
        reach = at = max(reach, end)
    return "".join([*parts, text[at:]]) if parts else text


def without_secrets(docs: DataFrame, min_cost: float = MIN_COST, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; ``n_chars`` follows a changed text."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(texts))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(text_col).to_pylist()
        new = [t and redacted(t, min_cost, words=shared.value) for t in old]
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns[text_col] = pa.array(new, pa.string())
        if "n_chars" in columns:
            sizes = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new)]
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_batches(docs, run, docs.schema)
