"""Language of texts and of their spans: scripts, word scores, Viterbi.

Each word (a run of letters) gets a log-likelihood per language from its hashed
character n-grams.  The script of its first letter narrows the languages to
those seen in that script.  Viterbi over the words with a penalty for each
switch labels spans of mixed-language text; the language with the most letters
is the prediction and its share of the letters the score.

Only text and language of the learning rows shape the model: about
``per_language`` texts of each language, chosen by their hashed ids (a
documented bound), used whole.  Null and letterless texts are ``und`` with
score 0, as is every text where nothing could be learned.  Rows without an id are
predicted but not learned from; repeated rows get equal results; an empty table
gives no rows.  The scores of all words of a text are held at once, so a task's
memory grows with its longest text times the number of languages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.lockstep import Lockstep, bounded_groups
from skyweave.llm.texts import about, map_batches, prepare, texts_of

#: Learning texts of each language.
PER_LANGUAGE = 1500
#: Hash buckets of character n-grams, and their orders.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: Cost of a switch of language between two words, in the unit of the word scores.
SWITCH = 8.0
#: Share of a language's letters in a script from which the script is one of its own.
SCRIPT_SHARE = 0.01
#: Score of a language outside the scripts of a word.
EXCLUDED = -60.0
#: Words times languages that are labelled together.
GROUP = 4_000_000
#: Remembered words of a worker.
REMEMBERED = 200_000

WORD = re.compile(r"[^\W\d_]+")
LETTER = regex.compile(r"\p{L}")

# First code points of script ranges, and their scripts.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` one after the other, and where each begins."""
    marked = "".join([f"^{w}$" for w in words])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.cumsum(sizes) - sizes


def _grams(words: list[str]):
    """For each order: buckets of all n-grams, and the word each belongs to."""
    points, first = _points(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[first, len(points)]))
    with np.errstate(over="ignore"):
        code = np.zeros(len(points), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            code = code[: len(points) - order + 1] * np.uint64(0x100000001B3) + points[order - 1 :] + np.uint64(1)
            if order not in ORDERS:
                continue
            inside = owner[: len(code)] == owner[order - 1 :]
            mixed = (code + np.uint64(order << 60)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed[inside] >> np.uint64(48)).astype(np.int64), owner[: len(code)][inside]


def _scripts(words: list[str]) -> np.ndarray:
    heads = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_FIRST, heads, side="right") - 1]


@dataclass
class Languages:
    """Log-likelihoods of n-gram buckets by language, and the languages of each script."""

    names: list[str]
    bucket_scores: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.names)))
        for buckets, owner in _grams(words):
            for i in range(len(self.names)):
                out[:, i] += np.bincount(owner, self.bucket_scores[buckets, i], minlength=len(words))
        out /= len(ORDERS)
        return out + np.where(self.allowed[_scripts(words)], 0.0, EXCLUDED)


class Labeller:
    """Labels texts; remembers the scores of words."""

    def __init__(self, model: Languages, switch: float):
        self.model, self.switch = model, switch
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.names)))
        self.letters = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        letters = np.fromiter((len(w) if w.isascii() else len(LETTER.findall(w)) for w in words), np.int64, len(words))
        scores = self.model.word_scores(words) if words else np.zeros((0, len(self.model.names)))
        scores[letters == 0] = 0.0
        start = len(self.known)
        self.known.update(zip(words, range(start, start + len(words))))
        self.scores, self.letters = np.vstack([self.scores, scores]), np.r_[self.letters, letters]

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: the language of each word, and its letters."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [WORD.findall(t.lower()) for t in texts]
        self._learn(list({w for words in split for w in words if w not in self.known}))
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        empty = np.zeros(0, np.int64)
        out = [(empty, empty)] * len(texts)
        for group in bounded_groups(lengths, max(1, GROUP // len(self.model.names))):
            ids = np.fromiter(
                (self.known[w] for i in group for w in split[i]), np.int64, int(lengths[group].sum())
            )
            path = viterbi(self.scores[ids], lengths[group], self.switch)
            cuts = np.cumsum(lengths[group])[:-1]
            for i, p, n in zip(group.tolist(), np.split(path, cuts), np.split(self.letters[ids], cuts)):
                out[i] = p, n
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of sequences (longest first, one after the other) with a penalty per switch."""
    first = np.cumsum(lengths) - lengths
    single = np.add.reduceat(scores, first, axis=0)
    free = np.add.reduceat(scores.max(axis=1), first)
    # No path with a switch can beat the best single label: the label is settled.
    settled = free - switch <= single.max(axis=1)
    path = np.repeat(single.argmax(axis=1), lengths)
    if settled.all():
        return path
    rows = np.repeat(~settled, lengths)
    path[rows] = _stepped(scores[rows], lengths[~settled], switch)
    return path


def _stepped(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    steps = Lockstep(lengths)
    ranked = scores[steps.order]
    stayed = np.ones(ranked.shape, bool)
    source = np.zeros(len(ranked), np.int64)
    marks = list(steps.steps())
    value = None
    for a, b in marks:
        here = ranked[a:b]
        if value is None:
            value = here.copy()
            continue
        value = value[: b - a]
        best = value.argmax(axis=1)
        source[a:b] = best
        jump = value[np.arange(b - a), best][:, None] - switch
        stay = value >= jump
        stayed[a:b] = stay
        value = np.where(stay, value, jump) + here
        ranked[a:b] = value
    labels = np.zeros(len(ranked), np.int64)
    at = np.zeros(0, np.int64)
    for t in range(len(marks) - 1, -1, -1):
        a, b = marks[t]
        ends = ranked[a + len(at) : b].argmax(axis=1)
        at = np.r_[at, ends]
        labels[a:b] = at
        at = np.where(stayed[a:b][np.arange(b - a), at], at, source[a:b])
    out = np.zeros(len(ranked), np.int64)
    out[steps.order] = labels
    return out


def fit_languages(learning: DataFrame, per_language: int = PER_LANGUAGE) -> Languages | None:
    """Fit on ``doc_id, text, lang``: n-gram and script counts, summed by Spark."""
    usable = learning.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    totals = usable.groupBy("lang").agg(F.count("*").alias("total"))
    # One row per language, of which the model itself holds a whole table; no text is moved.
    chosen = usable.join(F.broadcast(totals), "lang").filter(about("doc_id", F.col("total"), per_language))
    texts = chosen.select("lang", "text")

    def run(batch: pa.RecordBatch):
        langs = np.array(batch.column("lang").to_pylist(), object)
        words = [WORD.findall(t.lower()) for t in texts_of(batch)]
        for lang in sorted(set(langs.tolist())):
            own = [w for i in np.flatnonzero(langs == lang) for w in words[i]]
            for at in range(0, len(own), 200_000):
                part = own[at : at + 200_000]
                counts = sum(np.bincount(b, minlength=BUCKETS) for b, _ in _grams(part))
                scripts = np.bincount(_scripts(part), np.fromiter(map(len, part), np.int64), minlength=len(SCRIPTS))
                for base, found in ((0, counts), (BUCKETS, scripts)):
                    index = np.flatnonzero(found)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang] * len(index), "slot": pa.array(base + index), "n": pa.array(found[index].astype(np.int64))}
                    )

    summed = map_batches(texts, run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = summed.toPandas()
    if table.empty:
        return None
    names = sorted(set(table["lang"]))
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(names)))
    counts[table["slot"].to_numpy(), table["lang"].map(names.index).to_numpy()] = table["n"].to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    return Languages(names, scores.astype(np.float32), allowed)


@lru_cache(maxsize=2)
def _labeller(key: str, model: "Shared", switch: float) -> Labeller:
    return Labeller(model.value, switch)


@dataclass(frozen=True)
class Shared:
    """A broadcast variable that can key a cache."""

    broadcast: object
    key: str

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shared) and self.key == other.key


def _share(docs: DataFrame, model) -> Shared:
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)
    return Shared(sent, f"{context.applicationId}-{sent._jbroadcast.id()}")


def predicted_language(docs: DataFrame, model: Languages | None, switch: float = SWITCH) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``doc_id, text``."""
    shared = None if model is None else _share(docs, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in texts_of(batch)]
        names, scores = [], []
        own = shared and _labeller(shared.key, shared, switch)
        for path, letters in own.label(texts) if own else [(None, np.zeros(0))] * len(texts):
            total = int(letters.sum())
            if not total:
                names.append("und")
                scores.append(0.0)
                continue
            shares = np.bincount(path, letters, minlength=len(own.model.names))
            best = int(shares.argmax())
            names.append(own.model.names[best])
            scores.append(float(shares[best] / total))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Languages, switch: float = SWITCH) -> DataFrame:
    """``doc_id, begin, end, lang``: runs of words of one language, in code points of the lower-cased text."""
    shared = _share(docs, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = [(t or "").lower() for t in texts_of(batch)], []
        own = _labeller(shared.key, shared, switch)
        for doc, text, (path, _) in zip(batch.column("doc_id").to_pylist(), texts, own.label(texts)):
            if not len(path):
                continue
            places = [m.span() for m in WORD.finditer(text)]
            turns = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)].tolist()
            rows += [(doc, places[a][0], places[b - 1][1], own.model.names[path[a]]) for a, b in zip(turns, turns[1:])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "begin", "end", "lang"]
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, begin bigint, end bigint, lang string")


def narrowed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )


def identified(docs: DataFrame, modulus: int = 5, switch: float = SWITCH) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from the rows that are not held out, label all.

    A row with a null id is neither held out nor learned from.
    """
    prepare(docs.sparkSession)
    rows = narrowed(docs)
    model = fit_languages(rows.filter(remainder("doc_id", modulus) != 0))
    held = F.coalesce(remainder("doc_id", modulus) == 0, F.lit(False))
    return predicted_language(rows, model, switch).select("doc_id", held.alias("held_out"), "lang_pred", "score")
