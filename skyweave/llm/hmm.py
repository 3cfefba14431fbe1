"""Hidden Markov language model trained by Baum-Welch over all learning texts.

Words are separated by ASCII white space and lower-cased in A-Z; each text ends
with one end token.  Word counts over all learning texts give the base model
``b(w) = (c + 0.1) / (N + 0.1 * (V + 1))``, the end token counted as a word.

The latent states emit a symbol: the end, one of the ``symbols`` most frequent
words, or "another word", which then is drawn from ``b`` among the others.  So
every text has an exact probability.  Every round of Baum-Welch reads all
learning texts (``sample_rounds`` before them may read about ``sample`` texts,
by their hashed ids; there are none by default).  The texts are split and looked
up once: their symbols are written to the shared folder and every round reads
those.  Expected counts are formed for
whole texts in each task and summed by Spark, and only the tables of the model,
whose size is set by ``states`` and ``symbols``, reach the driver.  The
likelihood is the scaled forward recursion over the whole text.

Counts of frequent words (a bounded dictionary) are looked up in the task;
counts of all other words come from a join, so that the vocabulary may grow
without bound and no join key is frequent.

A null text is empty: its only token is the end.  A row with a null id is
neither held out nor learned from.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.langid import _share, remainder
from skyweave.llm.lockstep import bounded_groups
from skyweave.llm.texts import about, free_memory, id_text, map_batches, prepare, texts_of
from skyweave.session import cut_lineage

#: Latent states and words with emissions of their own.
STATES, SYMBOLS = 8, 8192
#: Frequent words whose counts every task holds.
DICTIONARY = 100_000
#: Rounds over all learning texts; texts and number of rounds over a sample before them.
FULL_ROUNDS, SAMPLE, SAMPLE_ROUNDS = 10, 1500, 0
#: Steps of a doubling of the count at which the dictionary may end.
STEPS = 16
#: Pseudo-count of a word in the base model.
PSEUDO = 0.1
#: Tokens that go through the recursion together.
GROUP = 200_000
#: Symbols that a task gathers before it sorts their sequences by length.
BUFFER = 8_000_000
#: Places after which the vectors of the recursion are brought back to a sum of one.
RESCALE = 4
#: Distinct words that a task counts before it passes them on.
FLUSH = 400_000
END, OTHER = 0, 1


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(learning: DataFrame) -> DataFrame:
    """``word, c`` over all texts, without the end token; pre-summed in the tasks."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def told():
            words = [w.decode() for w in counts]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for text in texts_of(batch):
                counts.update(tokens_of(text))
            if len(counts) > FLUSH:
                yield told()
                counts.clear()
        if counts:
            yield told()

    return learning.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Totals of the learning tokens and the counts of the frequent words.

    Frequent word ``i`` has symbol ``i + 2`` while ``i < symbols``, else ``OTHER``.
    """

    places: dict[bytes, int]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    symbols: int

    def base(self, count) -> np.ndarray:
        return (np.asarray(count, float) + PSEUDO) / (self.tokens + PSEUDO * (self.distinct + 1))

    @property
    def other_mass(self) -> float:
        """Base probability of all words without a symbol, unseen words included."""
        own = self.base(self.counts[: self.symbols]).sum() + self.base(self.ends)
        return max(1.0 - float(own), 1e-300)

    @property
    def code_type(self) -> type:
        return np.uint16 if self.symbols + 2 <= 2**16 else np.uint32

    def encode(self, texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words, their places (-1 for infrequent words) and the words per text."""
        words = [tokens_of(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = map(self.places.get, chain.from_iterable(words), repeat(-1))
        places = np.fromiter(found, np.int32, int(sizes.sum()))
        return words, places, sizes

    def sequences(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols of the texts one after the other, each with its end."""
        symbols = np.where((places >= 0) & (places < self.symbols), places + 2, OTHER)
        ends = np.cumsum(sizes)
        return np.insert(symbols, ends, END)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, base: np.ndarray, states: int, seed: int = 0) -> Model:
        """Sticky transitions and emissions scattered around the base model."""
        rng = np.random.default_rng(seed)
        emit = base[:, None] * rng.gamma(2.0, 0.5, (len(base), states))
        step = np.full((states, states), 0.02 / states) + 0.98 * np.eye(states)
        return cls(np.full(states, 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def lean(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions over their mean of the states, and that mean: products stay near one."""
        mean = self.emit.mean(axis=1)
        mean = np.where(mean > 0, mean, 1.0)
        return self.emit / mean[:, None], mean

    def log10(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence (longest first, one after the other)."""
        emit, mean = self.lean()
        out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.log10(mean)[symbols], minlength=len(sizes))
        placed, marks = place_major(symbols, sizes)
        seen = emit.take(placed, axis=0)
        alpha, last = None, len(marks) - 2
        for t in range(last + 1):
            a, b = marks[t], marks[t + 1]
            alpha = seen[a:b] * (self.start if alpha is None else alpha[: b - a] @ self.step)
            left = marks[t + 2] - b if t < last else 0
            if left < b - a:
                out[left : b - a] += np.log10(alpha[left:].sum(axis=1))
            if t % RESCALE == 0 and left:
                total = alpha[:left].sum(axis=1)
                out[:left] += np.log10(total)
                alpha[:left] /= total[:, None]
        return out

    def expected(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions of the sequences (longest first).

        The emissions of a symbol may be scaled: each place is weighed by its own
        sum over the states.  Vectors are rescaled every ``RESCALE`` places; where
        single precision runs out all the same, double precision at every place
        takes over.
        """
        placed, marks = place_major(symbols, sizes)
        ends = np.asarray(marks)[np.asarray(sizes) - 1] + np.arange(len(sizes))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
            found = self._expected(placed, marks, ends, RESCALE)
        if found is None:
            double = Model(*(x.astype(float) for x in (self.start, self.step, self.emit)))
            found = double._expected(placed, marks, ends, 1)
        return found

    def _expected(self, placed: np.ndarray, marks: list[int], ends: np.ndarray, every: int):
        step, turned = self.step, np.ascontiguousarray(self.step.T)
        ones = np.ones(len(self.start), step.dtype)
        seen = self.emit.take(placed, axis=0)
        alphas, betas = np.empty_like(seen), np.empty_like(seen)
        places = len(marks) - 1
        np.multiply(seen[: marks[1]], self.start, out=alphas[: marks[1]])
        a, b = 0, marks[1]
        for t in range(1, places):
            before, a, b = a, b, marks[t + 1]
            now = alphas[a:b]
            np.matmul(alphas[before : before + b - a], step, out=now)
            now *= seen[a:b]
            if t % every == 0:
                now /= (now @ ones)[:, None]
        # ``seen`` becomes emission times what follows.
        back = seen[:0]
        for t in range(places - 1, -1, -1):
            a, b, n = marks[t], marks[t + 1], len(back)
            if n:
                np.matmul(back, turned, out=betas[a : a + n])
            if a + n < b:
                betas[a + n : b] = 1
            back = seen[a:b]
            back *= betas[a:b]
            if t % every == 0:
                back /= (back @ ones)[:, None]
        gamma = np.multiply(alphas, betas, out=betas)
        weight = 1 / (gamma @ ones)
        if every > 1 and not (np.isfinite(weight).all() and np.isfinite(seen).all()):
            return None
        gamma *= weight[:, None]
        alphas *= weight[:, None]
        goes_on = np.ones(len(placed), bool)
        goes_on[ends] = False
        moved = step * (alphas[goes_on].T @ seen[marks[1] :])
        emitted = np.empty(self.emit.shape)
        for k, own in enumerate(gamma.T):
            emitted[:, k] = np.bincount(placed, own, minlength=len(emitted))
        return gamma[: marks[1]].sum(axis=0), moved, emitted


def place_major(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The symbols of all first places, then of all second ones, and where each place begins.

    The sequences are not empty and come longest first, so those that run on at a
    place are the first of those at the place before it.
    """
    sizes = np.asarray(sizes, np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    marks = np.r_[0, np.cumsum(running)]
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    placed = np.empty(len(place), np.asarray(symbols).dtype)
    placed[marks[place] + np.repeat(np.arange(len(sizes)), sizes)] = symbols
    return placed, marks.tolist()


def _in_groups(sequences: np.ndarray, sizes: np.ndarray):
    """Groups of sequences, longest first: their positions, symbols and sizes."""
    first = np.cumsum(sizes) - sizes
    for group in bounded_groups(sizes, GROUP):
        own = sizes[group]
        at = np.repeat(first[group] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        yield group, sequences[at], own


def encoded(texts: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, codes``: the symbols of each text and its end, two or four bytes each."""

    def run(batch):
        own = vocabulary.value
        _, places, sizes = own.encode(texts_of(batch))
        codes = own.sequences(places, sizes).astype(own.code_type)
        ends = np.r_[0, np.cumsum((sizes + 1) * codes.itemsize)].astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), binary], names=["doc_id", "codes"])

    return map_batches(texts, run, "doc_id bigint, codes binary")


def _code_blocks(batches, code_type):
    """Symbols and sizes of about ``BUFFER`` symbols: sorted by length, they share most steps."""
    codes, sizes, held = [], [], 0
    for batch in batches:
        column = batch.column("codes").cast(pa.large_binary())
        _, marks, data = column.buffers()
        marks = np.frombuffer(marks, np.int64)[column.offset : column.offset + len(column) + 1]
        if len(column):
            sizes.append(np.diff(marks) // np.dtype(code_type).itemsize)
            codes.append(np.frombuffer(data, np.uint8)[marks[0] : marks[-1]].copy().view(code_type))
            held += len(codes[-1])
        if held >= BUFFER:
            yield np.concatenate(codes), np.concatenate(sizes)
            codes, sizes, held = [], [], 0
    if held:
        yield np.concatenate(codes), np.concatenate(sizes)


def baum_welch_round(learning: DataFrame, model: Model, vocabulary, symbols: int) -> Model:
    """One round: expected counts of all ``encoded`` texts, summed by Spark, and the model they give.

    Rows of the counts: ``0`` starts, ``1 .. K`` transitions, then the symbols.
    """
    states = len(model.start)
    # Expected counts need no more than single precision; the likelihood keeps double.
    single = learning.sparkSession.sparkContext.broadcast(
        Model(*(x.astype(np.float32) for x in (model.start, model.step, model.lean()[0])))
    )
    code_type = vocabulary.value.code_type

    def run(batches):
        total, model = np.zeros((1 + states + symbols, states)), single.value
        for block, sizes in _code_blocks(batches, code_type):
            for _, codes, lengths in _in_groups(block, sizes):
                start, moved, emitted = model.expected(codes, lengths)
                total[0] += start
                total[1 : 1 + states] += moved
                total[1 + states :] += emitted
        free_memory()
        rows = np.flatnonzero(total.any(axis=1))
        if len(rows):
            values = pa.FixedSizeListArray.from_arrays(pa.array(total[rows].ravel()), states)
            yield pa.RecordBatch.from_arrays([pa.array(rows), values.cast(pa.list_(pa.float64()))], names=["slot", "n"])

    counted = learning.select("codes").mapInArrow(run, "slot bigint, n array<double>")
    summed = counted.groupBy("slot").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(states)])
    table = summed.toPandas()
    total = np.zeros((1 + states + symbols, states))
    if len(table):
        total[table["slot"].to_numpy()] = table[[f"n{k}" for k in range(states)]].to_numpy()
    single.unpersist()
    base = vocabulary.value
    prior = np.r_[base.base(base.ends), base.other_mass, base.base(base.counts[: base.symbols])]
    start = total[0] + 1.0 / states
    step = total[1 : 1 + states] + 0.01
    # The base model smooths the emissions: no symbol becomes impossible in a state.
    emit = total[1 + states :] + 10.0 * prior[:, None] / prior.sum()
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def fit_vocabulary(counts: DataFrame, ends: int, symbols: int, dictionary: int) -> Vocabulary:
    """The most frequent words, ``dictionary`` at most, and the totals of the written ``word, c``."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Words per step of their count; the bound is the lowest step from which few enough are left.
    step = F.floor(F.log2("c") * STEPS).cast("int")
    taken, bound = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True):
        taken += r.v
        if taken > dictionary:
            break
        bound = r.step
    frequent = counts.filter(step >= bound) if bound is not None else counts.limit(0)
    top = frequent.toPandas().sort_values(["c", "word"], ascending=[False, True])
    places = {w.encode(): i for i, w in enumerate(top["word"])}
    return Vocabulary(
        places, top["c"].to_numpy(np.int64), ends, whole.n + ends, whole.v + (ends > 0), min(symbols, len(places))
    )


def scored(
    docs: DataFrame,
    modulus: int = 10,
    states: int = STATES,
    symbols: int = SYMBOLS,
    dictionary: int = DICTIONARY,
    sample: int = SAMPLE,
    sample_rounds: int = SAMPLE_ROUNDS,
    full_rounds: int = FULL_ROUNDS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    prepare(docs.sparkSession)
    rows = id_text(docs)
    learning = rows.filter(remainder("doc_id", modulus) != 0)
    counts = cut_lineage(word_counts(learning))
    words = fit_vocabulary(counts, learning.count(), symbols, dictionary)
    shared = _share(docs, words)
    known = words.symbols + 2
    prior = np.r_[words.base(words.ends), words.other_mass, words.base(words.counts[: words.symbols])]
    model = Model.first(prior / prior.sum(), states)
    codes = cut_lineage(encoded(learning, shared))
    if sample_rounds:
        few = codes.filter(about("doc_id", words.ends, sample))
        for _ in range(sample_rounds):
            model = baum_welch_round(few, model, shared, known)
    for _ in range(full_rounds):
        model = baum_welch_round(codes, model, shared, known)
    return _scores(rows, counts, shared, words, model, modulus)


SCORED = "row string, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:string,n:bigint>>"


def _scores(rows: DataFrame, counts: DataFrame, shared, words: Vocabulary, model: Model, modulus: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import uuid

        task, n = uuid.uuid4().hex, 0
        rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            own: Vocabulary = shared.value
            log_base = np.log10(own.base(own.counts)) if len(own.counts) else np.zeros(0)
            log_end, log_other = np.log10(own.base(own.ends)), np.log10(own.other_mass)
            texts, places, sizes = own.encode(texts_of(batch))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            frequent, is_other = places >= 0, (places < 0) | (places >= own.symbols)
            value = np.where(frequent, log_base[places] if len(log_base) else 0.0, 0.0)
            base = np.bincount(owner, value, minlength=len(sizes)) + log_end
            # Words without a symbol: the model says "another word", the base model says which.
            other = np.bincount(owner, np.where(is_other, value - log_other, 0.0), minlength=len(sizes))
            seen = np.bincount(owner, frequent, minlength=len(sizes)).astype(np.int64) + (own.ends > 0)
            score = np.zeros(len(sizes))
            for group, codes, lengths in _in_groups(own.sequences(places, sizes), sizes + 1):
                score[group] = sent.value.log10(codes, lengths)
            rare, at = [], 0
            for ws in texts:
                miss = np.flatnonzero(places[at : at + len(ws)] < 0).tolist()
                at += len(ws)
                rare.append([(w.decode(), c) for w, c in Counter(ws[i] for i in miss).items()])
            names = [f"{task}-{n + i}" for i in range(len(sizes))]
            n += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names),
                    batch.column("doc_id"),
                    pa.array(sizes + 1),
                    pa.array(seen),
                    pa.array(base),
                    pa.array(score + other),
                    pa.array([[{"word": w, "n": c} for w, c in r] for r in rare], rare_type),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"],
            )

    # Written once: the row names are made while it is written.
    done = cut_lineage(rows.mapInArrow(run, SCORED))
    met = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    c = F.coalesce("c", F.lit(0))
    log_base = F.log10((c + F.lit(PSEUDO)) / F.lit(words.tokens + PSEUDO * (words.distinct + 1)))
    tail = (
        met.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * log_base).alias("tail"),
            F.sum("n").alias("rare_n"),
            F.sum(F.when(c > 0, F.col("n"))).alias("rare_known"),
        )
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    log_other = float(np.log10(words.other_mass))
    return (
        done.drop("rare")
        .join(tail, "row", "left")
        .select(
            "doc_id",
            F.coalesce(remainder("doc_id", modulus) == 0, F.lit(False)).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + zero("rare_known")).cast("bigint").alias("n_known"),
            F.lit(words.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + zero("tail")).alias("base_score"),
            (F.col("score") + zero("tail") - zero("rare_n") * log_other).alias("score"),
        )
    )
