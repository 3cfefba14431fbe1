"""Quality rules: fixed text rules plus a calibrated classifier on hashed n-grams.

The classifier is a logistic regression on the shares of hashed word n-grams
(one and two words) and byte n-grams (three and four bytes) of the whole text.
It is fitted on about ``sample`` labelled rows, chosen by their hashed ids (a
documented bound, the only one here), a quarter of which is held back for Platt
calibration.  Every row of the table is scored, in Arrow batches, against
the fixed ``threshold`` on the calibrated probability.

A null text has no words and fails the base rules.  Labels that are null or
neither 0 nor 1 are ignored, of conflicting labels of an id the smaller counts.
Without labels of both kinds the classifier keeps everything.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.texts import about, id_text, map_batches, prepare, texts_of

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Words of a window that counts as a repeat.
WINDOW = 8
#: Hash buckets of each of the two feature families.
BUCKETS = 1 << 17
#: Labelled rows that the classifier is fitted on.
SAMPLE = 4_000
#: Least calibrated probability of good quality that is kept.
THRESHOLD = 0.5
#: Scale of the n-gram shares, so that steps are neither tiny nor huge.
SCALE = 20.0
#: Bytes hashed at a time.
BLOCK = 1 << 20

_LINE = re.compile(rb"\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def covered_by_repeats(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice (exact)."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed, power = np.zeros(count, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            power = power * _MIX + np.uint64(k)
            mixed += ids[k : k + count] * power
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    suspects = np.unique(np.r_[order[1:][same], order[:-1][same]]).tolist()
    seen: dict[tuple[bytes, ...], int] = {}
    for i in suspects:  # equal hashes are only suspects
        key = tuple(words[i : i + width])
        seen[key] = seen.get(key, 0) + 1
    steps = np.zeros(len(words) + 1, np.int64)
    for i in suspects:
        if seen[tuple(words[i : i + width])] > 1:
            steps[i] += 1
            steps[i + width] -= 1
    return int((np.cumsum(steps) > 0).sum())


def text_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in _LINE.split(raw) if line.strip()]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), covered_by_repeats(words)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def _fold(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MIX) >> np.uint64(64 - 17)).astype(np.int64)


def _word_grams(text: str) -> np.ndarray:
    words = text.encode().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x100000001B3) + one[1:]
    return _fold(np.concatenate([one, two]))


def _byte_grams(raw: bytes):
    """Folded byte n-grams of the text, block by block."""
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw[at : at + BLOCK + 3], np.uint8).astype(np.uint64)
        three = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
        four = three[:-1] | b[3:] << np.uint64(24)
        yield np.concatenate([_fold(three[:BLOCK] + np.uint64(1 << 40)), _fold(four[:BLOCK])])


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and scaled shares of a text's n-grams."""
    with np.errstate(over="ignore"):
        words = np.bincount(_word_grams(text), minlength=BUCKETS)
        grams = np.zeros(BUCKETS, np.int64)
        for block in _byte_grams(text.encode()):
            grams += np.bincount(block, minlength=BUCKETS)
    at, value = [], []
    for base, family in ((0, words), (BUCKETS, grams)):
        index = np.flatnonzero(family)
        at.append(base + index)
        value.append(SCALE * family[index] / max(1, family.sum()))
    return np.concatenate(at), np.concatenate(value)


@dataclass
class Classifier:
    """Weights, bias and the two Platt parameters."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, text: str) -> float:
        with np.errstate(over="ignore"):
            words = _word_grams(text)
            total = float(self.weights[words].sum()) / max(1, len(words))
            grams, n = 0.0, 0
            for block in _byte_grams(text.encode()):
                grams += float(self.weights[BUCKETS + block].sum())
                n += len(block)
        return self.bias + SCALE * (total + grams / max(1, n))

    def probability(self, text: str) -> float:
        return _logistic(self.slope * self.margin(text) + self.shift)


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows, labels, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5):
    """Adagrad over rows of ``(buckets, values)``, in a fixed order."""
    weights, moved = np.zeros(2 * BUCKETS), np.full(2 * BUCKETS, 1e-3)
    bias, bias_moved = 0.0, 1e-3
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            slope = _logistic(bias + weights[at] @ value) - labels[i]
            step = slope * value + decay * weights[at]
            moved[at] += step * step
            weights[at] -= rate * step / np.sqrt(moved[at])
            bias_moved += slope * slope
            bias -= rate * slope / np.sqrt(bias_moved)
    return weights, float(bias)


def fit_platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton steps on smoothed labels."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    # Unit spread, so that the weak prior on the point means the same for every fit.
    spread = float(margins.std()) or 1.0
    design = np.column_stack([margins / spread, np.ones(len(margins))])
    point = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float((np.logaddexp(0, z) - goal * z).sum() + 0.5e-3 * (at @ at))

    for _ in range(rounds):
        p = _logistic(design @ point)
        slope = design.T @ (p - goal) + 1e-3 * point
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step, now = np.linalg.solve(bend, slope), loss(point)
        while np.abs(step).max() > 1e-9 and loss(point - step) > now:
            step = step / 2
        point = point - step
    point[0] /= spread
    return float(point[0]), float(point[1])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fit on about ``sample`` of the labelled rows."""
    prepare(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    chosen = known.filter(about("doc_id", known.count(), sample))
    marked = id_text(docs).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_counts(t or "") for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("label"),
                pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()),
            ],
            names=["doc_id", "label", "at", "value"],
        )

    features = map_batches(marked, run, "doc_id bigint, label int, at binary, value binary")

    def fit(batches):
        table = sorted((tuple(r.values()) for batch in batches for r in batch.to_pylist()), key=lambda r: r[0])
        if len({label for _, label, _, _ in table}) == 2:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(_fitted(table))]})

    # The sample is bounded: one task fits it, and the driver sees the weights only.
    model = features.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(model[0].model) if model else None


def _fitted(table: list[tuple[int, int, bytes, bytes]]) -> Classifier:
    """The classifier of rows ``(doc_id, label, buckets, values)``."""
    rows = [(np.frombuffer(at, "<i4"), np.frombuffer(value, "<f4")) for _, _, at, value in table]
    truth = np.array([label for _, label, _, _ in table], float)
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i, _, _, _ in table])
    fit_on = np.flatnonzero(~held)
    weights, bias = fit_logistic([rows[i] for i in fit_on], truth[fit_on])
    checked = np.flatnonzero(held) if len(set(truth[held].tolist())) == 2 else np.arange(len(rows))
    margins = np.array([bias + weights[rows[i][0]] @ rows[i][1] for i in checked])
    slope, shift = fit_platt(margins, truth[checked])
    return Classifier(weights.astype(np.float32), bias, slope, shift)


RULES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the rule counts, ``base_failed``, ``probability`` and ``kept``.

    ``probability`` is null where the base rules fail or no classifier could be fitted.
    """
    model = fit_quality(docs, labels, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        rules = [text_rules(t) for t in texts]
        failed = [fails(r[0], r[4]) for r in rules]
        scores = [None if f or model is None else model.probability(t) for t, f in zip(texts, failed)]
        kept = [not f and (s is None or s >= threshold) for f, s in zip(failed, scores)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array(c, pa.int64()) for c in zip(*rules)],
                pa.array(failed),
                pa.array(scores, pa.float64()),
                pa.array(kept),
            ],
            names=["doc_id", *[p.split()[0] for p in RULES.split(", ")], "base_failed", "probability", "kept"],
        )

    return map_batches(id_text(docs), run, f"doc_id bigint, {RULES}, base_failed boolean, probability double, kept boolean")


def quality_filtered(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that the rules or the classifier reject."""
    model = fit_quality(docs, labels, sample)

    def good(text: str | None) -> bool:
        n_words, _, _, _, repeats = text_rules(text)
        return not fails(n_words, repeats) and (model is None or model.probability(text) >= threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([good(t) for t in texts_of(batch)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
