"""Embedding whitening by Chebyshev-filtered subspace iteration.

Every usable vector becomes integers; each distinct integer vector counts once.
Sums are exact, so a centred entry is an exact integer over n.  The covariance
is never formed: a pass over the fit list gives V Q for a block Q of some tens of
columns (each task multiplies its rows, Spark adds the parts), and a recurrence of
such passes applies a Chebyshev polynomial that is small on the unwanted part of
the spectrum.  QR and a Rayleigh-Ritz step follow on the driver, on matrices of
dimension x block.  It ends when the residuals of all wanted pairs are certified
against the rounding level of a pass; a block that converges too slowly is
widened, at most to the dimension, where the step is exact.

Defined results: rows whose vector is null or empty, holds a null, a NaN or an
infinity, or an entry beyond 2^31 are dropped, as are rows whose length is not
the most frequent one (the longest on a tie).  Repeated vectors count once in the
fit and each get their rows; a null id stays null.  Components without variance
(not over 1e-13 of the largest) are left out, so one distinct vector, or none,
gives no rows.  A deviation beyond 64 bits is null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import cut_lineage

#: Steps per unit and offset of the integer grid.
SCALE, OFFSET = 64.0, 1_000_000
#: Largest magnitude of an entry that has a place on the grid.
WIDEST = float(1 << 31)
#: Degrees of the filter, and the largest ratio it may open between two columns of the block.
MAX_DEGREE, MAX_RATIO = 12, 1e8
#: Residual at which a pair is certified, and share of the largest variance below which none is.
CERTIFIED, NO_VARIANCE = 2e-15, 1e-13
#: Rounds before a block is doubled.
PATIENCE = 6


def gridded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the usable rows; ``x`` holds floor(64 c) + 1,000,000."""
    rows = table.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= WIDEST)
    rows = rows.filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(F.forall("c", lambda c: F.coalesce(usable(c), F.lit(False))))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET).alias("x"))


def usual_length(rows: DataFrame) -> int:
    """The most frequent vector length, the longest on a tie; 0 without rows."""
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    most = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first().m
    return most.d if most else 0


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as integers, one row each."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _parts(rows: DataFrame, dims: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part`` (dims x width) of each batch; tasks add first, Spark adds the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = part(matrix(batch, dims))
                total = y if total is None else total + y
        if total is not None:
            columns = [pa.array(np.arange(dims, dtype=np.int32))]
            columns += [pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]
            yield pa.RecordBatch.from_arrays(columns, ["i"] + [f"y{j}" for j in range(width)])

    kind = "bigint" if np.issubdtype(part(np.zeros((1, dims), np.int64)).dtype, np.integer) else "double"
    schema = "i int, " + ", ".join(f"y{j} {kind}" for j in range(width))
    sums = rows.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)])
    out = np.zeros((dims, width), np.int64 if kind == "bigint" else np.float64)
    for r in sums.collect():  # dims rows
        out[r[0]] = r[1:]
    return out


@dataclass(frozen=True)
class Centre:
    """Exact mean: sums over the fit list, taken relative to ``base``."""

    n: int
    base: np.ndarray
    rest: np.ndarray  # S - n * base, per dimension

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact; Python integers where 64 bits could overflow."""
        away = x - self.base
        if (float(np.abs(away).max(initial=0)) + 1) * self.n >= 2.0**62:
            away = away.astype(object)
        return self.n * away - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)


def centre_of(fit: DataFrame, dims: int) -> Centre:
    first = np.asarray(fit.first().x, np.int64)
    part = lambda x: np.stack([(x - first).sum(axis=0), np.full(dims, len(x), np.int64)], axis=1)
    sums = _parts(fit, dims, 2, part)
    n = int(sums[0, 1])
    shift = sums[:, 0] // n
    return Centre(n, first + shift, sums[:, 0] - n * shift)


def product(fit: DataFrame, dims: int, centre: Centre, q: np.ndarray) -> np.ndarray:
    """V q: one pass over the fit list, centred before multiplying."""

    def part(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x)
        return z.T @ (z @ q)

    return _parts(fit, dims, q.shape[1], part) / centre.n


def degree_for(top: float, cut: float) -> int:
    """Largest degree whose filter keeps the block's columns within MAX_RATIO of each other."""
    if cut <= 0 or top <= cut:
        return MAX_DEGREE
    steep = np.arccosh(2 * top / cut - 1)
    return int(np.clip(np.arccosh(MAX_RATIO) // steep, 2, MAX_DEGREE))


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of V on ``q`` that is at most one on [0, cut] and is scaled to one at ``top``.

    ``vq`` is V q, which the Rayleigh-Ritz step has already; each further degree is a pass.
    """
    half = cut / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(2, degree + 1):
        nxt = 1 / (tau - sigma)
        before, now = now, (times(now) - half * now) * (2 * nxt / half) - (sigma * nxt) * before
        sigma = nxt
    return now


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def leading_components(fit: DataFrame, dims: int, centre: Centre, wanted: int) -> Spectrum:
    """The ``wanted`` largest eigenpairs of the fit list's covariance, certified by their residuals."""
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(fit, dims, centre, q)

    trace = float(_parts(fit, dims, 1, lambda x: (centre.centred(x) ** 2).sum(axis=0)[:, None]).sum() / centre.n)
    wanted = min(wanted, dims)
    block = min(dims, 2 * wanted + 8)
    random = np.random.default_rng(7)
    q = np.linalg.qr(random.standard_normal((dims, block)))[0]
    best, rounds = None, 0
    while True:
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        live = values[:wanted] > NO_VARIANCE * top
        off = np.linalg.norm(vq - q * values, axis=0)[:wanted][live]
        residual = float(off.max() / top) if len(off) else 0.0
        if best is None or residual < best.residual:
            best = Spectrum(values[:wanted][live], q[:, :wanted][:, live], trace, residual, passes)
            stuck = 0
        else:
            stuck += 1
        # Done at the rounding level of a pass; once at 1e-13 it may stop falling.
        if not len(off) or residual <= CERTIFIED * np.sqrt(dims) or (residual < 1e-13 and stuck):
            return best
        rounds += 1
        cut = float(max(values[-1], 0.0))
        if block < dims and (rounds % PATIENCE == 0 or cut <= 0):
            block = min(dims, 2 * block)
            wide = random.standard_normal((dims, block - q.shape[1]))
            q = np.linalg.qr(np.concatenate([q, wide - q @ (q.T @ wide)], axis=1))[0]
            continue
        if block == dims or cut >= top:
            q = np.linalg.qr(q)[0]
            if rounds > 3 * PATIENCE:
                return best
            continue
        q = np.linalg.qr(chebyshev(times, q, vq, degree_for(top, cut), cut, top))[0]


def projected(centre: Centre, spectrum: Spectrum, x: np.ndarray) -> np.ndarray:
    return centre.centred(x) @ spectrum.vectors / np.sqrt(spectrum.values)


def identity_error(fit: DataFrame, dims: int, centre: Centre, spectrum: Spectrum) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = len(spectrum.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = projected(centre, spectrum, x)
        out = np.zeros((dims, k))
        out[:k] = w.T @ w
        return out

    return float(np.abs(_parts(fit, dims, k, part)[:k] / centre.n - np.eye(k)).max())


def exact_squares(z: np.ndarray) -> list[int | None]:
    """Row sums of squares without rounding; None beyond 64 bits."""
    if not len(z) or float(np.abs(z).max()) ** 2 * z.shape[1] < 2.0**62:
        return (z * z).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in z]
    return [s if s < 2**63 else None for s in sums]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component; see the module for what each case gives."""
    spark = table.sparkSession
    rows = gridded(table, id_col, vector_col)
    dims = usual_length(rows)
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.filter(F.size("x") == dims)
    fit = cut_lineage(rows.select("x").distinct())
    centre = centre_of(fit, dims)
    spectrum = leading_components(fit, dims, centre, components)
    k = len(spectrum.values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(fit, dims, centre, spectrum)
    explained = spectrum.values / spectrum.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, dims)
            total, each = len(x) * k, np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, centre.n, np.int64)),
                    pa.array(exact_squares(centre.scaled(x)), pa.int64()).take(pa.array(each)),
                    pa.array(projected(centre, spectrum, x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(total, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, SCHEMA)
