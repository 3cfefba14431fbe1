import math
from fractions import Fraction

import numpy as np
import pytest

from skyweave.llm import whitening
from skyweave.llm.queries import QUERIES
from skyweave.llm.texts import prepare
from skyweave.session import cut_lineage

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, component int, c double, i int"


def table(spark, rows):
    floats = lambda v: v and [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, floats(v), 1, "x", 2, 3, 4.0, 5) for i, v in rows], SCHEMA)


def brute(rows, components=16):
    """What NumPy's eigensolver and exact integers say: {vec_id: [(deviation, whitened row)]}, n, shares."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    centred = lambda v: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)])
    z = np.array([centred(v) for v in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > 1e-13 * values[0]).sum()) if values[0] > 0 else 0
    out = {}
    for i, v in x:
        scores = centred(v) @ vectors[:, :k] / np.sqrt(values[:k])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), scores))
    return out, n, values[:k] / values.sum() if k else []


def same(df, rows, components=16, close=1e-7):
    want, n, shares = brute(rows, components)
    got = {}
    for r in df.collect():
        assert r.n == n and r.identity_error <= 1e-10
        assert math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9)
        got.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert sum(map(len, got.values())) == sum(map(len, want.values())) * len(shares)
    for c in range(1, len(shares) + 1):
        mine, theirs = [], []
        for i, copies in want.items():
            assert sorted(d for d, _ in got[i, c]) == sorted(d for d, _ in copies)
            mine += [w for _, w in sorted(got[i, c])]
            theirs += [w for _, w in sorted((d, float(s[c - 1])) for d, s in copies)]
        mine, theirs = np.array(mine), np.array(theirs)
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < close


def test_query_is_numpy(spark, sf):
    df = QUERIES["op12_embedding_whitening"](spark, sf)
    assert df.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(df, rows)


def vectors(count, dims, seed, spread=None):
    random = np.random.default_rng(seed)
    scale = np.linspace(3, 0.5, dims) if spread is None else spread
    return [(i, [float(np.float32(c)) for c in random.standard_normal(dims) * scale]) for i in range(count)]


def test_odd_rows(spark):
    prepare(spark)
    rows = vectors(120, 6, 1)
    rows += [(500, rows[0][1])] * 40 + [(501, [c + 1e-6 for c in rows[1][1]]), (0, rows[5][1])]
    odd = [(600, None), (601, []), (602, [1.0, None, 1, 1, 1, 1]), (603, [math.nan] * 6), (604, [math.inf, 0, 0, 0, 0, 0])]
    odd += [(605, [1.0, 2.0]), (606, [3e9, 0, 0, 0, 0, 0]), (607, [-math.inf] * 6)]
    same(whitening.whitened(table(spark, rows + odd)), rows)


@pytest.mark.parametrize("components", [1, 3, 16])
def test_fewer_components(spark, components):
    prepare(spark)
    rows = vectors(300, 40, 2, np.geomspace(40, 0.05, 40))
    same(whitening.whitened(table(spark, rows), components), rows, components)


def test_rank_and_empty(spark):
    prepare(spark)
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    same(whitening.whitened(table(spark, flat)), flat)
    assert not whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert not whitening.whitened(table(spark, [])).collect()
    assert not whitening.whitened(table(spark, [(1, None), (2, [])])).collect()


def test_equal_variances_widen_the_block(spark):
    """All variances alike: the block grows to the dimension, and the whitened covariance is the identity."""
    prepare(spark)
    eye = np.eye(60) * 4
    rows = [(i, [float(c) for c in s * eye[i % 60]]) for i, s in enumerate([1] * 60 + [-1] * 60)]
    out = whitening.whitened(table(spark, rows)).collect()
    assert len(out) == 120 * 16 and max(r.identity_error for r in out) < 1e-10
    assert all(math.isclose(r.explained, 1 / 60, rel_tol=1e-9) for r in out)


def test_filter_is_the_polynomial():
    """The recurrence against the polynomial's own values on a diagonal matrix."""
    spectrum = np.array([9.0, 5.0, 3.1, 2.0, 1.0, 0.3, 0.0])
    times = lambda q: spectrum[:, None] * q
    for degree in (2, 5, 9):
        got = np.diag(whitening.chebyshev(times, np.eye(7), times(np.eye(7)), degree, 3.0, 9.0))
        t = np.polynomial.chebyshev.Chebyshev.basis(degree)
        assert np.allclose(got, t(2 * spectrum / 3 - 1) / t(2 * 9 / 3 - 1))


def test_a_pass_is_the_covariance(spark):
    prepare(spark)
    rows = vectors(200, 9, 4)
    fit = cut_lineage(whitening.gridded(table(spark, rows)).select("x").distinct())
    centre = whitening.centre_of(fit, 9)
    x = np.array([r.x for r in fit.collect()])
    q = np.random.default_rng(0).standard_normal((9, 4))
    assert np.allclose(whitening.product(fit, 9, centre, q), np.cov(x.T, bias=True) @ q)


def test_deviation_beyond_64_bits():
    z = np.array([[2**40, 3], [1, 2]], dtype=object)
    assert whitening.exact_squares(z) == [None, 5]
    centre = whitening.Centre(2**40, np.array([0, 0]), np.array([5, 0]))
    assert centre.scaled(np.array([[2**30, 1]]))[0, 0] == 2**70 - 5
