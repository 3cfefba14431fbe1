"""Interpolation: hand-made cases, invariants and a plain NumPy reference."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skyweave.operators import voronoi as vo
from skyweave.operators.voronoi import average_block, neighbour_weights, voronoi_average


def reference_weights(points, power=2.0):
    """Neighbours by inversion: the hull of p/|p|^2 around the origin (no bisectors)."""
    d2 = (points**2).sum(axis=1)
    if (d2 == 0).any():
        w = (d2 == 0).astype(float)
        return w / w.sum()
    inverted = points / d2[:, None]
    hull = set()
    n = len(points)
    for i in range(n):
        angles = []
        for j in range(n):
            if i != j:
                v = inverted[j] - inverted[i]
                angles.append(np.arctan2(v[1], v[0]))
        v = -inverted[i]
        angles.append(np.arctan2(v[1], v[0]))
        angles = np.sort(np.array(angles))
        gaps = np.diff(np.append(angles, angles[0] + 2 * np.pi))
        if gaps.max() > np.pi:
            hull.add(i)
    w = np.array([d2[i] ** (-power / 2) if i in hull else 0.0 for i in range(n)])
    return w / w.sum()


def weights(points):
    p = np.asarray(points, dtype=float)
    return neighbour_weights(p[None, :, 0], p[None, :, 1], 2.0)[0]


def test_square_shares_equally():
    assert np.allclose(weights([(1, 1), (-1, 1), (-1, -1), (1, -1)]), 0.25)


def test_hidden_monitor_has_no_weight():
    w = weights([(1, 0.1), (-1, 0.1), (0, -1), (0.1, 1), (4, 0.4)])
    assert w[4] == 0 and w.sum() == pytest.approx(1)


def test_monitor_on_target_takes_all():
    assert weights([(0, 0), (1, 0), (0, 2)]).tolist() == [1, 0, 0]


def test_few_and_collinear_monitors():
    assert weights([(2, 0)]).tolist() == [1]
    assert np.allclose(weights([(1, 0), (-1, 0)]), 0.5)
    w = weights([(1, 0), (2, 0), (-1, 0)])
    assert w[1] == 0 and np.allclose(w[[0, 2]], 0.5)


def test_matches_inversion_criterion():
    rng = np.random.default_rng(3)
    for n in (3, 5, 12, 30):
        for _ in range(20):
            points = rng.normal(size=(n, 2))
            assert np.allclose(weights(points), reference_weights(points))


def brute(sites, values, cell, k):
    delta = sites - np.array(cell)
    order = np.lexsort((np.arange(len(sites)), (delta**2).sum(axis=1)))[:k]
    return float((weights(delta[order]) * values[order]).sum())


@pytest.mark.parametrize("seed,n,spread", [(1, 200, 60.0), (2, 35, 300.0), (3, 500, 8.0), (4, 7, 50.0)])
def test_distributed_average_equals_brute_force(spark, seed, n, spread):
    """Sparse, dense, clustered and too few monitors all give the k nearest exactly."""
    rng = np.random.default_rng(seed)
    rows = []
    for day in (1, 2):
        centre = rng.uniform(0, 60, size=2)
        for i in range(n):
            x, y = rng.normal(centre, spread)
            rows.append((day, f"s{i:04d}", float(x), float(y), float(rng.uniform(0, 100)), 1.0))
    monitors = spark.createDataFrame(rows, "day INT, Site STRING, x DOUBLE, y DOUBLE, ozone DOUBLE, one DOUBLE")
    cells = [(d, r, c) for d in (1, 2, 3) for r in range(1, 50, 7) for c in range(1, 60, 9)]
    targets = spark.createDataFrame(cells, "day INT, ROW INT, COL INT")
    got = {
        (r.day, r.ROW, r.COL): (r.vna_ozone, r.vna_one)
        for r in voronoi_average(monitors, targets, ["day"], ["ozone", "one"]).collect()
    }
    assert {k[0] for k in got} == {1, 2}
    for day in (1, 2):
        mine = [r for r in rows if r[0] == day]
        sites, values = np.array([r[2:4] for r in mine]), np.array([r[4] for r in mine])
        for d, r, c in cells:
            if d == day:
                value, one = got[(d, r, c)]
                assert value == pytest.approx(brute(sites, values, (c - 0.5, r - 0.5), 30), abs=1e-9)
                assert one == pytest.approx(1.0)


def test_unwanted_targets_stay_null(spark):
    monitors = spark.createDataFrame(
        [(0, "a", 0.0, 0.0, 3.0), (0, "b", 9.0, 0.0, 5.0)], "k INT, Site STRING, x DOUBLE, y DOUBLE, ozone DOUBLE"
    )
    targets = spark.createDataFrame([(0, 1, 1, True, 7.0), (0, 1, 2, None, 8.0), (1, 1, 1, True, 9.0)], "k INT, ROW INT, COL INT, ok BOOLEAN, model DOUBLE")
    got = voronoi_average(monitors, targets, ["k"], ["ozone"], ["model"], "ok").collect()
    assert sorted((r.COL, r.model, r.vna_ozone is None) for r in got) == [(1, 7.0, False), (2, 8.0, True)]


def test_far_monitors_are_in_reach(spark):
    """A monitor far beyond the coarsest tiles still counts, alone or beside a near one."""
    schema = "k INT, Site STRING, x DOUBLE, y DOUBLE, ozone DOUBLE"
    rows = [(0, "far", 2e7, 0.0, 3.0), (1, "far", -3e7, 5.0, 8.0), (1, "near", 4.0, 0.5, 2.0)]
    targets = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "k INT, ROW INT, COL INT")
    got = {r.k: r.vna_ozone for r in voronoi_average(spark.createDataFrame(rows, schema), targets, ["k"], ["ozone"]).collect()}
    want = brute(np.array([[-3e7, 5.0], [4.0, 0.5]]), np.array([8.0, 2.0]), (0.5, 0.5), 30)
    assert got[0] == pytest.approx(3.0) and got[1] == pytest.approx(want)


def test_a_dense_cluster_keeps_its_k_nearest(spark):
    rng = np.random.default_rng(8)
    sites = np.vstack([rng.normal((3.0, 3.0), 0.01, (3000, 2)), rng.uniform(-40, 40, (40, 2))])
    values = rng.uniform(0, 9, len(sites))
    rows = [(0, f"s{i:05d}", float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(sites, values))]
    monitors = spark.createDataFrame(rows, "k INT, Site STRING, x DOUBLE, y DOUBLE, ozone DOUBLE")
    cells = [(r, c) for r in (1, 3, 4, 20) for c in (1, 3, 4, 20)]
    targets = spark.createDataFrame([(0, r, c) for r, c in cells], "k INT, ROW INT, COL INT")
    for r in voronoi_average(monitors, targets, ["k"], ["ozone"]).collect():
        assert r.vna_ozone == pytest.approx(brute(sites, values, (r.COL - 0.5, r.ROW - 0.5), 30), rel=1e-6)


def test_null_measure_voids_the_average(spark):
    monitors = spark.createDataFrame(
        [(0, "a", 0.0, 0.0, None, 1.0), (0, "b", 2.0, 0.0, 4.0, 1.0)],
        "k INT, Site STRING, x DOUBLE, y DOUBLE, ozone DOUBLE, mod DOUBLE",
    )
    targets = spark.createDataFrame([(0, 1, 1), (0, 1, 2)], "k INT, ROW INT, COL INT")
    rows = voronoi_average(monitors, targets, ["k"], ["ozone", "mod"]).collect()
    assert all(r.vna_ozone is None and r.vna_mod == pytest.approx(1) for r in rows)


def test_block_with_fewer_candidates_than_k():
    out = average_block(np.array([0.0]), np.array([0.0]), np.array([1.0, -1.0]), np.array([0.0, 0.0]), np.array([[2.0], [4.0]]), 30, 2.0)
    assert out.tolist() == [[3.0]]


def fold_case(sites, seed):
    rng = random.Random(seed)
    monitors = [(d, f"s{i:04d}", rng.uniform(0, 40), rng.uniform(0, 30), rng.choice([1, 1, 1, 1, 2, 3]), rng.uniform(20, 60)) for d in (1, 2) for i in range(sites)]
    targets = [(d, rng.randrange(1, 31), rng.randrange(1, 41), g) for d in (1, 2) for g in (1, 2, 3) for _ in range(15)]
    return monitors, sorted(set(targets))


@pytest.mark.parametrize("few", [16, 1, 0])
def test_folds_leave_out_their_own_monitors(spark, few, monkeypatch):
    """Very unequal folds, with the monitors of a key side by side and with the crowded path, against copies."""
    import skyweave.operators.voronoi as vo

    monkeypatch.setattr(vo, "FEW", few)
    monitors, targets = fold_case(90, 8)
    schema = "day int, Site string, x double, y double, g int, ozone double"
    df = spark.createDataFrame(monitors, schema)
    cells = spark.createDataFrame(targets, "day int, ROW int, COL int, g int")
    got = {(r.day, r.g, r.ROW, r.COL): r.vna_ozone for r in vo.voronoi_average(df, cells, ["day"], ["ozone"], fold="g").collect()}
    assert set(got) == {(d, g, r, c) for d, r, c, g in targets}
    for (day, g, row, col), value in got.items():
        own = sorted((s, x, y, v) for d, s, x, y, f, v in monitors if d == day and f != g)
        cx, cy, v = (np.array([o[i] for o in own]) for i in (1, 2, 3))
        want = average_block(np.array([col - 0.5]), np.array([row - 0.5]), cx, cy, v[:, None], 30, 2.0)[0, 0]
        assert value == pytest.approx(want, rel=1e-9)


def test_a_fold_without_training_monitors_is_null(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0, 5, 30.0), (1, "b", 2.0, 2.0, 5, 40.0)], "day int, Site string, x double, y double, g int, ozone double")
    cells = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 1, 6)], "day int, ROW int, COL int, g int")
    got = {r.g: r.vna_ozone for r in voronoi_average(df, cells, ["day"], ["ozone"], fold="g").collect()}
    assert got[5] is None and got[6] is not None


def test_recurring_site_sets_share_their_weights(spark):
    """The same sites on many days: rows with equal cells and monitors meet in one task, results stay per day."""
    rng = random.Random(2)
    sites = [(f"s{i}", rng.uniform(0, 16), rng.uniform(0, 16)) for i in range(40)]
    rows = [(d, s, x, y, float(d * 10 + i)) for d in range(12) for i, (s, x, y) in enumerate(sites)]
    df = spark.createDataFrame(rows, "day int, Site string, x double, y double, ozone double")
    cells = spark.createDataFrame([(d, r, c) for d in range(12) for r in range(1, 17, 3) for c in range(1, 17, 3)], "day int, ROW int, COL int")
    out = voronoi_average(df, cells, ["day"], ["ozone"])
    assert "_same" in out._jdf.queryExecution().analyzed().toString()
    got = {(r.day, r.ROW, r.COL): r.vna_ozone for r in out.collect()}
    assert len(got) == 12 * 36
    for (d, r, c), v in got.items():
        assert v == pytest.approx(got[0, r, c] + d * 10)


def test_a_crowded_key_hands_a_block_its_nearest_only(spark, monkeypatch):
    """However many monitors a key has, a cell meets the k nearest of each fold, not the whole network."""

    def counted(by, out, payload, n_values, k, power):
        def run(batches):
            for batch in batches:
                cells = batch.column("cells")
                owner = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(cells.value_lengths())))
                found = batch.column(f"c_{payload[0]}").value_lengths().fill_null(0).cast(pa.float64()).take(owner)
                flat = cells.flatten()
                arrays = [batch.column(b).take(owner) for b in by]
                arrays += [flat.field(flat.type.get_field_index(c)) for c in out] + [found] * n_values
                yield pa.RecordBatch.from_arrays(arrays, names=[*by, *out, *[f"_v{j}" for j in range(n_values)]])

        return run

    monkeypatch.setattr(vo, "_averages", counted)
    rng = np.random.default_rng(5)
    sites = [(1, f"s{i:05}", float(x), float(y), i % 4, 1.0) for i, (x, y) in enumerate(rng.random((4000, 2)) * 8)]
    cells = [(1, r, c, g) for r in range(1, 9) for c in range(1, 9) for g in range(4)]
    monitors = spark.createDataFrame(sites, "d int, Site string, x double, y double, g int, m double")
    targets = spark.createDataFrame(cells, "d int, ROW int, COL int, g int")
    rows = voronoi_average(monitors, targets, ["d"], ["m"], k=10, fold="g").collect()
    assert len(rows) == 256 and 10 <= max(r.vna_m for r in rows) <= 40
