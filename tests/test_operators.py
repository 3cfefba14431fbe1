"""Hand-computed cases and invariants of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import calendar as cal
from skyweave.functions import ozone as oz
from skyweave.functions.projection import CONUS_12KM, nearest_index
from skyweave.operators import audit as au
from skyweave.operators import compare as cp
from skyweave.operators import hourly as hr
from skyweave.operators import quantiles as qu
from skyweave.operators import regions as rg
from skyweave.operators import trend as tr
from skyweave.operators.combine import densify, with_site_offsets
from skyweave.operators.matching import nearest_k, nearest_known
from skyweave.operators.shelves import shelved
from skyweave.plans.validation import equal_site_folds, hash_folds
from skyweave.session import cut_lineage, scratch_path
from skyweave.sources import boundaries as bd
from skyweave.sources import sinks as sk

HOURS = "site STRING, ts TIMESTAMP_NTZ, v DOUBLE"


def hours(spark, values, start=dt.datetime(2011, 5, 1), site="a"):
    rows = [(site, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, HOURS)


def mda8(df):
    return [r.v for r in hr.daily_max_8h(df, ["site"], "ts", ["v"]).orderBy("Date").collect()]


def test_eight_hour_windows(spark):
    assert mda8(hours(spark, [1.0] * 7)) == [None]
    assert mda8(hours(spark, [float(i) for i in range(8)])) == [3.5]
    day = [float(i) for i in range(24)]
    assert mda8(hours(spark, day)) == [19.5]
    day[20] = None
    assert mda8(hours(spark, day)) == [15.5]


def test_windows_stop_at_midnight(spark):
    late = hours(spark, [90.0] * 8, dt.datetime(2011, 5, 1, 20))
    assert mda8(late) == [None, None]


def test_series_maximum_crosses_pieces(spark):
    rng = np.random.default_rng(0)
    values = rng.uniform(0, 10, size=9000).tolist()
    values[4090:4100] = [50.0] * 10
    got = hr.guarded_max_8h(hours(spark, values), ["site"], "ts", ["v"]).collect()[0].v
    windows = np.convolve(values, np.ones(8) / 8, "valid")
    assert got == pytest.approx(windows.max())
    short = hr.guarded_max_8h(hours(spark, values[:7]), ["site"], "ts", ["v"]).collect()[0].v
    assert short is None


def season(spark, ppb, skip=()):
    rows = []
    day = dt.datetime(2011, 3, 1)
    while day < dt.datetime(2011, 11, 1):
        if day.month not in skip:
            rows += [(1, 1, day + dt.timedelta(hours=h), ppb) for h in range(24)]
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "ROW INT, COL INT, local_time TIMESTAMP_NTZ, v DOUBLE")


def weight(ppb):
    v = ppb / 1000
    return v / (1 + 4403 * math.exp(-126 * v))


def test_w126_of_a_constant(spark):
    got = hr.grid_w126(season(spark, 60.0), ["v"], 2011).collect()[0].v
    assert got == pytest.approx(weight(60.0) * 12 * 92)


def test_w126_needs_three_months(spark):
    assert hr.grid_w126(season(spark, 60.0, skip=(5, 8)), ["v"], 2011).collect()[0].v is None


def test_w126_missing_hour_voids_the_result(spark):
    df = season(spark, 60.0)
    hole = (F.month("local_time") == 5) & (F.dayofmonth("local_time") == 3) & (F.hour("local_time") == 9)
    holed = df.withColumn("v", F.when(~hole, F.col("v")))
    assert hr.grid_w126(holed, ["v"], 2011).collect()[0].v is None


def test_w126_is_monotone(spark):
    values = [hr.grid_w126(season(spark, p), ["v"], 2011).collect()[0].v for p in (20.0, 60.0, 90.0)]
    assert values == sorted(values)


@pytest.mark.parametrize("share,complete", [(0.74, False), (0.75, True)])
def test_monitor_month_completeness(spark, share, complete):
    possible = 12 * 30
    n = math.floor(possible * share)
    rows = [("a", dt.datetime(2011, 4, 1 + i // 12, 8 + i % 12), 60.0) for i in range(n)]
    df = spark.createDataFrame(rows, HOURS)
    months = hr.complete_months(df, ["site"], "v", "ts").collect()
    if complete:
        assert months[0].v == pytest.approx(weight(60.0) * possible)
    else:
        assert months[0].v is None


def test_top_n_mean_with_ties_and_short_groups(spark):
    rows = [(1, float(v), float(-v)) for v in [5, 5, 5, 1, 2]] + [(2, 7.0, None)]
    df = spark.createDataFrame(rows, "k INT, a DOUBLE, b DOUBLE")
    got = {r.k: (r.a, r.b) for r in qu.top_n_mean(df, ["k"], ["a", "b"], 2).collect()}
    assert got == {1: (5.0, -1.5), 2: (7.0, None)}


@pytest.mark.parametrize("shape", ["even", "skewed", "tied", "single"])
def test_ranked_percentiles_match_numpy(spark, shape):
    rng = np.random.default_rng(5)
    values = {
        "even": rng.uniform(0, 100, 4000),
        "skewed": rng.exponential(1, 4000) ** 6,
        "tied": rng.integers(0, 3, 4000).astype(float),
        "single": np.array([4.25]),
    }[shape]
    df = spark.createDataFrame([(i % 2 if shape != "single" else 0, float(v)) for i, v in enumerate(values)], "k INT, v DOUBLE")
    wanted = {"lo": ("v", 0.005), "mid": ("v", 0.5), "hi": ("v", 0.98)}
    for k, row in {r.k: r for r in qu.exact_percentiles(df, ["k"], wanted).collect()}.items():
        mine = values[k::2] if shape != "single" else values
        for name, (_, p) in wanted.items():
            assert row[name] == pytest.approx(np.quantile(mine, p), abs=1e-9)


def test_hot_group_is_split_from_ordinary_ones(spark):
    df = spark.range(5000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.col("id").cast("double").alias("v"))
    wanted = {"p": ("v", 0.98)}
    got = {r.k: r.p for r in qu.exact_percentiles(df, ["k"], wanted).collect()}
    ids = np.arange(5000)
    assert got[0] == pytest.approx(np.quantile(ids[ids % 10 != 0], 0.98))
    assert got[1] == pytest.approx(np.quantile(ids[ids % 10 == 0], 0.98))


def test_percentiles_of_null_groups_and_columns(spark):
    rows = [(None, 1.0, None), (None, 4.0, None), ("a", None, 2.0), ("b", 7.0, 7.0)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, w DOUBLE")
    got = qu.exact_percentiles(df, ["k"], {"p": ("v", 0.5), "q": ("w", 0.5)}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2.5, None), ("a", None, 2.0), ("b", 7.0, 7.0)], key=str)
    assert tuple(qu.exact_percentiles(df, [], {"p": ("v", 0.5)}).first()) == (4.0,)
    assert qu.exact_percentiles(df.filter("k = 'z'"), ["k"], {"p": ("v", 0.5)}).count() == 0


def test_one_far_outlier_does_not_fill_a_shelf(spark):
    df = spark.range(40000).select(F.lit(1).alias("k"), F.when(F.col("id") == 7, 1e15).otherwise(F.col("id")).cast("double").alias("v"))
    wide = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in shelved(df, ["k"], ["v"]).groupBy("_shelf").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide)
    assert len(sizes) == 8 and max(sizes) < 2 * 40000 / 8


def test_cube_score_of_values_far_from_zero(spark):
    rows = [(d, d % 3, 1e7 + v, 1e7 + v + e) for d in range(6) for v, e in ((-2.0, 0.5), (0.0, -0.5), (2.0, 0.25))]
    df = spark.createDataFrame(rows, "Timestamp INT, Fold INT, y DOUBLE, p DOUBLE")
    got = {(r.Timestamp, r.Fold): r.R2 for r in cp.score_cube(df, "y", "p").collect()}
    want = df.agg(cp.r2_score("y", "p").alias("r")).first().r
    assert got["Mean", "Mean"] == pytest.approx(want, abs=1e-6) and got["1", "1"] == pytest.approx(want, abs=1e-6)


def test_densify_many_labels(spark):
    cells = spark.createDataFrame([(1, 1), (1, 2)], "ROW INT, COL INT")
    labels = spark.range(1500).select(F.col("id").alias("Period"))
    df = spark.createDataFrame([(1, 2, 1400, 3.0)], "ROW INT, COL INT, Period LONG, v DOUBLE")
    got = densify(df, cells, "Period", labels)
    assert got.count() == 3000 and [tuple(r) for r in got.filter("v IS NOT NULL").collect()] == [(1, 2, 1400, 3.0)]


def series(spark, values):
    rows = [(1, 2000 + i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k INT, Year INT, v DOUBLE")


def slope(df, **kw):
    return tr.median_slope(df, ["k"], ["v"], **kw).collect()[0].v


def test_median_slope(spark):
    assert slope(series(spark, [1.0, 3.0, 5.0, 7.0])) == 2.0
    assert slope(series(spark, [1.0, 3.0, 500.0, 7.0, 9.0])) == pytest.approx(2.0)
    assert slope(series(spark, [1.0, None, 5.0])) is None
    assert slope(series(spark, [1.0])) is None
    assert slope(series(spark, [1.0, 3.0, 100.0]), last_year={"v": 2001}) == 2.0


def test_fit_statistics_and_r2(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 200)
    y = 2 * x + 1 + rng.normal(size=200)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k INT, x DOUBLE, y DOUBLE")
    row = cp.fit_statistics(df, ["k"], "x", "y").collect()[0]
    b, a = np.polyfit(x, y, 1)
    assert (row.Slope, row.Intercept) == (pytest.approx(b), pytest.approx(a))
    assert row.RMSE == pytest.approx(np.sqrt(((y - x) ** 2).mean()))
    r2 = df.agg(cp.r2_score("y", "x").alias("r")).collect()[0].r
    assert r2 == pytest.approx(1 - ((y - x) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_kernel_density_close_to_exact(spark):
    rng = np.random.default_rng(2)
    points = rng.multivariate_normal([30, 40], [[20, 12], [12, 15]], 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "x DOUBLE, y DOUBLE")
    rows = cp.kernel_density(df, "x", "y", per_band=12).collect()
    inverse = np.linalg.inv(np.cov(points.T) * len(points) ** (-1 / 3))
    delta = points[:, None, :] - points[None, :, :]
    exact = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", delta, inverse, delta)).sum(axis=1)
    exact = (exact - exact.min()) / (exact.max() - exact.min())
    by_point = {(float(a), float(b)): e for (a, b), e in zip(points, exact)}
    assert len(rows) == len(points)
    assert max(abs(r.density - by_point[(r.x, r.y)]) for r in rows) < 0.03


def test_smoothed_lines_cross_block_borders(spark, monkeypatch):
    """Short blocks, so that lines, halos and gaps meet many borders, against a direct sum."""
    monkeypatch.setattr(cp, "LINE_BLOCK", 8)
    rng = np.random.default_rng(3)
    nodes = {(int(v), int(u)): float(w) for v, u, w in zip(rng.integers(-2, 3, 80), rng.integers(-60, 60, 80), rng.random(80))}
    df = spark.createDataFrame([(v, u, w) for (v, u), w in nodes.items()], "v long, u long, w double")
    kernel = np.exp(-np.arange(-11, 12) ** 2 / 20.0)
    got = {(r.v, r.u): r.w for r in cp.smoothed_lines(df, "v", "u", "w", kernel).collect()}
    want = {}
    for (v, u), w in nodes.items():
        for o in range(-11, 12):
            want[v, u + o] = want.get((v, u + o), 0.0) + w * kernel[o + 11]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_projection_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(-97.0, 40.0), (-120.5, 33.25), (-70.0, 45.0)], "lon DOUBLE, lat DOUBLE")
    g = CONUS_12KM
    plane = df.withColumns({"x": g.x(F.col("lon"), F.col("lat")), "y": g.y(F.col("lon"), F.col("lat"))})
    back = plane.withColumns({"lon2": g.lon(F.col("x"), F.col("y")), "lat2": g.lat(F.col("x"), F.col("y"))}).collect()
    assert (back[0].x, back[0].y) == (pytest.approx(213.0), pytest.approx(144.0))
    for r in back:
        assert (r.lon2, r.lat2) == (pytest.approx(r.lon), pytest.approx(r.lat))


def test_nearest_cell_clamps_and_breaks_ties_upwards(spark):
    df = spark.createDataFrame([(-3.0,), (0.2,), (1.0,), (9.99,), (55.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(nearest_index(F.col("x"), 10)).collect()] == [1, 1, 2, 10, 10]


def test_nearest_known_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    known = [(f"k{i}", float(a), float(b), i) for i, (a, b) in enumerate(rng.normal(0, 30, size=(60, 2)))]
    far = [(f"m{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-150, 150, size=(80, 2)))]
    got = nearest_known(
        spark.createDataFrame(far, "site_id STRING, Lon DOUBLE, Lat DOUBLE"),
        spark.createDataFrame(known, "site_id STRING, Lon DOUBLE, Lat DOUBLE, n INT"),
        "site_id", "site_id", "Lon", "Lat", ["n"],
    ).collect()
    places = np.array([k[1:3] for k in known])
    expect = {m[0]: int(((places - np.array(m[1:])) ** 2).sum(axis=1).argmin()) for m in far}
    assert {r.site_id: r.n for r in got} == expect


def most_rows(spark, run):
    """The most rows that any one step of the plans of ``run`` put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    before = {e.executionId() for e in seq(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for e in seq(store.executionsList()):
        if e.executionId() not in before:
            names = {m.accumulatorId(): m.name() for m in seq(e.metrics())}
            values = seq(store.executionMetrics(e.executionId()).toSeq())
            most = max([most, *[int(v._2().replace(",", "")) for v in values if names.get(v._1()) == "number of output rows"]])
    return most


@pytest.mark.parametrize("spread,off", [(0.2, 0.0), (10.0, 30.0)])
def test_nearest_known_pairs_grow_with_the_points_only(spark, spread, off):
    """Sites crowded in less than a degree, and points far outside the sites' range: few pairs for a point."""
    rng = np.random.default_rng(4)
    known = [(f"k{i}", float(a), float(b), i) for i, (a, b) in enumerate(rng.uniform(0, spread, size=(4000, 2)))]
    far = [(f"m{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, spread, size=(3000, 2)) + [0, off])]
    missing = spark.createDataFrame(far, "site_id STRING, Lon DOUBLE, Lat DOUBLE")
    sites = spark.createDataFrame(known, "site_id STRING, Lon DOUBLE, Lat DOUBLE, n INT")
    got = {}
    run = lambda: got.update({r.site_id: r.n for r in nearest_known(missing, sites, "site_id", "site_id", "Lon", "Lat", ["n"]).collect()})
    assert most_rows(spark, run) <= 40 * len(far)
    places = np.array([k[1:3] for k in known])
    assert got == {m[0]: int(((places - np.array(m[1:])) ** 2).sum(axis=1).argmin()) for m in far}


@pytest.mark.parametrize("k", [1, 3, 30])
def test_nearest_k_equals_brute_force_on_odd_places(spark, k):
    """Clusters, far outliers, copies at one place, equal distances on a lattice, a key with few sites and one without."""
    rng = np.random.default_rng(k)
    spots = [
        *rng.normal((5, 5), 1e-6, (150, 2)), *rng.uniform(-50, 50, (60, 2)), *[(7.0, 7.0)] * 80,
        *[(float(a), float(b)) for a in range(-4, 5) for b in range(-4, 5)], (3e6, -2e6), (-0.0, 0.0),
    ]
    sites = [(1, f"s{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(2, "only", 4.0, 4.0), (2, "far", -1e5, 9.0)]
    marks = [*rng.normal((5, 5), 1e-6, (20, 2)), *rng.uniform(-90, 90, (40, 2)), (7.0, 7.0), (0.5, 0.5), (0.0, 0.0), (2e6, 2e6), (4e6, 0.0)]
    points = [(d, i, float(x), float(y)) for d in (1, 2, 3) for i, (x, y) in enumerate(marks)]
    lost = [(1, 900, None, 1.0), (1, 901, float("nan"), 1.0)]
    got = {}
    for r in nearest_k(
        spark.createDataFrame(points + lost, "d INT, id INT, x DOUBLE, y DOUBLE"),
        spark.createDataFrame(sites + [(1, "lost", None, None)], "d INT, Site STRING, x DOUBLE, y DOUBLE"),
        ["d"], "id", "Site", k,
    ).collect():
        got.setdefault((r.d, r.id), []).append((r["rank"], r.Site, r.distance))
    assert set(got) == {(d, i) for d, i, _, _ in points if d != 3}
    for d, i, px, py in points:
        own = sorted(((x - px) ** 2 + (y - py) ** 2, s) for g, s, x, y in sites if g == d)[:k]
        assert sorted(got.get((d, i), [])) == [(n + 1, s, pytest.approx(d2**0.5)) for n, (d2, s) in enumerate(own)]


def test_nearest_known_of_copies_ties_and_nothing(spark):
    schema = "site_id STRING, Lon DOUBLE, Lat DOUBLE"
    known = [("b", 1.0, 0.0, 2), ("a", -1.0, 0.0, 1), *[(f"c{i}", 9.0, 9.0, 100 + i) for i in range(300)]]
    sites = spark.createDataFrame(known, schema + ", n INT")
    points = spark.createDataFrame([("p", 0.0, 0.0), ("q", 9.0, 8.0), *[(f"r{i}", 9.0, 9.0) for i in range(300)]], schema)
    got = {r.site_id: r.n for r in nearest_known(points, sites, "site_id", "site_id", "Lon", "Lat", ["n"]).collect()}
    assert got == {"p": 1, "q": 100, **{f"r{i}": 100 for i in range(300)}}
    assert nearest_known(points, sites.limit(0), "site_id", "site_id", "Lon", "Lat", ["n"]).count() == 0
    assert nearest_known(points.limit(0), sites, "site_id", "site_id", "Lon", "Lat", ["n"]).count() == 0
    one = nearest_known(points.filter("site_id = 'q'"), sites.filter("site_id = 'a'"), "site_id", "site_id", "Lon", "Lat", ["n"]).collect()
    assert [tuple(r) for r in one] == [("q", 1)]


def test_offset_fill_keeps_every_row(spark):
    obs = spark.createDataFrame([("a", 1.0, 1.0, 5.0), ("b", 2.0, 2.0, 6.0), ("b", 2.0, 2.0, 7.0)], "site_id STRING, Lat DOUBLE, Lon DOUBLE, O3 DOUBLE")
    tz = spark.createDataFrame([("a", 1.0, 1.0, -5.0, "R1")], "site_id STRING, Lat DOUBLE, Lon DOUBLE, gmt_offset DOUBLE, epa_region STRING")
    rows = with_site_offsets(obs, tz).collect()
    assert len(rows) == 3 and {r.gmt_offset for r in rows} == {-5.0}


def test_polygon_with_hole_and_area(spark):
    ring = lambda part, no, pts: [(0, part, no, i, x, y) for i, (x, y) in enumerate(pts)]
    outer = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    vertices = spark.createDataFrame(
        ring(0, 0, outer) + ring(0, 1, hole), "poly_id INT, part INT, ring INT, pos INT, x DOUBLE, y DOUBLE"
    )
    edges = rg.ring_edges(vertices, ["poly_id", "part", "ring"])
    grid = spark.range(24 * 24).select(
        "id", (F.col("id") % 24 * 0.5 - 0.75).alias("x"), (F.floor(F.col("id") / 24) * 0.5 - 0.75).alias("y")
    )
    inside = rg.containing_polygon(grid, edges, ["id"]).filter("region = 0").count()
    assert inside * 0.25 == 96.0


def test_time_zone_rules(spark, tmp_path):
    box = lambda off, y0, y1: [f"5,{off},Z"] + [f"{x},{y}" for x, y in [(-90, y0), (-80, y0), (-80, y1), (-90, y1), (-90, y0)]]
    lines = box(-6, 30, 35) + box(-6, 36, 40) + box(-5, 44, 50)
    (tmp_path / "tz.csv").write_text("\n".join(lines) + "\n")
    vertices = bd.read_zone_lines(spark, str(tmp_path / "tz.csv"))
    assert vertices.select("zone_id").distinct().count() == 3
    points = [(1, -85.0, 32.0), (2, -85.0, 35.5), (3, -85.0, 42.0), (4, -85.0, 45.0), (5, 100.0, 0.0)]
    got = rg.time_zone(spark.createDataFrame(points, "id INT, Lon DOUBLE, Lat DOUBLE"), bd.zone_edges(vertices), ["id"])
    assert {r.id: r.gmt_offset for r in got.collect()} == {1: -6, 2: -6, 3: -6, 4: -5, 5: 7}


def test_calendar(spark):
    df = spark.createDataFrame([(2012366,), (2011366,), (2011000,), (2011059,)], "f INT")
    dates = [r[0] for r in df.select(cal.julian_date("f")).collect()]
    assert dates == [dt.date(2012, 12, 31), None, None, dt.date(2011, 2, 28)]
    assert cal.month_set_label([9, 8, 7], 2011) == "JAS_2011"
    assert cal.month_set_label([1, 2], 2011) == "2011[1, 2]"
    assert cal.month_set_label(None, 2011, [dt.date(2011, 4, 1), dt.date(2011, 10, 31)]) == "20110401_20111031"
    assert cal.month_set_label([]) == "UNSPECIFIED"
    days = spark.createDataFrame([(dt.date(2011, m, 15),) for m in range(1, 13)], "d DATE")
    winter = days.filter(cal.in_wrapping_range("d", "11-15", "02-10")).count()
    assert winter == 3


def test_identities(spark):
    df = spark.createDataFrame([(50.0, 50.0), (0.0, 3.0), (40.0, None)], "mod DOUBLE, obs DOUBLE")
    rows = df.select(
        "mod",
        oz.ratio_fusion("mod", oz.response_ratio("obs", "mod")).alias("e"),
        oz.additive_fusion("mod", oz.model_bias("mod", "obs")).alias("a"),
    ).collect()
    assert (rows[0].e, rows[0].a) == (50.0, 50.0)
    assert (rows[1].e, rows[1].a) == (None, 3.0)
    assert (rows[2].e, rows[2].a) == (None, None)
    bins = spark.createDataFrame([(-1.0,), (0.0,), (40.0,), (40.1,), (80.0,), (81.0,), (None,)], "v DOUBLE")
    assert [r[0] for r in bins.select(oz.exposure_bin("v")).collect()] == [None, "< 40", "< 40", "40-50", "70-80", "> 80", None]


def test_score_cube_levels_come_from_rows(spark):
    rows = [("d1", 1, 1.0, 2.0), ("d1", 2, 4.0, 4.0), ("d2", 1, 3.0, 5.0), ("d2", 2, 8.0, 7.0)]
    df = spark.createDataFrame(rows, "Timestamp STRING, Fold INT, y DOUBLE, p DOUBLE")
    got = {(r.Timestamp, r.Fold): r for r in cp.score_cube(df, "y", "p").collect()}
    assert len(got) == 9
    assert got[("Mean", "Mean")].MB == pytest.approx((1 + 0 + 2 - 1) / 4)
    assert got[("d1", "Mean")].RMSE == pytest.approx(math.sqrt(0.5))
    assert got[("d1", "1")].R2 is None


def test_set_audit_of_identical_and_disjoint_sets(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "Date INT, Site STRING")
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "d")], "Date INT, Site STRING")
    got = {r.Date: (r.common, r.only_left, r.only_right, r.left_covers) for r in au.site_set_audit(a, b, "Date", "Site").collect()}
    assert got == {1: (2, 0, 0, True), 2: (0, 1, 1, False)}
    empty = a.filter("Date > 9")
    assert all(r.common == 0 for r in au.site_set_audit(a, empty, "Date", "Site").collect())


def test_positions_cover_each_group(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id")).alias("n"))
    rows = au.positions(df, ["g"], "n").collect()
    for g in range(3):
        mine = sorted((r.n, r._p) for r in rows if r.g == g)
        assert [p for _, p in mine] == list(range(1000))


def test_folds(spark):
    sites = spark.createDataFrame([(d, f"s{i}") for d in (1, 2) for i in range(23)], "Date INT, Site STRING")
    sizes = equal_site_folds(sites, "Date", "Site", 10).groupBy("Date", "CVgroup").count().collect()
    assert sorted(r["count"] for r in sizes) == [2] * 14 + [3] * 6
    again = [hash_folds(sites, ["Site", "Date"], 5).orderBy("Date", "Site").collect() for _ in range(2)]
    assert again[0] == again[1]
    assert {r.CVgroup for r in again[0]} == {1, 2, 3, 4, 5}


def test_points_of_one_strip(spark):
    ring = [(1, p, float(x), float(y)) for p, (x, y) in enumerate([(0, 0), (6, 0), (6, 1), (0, 1), (0, 0)])]
    edges = rg.ring_edges(spark.createDataFrame(ring, "poly_id INT, pos INT, x DOUBLE, y DOUBLE"), ["poly_id"])
    points = spark.range(4000).select("id", (F.col("id") / 400.0).alias("x"), F.lit(0.5).alias("y"))
    found = rg.containing_polygon(points, edges, ["id"]).filter("region = 1")
    assert found.count() == 2400 and found.agg(F.max("id")).first()[0] == 2399


def test_replacement_survives_a_stop_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path + ".old")
    sk.recover_table(spark, path)
    assert spark.read.parquet(path).count() == 5
    sk.replace_table(spark.range(7).toDF("id"), path)
    assert spark.read.parquet(path).count() == 7
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_resume_with_odd_partition_values(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a b/c", 1, 1), (None, 2, 2), ("x=y", 3, 3)], "k STRING, m INT, v INT")
    sk.write_missing(df.filter("v < 3"), path, ["k", "m"])
    sk.write_missing(df.withColumn("v", F.col("v") + 10), path, ["k", "m"])
    rows = sorted(((r.k, r.m, r.v) for r in spark.read.parquet(path).collect()), key=str)
    assert rows == sorted([("a b/c", 1, 1), (None, 2, 2), ("x=y", 3, 13)], key=str)


def test_replace_and_resume(spark):
    path = scratch_path(spark, "t")
    spark.range(5).write.parquet(path)
    sk.replace_table(spark.read.parquet(path).filter("id < 3"), path)
    assert spark.read.parquet(path).count() == 3
    out = scratch_path(spark, "t")
    df = spark.range(6).select((F.col("id") % 2).cast("int").alias("k"), "id")
    sk.write_missing(df.filter("k = 0"), out, ["k"])
    sk.write_missing(df.withColumn("id", F.col("id") + 100), out, ["k"])
    assert {r.k: r.m for r in spark.read.parquet(out).groupBy("k").agg(F.max("id").alias("m")).collect()} == {0: 4, 1: 105}
    assert cut_lineage(df).count() == 6


def test_hourly_range_prunes_years_and_reaches_the_scan(spark, tmp_path):
    """The local range is widened by the offsets that occur; only its years are read."""
    from pyspark.sql import functions as F

    from skyweave.plans.fusion import local_rows_in_range

    rows = [(f"s{i % 3}", f"{y}-{m:02d}-15 12:00:00", 1.0, y) for i, (y, m) in enumerate((y, m) for y in range(2008, 2014) for m in range(1, 13))]
    rows += [("s0", "2010-12-31 20:00:00", 2.0, 2010), ("s0", "2010-12-31 14:00:00", 3.0, 2010)]
    df = spark.createDataFrame(rows, "site_id string, t string, O3 double, Year int").withColumn("dateon", F.col("t").cast("timestamp_ntz")).drop("t")
    df.write.partitionBy("Year").parquet(str(tmp_path / "obs"))
    offsets = spark.createDataFrame([("s0", -5.0), ("s1", -9.0), ("s2", None)], "site_id string, gmt_offset double")
    stored = spark.read.parquet(str(tmp_path / "obs"))
    near = local_rows_in_range(stored, offsets, "2011-01-01 02:00:00", "2011-02-28 00:00:00", year="Year")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan.replace("PartitionFilters: [Year", "PartitionFilters: [isnotnull(Year") and "GreaterThanOrEqual(dateon" in plan
    assert sorted((r.Year, r.O3) for r in near.collect()) == [(2010, 2.0), (2011, 1.0), (2011, 1.0)]


def ring(points):
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def test_polygons_by_tiles_equal_every_edge_test(spark):
    """Star and holed polygons, level and upright edges on tile borders, points of all tiles, against plain parity."""
    rng = np.random.default_rng(6)
    star = [(10 + (6 if i % 2 else 2.5) * np.cos(i * np.pi / 9), 8 + (6 if i % 2 else 2.5) * np.sin(i * np.pi / 9)) for i in range(18)]
    shapes = {0: ring(star), 1: ring([(2.0, 1.0), (18.0, 1.0), (18.0, 15.0), (2.0, 15.0)]) + ring([(5.0, 3.0), (7.5, 3.0), (7.5, 4.0), (5.0, 4.0)])}
    edges = spark.createDataFrame([(k, *map(float, e)) for k, es in shapes.items() for e in es], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 20, (3000, 2)))]
    points += [(5000 + i, a, b) for i, (a, b) in enumerate([(2.0, 1.0), (2.0, 5.0), (18.0, 5.0), (6.0, 3.0), (6.0, 4.0), (5.0, 3.5), (7.5, 3.5), (10.0, 15.0), (3.0, 2.0)])]

    def parity(es, px, py):
        return sum(((y1 <= py) != (y2 <= py)) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in es if y1 != y2) % 2

    want = {i: next((k for k in (0, 1) if parity(shapes[k], px, py)), -999) for i, px, py in points}
    df = spark.createDataFrame(points, "id int, x double, y double")
    for width in (1.0, 0.3, 25.0):
        assert {r.id: r.region for r in rg.containing_polygon(df, edges, ["id"], width=width).collect()} == want


def test_points_of_one_tile_meet_no_edge(spark, monkeypatch):
    """All points in one inner tile: a single point of it meets the edges; a crowded strip is split by its count."""
    met = []
    original = rg._meet
    monkeypatch.setattr(rg, "_meet", lambda points, edges, point: met.append(points.count()) or original(points, edges, point))
    monkeypatch.setattr(rg, "SHARE", 100)
    square = spark.createDataFrame([(3, *map(float, e)) for e in ring([(0, 0), (10, 0), (10, 10), (0, 10)])], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    inner = spark.range(2000).select(F.col("id"), (F.lit(5.0) + F.col("id") / 4000).alias("x"), F.lit(5.2).alias("y"))
    assert rg.containing_polygon(inner, square, ["id"]).filter("region = 3").count() == 2000
    assert met == [1, 0]
    edge = spark.range(2000).select(F.col("id"), (F.lit(9.0) + F.col("id") / 4000).alias("x"), F.lit(0.2).alias("y"))
    assert rg.containing_polygon(edge, square, ["id"]).filter("region = 3").count() == 2000
    assert met[2:] == [0, 2000]


def test_key_sets_are_dealt_by_their_size(spark, monkeypatch):
    from skyweave import session
    from skyweave.operators import audit as au
    from skyweave.operators import combine as co

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    a = spark.createDataFrame([(f"s{i}", i % 3) for i in range(60)] + [(None, 1)], "Site string, Date int")
    b = spark.createDataFrame([(f"s{i}", i % 3) for i in range(20, 70)] + [(None, 1)], "Site string, Date int")
    both = co.two_way_difference(a, b, ["Site", "Date"])
    assert both.rdd.getNumPartitions() == 12
    # As in EXCEPT, a NULL key is on both sides.
    want = [(f"s{i}", i % 3, "left" if i < 20 else "right") for i in (*range(20), *range(60, 70))]
    assert sorted(map(tuple, both.collect())) == sorted(want)
    got = {r.Date: (r.common, r.only_left, r.only_right, r.left_covers) for r in au.site_set_audit(a, b, "Date", "Site").collect()}
    assert got == {0: (13, 7, 4, False), 1: (13, 8, 4, False), 2: (14, 6, 3, False)}
