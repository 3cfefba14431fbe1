"""Radix selection and the one-pass period state against NumPy and pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from skyweave.operators import radix
from skyweave.operators.periodstate import PartialState, period_states, top_and_period_means
from skyweave.operators.quantiles import exact_percentiles
from pyspark.sql import functions as F

WANTED = {"p0": ("v", 0.0), "p02": ("v", 0.02), "p50": ("v", 0.5), "p98": ("v", 0.98), "p100": ("v", 1.0), "w50": ("w", 0.5)}


def check(spark, groups):
    rows = [(k, v, w) for k, pairs in groups.items() for v, w in pairs]
    df = spark.createDataFrame(rows, "key string, v double, w double").repartition(5)
    got = {r.key: r for r in exact_percentiles(df, ["key"], WANTED).collect()}
    assert set(got) == set(groups)
    for k, pairs in groups.items():
        for out, (column, p) in WANTED.items():
            values = [x["vw".index(column)] for x in pairs]
            values = [x for x in values if x is not None and not math.isnan(x)]
            if not values:
                assert got[k][out] is None
            else:
                want = float(np.quantile(values, p))
                assert got[k][out] == want or math.isclose(got[k][out], want, rel_tol=1e-12, abs_tol=1e-300)


def test_percentiles_are_numpys(spark):
    rng = np.random.default_rng(1)
    both = lambda v: [(float(x), float(-x)) for x in v]
    check(
        spark,
        {
            "normal": both(rng.standard_normal(5000)),
            "outlier": both([*rng.random(500), 1e300, -1e300]),
            "near": both(1e6 + rng.random(3000) * 1e-7),
            "ties": both(rng.integers(0, 3, 2000)),
            "signs": both([-0.0, 0.0, 1e-310, -1e-310, 5e-324]),
            "one": both([7.5]),
            "two": both([7.5, -3]),
            "wide": both([-1.7e308, 1.7e308, 0.0, 1.0]),
            "gaps": [(None, 1.0), (math.nan, None), (2.0, None), (3.0, math.nan)],
            "none": [(None, None), (math.nan, None)],
            None: both([1, 2, 3, 4]),
        },
    )


def test_percentiles_of_all_rows_and_of_none(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert exact_percentiles(df, [], {"q": ("v", 0.25)}).collect()[0].q == 250.0
    assert exact_percentiles(df.withColumn("k", F.lit(1)).limit(0), ["k"], {"q": ("v", 0.25)}).collect() == []


def test_a_dominating_group_is_only_counted(spark):
    """The plan sorts, samples and writes no values; what is written has a row per group and percentile."""
    written = []
    original = radix.cut_lineage

    def counted(df):
        out = original(df)
        written.append(out.count())
        return out

    radix.cut_lineage = counted
    try:
        df = spark.range(200_000).select((F.col("id") % 1000 == 0).alias("k"), F.rand(1).alias("v"))
        got = {r.k: r for r in exact_percentiles(df, ["k"], {"a": ("v", 0.98), "b": ("v", 0.5)}).collect()}
    finally:
        radix.cut_lineage = original
    assert 2 <= len(written) <= 4 and max(written) <= 4
    values = df.toPandas().groupby("k")["v"]
    for k, v in values:
        assert math.isclose(got[k].a, np.quantile(v, 0.98)) and math.isclose(got[k].b, np.quantile(v, 0.5))


def test_leading_bits_rise_with_the_value(spark):
    values = [-math.inf, -1e308, -3.0, -1.0, -1e-310, -5e-324, 0.0, 5e-324, 1e-310, 0.1, 0.1000001, 1.0, 1.05, 1.2, 3.0, 1e308, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r.b for r in df.select("v", radix.leading_bits(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins) and len(set(bins)) > 10


def frame(rng, rows, keys):
    days = [dt.date(2010, 1, 1) + dt.timedelta(int(d)) for d in rng.integers(0, 800, rows)]
    v = np.where(rng.random(rows) < 0.1, np.nan, rng.random(rows).round(2))
    return pd.DataFrame({"k": rng.choice(keys, rows), "d": days, "v": v, "w": rng.standard_normal(rows)})


@pytest.mark.parametrize("small", [False, True])
def test_period_rows_are_pandas(spark, small, monkeypatch):
    if small:  # states are reduced and passed on many times
        monkeypatch.setattr("skyweave.operators.periodstate.ROWS", 50)
        monkeypatch.setattr("skyweave.operators.periodstate.ENTRIES", 40)
    table = frame(np.random.default_rng(4), 4000, ["a", "b", "c"])
    table.loc[table.k == "c", "v"] = np.nan
    rows = [tuple(None if x != x else x for x in r) for r in table.itertuples(index=False)] + [("a", None, 99.0, None), (None, dt.date(2011, 7, 1), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, d date, v double, w double").repartition(3)
    got = {(r.k, r.Period, r.Year): (r.v, r.w) for r in top_and_period_means(df, ["k"], "d", ["v", "w"]).collect()}
    seasons = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA"}
    want = {}
    for k, part in pd.DataFrame(rows, columns=list("kdvw")).groupby("k", dropna=False):
        k = None if k != k else k
        top = lambda c: part[c].dropna().nlargest(10)
        want[k, "top-10", None] = (top("v").mean(), top("w").mean())
        dated = part[part.d.notna()]
        months = dated.d.map(lambda d: d.month)
        for name, chosen in {
            **{s: months.map(lambda m: seasons.get(m, "SON")) == s for s in ("DJF", "MAM", "JJA", "SON")},
            "Apr-Sep": months.between(4, 9),
        }.items():
            if chosen.any():
                want[k, name, None] = (dated[chosen].v.mean(), dated[chosen].w.mean())
        for year, own in dated.groupby(dated.d.map(lambda d: d.year)):
            want[k, "Annual", year] = (own.v.mean(), own.w.mean())
    assert set(got) == set(want)
    for key, pair in want.items():
        for mine, theirs in zip(got[key], pair):
            assert (mine is None and theirs != theirs) or math.isclose(mine, theirs, rel_tol=1e-9)


def test_state_is_bounded_and_one_exchange(spark):
    df = spark.range(50_000).select(
        (F.col("id") % 7).cast("int").alias("k"), F.date_add(F.lit("2011-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("d"),
        F.rand(2).alias("v"),
    )
    means = top_and_period_means(df, ["k"], "d", ["v"])
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1
    states = period_states(df, ["k"], "d", ["v"], n=3).collect()
    assert len(states) == 7 and all(len(r.t0) == 3 for r in states)


def test_partial_states_of_parts_equal_that_of_the_whole():
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"k0": pd.array(rng.integers(0, 5, 900), dtype="Int32"), "ym": rng.integers(0, 24, 900), "c0": rng.random(900)})
    rows.loc[:20, "k0"] = pd.NA
    whole, parts = PartialState(["k0"], 1, 4), PartialState(["k0"], 1, 4)
    whole.add(rows)
    for at in range(0, 900, 100):
        parts.add(rows.iloc[at : at + 100])
    assert whole.groups["k0"].equals(parts.groups["k0"]) and (whole.of == parts.of).all() and (whole.ym == parts.ym).all()
    assert np.allclose(whole.sums, parts.sums) and (whole.counts == parts.counts).all()
    assert all((a == b).all() for a, b in zip(whole.tops[0], parts.tops[0]))
