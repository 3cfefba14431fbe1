"""Queries: spread, regression, error statistics, trends, ranges, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.operators import compare as cp
from skyweave.operators import trend as tr
from skyweave.operators.combine import densify

C = fx.METRIC_COLUMNS
FLOATS = " ".join(C)
KEYS = ["ROW", "COL", "Period"]
PAIRED = [*KEYS, "Pair"]
_LIMIT = {"harvard_ml": 1999}


_LIST = "[" + ", ".join(C) + "]"


@query(
    "a24_method_spread",
    f"""SELECT ROW, COL, Period, SD, CASE WHEN m <> 0 THEN SD / m * 100 END AS CV FROM (SELECT ROW, COL, Period, avg(s) AS SD, avg(a) AS m FROM
 (SELECT ROW, COL, Period, CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END AS s, list_avg(v) AS a FROM
 (SELECT ROW, COL, Period, list_filter({_LIST}, lambda x: x IS NOT NULL) AS v FROM metrics)) GROUP BY ROW, COL, Period)""",
    "metrics",
    "SD CV",
)
def _(spark, sf):
    return cp.method_spread(fx.metrics(spark, sf), KEYS, C)


def _slope_sql(c: str) -> str:
    limit = f" AND a.\"Year\" <= {_LIMIT[c]} AND b.\"Year\" <= {_LIMIT[c]}" if c in _LIMIT else ""
    own = f' FILTER ("Year" <= {_LIMIT[c]})' if c in _LIMIT else ""
    return f"""(SELECT k.ROW, k.COL, k.Period, CASE WHEN k.n = k.v THEN s.s END AS {c} FROM
 (SELECT ROW, COL, Period, count(*){own} AS n, count({c}){own} AS v FROM metrics GROUP BY ALL) k LEFT JOIN
 (SELECT a.ROW, a.COL, a.Period, median((b.{c} - a.{c}) / (b."Year" - a."Year")) AS s FROM metrics a JOIN metrics b
 ON a.ROW = b.ROW AND a.COL = b.COL AND a.Period = b.Period AND b."Year" > a."Year"{limit} GROUP BY ALL) s USING (ROW, COL, Period))"""


@query(
    "a25_median_slope",
    f"SELECT * FROM {_slope_sql('model')} JOIN {_slope_sql('ds_ozone')} USING (ROW, COL, Period) JOIN {_slope_sql('harvard_ml')} USING (ROW, COL, Period)",
    "metrics",
    "model ds_ozone harvard_ml",
)
def _(spark, sf):
    return tr.median_slope(
        fx.metrics(spark, sf), KEYS, ["model", "ds_ozone", "harvard_ml"], last_year=_LIMIT
    )


_REG = "regr_slope(y, x) AS Slope, regr_intercept(y, x) AS Intercept, regr_r2(y, x) AS R_squared"
_ERR = "sqrt(avg((y - x) * (y - x))) AS RMSE, avg(y - x) AS MB, avg(abs(y - x)) AS MAE"


@query(
    "a26_linear_regression",
    f"SELECT CVgroup, {_REG} FROM (SELECT CVgroup, Conc AS x, ds_ozone AS y FROM cv_result WHERE Conc IS NOT NULL AND ds_ozone IS NOT NULL) GROUP BY CVgroup",
    "cv_result",
    "Slope Intercept R_squared",
)
def _(spark, sf):
    return cp.paired(fx.cv_result(spark, sf), "Conc", "ds_ozone").groupBy("CVgroup").agg(
        *cp.regression("Conc", "ds_ozone")
    )


@query(
    "a27_error_statistics",
    f"SELECT CVgroup, {_ERR} FROM (SELECT CVgroup, Conc AS x, ds_ozone AS y FROM cv_result WHERE ds_ozone IS NOT NULL) GROUP BY CVgroup",
    "cv_result",
    "RMSE MB MAE",
)
def _(spark, sf):
    return cp.paired(fx.cv_result(spark, sf), "Conc", "ds_ozone").groupBy("CVgroup").agg(
        *cp.errors("Conc", "ds_ozone")
    )


_R2 = "1 - sum((x - y) * (x - y)) / (var_pop(x) * count(*))"


@query(
    "a28_r2_score",
    f'SELECT "Date", CVgroup, CASE WHEN var_pop(x) > 0 THEN {_R2} END AS R2 FROM (SELECT date_trunc(\'month\', "Date")::DATE AS "Date", CVgroup, Conc AS x, vna_ozone AS y FROM cv_result) GROUP BY ALL',
    "cv_result",
    "R2",
)
def _(spark, sf):
    monthly = fx.cv_result(spark, sf).withColumn("Date", F.trunc("Date", "month"))
    return monthly.groupBy("Date", "CVgroup").agg(cp.r2_score("Conc", "vna_ozone").alias("R2"))


@query(
    "a29_score_cube",
    f"""SELECT CASE WHEN grouping(t) = 1 THEN 'Mean' ELSE t END AS "Timestamp", CASE WHEN grouping(f) = 1 THEN 'Mean' ELSE f END AS Fold,
 count(*) AS n, CASE WHEN var_pop(x) > 0 THEN {_R2} END AS R2, {_ERR} FROM (SELECT CAST(date_trunc('month', "Date")::DATE AS VARCHAR) AS t, CAST(CVgroup AS VARCHAR) AS f, Conc AS x, vna_ozone AS y FROM cv_result)
 GROUP BY CUBE (t, f)""",
    "cv_result",
    "R2 RMSE MB MAE",
)
def _(spark, sf):
    rows = fx.cv_result(spark, sf).select(
        F.trunc("Date", "month").alias("Timestamp"), F.col("CVgroup").alias("Fold"), "Conc", "vna_ozone"
    )
    return cp.score_cube(rows, "Conc", "vna_ozone")


def _pair_sql() -> str:
    from itertools import combinations

    return " UNION ALL ".join(
        f"SELECT '{a} vs {b}' AS pair, ROW, COL, \"Year\", Period, {a} AS x, {b} AS y FROM metrics"
        for a, b in combinations(C, 2)
    )


@query(
    "a30_comparison_table",
    f"""SELECT pair AS Variable_Pair, Period, round(regr_r2(y, x) + 1.3e-9, 2) AS R_squared, round(sqrt(avg((y - x) * (y - x))) + 1.3e-9, 2) AS RMSE,
 round(avg(y - x) + 1.3e-9, 2) AS MB, round(regr_slope(y, x) + 1.3e-9, 2) AS Slope FROM ({_pair_sql()}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY pair, Period""",
    "metrics",
    "R_squared RMSE MB Slope",
    digits=4,
)
def _(spark, sf):
    return cp.comparison_table(fx.metrics(spark, sf), C)


@query(
    "f24_pair_differences",
    f"SELECT ROW, COL, \"Year\", Period, pair, y - x AS diff FROM ({_pair_sql()})",
    "metrics",
    "diff",
)
def _(spark, sf):
    return cp.pair_differences(fx.metrics(spark, sf), ["ROW", "COL", "Year", "Period"], C)


@query(
    "j28_paired_metric_tables",
    """SELECT ROW, COL, Period, Pair, a.model AS x, b.model AS y, b.model - a.model AS diff FROM metrics_even a JOIN metrics_odd b USING (ROW, COL, Period, Pair)""",
    "metrics_even metrics_odd",
    "x y diff",
)
def _(spark, sf):
    a, b = fx.metric_sides(spark, sf)
    a, b = a.select(*PAIRED, F.col("model").alias("x")), b.select(*PAIRED, F.col("model").alias("y"))
    return a.join(b, PAIRED).withColumn("diff", F.col("y") - F.col("x"))


_TWO = """SELECT ROW, COL, Period, Pair, {cols} FROM (SELECT *, 1 AS a FROM metrics_even) x
 FULL JOIN (SELECT *, 1 AS b FROM metrics_odd) y USING (ROW, COL, Period, Pair)"""


@query(
    "f23_year_over_base",
    _TWO.format(cols=", ".join(f"y.{c} - x.{c} AS {c}" for c in C) + ", (a IS NOT NULL AND b IS NOT NULL) AS matched"),
    "metrics_even metrics_odd",
    FLOATS,
)
def _(spark, sf):
    return cp.year_over_base(*fx.metric_sides(spark, sf), PAIRED, C)


@query(
    "j16_unmatched_keys",
    "SELECT count(*) AS keys, count(*) FILTER (a IS NULL OR b IS NULL) AS unmatched FROM ("
    + _TWO.format(cols="a, b")
    + ")",
    "metrics_even metrics_odd",
)
def _(spark, sf):
    return cp.unmatched_keys(*fx.metric_sides(spark, sf), PAIRED)


_BD = _TWO.format(
    cols=", ".join(f"x.{c} AS {c}_base, y.{c} AS {c}_delta" for c in ("model", "vna_ozone"))
)
_J13 = f"SELECT * FROM ({_BD}) WHERE Period <> 'W126'"


def base_delta(spark, sf):
    return cp.base_and_delta(*fx.metric_sides(spark, sf), PAIRED, ["model", "vna_ozone"])


@query(
    "j13_base_and_delta",
    _J13,
    "metrics_even metrics_odd",
    "model_base model_delta vna_ozone_base vna_ozone_delta",
)
def _(spark, sf):
    return base_delta(spark, sf)


def _bin(c: str) -> str:
    return f"""CASE WHEN {c} < 0 THEN NULL WHEN {c} <= 40 THEN '< 40' WHEN {c} <= 50 THEN '40-50' WHEN {c} <= 60 THEN '50-60'
 WHEN {c} <= 70 THEN '60-70' WHEN {c} <= 80 THEN '70-80' WHEN {c} IS NOT NULL THEN '> 80' END"""


_BINNED = (
    f", bd AS ({_J13}), long AS ("
    + " UNION ALL ".join(
        f"SELECT ROW, COL, Period, Pair, {_bin(c + '_base')} AS bin, {c}_delta AS delta, '{c}' AS \"method\" FROM bd"
        for c in ("model", "vna_ozone")
    )
    + "), l AS (SELECT * FROM long WHERE bin IS NOT NULL AND delta IS NOT NULL)"
)


@query("r06_binned_deltas", _BINNED + " SELECT * FROM l", "metrics_even metrics_odd", "delta")
def _(spark, sf):
    return cp.binned_deltas(base_delta(spark, sf), PAIRED, ["model", "vna_ozone"])


@query(
    "a50_box_statistics",
    _BINNED
    + """, q AS (SELECT Period, bin, "method", quantile_cont(delta, 0.25) AS q1, quantile_cont(delta, 0.5) AS median, quantile_cont(delta, 0.75) AS q3 FROM l GROUP BY ALL)
 SELECT Period, bin, "method", q1, median, q3, count(*) AS n, min(delta) FILTER (delta >= q1 - 1.5 * (q3 - q1) AND delta <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(delta) FILTER (delta >= q1 - 1.5 * (q3 - q1) AND delta <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (NOT (delta >= q1 - 1.5 * (q3 - q1) AND delta <= q3 + 1.5 * (q3 - q1))) AS outliers
 FROM l JOIN q USING (Period, bin, "method") GROUP BY ALL""",
    "metrics_even metrics_odd",
    "q1 median q3 whisker_low whisker_high",
)
def _(spark, sf):
    long = cp.binned_deltas(base_delta(spark, sf), PAIRED, ["model", "vna_ozone"])
    return cp.box_statistics(long, ["Period", "bin", "method"], "delta")


_SERIES_COLS = ["vna_ozone", "model", "harvard_ml"]


def _series_avg(c: str) -> str:
    return f'avg({c}) FILTER ("Year" <= {_LIMIT[c]}) AS {c}' if c in _LIMIT else f"avg({c}) AS {c}"


_SERIES = f""", j AS (SELECT m.*, ClimateRegion FROM metrics m LEFT JOIN climate_region USING (ROW, COL)),
 series AS (SELECT Period, ClimateRegion AS Region, "Year", {", ".join(_series_avg(c) for c in _SERIES_COLS)} FROM j WHERE ClimateRegion BETWEEN 0 AND 8 GROUP BY ALL
 UNION ALL SELECT Period, 9 AS Region, "Year", {", ".join(_series_avg(c) for c in _SERIES_COLS)} FROM j GROUP BY ALL)"""


def series(spark, sf):
    return tr.region_series(fx.metrics(spark, sf), fx.climate_region(spark, sf), _SERIES_COLS, _LIMIT)


@query("a38_region_series", _SERIES + " SELECT * FROM series", "metrics climate_region", " ".join(_SERIES_COLS))
def _(spark, sf):
    return series(spark, sf)


_LONG_SERIES = """, ls AS (SELECT * FROM series UNPIVOT INCLUDE NULLS (v FOR \"method\" IN (vna_ozone, model, harvard_ml)))"""


@query(
    "a38_series_all_years",
    _SERIES
    + _LONG_SERIES
    + """ SELECT k.Period, k.Region, k."method", CAST(k.y AS INTEGER) AS "Year", ls.v FROM (SELECT * FROM (SELECT DISTINCT Period, Region, "method" FROM ls) CROSS JOIN (SELECT unnest(range(1994, 2004)) AS y) g) k
 LEFT JOIN ls ON k.Period = ls.Period AND k.Region = ls.Region AND k."method" = ls."method" AND k.y = ls."Year" """,
    "metrics climate_region",
    "v",
)
def _(spark, sf):
    return tr.all_years(series(spark, sf), 1994, 2003, _SERIES_COLS)


@query(
    "r07_year_matrix",
    _SERIES
    + _LONG_SERIES
    + ' SELECT Period, Region, "method", '
    + ", ".join(f'max(v) FILTER ("Year" = {y}) AS y{y}' for y in range(1995, 2002))
    + " FROM ls GROUP BY ALL",
    "metrics climate_region",
    " ".join(f"y{y}" for y in range(1995, 2002)),
)
def _(spark, sf):
    return tr.year_matrix(series(spark, sf), 1995, 2001, _SERIES_COLS)


@query(
    "a39_legend_bounds",
    _SERIES
    + " SELECT CASE WHEN Period = 'top-10' THEN 'top-10' ELSE 'other' END AS legend, min(least(vna_ozone, model, harvard_ml)) AS low, max(greatest(vna_ozone, model, harvard_ml)) AS high FROM series GROUP BY ALL",
    "metrics climate_region",
    "low high",
)
def _(spark, sf):
    return tr.legend_bounds(series(spark, sf), _SERIES_COLS)


_POOL = """, l AS (UNPIVOT (SELECT "Year", CASE WHEN Period = 'top-10' THEN 'top-10' ELSE 'not top-10' END AS "class", vna_ozone, evna_ozone, avna_ozone, model FROM metrics)
 ON vna_ozone, evna_ozone, avna_ozone, model INTO NAME name VALUE v),
 yr AS (SELECT "Year", "class", quantile_cont(v, 0.005) AS p_low, quantile_cont(v, 0.995) AS p_high, min(v) AS "min", max(v) AS "max" FROM l GROUP BY ALL)"""


@query(
    "a40_pooled_ranges",
    _POOL
    + """ SELECT CAST("Year" AS VARCHAR) AS "Year", "class", p_low, p_high, "min", "max" FROM yr
 UNION ALL SELECT 'Mean', "class", avg(p_low), avg(p_high), avg("min"), avg("max") FROM yr GROUP BY "class" """,
    "metrics",
    "p_low p_high min max",
)
def _(spark, sf):
    return tr.pooled_ranges(fx.metrics(spark, sf), fx.METHODS)


@query(
    "a41_display_range",
    'SELECT "Year", Period, quantile_cont(vna_ozone, 0.005) AS v_min, quantile_cont(vna_ozone, 0.995) AS v_max FROM metrics GROUP BY "Year", Period',
    "metrics",
    "v_min v_max",
)
def _(spark, sf):
    return tr.display_range(fx.metrics(spark, sf), ["Year", "Period"], "vna_ozone")


@query(
    "a41_looked_up_range",
    _POOL
    + """, own AS (SELECT "Year", Period, quantile_cont(vna_ozone, 0.005) AS v_min, quantile_cont(vna_ozone, 0.995) AS v_max FROM metrics GROUP BY "Year", Period)
 SELECT o."Year", Period, coalesce(p_low, v_min) AS v_min, coalesce(p_high, v_max) AS v_max FROM own o LEFT JOIN (SELECT * FROM yr WHERE "Year" <= 1998) s
 ON s."Year" = o."Year" AND s."class" = CASE WHEN o.Period = 'top-10' THEN 'top-10' ELSE 'not top-10' END""",
    "metrics",
    "v_min v_max",
)
def _(spark, sf):
    m = fx.metrics(spark, sf)
    stored = tr.pooled_ranges(m.filter(F.col("Year") <= 1998), fx.METHODS).filter(F.col("Year") != "Mean")
    stored = stored.withColumn("Year", F.col("Year").try_cast("int"))
    return tr.looked_up_range(m, ["Year", "Period"], "vna_ozone", stored)


@query(
    "a43_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS nulls, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min", max({c}) AS "max",
 quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM fused_daily"""
        for c in fx.METHODS
    ),
    "fused_daily",
    "mean std min max q25 q50 q75",
)
def _(spark, sf):
    return cp.describe(fx.fused_daily(spark, sf), fx.METHODS)


def _both_sql(c: str) -> str:
    sides = [("x", "fused_daily WHERE month(\"Timestamp\") <= 6"), ("y", "fused_daily WHERE month(\"Timestamp\") > 6")]
    parts = []
    for s, (_, source) in enumerate(sides, 1):
        parts.append(
            f"""(SELECT count({c}) AS count{s}, count(*) - count({c}) AS nulls{s}, avg({c}) AS mean{s}, stddev_samp({c}) AS std{s}, min({c}) AS min{s}, max({c}) AS max{s},
 count(DISTINCT {c}) AS distinct{s}, quantile_cont({c}, 0.25) AS q25_{s}, quantile_cont({c}, 0.5) AS q50_{s}, quantile_cont({c}, 0.75) AS q75_{s} FROM {source})"""
        )
    shared = f"SELECT count(*) FROM (SELECT {c} FROM {sides[0][1]} AND {c} IS NOT NULL INTERSECT SELECT {c} FROM {sides[1][1]})"
    return f"SELECT '{c}' AS \"column\", *, ({shared}) AS common_distinct FROM {parts[0]}, {parts[1]}"


@query(
    "a43_describe_both",
    " UNION ALL ".join(_both_sql(c) for c in fx.METHODS),
    "fused_daily",
    "mean1 std1 min1 max1 q25_1 q50_1 q75_1 mean2 std2 min2 max2 q25_2 q50_2 q75_2",
)
def _(spark, sf):
    daily = fx.fused_daily(spark, sf)
    first = F.month("Timestamp") <= 6
    return cp.describe_both(daily.filter(first), daily.filter(~first), fx.METHODS)


@query(
    "a51_empirical_cdf",
    """SELECT model, count(*) AS n, (min(r) * 1.0 / max(t))::DOUBLE AS cdf_first, (max(r) * 1.0 / max(t))::DOUBLE AS cdf_last FROM
 (SELECT model, row_number() OVER (ORDER BY model) AS r, count(*) OVER () AS t FROM fused_daily) GROUP BY model""",
    "fused_daily",
    "cdf_first cdf_last",
)
def _(spark, sf):
    return cp.empirical_cdf(fx.fused_daily(spark, sf), "model")


_KDE = """, p AS (SELECT Conc AS x, model AS y, count(*) AS c FROM (SELECT Conc, model FROM cv_result WHERE Conc IS NOT NULL AND model IS NOT NULL) GROUP BY ALL),
 m AS (SELECT sum(c) AS n, sum(c * x) / sum(c) AS mx, sum(c * y) / sum(c) AS my FROM p),
 v AS (SELECT max(n) AS n, max(mx) AS mx, max(my) AS my, sum(c * (x - mx) * (x - mx)) / (sum(c) - 1) AS sxx, sum(c * (x - mx) * (y - my)) / (sum(c) - 1) AS sxy,
 sum(c * (y - my) * (y - my)) / (sum(c) - 1) AS syy FROM p, m),
 l AS (SELECT x, y, c, round((x - mx) / sqrt(sxx) * pow(n, 1.0 / 6) * 4) AS iu,
 round(((y - my) - sxy / sxx * (x - mx)) / sqrt(syy - sxy * sxy / sxx) * pow(n, 1.0 / 6) * 4) AS iv FROM p, v),
 nodes AS (SELECT iu, iv, sum(c) AS w FROM l GROUP BY ALL),
 d AS (SELECT a.iu, a.iv, sum(b.w * exp(-((a.iu - b.iu) * (a.iu - b.iu) + (a.iv - b.iv) * (a.iv - b.iv)) / 32)) AS density FROM nodes a, nodes b
 WHERE abs(a.iu - b.iu) <= 36 AND abs(a.iv - b.iv) <= 36 GROUP BY ALL),
 r AS (SELECT min(density) AS lo, max(density) AS hi FROM d)
 SELECT x AS Conc, y AS model, (density - lo) / (hi - lo) AS density FROM l JOIN d USING (iu, iv), r"""


@query("a52_kernel_density", _KDE, "cv_result", "density")
def _(spark, sf):
    pairs = fx.cv_result(spark, sf).select("Conc", "model")
    return cp.kernel_density(pairs, "Conc", "model")


@query(
    "a54_domain_mean",
    'SELECT "Year", Period, avg(model) AS model, avg(vna_ozone - model) AS diff FROM metrics GROUP BY "Year", Period',
    "metrics",
    "model diff",
)
def _(spark, sf):
    return fx.metrics(spark, sf).groupBy("Year", "Period").agg(
        F.avg("model").alias("model"), F.avg(F.col("vna_ozone") - F.col("model")).alias("diff")
    )


@query(
    "j12_densify_periods",
    """SELECT c.ROW, c.COL, p.Period, m.model FROM cells c CROSS JOIN (SELECT DISTINCT Period FROM metrics) p
 LEFT JOIN (SELECT ROW % 10 + 2 AS ROW, COL, Period, avg(model) AS model FROM metrics GROUP BY ALL) m ON m.ROW = c.ROW AND m.COL = c.COL AND m.Period = p.Period""",
    "metrics cells",
    "model",
)
def _(spark, sf):
    m = fx.metrics(spark, sf)
    # One row up: the first row of cells has no values.
    some = m.groupBy((F.col("ROW") % 10 + 2).alias("ROW"), "COL", "Period").agg(F.avg("model").alias("model"))
    return densify(some, fx.region(spark, sf), "Period", m)


@query(
    "j14_limited_year_slopes",
    f"SELECT * FROM {_slope_sql('harvard_ml')}",
    "metrics",
    "harvard_ml",
)
def _(spark, sf):
    return tr.median_slope(fx.metrics(spark, sf), KEYS, ["harvard_ml"], last_year=_LIMIT)
