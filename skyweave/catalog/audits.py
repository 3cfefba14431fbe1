"""Queries: completeness, audits, sorted reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.operators import audit as au
from skyweave.operators.shelves import running_blocks, step_to_next

MONTHS = {"Jan": [1], "DJF": [12, 1, 2], "Apr-Sep": [4, 5, 6, 7, 8, 9]}
_EXPECTED = "(VALUES ('Jan', 31), ('DJF', 91), ('Apr-Sep', 183)) p(Period, days)"


@query("a31_site_counts", 'SELECT "Date", count(DISTINCT Site) AS sites FROM obs_daily GROUP BY "Date"', "obs_daily")
def _(spark, sf):
    return au.distinct_sites(fx.obs_daily(spark, sf), "Site", ["Date"])


@query("a31_site_count_overall", "SELECT count(DISTINCT Site) AS sites FROM obs_daily", "obs_daily")
def _(spark, sf):
    return au.distinct_sites(fx.obs_daily(spark, sf), "Site")


@query(
    "a32_leading_sites",
    """SELECT DISTINCT Site FROM (SELECT * FROM cv_result WHERE Site IN (SELECT Site FROM cv_result GROUP BY Site HAVING count(DISTINCT "Date") >= 10)
 ORDER BY ds_ozone DESC NULLS LAST, Site, "Date" LIMIT 10)""",
    "cv_result",
)
def _(spark, sf):
    return au.leading_sites(fx.cv_result(spark, sf), "Site", "Date", "ds_ozone")


@query(
    "a33_full_days",
    "SELECT count(*) FILTER (h = 24) AS complete, count(*) FILTER (h < 24) AS incomplete FROM (SELECT site_id, dateon::DATE AS d, count(DISTINCT hour(dateon)) AS h FROM event_hours GROUP BY ALL)",
    "event_hours",
)
def _(spark, sf):
    return au.full_days(fx.event_hours(spark, sf), "site_id", "dateon")


_SITES9 = "(SELECT CAST(s_suppkey + 1 AS VARCHAR) AS site_id FROM supplier)"


def _missing(present: str, per_day: int) -> str:
    return f"""SELECT s.site_id, p.Period, p.days * {per_day} - coalesce(n, 0) AS missing FROM {_SITES9} s CROSS JOIN {_EXPECTED} LEFT JOIN
 (SELECT site_id, Period, {present} AS n FROM event_hours JOIN (VALUES ('Jan', 1), ('DJF', 1), ('DJF', 2), ('DJF', 12), ('Apr-Sep', 4)) m(Period, mo) ON mo = month(dateon) WHERE year(dateon) = 2024 GROUP BY ALL) e
 ON e.site_id = s.site_id AND e.Period = p.Period"""


def all_sites(spark, sf):
    return fx.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).cast("string").alias("site_id"))


@query("a34_missing_hours", _missing("count(DISTINCT dateon)", 24), "event_hours")
def _(spark, sf):
    return au.missing_time(
        fx.event_hours(spark, sf), all_sites(spark, sf), "site_id", "dateon", 2024, MONTHS
    )


@query("a35_missing_days", _missing("count(*)", 1), "event_hours")
def _(spark, sf):
    return au.missing_time(
        fx.event_hours(spark, sf), all_sites(spark, sf), "site_id", "dateon", 2024, MONTHS, hourly=False
    )


@query(
    "a36_site_set_audit",
    """SELECT coalesce(a."Date", b."Date") AS "Date", count(*) FILTER (a.Site IS NOT NULL AND b.Site IS NOT NULL) AS common, count(*) FILTER (b.Site IS NULL) AS only_left,
 count(*) FILTER (a.Site IS NULL) AS only_right, count(*) FILTER (a.Site IS NULL) = 0 AS left_covers FROM (SELECT DISTINCT Site, "Date" FROM obs_daily) a
 FULL JOIN (SELECT DISTINCT Site, "Date" FROM cv_assignment) b ON a.Site = b.Site AND a."Date" = b."Date" GROUP BY 1""",
    "obs_daily cv_assignment",
)
def _(spark, sf):
    return au.site_set_audit(fx.obs_daily(spark, sf), fx.cv_assignment(spark, sf), "Date", "Site")


@query(
    "a37_region_counts",
    "SELECT ClimateRegion, count(*) AS n FROM fused_daily JOIN climate_region USING (ROW, COL) GROUP BY ClimateRegion",
    "fused_daily climate_region",
)
def _(spark, sf):
    located = fx.fused_daily(spark, sf).join(fx.climate_region(spark, sf), ["ROW", "COL"])
    return au.label_counts(located, "ClimateRegion")


@query(
    "a42_rounded_range",
    """SELECT round(min(model) + 1e-9, 2) AS "min", round(max(model) + 1e-9, 2) AS "max", round(avg(model) + 1e-9, 2) AS mean FROM metrics WHERE Period IN ('DJF', 'JJA')""",
    "metrics",
    "min max mean",
    digits=4,
)
def _(spark, sf):
    return au.grouped_range(fx.metrics(spark, sf), "model", ["DJF", "JJA"])


@query(
    "a44_key_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", TRUE AS same_type, count(DISTINCT a) AS left_distinct, count(DISTINCT b) AS right_distinct, count(DISTINCT CASE WHEN a = b THEN a END) AS common
 FROM (SELECT DISTINCT CAST("{c}" AS VARCHAR) AS a FROM metrics_even) x FULL JOIN (SELECT DISTINCT CAST({e} AS VARCHAR) AS b FROM metrics_odd) y ON a = b"""
        for c, e in (("ROW", "ROW + 1"), ("COL", "COL + 2"), ("Period", "Period"))
    ),
    "metrics_even metrics_odd",
)
def _(spark, sf):
    a, b = fx.metric_sides(spark, sf)
    b = b.withColumns({"ROW": F.col("ROW") + 1, "COL": F.col("COL") + 2})
    return au.key_report(a, b, ["ROW", "COL", "Period"])


@query(
    "a45_arg_max_rows",
    'SELECT ROW, COL, "Timestamp", model FROM fused_daily WHERE model = (SELECT max(model) FROM fused_daily)',
    "fused_daily",
)
def _(spark, sf):
    return au.arg_max_rows(fx.fused_daily(spark, sf).select("ROW", "COL", "Timestamp", "model"), "model")


@query(
    "a46_max_inside_outside",
    """SELECT site_id, max(O3) FILTER (hour(dateon) BETWEEN 8 AND 20) AS inside, max(O3) FILTER (NOT (hour(dateon) BETWEEN 8 AND 20)) AS outside FROM obs_hourly GROUP BY site_id""",
    "obs_hourly",
)
def _(spark, sf):
    from skyweave.functions.calendar import is_daytime

    day = is_daytime("dateon", inclusive=True)
    return fx.obs_hourly(spark, sf).groupBy("site_id").agg(
        F.max(F.when(day, F.col("O3"))).alias("inside"), F.max(F.when(~day, F.col("O3"))).alias("outside")
    )


@query(
    "a47_numeric_means",
    "SELECT Site, avg(POC) AS POC, avg(Lat) AS Lat, avg(Lon) AS Lon, avg(Conc) AS Conc FROM obs_daily GROUP BY Site",
    "obs_daily",
    "POC Lat Lon Conc",
)
def _(spark, sf):
    obs = fx.obs_daily(spark, sf)
    numeric = [c for c, t in obs.dtypes if t in ("int", "bigint", "double")]
    return obs.groupBy("Site").agg(*[F.avg(c).alias(c) for c in numeric])


@query(
    "a48_collapse_sparse_rows",
    'SELECT Site, "Date", max(CASE WHEN POC = 1 THEN Conc END) AS a, max(CASE WHEN POC = 2 THEN Conc END) AS b FROM obs_daily GROUP BY ALL',
    "obs_daily",
)
def _(spark, sf):
    from skyweave.operators.reshape import collapse_sparse

    sparse = fx.obs_daily(spark, sf).select(
        "Site",
        "Date",
        F.when(F.col("POC") == 1, F.col("Conc")).alias("a"),
        F.when(F.col("POC") == 2, F.col("Conc")).alias("b"),
    )
    return collapse_sparse(sparse, ["Site", "Date"], ["a", "b"])


@query(
    "a49_mean_over_ranks",
    """SELECT ROW, COL, avg(O3_MDA8) AS value FROM (SELECT *, row_number() OVER (PARTITION BY ROW, COL ORDER BY O3_MDA8 DESC, "Date") AS r FROM model_daily WHERE LAY = 0) WHERE r <= 10 GROUP BY ROW, COL""",
    "model_daily",
    "value",
)
def _(spark, sf):
    from skyweave.operators.quantiles import ranked_rows

    model = fx.model_daily(spark, sf).filter(F.col("LAY") == 0)
    ranked = ranked_rows(model, ["ROW", "COL"], "O3_MDA8", 10, ["Date"])
    return ranked.groupBy("ROW", "COL").agg(F.avg("O3_MDA8").alias("value"))


@query(
    "a53_sign_counts",
    "SELECT count(*) FILTER (O3 < 0) AS negative, count(*) AS total FROM obs_hourly",
    "obs_hourly",
)
def _(spark, sf):
    return au.sign_counts(fx.obs_hourly(spark, sf), "O3")


@query(
    "w03_rank_in_group",
    """SELECT Site, "Date", Conc, CAST(r AS INTEGER) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY Site ORDER BY Conc DESC, "Date") AS r FROM cv_result) WHERE r <= 10""",
    "cv_result",
    "Conc",
)
def _(spark, sf):
    from skyweave.operators.quantiles import ranked_rows

    return ranked_rows(fx.cv_result(spark, sf), ["Site"], "Conc", 10, ["Date"]).select("Site", "Date", "Conc", "rank")


@query(
    "w04_position_to_cell",
    """SELECT c_mktsegment AS Period, c_custkey, CAST(p % 7 + 1 AS INTEGER) AS ROW, CAST(p // 7 + 1 AS INTEGER) AS COL FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS p FROM customer)""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("Period"), "c_custkey")
    return au.numbered(rows, ["Period"], "c_custkey", 7)


@query(
    "w04_position_to_cell_by_row",
    """SELECT c_mktsegment AS Period, c_custkey, CAST(p // 9 + 1 AS INTEGER) AS ROW, CAST(p % 9 + 1 AS INTEGER) AS COL FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS p FROM customer)""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("Period"), "c_custkey")
    return au.numbered(rows, ["Period"], "c_custkey", 9, column_major=False)


@query(
    "t01_sorted_site_days",
    'SELECT "Date", Site, avg(Conc) AS Conc FROM obs_daily GROUP BY ALL ORDER BY "Date", Site',
    "obs_daily",
    "Conc",
)
def _(spark, sf):
    means = fx.obs_daily(spark, sf).groupBy("Date", "Site").agg(F.avg("Conc").alias("Conc"))
    return means.orderBy("Date", "Site")


@query(
    "t02_sites_by_value",
    "SELECT Site, max(Conc) AS Conc FROM obs_daily GROUP BY Site ORDER BY Conc DESC, Site",
    "obs_daily",
)
def _(spark, sf):
    top = fx.obs_daily(spark, sf).groupBy("Site").agg(F.max("Conc").alias("Conc"))
    return top.orderBy(F.desc("Conc"), "Site")


@query(
    "t03_multi_key_sort",
    'SELECT ROW, COL, "Timestamp", model FROM fused_hourly ORDER BY ROW, COL, "Timestamp"',
    "fused_hourly",
    "model",
)
def _(spark, sf):
    return fx.fused_hourly(spark, sf).select("ROW", "COL", "Timestamp", "model").orderBy("ROW", "COL", "Timestamp")


@query(
    "t04_first_seen_order",
    'SELECT o.Site, "Date", POC, Conc, first_day FROM obs_daily o JOIN (SELECT Site, min("Date") AS first_day FROM obs_daily GROUP BY Site) USING (Site) ORDER BY first_day, Site',
    "obs_daily",
)
def _(spark, sf):
    obs = fx.obs_daily(spark, sf).select("Site", "Date", "POC", "Conc")
    order = obs.groupBy("Site").agg(F.min("Date").alias("first_day"))
    return obs.join(order, "Site").orderBy("first_day", "Site")


@query(
    "t05_extreme_rows",
    """(SELECT ROW, COL, "Year", Period, model, 'top' AS "end" FROM metrics WHERE ds_ozone IS NOT NULL ORDER BY model DESC NULLS LAST, ROW, COL, "Year", Period LIMIT 3)
 UNION ALL (SELECT ROW, COL, "Year", Period, model, 'bottom' FROM metrics WHERE ds_ozone IS NOT NULL ORDER BY model NULLS LAST, ROW, COL, "Year", Period LIMIT 3)""",
    "metrics",
    "model",
)
def _(spark, sf):
    rows = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "model", "ds_ozone")
    return au.extreme_rows(rows, "model", "ds_ozone", 3, ["ROW", "COL", "Year", "Period"]).drop("ds_ozone")


@query(
    "t06_top10_per_group",
    """SELECT ROW, COL, "Timestamp", vna_ozone, CAST(r AS INTEGER) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY ROW, COL ORDER BY vna_ozone DESC, "Timestamp", model) AS r FROM fused_daily) WHERE r <= 10""",
    "fused_daily",
)
def _(spark, sf):
    from skyweave.operators.quantiles import ranked_rows

    top = ranked_rows(fx.fused_daily(spark, sf), ["ROW", "COL"], "vna_ozone", 10, ["Timestamp", "model"])
    return top.select("ROW", "COL", "Timestamp", "vna_ozone", "rank")


@query(
    "t07_global_top10",
    'SELECT ROW, COL, "Year", Period, vna_ozone FROM metrics ORDER BY vna_ozone DESC, ROW, COL, "Year", Period LIMIT 10',
    "metrics",
    "vna_ozone",
)
def _(spark, sf):
    m = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "vna_ozone")
    return m.orderBy(F.desc("vna_ozone"), "ROW", "COL", "Year", "Period").limit(10)


@query(
    "r04_full_grid_check",
    """SELECT "Date", count(*) AS n, count(*) = 120 AS complete FROM model_daily WHERE LAY = 0 GROUP BY "Date" """,
    "model_daily",
)
def _(spark, sf):
    model = fx.model_daily(spark, sf).filter(F.col("LAY") == 0)
    return au.grid_days_complete(model, "Date", fx.ROWS * fx.COLS)


_BLOCK = """SELECT Site, "Date", CAST(sum(starts) OVER (PARTITION BY Site ORDER BY "Date") AS BIGINT) AS block FROM
 (SELECT Site, "Date", CASE WHEN Conc >= 30 THEN 1 ELSE 0 END AS starts FROM cv_result)"""


@query("w05_running_block_number", _BLOCK, "cv_result")
def _(spark, sf):
    rows = fx.cv_result(spark, sf).select("Site", "Date", "Conc")
    return running_blocks(rows, ["Site"], ["Date"], F.col("Conc") >= 30).drop("Conc")


@query(
    "w06_adjacent_comparison",
    'SELECT Site, "Date", Conc - lead(Conc) OVER (PARTITION BY Site ORDER BY "Date") AS step FROM cv_result',
    "cv_result",
    "step",
)
def _(spark, sf):
    rows = fx.cv_result(spark, sf).select("Site", "Date", "Conc")
    return step_to_next(rows, ["Site"], ["Date"], "Conc").drop("Conc")
