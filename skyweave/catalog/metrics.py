"""Queries: period metrics, 8-hour maxima, W126."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.functions.calendar import period_labels
from skyweave.operators import hourly as hr
from skyweave.operators import rollup as ru
from skyweave.operators.clean import drop_sentinel
from skyweave.operators.quantiles import nth_largest, smallest_of_top
from skyweave.plans import exposure

M = fx.METHODS
FLOATS = " ".join(M)
CELL = ["ROW", "COL"]
AVG4 = ", ".join(f"avg({c}) AS {c}" for c in M)
_WARM = 'month("Timestamp") BETWEEN 4 AND 9'
_SEASON = """CASE WHEN month("Timestamp") IN (12, 1, 2) THEN 'DJF' WHEN month("Timestamp") IN (3, 4, 5) THEN 'MAM'
 WHEN month("Timestamp") IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""
Q98 = "SELECT ROW, COL, " + ", ".join(f"quantile_cont({c}, 0.98) AS {c}" for c in M) + ", '98th' AS Period FROM {t} GROUP BY ROW, COL"
TOP10 = (
    "SELECT ROW, COL, "
    + ", ".join(f"avg({c}) FILTER (n_{c} <= 10) AS {c}" for c in M)
    + ", 'top-10' AS Period FROM (SELECT *, "
    + ", ".join(
        f"row_number() OVER (PARTITION BY ROW, COL ORDER BY {c} DESC NULLS LAST) AS n_{c}" for c in M
    )
    + " FROM {t}) GROUP BY ROW, COL"
)
PERIODS = f"""SELECT ROW, COL, CAST(year("Timestamp") AS INTEGER) AS "Year", {AVG4}, 'Annual' AS Period FROM {{t}} GROUP BY ROW, COL, year("Timestamp")
 UNION ALL BY NAME SELECT ROW, COL, {AVG4}, 'Apr-Sep' AS Period FROM {{t}} WHERE {_WARM} GROUP BY ROW, COL
 UNION ALL BY NAME SELECT ROW, COL, {AVG4}, {_SEASON} AS Period FROM {{t}} GROUP BY ALL"""
TABLE = Q98 + " UNION ALL BY NAME " + TOP10 + " UNION ALL BY NAME " + PERIODS


@query("a04_percentile_98", Q98.format(t="fused_daily"), "fused_daily", FLOATS)
def _(spark, sf):
    return ru.percentile_98(fx.fused_daily(spark, sf), CELL, M)


@query("a05_top10_mean", TOP10.format(t="fused_daily"), "fused_daily", FLOATS)
def _(spark, sf):
    return ru.top_10(fx.fused_daily(spark, sf), CELL, M)


@query(
    "a06_annual_mean",
    f"""SELECT ROW, COL, CAST(year("Timestamp") AS INTEGER) AS "Year", {AVG4}, 'Annual' AS Period FROM fused_daily GROUP BY ALL""",
    "fused_daily",
    FLOATS,
)
def _(spark, sf):
    return ru.period_mean(fx.fused_daily(spark, sf), CELL, "Timestamp", M, "Annual", year=True)


@query(
    "a07_warm_season_mean",
    f"SELECT ROW, COL, {AVG4}, 'Apr-Sep' AS Period FROM fused_daily WHERE {_WARM} GROUP BY ALL",
    "fused_daily",
    FLOATS,
)
def _(spark, sf):
    return ru.period_mean(fx.fused_daily(spark, sf), CELL, "Timestamp", M, "Apr-Sep")


@query("a08_period_means", PERIODS.format(t="fused_daily"), "fused_daily", FLOATS)
def _(spark, sf):
    return ru.period_means(fx.fused_daily(spark, sf), CELL, "Timestamp", M)


@query("a09_metric_table", TABLE.format(t="fused_daily"), "fused_daily", FLOATS)
def _(spark, sf):
    return ru.metric_table(fx.fused_daily(spark, sf), CELL, "Timestamp", M)


@query(
    "a10_monitor_98th",
    """SELECT Site, min(Conc) AS Conc FROM (SELECT Site, Conc, row_number() OVER (PARTITION BY Site ORDER BY Conc DESC) AS r FROM obs_daily)
 WHERE r <= 7 GROUP BY Site""",
    "obs_daily",
    "Conc",
)
def _(spark, sf):
    return smallest_of_top(fx.obs_daily(spark, sf), ["Site"], "Conc", 7, "Conc")


@query(
    "a11_nth_largest",
    """SELECT ROW, COL, O3_MDA8 AS value FROM (SELECT *, row_number() OVER (PARTITION BY ROW, COL ORDER BY O3_MDA8 DESC) AS r FROM model_daily)
 WHERE r = 3""",
    "model_daily",
    "value",
)
def _(spark, sf):
    return nth_largest(fx.model_daily(spark, sf), CELL, "O3_MDA8", 3, "value")


@query(
    "a12_wrapping_period_mean",
    """SELECT ROW, COL, avg(O3_MDA8) AS O3_MDA8 FROM model_daily
 WHERE strftime("Date", '%m-%d') >= '11-15' OR strftime("Date", '%m-%d') <= '02-10' GROUP BY ROW, COL""",
    "model_daily",
    "O3_MDA8",
)
def _(spark, sf):
    from skyweave.functions.calendar import in_wrapping_range

    model = fx.model_daily(spark, sf).filter(in_wrapping_range("Date", "11-15", "02-10"))
    return model.groupBy(*CELL).agg(F.avg("O3_MDA8").alias("O3_MDA8"))


_LOCAL = """SELECT f.*, t.gmt_offset, f."Timestamp" + to_hours(CAST(t.gmt_offset AS INTEGER)) AS local_time
 FROM fused_hourly f LEFT JOIN tz_grid t USING (ROW, COL)"""


@query(
    "f21_grid_local_time",
    f"""SELECT l.*, CAST(year(local_time) AS INTEGER) AS "Year", CAST(month(local_time) AS INTEGER) AS "Month",
 CAST(day(local_time) AS INTEGER) AS "Day", CAST(hour(local_time) AS INTEGER) AS "hour" FROM ({_LOCAL}) l""",
    "fused_hourly tz_grid",
    FLOATS,
)
def _(spark, sf):
    return hr.grid_local_time(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf))


def rolled(c: str, by: str, order: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} = 8 THEN avg({c}) {w} END"


_DAYS = "ROW, COL, CAST(local_time AS DATE)"
_MDA8 = (
    f', loc AS ({_LOCAL}), r AS (SELECT ROW, COL, CAST(local_time AS DATE) AS "Date", '
    + ", ".join(f"{rolled(c, _DAYS, 'local_time')} AS {c}" for c in M)
    + ' FROM loc WHERE gmt_offset IS NOT NULL), mda8 AS (SELECT ROW, COL, "Date", '
    + ", ".join(f"max({c}) AS {c}" for c in M)
    + ' FROM r GROUP BY ROW, COL, "Date")'
)


@query(
    "w01_rolling_8h",
    f"SELECT ROW, COL, \"Timestamp\", {rolled('model', 'ROW, COL, CAST(\"Timestamp\" AS DATE)', '\"Timestamp\"')} AS r8 FROM fused_hourly",
    "fused_hourly",
    "r8",
)
def _(spark, sf):
    day = fx.fused_hourly(spark, sf).withColumn("Date", F.col("Timestamp").cast("date"))
    return day.select(
        *CELL, "Timestamp", hr.rolling_mean("model", [*CELL, "Date"], "Timestamp", 8).alias("r8")
    )


@query("a13_mda8_grid", _MDA8 + " SELECT * FROM mda8", "fused_hourly tz_grid", FLOATS)
def _(spark, sf):
    return exposure.hourly_to_mda8(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf), M).drop(
        "Year", "Month"
    )


@query(
    "f22_hourly_to_metrics",
    _MDA8
    + ', d AS (SELECT * RENAME ("Date" AS "Timestamp") FROM mda8 WHERE year("Date") = 2011) '
    + TOP10.format(t="d")
    + " UNION ALL BY NAME "
    + PERIODS.format(t="d"),
    "fused_hourly tz_grid",
    FLOATS,
)
def _(spark, sf):
    return exposure.hourly_to_metrics(
        fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf), M, year=2011
    )


_EV = """, h AS (SELECT site_id, dateon, avg(O3) AS O3, avg(model) AS model FROM event_hours GROUP BY ALL)"""


@query(
    "a14_mda8_site",
    _EV
    + f""", r AS (SELECT *, CAST(dateon AS DATE) AS "Date", {rolled('O3', 'site_id, CAST(dateon AS DATE)', 'dateon')} AS r8 FROM h)
 SELECT site_id, "Date", arg_min(model, dateon) AS model, max(r8) AS O3 FROM r GROUP BY site_id, "Date" """,
    "event_hours",
    "O3 model",
)
def _(spark, sf):
    hours = hr.hourly_means(fx.event_hours(spark, sf), ["site_id"], "dateon", ["O3", "model"])
    return hr.daily_max_8h(hours, ["site_id"], "dateon", ["O3"], keep_first=["model"])


@query(
    "a15_mda8_whole_series",
    _EV
    + f", r AS (SELECT site_id, {rolled('O3', 'site_id', 'dateon')} AS r8 FROM h) SELECT site_id, max(r8) AS O3 FROM r GROUP BY site_id",
    "event_hours",
    "O3",
)
def _(spark, sf):
    hours = hr.hourly_means(fx.event_hours(spark, sf), ["site_id"], "dateon", ["O3"])
    return hr.guarded_max_8h(hours, ["site_id"], "dateon", ["O3"])


def _w(c: str) -> str:
    return f"({c} / 1000) / (1 + 4403 * exp(-126 * ({c} / 1000)))"


_MONTHS = (
    f', loc AS ({_LOCAL}), months AS (SELECT ROW, COL, CAST(year(local_time) AS INTEGER) AS "Year", CAST(month(local_time) AS INTEGER) AS "Month", '
    + ", ".join(f"CASE WHEN count({c}) = count(*) THEN sum({_w(c)}) END AS {c}" for c in M)
    + " FROM loc WHERE hour(local_time) >= 8 AND hour(local_time) < 20 GROUP BY ALL)"
)


@query("a16_w126_months", _MONTHS + " SELECT * FROM months", "fused_hourly tz_grid", FLOATS)
def _(spark, sf):
    local = hr.grid_local_time(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf))
    return hr.weighted_months(local, CELL, M)


def _best(c: str, strict: bool = True) -> str:
    """Maximum over month triples; NULL when a complete triple has a void month."""
    sums = f"max({c}_sum)"
    return f"CASE WHEN count(*) FILTER (n = 3 AND {c}_n < 3) = 0 THEN {sums} END AS {c}" if strict else f"{sums} AS {c}"


def _triples(keys: str, source: str, columns: list[str], strict: bool = True) -> str:
    return (
        f"""tri AS (SELECT {keys}, s.m, count(*) AS n, """
        + ", ".join(
            f"count({c}) AS {c}_n, CASE WHEN count(*) = 3 AND count({c}) = 3 THEN sum({c}) END AS {c}_sum"
            for c in columns
        )
        + f""" FROM {source} JOIN (SELECT unnest([3, 4, 5, 6, 7, 8]) AS m) s ON "Month" BETWEEN s.m AND s.m + 2 GROUP BY {keys}, s.m),
 everyone AS (SELECT DISTINCT {keys} FROM {source}),
 best AS (SELECT {keys}, {", ".join(_best(c, strict) for c in columns)} FROM tri GROUP BY {keys})"""
    )


_W126 = (
    _MONTHS
    + ', y AS (SELECT * FROM months WHERE "Year" = 2011), '
    + _triples("ROW, COL", "y", M)
    + f", w AS (SELECT e.ROW, e.COL, {', '.join(M)}, 'W126' AS Period FROM everyone e LEFT JOIN best USING (ROW, COL))"
)


@query("a17_w126_triples", _W126 + " SELECT * FROM w", "fused_hourly tz_grid", FLOATS)
def _(spark, sf):
    return exposure.hourly_to_w126(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf), M, 2011)


@query(
    "a18_w126_present_months",
    _MONTHS
    + """ SELECT ROW, COL, max(s) AS model, 'W126' AS Period FROM (SELECT ROW, COL, CASE WHEN count(*) OVER w = 3 AND count(model) OVER w = 3 THEN sum(model) OVER w END AS s
 FROM months WHERE "Year" IS NOT NULL WINDOW w AS (PARTITION BY ROW, COL ORDER BY "Year", "Month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) GROUP BY ROW, COL""",
    "fused_hourly tz_grid",
    "model",
)
def _(spark, sf):
    local = hr.grid_local_time(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf))
    return hr.running_w126(hr.weighted_months(local, CELL, ["model"]), CELL, ["model"])


_OBS_HOURS = ", oh AS (SELECT site_id, dateon, avg(O3) AS O3 FROM obs_hourly WHERE O3 <> -999 GROUP BY site_id, dateon)"


@query(
    "a19_w126_monitor",
    _OBS_HOURS
    + f""", mm AS (SELECT site_id, CAST(year(dateon) AS INTEGER) AS "Year", CAST(month(dateon) AS INTEGER) AS "Month",
 count(*) / (12.0 * max(day(last_day(dateon)))) AS ratio, sum({_w('O3')}) AS s FROM oh WHERE hour(dateon) >= 8 AND hour(dateon) < 20 GROUP BY ALL),
 m AS (SELECT site_id, "Year", "Month", CASE WHEN ratio >= 0.75 THEN s / ratio END AS O3 FROM mm), """
    + _triples('site_id, "Year"', "m", ["O3"], strict=False)
    + """ SELECT e.site_id, e."Year", O3, 'W126' AS Period FROM everyone e LEFT JOIN best b ON e.site_id = b.site_id AND e."Year" = b."Year" """,
    "obs_hourly",
    "O3",
)
def _(spark, sf):
    hours = hr.hourly_means(
        drop_sentinel(fx.obs_hourly(spark, sf), "O3"), ["site_id"], "dateon", ["O3"]
    )
    months = hr.complete_months(hours, ["site_id"], "O3", "dateon")
    return hr.max_triple(months, ["site_id", "Year"], ["O3"], strict=False)


@query(
    "a20_w126_domain",
    """, l AS (UNPIVOT (SELECT "Timestamp", vna_ozone, evna_ozone, avna_ozone, model FROM fused_hourly WHERE year("Timestamp") = 2011 AND hour("Timestamp") >= 8 AND hour("Timestamp") < 20)
  ON vna_ozone, evna_ozone, avna_ozone, model INTO NAME name VALUE v),
 mm AS (SELECT name, CAST(month("Timestamp") AS INTEGER) AS "Month", count(*) / (12.0 * 31) AS ratio, sum("""
    + _w("v")
    + """) AS s FROM l GROUP BY ALL),
 m AS (SELECT name, "Month", CASE WHEN ratio < 1 THEN s / ratio ELSE s END AS v FROM mm WHERE ratio >= 0.75), """
    + _triples("name", "m", ["v"], strict=False)
    + """ SELECT 'W126_' || name AS Period, v AS "Value" FROM best WHERE v IS NOT NULL""",
    "fused_hourly",
    "Value",
)
def _(spark, sf):
    year = fx.fused_hourly(spark, sf).filter(F.year("Timestamp") == 2011)
    return hr.domain_w126(year, M, "Timestamp")


@query(
    "a20_w126_domain_all_hours",
    """, l AS (SELECT "Timestamp", unnest(['vna_ozone', 'evna_ozone', 'avna_ozone', 'model']) AS name, unnest([vna_ozone, evna_ozone, avna_ozone, model]) AS v
  FROM fused_hourly WHERE year("Timestamp") = 2011 AND hour("Timestamp") >= 8 AND hour("Timestamp") < 20),
 m AS (SELECT name, CAST(month("Timestamp") AS INTEGER) AS "Month", coalesce(sum("""
    + _w("v")
    + """), 0) AS v FROM l GROUP BY ALL), """
    + _triples("name", "m", ["v"], strict=False)
    + """ SELECT 'W126_' || name AS Period, v AS "Value" FROM best WHERE v IS NOT NULL""",
    "fused_hourly",
    "Value",
)
def _(spark, sf):
    year = fx.fused_hourly(spark, sf).filter(F.year("Timestamp") == 2011)
    return hr.domain_w126(year, M, "Timestamp", complete=False)


@query(
    "a21_w126_dense_grid",
    _W126 + f" SELECT c.ROW, c.COL, 'W126' AS Period, {', '.join(M)} FROM cells c LEFT JOIN w USING (ROW, COL)",
    "fused_hourly tz_grid",
    FLOATS,
)
def _(spark, sf):
    cells = fx.region(spark, sf)
    return exposure.hourly_to_w126(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf), M, 2011, cells)


_S = ["Conc", "model", "vna_ozone", "ds_ozone"]
_SITE_PERIODS = f"""SELECT Site, p AS Period, {", ".join(f"avg({c}) AS {c}" for c in _S)} FROM (SELECT *, unnest(list_filter(['Annual',
 CASE WHEN month("Date") IN (12, 1, 2) THEN 'DJF' WHEN month("Date") IN (3, 4, 5) THEN 'MAM' WHEN month("Date") IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END,
 CASE WHEN month("Date") BETWEEN 4 AND 9 THEN 'Apr-Sep' END], lambda x: x IS NOT NULL)) AS p FROM cv_result) GROUP BY Site, p"""
_SITE_TOP = f"""SELECT Site, 'top-10' AS Period, {", ".join(f"avg({c}) AS {c}" for c in _S)} FROM (SELECT *, row_number() OVER (PARTITION BY Site ORDER BY Conc DESC, "Date") AS r
 FROM cv_result) WHERE r <= 10 GROUP BY Site"""


@query("a22_site_period_means", _SITE_PERIODS, "cv_result", " ".join(_S))
def _(spark, sf):
    return ru.period_means(fx.cv_result(spark, sf), ["Site"], "Date", _S, by_year=False)


@query("a23_site_top10_days", _SITE_TOP, "cv_result", " ".join(_S))
def _(spark, sf):
    return ru.top_days_mean(fx.cv_result(spark, sf), ["Site"], "Conc", _S, ["Date"])


@query(
    "r01_site_metric_rows",
    _SITE_PERIODS + " UNION ALL BY NAME " + _SITE_TOP,
    "cv_result",
    " ".join(_S),
)
def _(spark, sf):
    return ru.site_metrics(fx.cv_result(spark, sf), ["Site"], "Date", "Conc", _S, ["Date"])


@query(
    "w02_sliding_month_sum",
    """, m AS (SELECT ROW, COL, CAST(year("Timestamp") AS INTEGER) AS "Year", CAST(month("Timestamp") AS INTEGER) AS "Month", sum(model) AS s FROM fused_daily GROUP BY ALL)
 SELECT ROW, COL, "Year", "Month", CASE WHEN count(*) OVER w = 3 THEN sum(s) OVER w END AS s3 FROM m
 WINDOW w AS (PARTITION BY ROW, COL ORDER BY "Year", "Month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "fused_daily",
    "s3",
)
def _(spark, sf):
    months = ru.monthly_sums(fx.fused_daily(spark, sf), CELL, "Timestamp", ["model"])
    return months.select(
        *CELL,
        "Year",
        "Month",
        hr.sliding_sum("s_model", CELL, ["Year", "Month"], 3).alias("s3"),
    )


@query(
    "f25_daily_extremes",
    """, d AS (SELECT *, CAST("Timestamp" AS DATE) AS "Date" FROM fused_hourly)
 SELECT ROW, COL, "Date", max(model) AS max_value, CAST(hour(arg_max("Timestamp", {'v': model, 't': -epoch("Timestamp")})) AS INTEGER) AS max_hour,
 min(model) AS min_value, CAST(hour(arg_min("Timestamp", {'v': model, 't': epoch("Timestamp")})) AS INTEGER) AS min_hour,
 count(DISTINCT "Timestamp") AS hours, 24 - count(DISTINCT CASE WHEN model IS NOT NULL THEN "Timestamp" END) AS missing_hours
 FROM d GROUP BY ROW, COL, "Date" """,
    "fused_hourly",
    "max_value min_value",
)
def _(spark, sf):
    return hr.daily_extremes(fx.fused_hourly(spark, sf), CELL, "Timestamp", "model")
