"""Queries: long and wide forms."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.operators import reshape as rs

_SEASONS = ["DJF", "MAM", "JJA", "SON"]
_PERIODS = [*_SEASONS, "top-10", "W126"]


@query(
    "r01_metric_pivot",
    """, l AS (SELECT ROW, COL, "Year", Period, avg(model) AS v FROM metrics GROUP BY ALL) SELECT ROW, COL, "Year", """
    + ", ".join(f"max(v) FILTER (Period = '{p}') AS {p.replace('-', '_')}" for p in _PERIODS)
    + " FROM l GROUP BY ALL",
    "metrics",
    "DJF MAM JJA SON top_10 W126",
)
def _(spark, sf):
    long = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", F.col("model").alias("v"))
    return rs.metric_rows_to_columns(long, ["ROW", "COL", "Year"], "Period", "v", _PERIODS).withColumnRenamed("top-10", "top_10")


def day_codes() -> list[str]:
    """The day codes MMDD of a leap year."""
    first = date(2012, 1, 1)
    return [f"{first + timedelta(i):%m%d}" for i in range(366)]


def wide(spark, sf):
    """One row per cell, a column per (method, day code): 2 x 366."""
    day = F.date_format("Timestamp", "MMdd")
    codes = day_codes()
    df = fx.fused_daily(spark, sf).select("ROW", "COL", day.alias("day"), "model", "vna_ozone")
    spread = df.groupBy("ROW", "COL").pivot("day", codes).agg(F.max("model").alias("O3"), F.max("vna_ozone").alias("VNA"))
    return spread.toDF("ROW", "COL", *[f"{n}_d{c}" for c in codes for n in ("O3", "VNA")])


_DAYS = """SELECT ROW, COL, max(model) AS o3, max(vna_ozone) AS vna, strftime("Timestamp", '%m%d') AS code FROM fused_daily GROUP BY ALL"""
_EVERY_DAY = """(SELECT c.ROW, c.COL, m.code FROM (SELECT DISTINCT ROW, COL FROM d) c
 CROSS JOIN (SELECT strftime(DATE '2012-01-01' + CAST(i AS INTEGER), '%m%d') AS code FROM (SELECT unnest(range(366)) AS i)) m)"""


@query(
    "r02_split_and_pivot",
    f", d AS ({_DAYS}) SELECT g.ROW, g.COL, 'd' || code AS day, o3 AS \"O3\", vna AS \"VNA\" FROM {_EVERY_DAY} g LEFT JOIN d USING (ROW, COL, code)",
    "fused_daily",
)
def _(spark, sf):
    table = wide(spark, sf)
    days = [c for c in table.columns if c not in ("ROW", "COL")]
    return rs.split_names(table, ["ROW", "COL"], days, "_", ["variable", "day"], "variable", ["O3", "VNA"])


@query(
    "r03_day_columns_to_rows",
    f", d AS ({_DAYS}) SELECT g.ROW, g.COL, strptime('2012' || code, '%Y%m%d')::DATE AS \"Timestamp\", o3 AS model, vna AS vna_ozone FROM {_EVERY_DAY} g LEFT JOIN d USING (ROW, COL, code)",
    "fused_daily",
)
def _(spark, sf):
    return rs.day_columns_to_rows(wide(spark, sf), ["ROW", "COL"], 2012, {"O3": "model", "VNA": "vna_ozone"})


@query(
    "r04_day_code_rows",
    """SELECT ROW, COL, code, strptime('2012' || lpad(CAST(code AS VARCHAR), 4, '0'), '%Y%m%d')::DATE AS "Timestamp" FROM (SELECT ROW, COL, CAST(month("Timestamp") * 100 + day("Timestamp") AS INTEGER) AS code FROM fused_daily)""",
    "fused_daily",
)
def _(spark, sf):
    coded = fx.fused_daily(spark, sf).select(
        "ROW", "COL", (F.month("Timestamp") * 100 + F.dayofmonth("Timestamp")).alias("code")
    )
    return rs.day_code_date(coded, "code", 2012)


@query(
    "r05_period_columns_to_rows",
    """, k AS (SELECT ROW * 1000 + COL AS id, Period, avg(model) AS model, avg(vna_ozone) AS vna_ozone FROM metrics GROUP BY ALL)
 SELECT i.id, p.Period, k.model, k.vna_ozone FROM (SELECT DISTINCT id FROM k) i CROSS JOIN (VALUES ('DJF'), ('MAM'), ('JJA'), ('SON'), ('top-10'), ('W126')) p(Period) LEFT JOIN k ON k.id = i.id AND k.Period = p.Period""",
    "metrics",
    "model vna_ozone",
)
def _(spark, sf):
    periods = [*_SEASONS, "top-10", "W126"]
    m = fx.metrics(spark, sf).withColumn("id", F.col("ROW") * 1000 + F.col("COL"))
    by = lambda c: m.groupBy("id").agg(
        *[F.avg(F.when(F.col("Period") == p, F.col(c))).alias(p) for p in periods]
    )
    return rs.period_columns_to_rows({c: by(c) for c in ("model", "vna_ozone")}, "id", periods)


@query(
    "r08_methods_to_rows",
    """SELECT ROW, COL, "Year", Period, "Method", y_pred FROM (SELECT ROW, COL, "Year", Period, model, ds_ozone FROM metrics) UNPIVOT INCLUDE NULLS (y_pred FOR "Method" IN (model, ds_ozone))""",
    "metrics",
    "y_pred",
)
def _(spark, sf):
    return rs.methods_to_rows(
        fx.metrics(spark, sf), ["ROW", "COL", "Year", "Period"], ["model", "ds_ozone"]
    )
