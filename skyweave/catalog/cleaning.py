"""Queries: filters, masks, scalar column work."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.functions import calendar as cal
from skyweave.functions import ozone as oz
from skyweave.functions import text as tx
from skyweave.functions.projection import centre_to_index, index_to_centre
from skyweave.operators import clean as cl

M = fx.METHODS
FLOATS = " ".join(M)
ALL = 'ROW, COL, "Timestamp", vna_ozone, evna_ozone, avna_ozone, model'


@query(
    "p01_ppb_to_ppm",
    'SELECT ROW, COL, "Timestamp", ' + ", ".join(f"{c} / 1000 AS {c}" for c in M) + " FROM fused_daily",
    "fused_daily",
    FLOATS,
    digits=9,
)
def _(spark, sf):
    return cl.scale_to_ppm(fx.fused_daily(spark, sf), M)


@query(
    "p02_region_keep",
    f'SELECT {ALL} FROM fused_daily JOIN region USING (ROW, COL) WHERE "Is" = 1',
    "fused_daily region",
)
def _(spark, sf):
    return cl.keep_region(fx.fused_daily(spark, sf), fx.region(spark, sf))


@query(
    "p03_null_outside_region",
    'SELECT ROW, COL, "Timestamp", CASE WHEN "Is" = 1 THEN vna_ozone END AS vna_ozone, evna_ozone, avna_ozone, CASE WHEN "Is" = 1 THEN model END AS model FROM fused_daily LEFT JOIN region USING (ROW, COL)',
    "fused_daily region",
)
def _(spark, sf):
    return cl.blank_outside_region(
        fx.fused_daily(spark, sf), fx.region(spark, sf), ["vna_ozone", "model"]
    )


@query(
    "p04_copy_missing_mask",
    """SELECT ROW, COL, Period, Pair, CASE WHEN o.m IS NOT NULL THEN x.model END AS model FROM metrics_even x
 LEFT JOIN (SELECT ROW, COL, Period, Pair, CASE WHEN vna_ozone > 50 THEN vna_ozone END AS m FROM metrics_odd) o USING (ROW, COL, Period, Pair)""",
    "metrics_even metrics_odd",
    "model",
)
def _(spark, sf):
    mine, other = fx.metric_sides(spark, sf)
    keys = ["ROW", "COL", "Period", "Pair"]
    other = other.withColumn("vna_ozone", F.when(F.col("vna_ozone") > 50, F.col("vna_ozone")))
    return cl.copy_missing(mine.select(*keys, "model"), other, keys, "vna_ozone", ["model"])


@query(
    "p05_date_range",
    f"SELECT {ALL} FROM fused_daily WHERE \"Timestamp\" BETWEEN DATE '1996-03-01' AND DATE '1996-10-31'",
    "fused_daily",
)
def _(spark, sf):
    bounds = [F.lit(d).cast("date") for d in ("1996-03-01", "1996-10-31")]
    return cl.between(fx.fused_daily(spark, sf), "Timestamp", *bounds)


@query(
    "p06_wrapping_range",
    f"""SELECT {ALL} FROM fused_daily WHERE strftime("Timestamp", '%m-%d') >= '12-01' OR strftime("Timestamp", '%m-%d') <= '02-28'""",
    "fused_daily",
)
def _(spark, sf):
    return fx.fused_daily(spark, sf).filter(cal.in_wrapping_range("Timestamp", "12-01", "02-28"))


@query(
    "p07_month_set", f'SELECT {ALL} FROM fused_daily WHERE month("Timestamp") IN (4, 5, 6, 7, 8, 9)', "fused_daily"
)
def _(spark, sf):
    return fx.fused_daily(spark, sf).filter(F.month("Timestamp").isin(4, 5, 6, 7, 8, 9))


@query(
    "p08_daytime_hours",
    """SELECT ROW, COL, "Timestamp", model, hour("Timestamp") < 20 AS before_eight_pm FROM fused_hourly WHERE hour("Timestamp") BETWEEN 8 AND 20""",
    "fused_hourly",
    "model",
)
def _(spark, sf):
    hours = fx.fused_hourly(spark, sf).filter(cal.is_daytime("Timestamp", inclusive=True))
    return hours.select("ROW", "COL", "Timestamp", "model", cal.is_daytime("Timestamp").alias("before_eight_pm"))


_LOCAL = """(SELECT ROW, COL, model, f."Timestamp" + to_hours(CAST(t.gmt_offset AS INTEGER)) AS local_time FROM fused_hourly f LEFT JOIN tz_grid t USING (ROW, COL))"""


def local_hours(spark, sf):
    from skyweave.operators.hourly import grid_local_time

    return grid_local_time(fx.fused_hourly(spark, sf), fx.tz_grid(spark, sf)).select(
        "ROW", "COL", "model", "local_time"
    )


@query(
    "p09_local_year",
    f"SELECT ROW, COL, local_time, model FROM {_LOCAL} WHERE year(local_time) = 2010",
    "fused_hourly tz_grid",
    "model",
)
def _(spark, sf):
    return local_hours(spark, sf).filter(F.year("local_time") == 2010)


@query(
    "p10_local_month_range",
    f"SELECT ROW, COL, local_time, model FROM {_LOCAL} WHERE month(local_time) BETWEEN 3 AND 10",
    "fused_hourly tz_grid",
    "model",
)
def _(spark, sf):
    return local_hours(spark, sf).filter(F.month("local_time").between(3, 10))


@query("p11_sentinel_drop", "SELECT * FROM obs_hourly WHERE O3 <> -999", "obs_hourly")
def _(spark, sf):
    return cl.drop_sentinel(fx.obs_hourly(spark, sf), "O3")


@query(
    "p12_quality_filter",
    """SELECT * FROM (SELECT site_id, dateon, O3, CASE WHEN POCode = 2 THEN 1 END AS EPA_FLAG FROM obs_hourly) WHERE O3 >= 0 AND (EPA_FLAG IS NULL OR EPA_FLAG <> 1)""",
    "obs_hourly",
)
def _(spark, sf):
    flagged = fx.obs_hourly(spark, sf).select(
        "site_id", "dateon", "O3", F.when(F.col("POCode") == 2, 1).alias("EPA_FLAG")
    )
    return cl.valid_measurements(flagged, "O3", "EPA_FLAG")


@query("p13_drop_nulls", f"SELECT {ALL} FROM fused_daily WHERE avna_ozone IS NOT NULL", "fused_daily")
def _(spark, sf):
    return fx.fused_daily(spark, sf).dropna(subset=["avna_ozone"])


@query("p14_exclude_site", "SELECT * FROM obs_daily WHERE Site <> '7'", "obs_daily")
def _(spark, sf):
    return fx.obs_daily(spark, sf).filter(F.col("Site") != "7")


@query("p15_ids_without_letters", "SELECT c_custkey, c_mktsegment FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer) WHERE NOT regexp_matches(id, '[a-zA-Z]')")
def _(spark, sf):
    ids = fx.table(spark, sf, "customer").withColumn(
        "id", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    )
    return ids.filter(~tx.has_letters("id")).select("c_custkey", "c_mktsegment")


_ID9 = "CAST(CASE WHEN c_custkey % 4 = 0 THEN 800000000 ELSE 60000000 END + c_custkey AS VARCHAR)"


@query("p16_id_pattern", f"SELECT id FROM (SELECT {_ID9} AS id FROM customer) WHERE regexp_matches(id, '^8[0-9]{{8}}$')")
def _(spark, sf):
    ids = fx.table(spark, sf, "customer").select(F.expr(_ID9.replace("VARCHAR", "STRING")).alias("id"))
    return ids.filter(tx.is_nine_digit_8("id"))


@query(
    "p17_period_match",
    "SELECT ROW, COL, \"Year\", Period, model FROM metrics WHERE contains(lower(Period), 'top')",
    "metrics",
    "model",
)
def _(spark, sf):
    m = fx.metrics(spark, sf).filter(tx.matches_period("Period", "TOP"))
    return m.select("ROW", "COL", "Year", "Period", "model")


@query("p18_date_prefix", "SELECT * FROM (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') AS d FROM lineitem) WHERE starts_with(d, '1997')")
def _(spark, sf):
    days = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd").alias("d")
    )
    return days.filter(F.col("d").startswith("1997"))


@query(
    "p19_column_shaping",
    "SELECT 'daily' AS kind, \"Timestamp\" AS \"Date\", ROW, COL, model AS base_model FROM fused_daily",
    "fused_daily",
)
def _(spark, sf):
    df = fx.fused_daily(spark, sf)
    slim = df.drop(*cl.columns_like(df, "ozone")).withColumnsRenamed({"model": "base_model", "Timestamp": "Date"})
    return slim.withColumn("kind", F.lit("daily")).select("kind", "Date", "ROW", "COL", "base_model")


@query(
    "p20_difference_column",
    'SELECT ROW, COL, "Timestamp", vna_ozone - model AS diff FROM fused_daily',
    "fused_daily",
)
def _(spark, sf):
    return fx.fused_daily(spark, sf).select(
        "ROW", "COL", "Timestamp", (F.col("vna_ozone") - F.col("model")).alias("diff")
    )


_RATIO = "CASE WHEN model <> 0 THEN avna_ozone / model END"


@query(
    "p21_capped_ratio",
    f'SELECT ROW, COL, "Timestamp", CASE WHEN {_RATIO} > 3 THEN 3.0::DOUBLE ELSE {_RATIO} END AS r_n FROM fused_daily',
    "fused_daily",
    "r_n",
)
def _(spark, sf):
    ratio = oz.response_ratio("avna_ozone", "model")
    return fx.fused_daily(spark, sf).select("ROW", "COL", "Timestamp", oz.cap_ratio(ratio).alias("r_n"))


@query(
    "p22_ratio_outliers",
    f'SELECT * FROM (SELECT ROW, COL, "Timestamp", {_RATIO} AS r_n FROM fused_daily) WHERE r_n > 5',
    "fused_daily",
    "r_n",
)
def _(spark, sf):
    rows = fx.fused_daily(spark, sf).select(
        "ROW", "COL", "Timestamp", oz.response_ratio("avna_ozone", "model").alias("r_n")
    )
    return rows.filter(F.col("r_n") > oz.OUTLIER_RATIO)


@query(
    "p23_validity_flag",
    'SELECT ROW, COL, "Timestamp", CAST(CASE WHEN avna_ozone IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS flag FROM fused_daily',
    "fused_daily",
)
def _(spark, sf):
    return fx.fused_daily(spark, sf).select("ROW", "COL", "Timestamp", oz.valid_flag("avna_ozone").alias("flag"))


@query(
    "p24_standard_offset",
    "SELECT f.ROW, f.COL, f.\"Timestamp\", CAST(gmt_offset - 1 AS INTEGER) AS gmt_offset FROM fused_daily f JOIN tz_grid USING (ROW, COL)",
    "fused_daily tz_grid",
)
def _(spark, sf):
    joined = fx.fused_daily(spark, sf).join(fx.tz_grid(spark, sf), ["ROW", "COL"])
    return cl.standard_offset(joined.select("ROW", "COL", "Timestamp", "gmt_offset"))


@query(
    "p25_index_and_centre",
    'SELECT "Timestamp", (ROW - 0.5)::DOUBLE AS y, (COL - 0.5)::DOUBLE AS x, ROW, COL FROM fused_daily',
    "fused_daily",
)
def _(spark, sf):
    centres = fx.fused_daily(spark, sf).select(
        "Timestamp", index_to_centre(F.col("ROW")).alias("y"), index_to_centre(F.col("COL")).alias("x")
    )
    return centres.withColumns({"ROW": centre_to_index(F.col("y")), "COL": centre_to_index(F.col("x"))})


@query(
    "p26_bounding_box",
    "SELECT * FROM obs_daily WHERE Lon BETWEEN -100 AND -80 AND Lat BETWEEN 33 AND 42",
    "obs_daily",
)
def _(spark, sf):
    return fx.obs_daily(spark, sf).filter(cl.in_box("Lon", "Lat", -100, -80, 33, 42))


@query(
    "p27_model_without_fusion",
    f"SELECT {ALL} FROM fused_daily WHERE model IS NOT NULL AND avna_ozone IS NULL",
    "fused_daily",
)
def _(spark, sf):
    return cl.model_without_fusion(fx.fused_daily(spark, sf), "model", "avna_ozone")


@query(
    "p28_all_present_flag",
    'SELECT ROW, COL, "Year", Period, CAST(CASE WHEN vna_ozone IS NOT NULL AND avna_ozone IS NOT NULL AND ds_ozone IS NOT NULL THEN 1 END AS INTEGER) AS "Is" FROM metrics',
    "metrics",
)
def _(spark, sf):
    return fx.metrics(spark, sf).select(
        "ROW", "COL", "Year", "Period", oz.all_present(["vna_ozone", "avna_ozone", "ds_ozone"]).alias("Is")
    )


@query("p29_lossless_integer", "SELECT l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS label FROM lineitem WHERE l_quantity = floor(l_quantity)")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").filter(F.col("l_quantity") == F.floor("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", oz.whole_number_or_same("l_quantity").alias("label"))


@query(
    "p30_columns_by_name",
    'SELECT ROW, COL, "Timestamp", evna_ozone, avna_ozone FROM fused_daily',
    "fused_daily",
)
def _(spark, sf):
    df = fx.fused_daily(spark, sf)
    named = [c for c in cl.columns_like(df, "VNA", "ozone") if c not in cl.columns_with_prefix(df, "vna")]
    return df.select("ROW", "COL", "Timestamp", *named)


@query(
    "p31_valid_pair",
    "SELECT a.site_id, a.dateon, a.O3 AS x, b.O3 AS y FROM (SELECT site_id, dateon, max(O3) AS O3 FROM obs_hourly WHERE POCode = 1 GROUP BY ALL) a JOIN (SELECT site_id, dateon, max(O3) AS O3 FROM obs_hourly WHERE POCode = 2 GROUP BY ALL) b USING (site_id, dateon) WHERE a.O3 >= 0 AND b.O3 >= 0",
    "obs_hourly",
)
def _(spark, sf):
    obs = fx.obs_hourly(spark, sf)
    side = lambda poc, name: obs.filter(F.col("POCode") == poc).groupBy("site_id", "dateon").agg(F.max("O3").alias(name))
    return cl.valid_pair(side(1, "x").join(side(2, "y"), ["site_id", "dateon"]), "x", "y")


@query(
    "p32_pairwise_complete",
    'SELECT ROW, COL, "Year", Period, avna_ozone AS x, ds_ozone AS y FROM metrics WHERE avna_ozone IS NOT NULL AND ds_ozone IS NOT NULL',
    "metrics",
    "x y",
)
def _(spark, sf):
    from skyweave.operators.compare import paired

    return paired(fx.metrics(spark, sf), "avna_ozone", "ds_ozone").select(
        "ROW", "COL", "Year", "Period", F.col("avna_ozone").alias("x"), F.col("ds_ozone").alias("y")
    )


@query(
    "p33_large_groups",
    "SELECT * FROM obs_daily WHERE (Site, \"Date\") IN (SELECT (Site, \"Date\") FROM obs_daily GROUP BY Site, \"Date\" HAVING count(*) >= 2)",
    "obs_daily",
)
def _(spark, sf):
    return cl.large_groups(fx.obs_daily(spark, sf), ["Site", "Date"], 2)
