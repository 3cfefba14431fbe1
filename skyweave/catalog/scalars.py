"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.functions import calendar as cal
from skyweave.functions import ozone as oz
from skyweave.functions import text as tx

_FILE = "'out/' || CAST(1995 + o_custkey % 40 AS VARCHAR) || '_' || ['Annual', 'x top-10 y', 'none', 'DJF_MAM'][CAST(o_orderkey % 4 + 1 AS INTEGER)] || '.csv'"


@query(
    "fn_name_year_and_period",
    f"""SELECT o_orderkey, f, CASE WHEN regexp_matches(f, '20[0-2][0-9]') THEN CAST(regexp_extract(f, '(20[0-2][0-9])', 1) AS INTEGER) END AS y,
 CASE WHEN contains(f, 'DJF') THEN 'DJF' WHEN contains(f, 'Annual') THEN 'Annual' WHEN contains(f, 'top-10') THEN 'top-10' END AS period
 FROM (SELECT o_orderkey, {_FILE} AS f FROM orders)""",
)
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Annual", "x top-10 y", "none", "DJF_MAM")])
    name = F.concat(
        F.lit("out/"),
        (1995 + F.col("o_custkey") % 40).cast("string"),
        F.lit("_"),
        F.element_at(words, (F.col("o_orderkey") % 4 + 1).cast("int")),
        F.lit(".csv"),
    )
    files = fx.table(spark, sf, "orders").select("o_orderkey", name.alias("f"))
    return files.select("o_orderkey", "f", tx.year_in_name("f").alias("y"), tx.period_key("f").alias("period"))


@query(
    "fn_site_ids",
    "SELECT c_custkey, ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') AS id FROM customer",
)
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", tx.canonical_site("c_name").alias("id"))


@query(
    "fn_text_parts",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, replace(p_brand, 'Brand#', 'B') AS brand, starts_with(p_type, 'ECO') AS eco,
 lpad(CAST(p_size AS VARCHAR), 4, '0') AS size4, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind FROM part""",
)
def _(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        F.split("p_name", " ")[0].alias("first_word"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("brand"),
        F.col("p_type").startswith("ECO").alias("eco"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size4"),
        F.initcap("p_type").alias("kind"),
    )


@query(
    "fn_period_spelling",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'top-10' WHEN l_linenumber = 6 THEN 'Apr-Sep' ELSE 'JJA' END AS period FROM lineitem",
)
def _(spark, sf):
    spelled = F.when(F.col("l_linenumber") == 7, "top - 10").when(F.col("l_linenumber") == 6, "Apr - Sep").otherwise("JJA")
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.canonical_period(spelled).alias("period"))


@query(
    "fn_compound_cell_id",
    "SELECT id, CAST(right(id, 3) AS INTEGER) AS ROW, CAST(left(id, len(id) - 3) AS INTEGER) AS COL FROM (SELECT CAST((l_suppkey % 459 + 1) * 1000 + l_partkey % 299 + 1 AS VARCHAR) AS id FROM lineitem)",
)
def _(spark, sf):
    ids = fx.table(spark, sf, "lineitem").select(
        F.expr("CAST((l_suppkey % 459 + 1) * 1000 + l_partkey % 299 + 1 AS STRING)").alias("id")
    )
    row, column = tx.cell_of_compound_id("id")
    return ids.select("id", row.alias("ROW"), column.alias("COL"))


@query(
    "fn_method_labels",
    """SELECT name, count(*) AS n, CASE name WHEN 'model' THEN 'EQUATES' WHEN 'evna_ozone' THEN 'eVNA' WHEN 'avna_ozone' THEN 'aVNA' WHEN 'vna_ozone' THEN 'VNA' END AS label
 FROM (UNPIVOT (SELECT vna_ozone, evna_ozone, avna_ozone, model FROM fused_daily) ON vna_ozone, evna_ozone, avna_ozone, model INTO NAME name VALUE v) GROUP BY name""",
    "fused_daily",
)
def _(spark, sf):
    long = fx.fused_daily(spark, sf).select(*fx.METHODS).unpivot([], fx.METHODS, "name", "v")
    counts = long.filter(F.col("v").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
    return counts.withColumn("label", tx.method_label("name"))


@query(
    "fn_month_set_labels",
    """SELECT ROW, COL, CAST(year("Timestamp") AS INTEGER) AS "Year", CASE WHEN month("Timestamp") <= 3 THEN 'JFM_' WHEN month("Timestamp") <= 6 THEN 'AMJ_' WHEN month("Timestamp") <= 9 THEN 'JAS_' ELSE 'OND_' END || CAST(year("Timestamp") AS VARCHAR) AS label,
 avg(model) AS model FROM fused_daily GROUP BY ALL""",
    "fused_daily",
    "model",
)
def _(spark, sf):
    from skyweave.operators.rollup import calendar_means

    quarters = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]]
    dated = fx.fused_daily(spark, sf).withColumn("Year0", F.year("Timestamp"))
    means = calendar_means(
        dated, ["ROW", "COL", "Year0"], "Timestamp", ["model"], {cal.month_set_label(q, ""): q for q in quarters}
    )
    return means.withColumn("label", F.concat("label", F.col("Year0").cast("string"))).withColumnRenamed("Year0", "Year")


@query(
    "fn_date_parts",
    """SELECT l_orderkey, l_linenumber, strptime(strftime(l_shipdate, '%Y%m%d'), '%Y%m%d')::DATE AS d, CAST(dayofyear(l_shipdate) AS INTEGER) AS doy,
 CAST(day(last_day(l_shipdate)) AS INTEGER) AS days, strftime(l_shipdate, '%Y-%m-%d') AS text FROM lineitem""",
)
def _(spark, sf):
    compact = F.date_format("l_shipdate", "yyyyMMdd")
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.to_date(compact, "yyyyMMdd").alias("d"),
        F.dayofyear("l_shipdate").alias("doy"),
        cal.days_in_month("l_shipdate").alias("days"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"),
    )


@query(
    "fn_hour_shifts",
    """SELECT site_id, POCode, dateon, O3, dateon + to_hours(5) AS plus5, dateon - to_hours(CAST(-4 - POCode AS INTEGER)) AS utc FROM obs_hourly""",
    "obs_hourly",
)
def _(spark, sf):
    obs = fx.obs_hourly(spark, sf).select("site_id", "POCode", "dateon", "O3")
    return obs.withColumns(
        {"plus5": cal.shift_hours("dateon", 5), "utc": cal.local_to_utc("dateon", -4 - F.col("POCode"))}
    )


@query(
    "fn_w126_weight",
    'SELECT ROW, COL, "Timestamp", (model / 1000) / (1 + 4403 * exp(-126 * (model / 1000))) AS w FROM fused_daily',
    "fused_daily",
    "w",
    digits=9,
)
def _(spark, sf):
    return fx.fused_daily(spark, sf).select(
        "ROW", "COL", "Timestamp", oz.w126_weight(oz.ppb_to_ppm("model")).alias("w")
    )


@query(
    "fn_fusion_columns",
    """SELECT ROW, COL, "Timestamp", model - vna_ozone AS bias, CASE WHEN model <> 0 THEN vna_ozone / model END AS r_n, model - (model - evna_ozone) AS additive,
 model * (CASE WHEN model <> 0 THEN vna_ozone / model END) AS ratio, CASE WHEN evna_ozone <> 0 THEN model * vna_ozone / evna_ozone END AS quotient FROM fused_daily""",
    "fused_daily",
    "bias r_n additive ratio quotient",
)
def _(spark, sf):
    return fx.fused_daily(spark, sf).select(
        "ROW",
        "COL",
        "Timestamp",
        oz.model_bias("model", "vna_ozone").alias("bias"),
        oz.response_ratio("vna_ozone", "model").alias("r_n"),
        oz.additive_fusion("model", oz.model_bias("model", "evna_ozone")).alias("additive"),
        oz.ratio_fusion("model", oz.response_ratio("vna_ozone", "model")).alias("ratio"),
        oz.quotient_fusion("model", "vna_ozone", "evna_ozone").alias("quotient"),
    )


@query(
    "fn_min_max_scale",
    """SELECT ROW, COL, "Timestamp", (model - lo) / (hi - lo) AS scaled, CAST(trunc(model) AS INTEGER) AS whole, sqrt(pow(model, 2) + pow(vna_ozone, 2)) AS norm FROM
 fused_daily CROSS JOIN (SELECT min(model) AS lo, max(model) AS hi FROM fused_daily)""",
    "fused_daily",
    "scaled norm",
)
def _(spark, sf):
    df = fx.fused_daily(spark, sf)
    ends = df.agg(F.min("model").alias("lo"), F.max("model").alias("hi"))
    return df.select(
        "ROW",
        "COL",
        "Timestamp",
        oz.min_max_scale("model", ends.select("lo").scalar(), ends.select("hi").scalar()).alias("scaled"),
        F.col("model").cast("int").alias("whole"),
        F.hypot("model", "vna_ozone").alias("norm"),
    )


@query(
    "fn_exposure_bins",
    """SELECT bin, count(*) AS n FROM (SELECT CASE WHEN v < 0 THEN NULL WHEN v <= 40 THEN '< 40' WHEN v <= 50 THEN '40-50' WHEN v <= 60 THEN '50-60'
 WHEN v <= 70 THEN '60-70' WHEN v <= 80 THEN '70-80' WHEN v IS NOT NULL THEN '> 80' END AS bin FROM (SELECT avna_ozone - 5 AS v FROM fused_daily)) GROUP BY bin""",
    "fused_daily",
)
def _(spark, sf):
    shifted = fx.fused_daily(spark, sf).select(oz.exposure_bin(F.col("avna_ozone") - 5).alias("bin"))
    return shifted.groupBy("bin").agg(F.count("*").alias("n"))


@query(
    "fn_array_ranks",
    """SELECT ROW, COL, "Timestamp", list_sum(top2) / 2 AS mean2, top2[1] AS first, quantile AS q FROM (SELECT ROW, COL, "Timestamp",
 list_reverse_sort([vna_ozone, evna_ozone, model])[1:2] AS top2, list_sort([vna_ozone, evna_ozone, model])[2] AS quantile FROM fused_daily)""",
    "fused_daily",
    "mean2 first q",
)
def _(spark, sf):
    values = F.array("vna_ozone", "evna_ozone", "model")
    top2 = F.slice(F.sort_array(values, asc=False), 1, 2)
    return fx.fused_daily(spark, sf).select(
        "ROW",
        "COL",
        "Timestamp",
        (F.aggregate(top2, F.lit(0.0), lambda a, v: a + v) / 2).alias("mean2"),
        F.element_at(top2, 1).alias("first"),
        F.element_at(F.sort_array(values), 2).alias("q"),
    )


@query(
    "fn_method_combinations",
    'SELECT ROW, COL, "Year", Period, count(*) AS pairs FROM (SELECT ROW, COL, "Year", Period, unnest(range(15)) AS i FROM metrics) GROUP BY ALL',
    "metrics",
)
def _(spark, sf):
    from skyweave.operators.compare import method_pairs

    pairs = fx.metrics(spark, sf).select(
        "ROW", "COL", "Year", "Period", F.explode(method_pairs(fx.METRIC_COLUMNS)).alias("p")
    )
    return pairs.groupBy("ROW", "COL", "Year", "Period").agg(F.count("p.pair").alias("pairs"))


@query(
    "fn_name_map",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders",
)
def _(spark, sf):
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", tx.mapped("o_orderstatus", {"F": "final", "O": "open"}).alias("status")
    )


@query("fn_json_navigation", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k INT")
    return fx.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query(
    "j29_zone_name_hours",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN -5 WHEN 'N' THEN -6 WHEN 'R' THEN NULL END AS hours FROM lineitem""",
)
def _(spark, sf):
    zone = F.when(F.col("l_returnflag") == "A", "Eastern").when(F.col("l_returnflag") == "N", "Central").otherwise("Unknown")
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.zone_hours(zone).alias("hours"))
