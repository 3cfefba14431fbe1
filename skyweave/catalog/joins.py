"""Queries: joins between domain tables and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.operators import combine as co
from skyweave.operators import hourly as hr

DAY = 'ROW, COL, "Timestamp", vna_ozone, evna_ozone, avna_ozone, model'


@query(
    "j01_grid_time_zone",
    f"SELECT {DAY}, gmt_offset FROM fused_daily LEFT JOIN tz_grid USING (ROW, COL)",
    "fused_daily tz_grid",
)
def _(spark, sf):
    zones = fx.tz_grid(spark, sf).select("ROW", "COL", "gmt_offset")
    return fx.fused_daily(spark, sf).join(zones, ["ROW", "COL"], "left")


@query(
    "j02_site_time_zone",
    "SELECT o.*, gmt_offset, epa_region FROM obs_hours o LEFT JOIN tz_site USING (site_id)",
    "obs_hours tz_site",
)
def _(spark, sf):
    return co.with_site_offsets(fx.obs_hours(spark, sf), fx.tz_site(spark, sf), fill=False)


@query(
    "j05_known_cell_join",
    """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, ROW, COL, gmt_offset FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 10 + 1 AS INTEGER) AS ROW, CAST(l_suppkey % 15 + 1 AS INTEGER) AS COL FROM lineitem)
 LEFT JOIN tz_grid USING (ROW, COL)""",
    "tz_grid",
)
def _(spark, sf):
    monitors = fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_partkey") % 10 + 1).cast("int").alias("ROW"),
        (F.col("l_suppkey") % 15 + 1).cast("int").alias("COL"),
    )
    grid = fx.tz_grid(spark, sf).select("ROW", "COL", "gmt_offset")
    return monitors.join(grid, ["ROW", "COL"], "left")


@query(
    "j07_exclude_sites",
    "SELECT * FROM obs_daily WHERE Site NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 5)",
    "obs_daily",
)
def _(spark, sf):
    bad = fx.table(spark, sf, "supplier").filter(F.col("s_nationkey") < 5)
    return fx.obs_daily(spark, sf).join(
        bad.select(F.col("s_suppkey").cast("string").alias("Site")), "Site", "left_anti"
    )


@query(
    "j09_attach_downscaler",
    'SELECT o.Site, o."Date", POC, Conc, Prediction AS ds_ozone FROM obs_daily o LEFT JOIN cv_assignment c ON c.Site = o.Site AND c."Date" = o."Date"',
    "obs_daily cv_assignment",
    "ds_ozone",
)
def _(spark, sf):
    predictions = fx.cv_assignment(spark, sf).select("Site", "Date", F.col("Prediction").alias("ds_ozone"))
    return fx.obs_daily(spark, sf).select("Site", "Date", "POC", "Conc").join(
        predictions, ["Site", "Date"], "left"
    )


@query(
    "j10_add_metric_column",
    """SELECT m.ROW, m.COL, m.Period, m.Pair, m.model, d.ds_ozone FROM metrics_even m LEFT JOIN metrics_odd d USING (ROW, COL, Period, Pair)""",
    "metrics_even metrics_odd",
    "model ds_ozone",
)
def _(spark, sf):
    mine, extra = fx.metric_sides(spark, sf)
    keys = ["ROW", "COL", "Period", "Pair"]
    return mine.select(*keys, "model").join(extra.select(*keys, "ds_ozone"), keys, "left")


@query(
    "j11_densify_grid",
    'SELECT CAST(r AS INTEGER) AS ROW, CAST(c AS INTEGER) AS COL, d.n FROM (SELECT unnest(range(1, 11)) AS r) CROSS JOIN (SELECT unnest(range(1, 13)) AS c) LEFT JOIN (SELECT ROW + 1 AS ROW, COL, count(*) AS n FROM fused_daily GROUP BY ALL) d ON d.ROW = r AND d.COL = c',
    "fused_daily",
)
def _(spark, sf):
    from skyweave.sources.grids import regular_grid

    # One row up: the first row of the grid has no counts, the last counts have no cell.
    counts = fx.fused_daily(spark, sf).groupBy((F.col("ROW") + 1).alias("ROW"), "COL").agg(F.count("*").alias("n"))
    return regular_grid(spark, fx.ROWS, fx.COLS).join(counts, ["ROW", "COL"], "left")


@query(
    "j15_index_comparison",
    """SELECT a.id, a.own, b.other, a.own - b.other AS diff FROM (SELECT ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') AS id, c_acctbal AS own FROM customer) a
 JOIN (SELECT CAST(o_custkey AS VARCHAR) AS id, avg(o_totalprice) AS other FROM orders GROUP BY o_custkey) b USING (id)""",
    floats="other diff",
    digits=4,
)
def _(spark, sf):
    from skyweave.functions.text import canonical_site

    own = fx.table(spark, sf, "customer").select(canonical_site("c_name").alias("id"), F.col("c_acctbal").alias("own"))
    other = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.avg("o_totalprice").alias("other"))
    return own.join(other, "id").withColumn("diff", F.col("own") - F.col("other"))


@query(
    "j17_climate_region",
    "SELECT ROW, COL, \"Year\", Period, model, ClimateRegion FROM metrics LEFT JOIN climate_region USING (ROW, COL)",
    "metrics climate_region",
    "model",
)
def _(spark, sf):
    m = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "model")
    return m.join(fx.climate_region(spark, sf), ["ROW", "COL"], "left")


@query(
    "j18_offset_difference",
    "SELECT f.ROW, f.COL, f.\"Timestamp\", a.gmt_offset - b.gmt_offset AS diff FROM fused_daily f JOIN tz_grid a ON a.ROW = f.ROW AND a.COL = f.COL JOIN tz_grid b ON b.ROW = f.COL AND b.COL = f.ROW",
    "fused_daily tz_grid",
)
def _(spark, sf):
    tz = fx.tz_grid(spark, sf).select("ROW", "COL", "gmt_offset")
    other = tz.select(F.col("COL").alias("ROW"), F.col("ROW").alias("COL"), F.col("gmt_offset").alias("b"))
    both = tz.join(other, ["ROW", "COL"]).select("ROW", "COL", (F.col("gmt_offset") - F.col("b")).alias("diff"))
    return fx.fused_daily(spark, sf).select("ROW", "COL", "Timestamp").join(both, ["ROW", "COL"])


@query(
    "j19_site_coordinates",
    "SELECT o_orderkey, o_custkey, n_regionkey FROM orders JOIN (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey) ON c_custkey = o_custkey",
)
def _(spark, sf):
    nations = fx.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    places = fx.table(spark, sf, "customer").join(
        nations, F.col("n_nationkey") == F.col("c_nationkey")
    )
    return (
        fx.table(spark, sf, "orders")
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_custkey", "n_regionkey")
    )


@query(
    "j20_first_station",
    """SELECT o.Site, o."Date", o.Conc, s.Lat, s.POC AS first_poc FROM obs_daily o JOIN (SELECT Site, arg_min(Lat, k) AS Lat, arg_min(POC, k) AS POC FROM (SELECT Site, Lat, POC, {'d': "Date", 'p': POC} AS k FROM obs_daily) GROUP BY Site) s USING (Site)""",
    "obs_daily",
)
def _(spark, sf):
    obs = fx.obs_daily(spark, sf)
    stations = obs.withColumn("k", F.struct("Date", "POC"))
    first = co.first_station(stations, "Site", ["Lat", "POC"], "k").withColumnRenamed("POC", "first_poc")
    return obs.select("Site", "Date", "Conc").join(first, "Site")


@query(
    "j21_fill_from_second_table",
    """SELECT a.site_id, a.dateon, coalesce(a.O3, b.O3) AS O3 FROM (SELECT site_id, dateon, max(CASE WHEN O3 <> -999 AND O3 < 60 THEN O3 END) AS O3 FROM obs_hourly GROUP BY ALL) a
 LEFT JOIN (SELECT site_id, dateon, min(O3) AS O3 FROM obs_hourly WHERE POCode = 2 AND O3 <> -999 GROUP BY ALL) b USING (site_id, dateon)""",
    "obs_hourly",
)
def _(spark, sf):
    obs = fx.obs_hourly(spark, sf)
    keys = ["site_id", "dateon"]
    low = F.when((F.col("O3") != -999) & (F.col("O3") < 60), F.col("O3"))
    first = obs.groupBy(*keys).agg(F.max(low).alias("O3"))
    second = obs.filter((F.col("POCode") == 2) & (F.col("O3") != -999)).groupBy(*keys).agg(F.min("O3").alias("O3"))
    return co.fill_from(first, second, keys, "O3")


@query(
    "j25_nearest_region_of_site",
    """SELECT s.id AS site_id, arg_min(k.reg, {'d': (s.Lat - k.Lat) * (s.Lat - k.Lat) + (s.Lon - k.Lon) * (s.Lon - k.Lon), 's': k.id}) AS epa_region FROM
 (SELECT CAST(c_custkey AS VARCHAR) AS id, 25 + c_custkey * 53 % 1999 / 64.0 AS Lat, -120 + c_custkey * 17 % 3001 / 64.0 AS Lon FROM customer) s,
 (SELECT CAST(s_suppkey AS VARCHAR) AS id, 30 + s_suppkey * 37 % 1000 / 64.0 AS Lat, -120 + s_suppkey * 91 % 2999 / 64.0 AS Lon, 'R' || CAST(s_nationkey AS VARCHAR) AS reg FROM supplier) k GROUP BY s.id""",
)
def _(spark, sf):
    missing = fx.columns(
        fx.table(spark, sf, "customer"),
        "site_id = CAST(c_custkey AS STRING)\nLat = 25 + c_custkey * 53 % 1999 / 64D\nLon = -120 + c_custkey * 17 % 3001 / 64D",
    )
    known = fx.columns(
        fx.table(spark, sf, "supplier"),
        "site_id = CAST(s_suppkey AS STRING)\nLat = 30 + s_suppkey * 37 % 1000 / 64D\nLon = -120 + s_suppkey * 91 % 2999 / 64D\nepa_region = concat('R', CAST(s_nationkey AS STRING))",
    )
    return co.nearest_entries(missing, known, ["epa_region"])


@query(
    "j25_thirty_neighbours",
    """SELECT POC, id, Site, CAST(r AS INTEGER) AS rank, sqrt(d2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY POC, id ORDER BY d2, Site) AS r
 FROM (SELECT *, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM (SELECT ROW * 100 + COL AS id, -125 + COL * 5.0 AS px, 25 + ROW * 2.5 AS py FROM cells) p,
 (SELECT DISTINCT POC, Site, Lon AS x, Lat AS y FROM obs_daily) s)) WHERE r <= 30""",
    "obs_daily cells",
    "distance",
)
def _(spark, sf):
    from skyweave.operators.matching import nearest_k

    sites = fx.obs_daily(spark, sf).select("POC", "Site", F.col("Lon").alias("x"), F.col("Lat").alias("y")).distinct()
    cells = fx.tz_grid(spark, sf).select((F.col("ROW") * 100 + F.col("COL")).alias("id"), F.col("Lon").alias("x"), F.col("Lat").alias("y"))
    keys = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("POC")
    return nearest_k(cells.select(keys, "id", "x", "y"), sites, ["POC"], "id", "Site", 30)


@query(
    "j26_fused_value_at_test_cell",
    """, t AS (SELECT Site, "Date", Conc, CAST(CAST(Site AS INTEGER) % 10 + 1 AS INTEGER) AS ROW, CAST(CAST(Site AS INTEGER) % 12 + 1 AS INTEGER) AS COL FROM obs_daily),
 f AS (SELECT ROW, COL, "Timestamp" AS "Date", avg(vna_ozone) AS vna_ozone, avg(evna_ozone) AS evna_ozone FROM fused_daily GROUP BY ALL),
 j AS (SELECT Site, "Date", Conc AS y_true, ROW, COL, vna_ozone, evna_ozone FROM t JOIN f USING (ROW, COL, "Date"))
 SELECT Site, "Date", y_true, ROW, COL, 'vna_ozone' AS "Method", vna_ozone AS y_pred FROM j UNION ALL SELECT Site, "Date", y_true, ROW, COL, 'evna_ozone', evna_ozone FROM j""",
    "obs_daily fused_daily",
    "y_pred",
)
def _(spark, sf):
    from skyweave.operators.reshape import methods_to_rows

    number = F.col("Site").cast("int")
    test = fx.obs_daily(spark, sf).select(
        "Site", "Date", F.col("Conc").alias("y_true"), (number % 10 + 1).alias("ROW"), (number % 12 + 1).alias("COL")
    )
    fused = (
        fx.fused_daily(spark, sf)
        .groupBy("ROW", "COL", F.col("Timestamp").alias("Date"))
        .agg(F.avg("vna_ozone").alias("vna_ozone"), F.avg("evna_ozone").alias("evna_ozone"))
    )
    joined = test.join(fused, ["ROW", "COL", "Date"])
    return methods_to_rows(joined, ["Site", "Date", "y_true", "ROW", "COL"], ["vna_ozone", "evna_ozone"])


@query(
    "j27_observation_on_cell",
    """SELECT c.ROW, c.COL, c.Period, c."Year", c.model, o.Conc FROM metrics c LEFT JOIN
 (SELECT CAST(CAST(Site AS INTEGER) % 10 + 1 AS INTEGER) AS ROW, CAST(CAST(Site AS INTEGER) % 12 + 1 AS INTEGER) AS COL, avg(Conc) AS Conc FROM obs_daily GROUP BY ALL) o USING (ROW, COL)""",
    "metrics obs_daily",
    "model Conc",
)
def _(spark, sf):
    number = F.col("Site").cast("int")
    stamped = fx.obs_daily(spark, sf).groupBy(
        (number % 10 + 1).alias("ROW"), (number % 12 + 1).alias("COL")
    ).agg(F.avg("Conc").alias("Conc"))
    grid = fx.metrics(spark, sf).select("ROW", "COL", "Period", "Year", "model")
    return grid.join(stamped, ["ROW", "COL"], "left")


@query(
    "j30_site_group_map",
    'SELECT o.Site, o."Date", POC, Conc, g.CVgroup FROM obs_daily o LEFT JOIN (SELECT Site, arg_max(CVgroup, "Date") AS CVgroup FROM cv_assignment GROUP BY Site) g USING (Site)',
    "obs_daily cv_assignment",
)
def _(spark, sf):
    groups = fx.cv_assignment(spark, sf).groupBy("Site").agg(F.max_by("CVgroup", "Date").alias("CVgroup"))
    return fx.obs_daily(spark, sf).select("Site", "Date", "POC", "Conc").join(groups, "Site", "left")


# Set operations.
_LEFT = """(SELECT * FROM obs_daily WHERE POC <> 2)"""
_RIGHT = """(SELECT * FROM obs_daily WHERE POC = 2)"""


def sides(spark, sf):
    obs = fx.obs_daily(spark, sf)
    return obs.filter(F.col("POC") != 2), obs.filter(F.col("POC") == 2)


@query(
    "u01_append_tables",
    f"""SELECT ROW, COL, "Timestamp", model, NULL::DOUBLE AS vna_ozone FROM fused_daily WHERE vna_ozone < 50
 UNION ALL SELECT ROW, COL, "Timestamp", NULL, vna_ozone FROM fused_daily WHERE vna_ozone >= 50""",
    "fused_daily",
)
def _(spark, sf):
    df = fx.fused_daily(spark, sf)
    cell = ["ROW", "COL", "Timestamp"]
    low = df.filter(F.col("vna_ozone") < 50).select(*cell, "model")
    high = df.filter(F.col("vna_ozone") >= 50).select(*cell, "vna_ozone")
    return co.append_all([low, high])


@query(
    "u02_splice_tables",
    """SELECT ROW, COL, "Timestamp", vna_ozone AS v FROM fused_daily WHERE "Timestamp" < DATE '1998-07-01' UNION ALL SELECT ROW, COL, "Timestamp", model FROM fused_daily WHERE "Timestamp" >= DATE '1998-07-01'""",
    "fused_daily",
)
def _(spark, sf):
    df = fx.fused_daily(spark, sf)
    side = lambda c: df.select("ROW", "COL", "Timestamp", F.col(c).alias("v"))
    return co.splice(side("vna_ozone"), side("model"), "Timestamp", F.lit("1998-07-01").cast("date"))


@query(
    "u03_duplicate_report",
    'SELECT Site, "Date", POC, Conc, count(*) AS n FROM obs_daily GROUP BY ALL HAVING count(*) > 1',
    "obs_daily",
)
def _(spark, sf):
    return co.duplicated(fx.obs_daily(spark, sf), ["Site", "Date", "POC", "Conc"])


@query("u03_duplicates_removed", "SELECT DISTINCT * FROM obs_daily", "obs_daily")
def _(spark, sf):
    return fx.obs_daily(spark, sf).dropDuplicates()


@query(
    "u04_key_flags",
    f"""SELECT coalesce(a.Site, b.Site) AS Site, coalesce(a."Date", b."Date") AS "Date", CAST(CASE WHEN a.Site IS NOT NULL AND b.Site IS NOT NULL THEN 1 WHEN a.Site IS NOT NULL THEN 2 ELSE 3 END AS INTEGER) AS Flag
 FROM (SELECT DISTINCT Site, "Date" FROM {_LEFT}) a FULL JOIN (SELECT DISTINCT Site, "Date" FROM {_RIGHT}) b ON a.Site = b.Site AND a."Date" = b."Date" """,
    "obs_daily",
)
def _(spark, sf):
    return co.key_flags(*sides(spark, sf), ["Site", "Date"])


@query(
    "u05_one_sided_sites",
    f"""SELECT coalesce(a.Site, b.Site) AS Site, coalesce(a."Date", b."Date") AS "Date", CAST(CASE WHEN a.Site IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS Flag, coalesce(a.Lat, b.Lat) AS Lat, coalesce(a.Lon, b.Lon) AS Lon
 FROM (SELECT Site, "Date", min(Lat) AS Lat, min(Lon) AS Lon FROM {_LEFT} GROUP BY ALL) a FULL JOIN (SELECT Site, "Date", min(Lat) AS Lat, min(Lon) AS Lon FROM {_RIGHT} GROUP BY ALL) b ON a.Site = b.Site AND a."Date" = b."Date"
 WHERE a.Site IS NULL OR b.Site IS NULL""",
    "obs_daily",
)
def _(spark, sf):
    return co.one_sided_sites(*sides(spark, sf), ["Site", "Date"], ["Lat", "Lon"])


@query(
    "u06_two_way_difference",
    f"""SELECT Site, "Date", 'left' AS side FROM (SELECT Site, "Date" FROM {_LEFT} EXCEPT SELECT Site, "Date" FROM {_RIGHT})
 UNION ALL SELECT Site, "Date", 'right' FROM (SELECT Site, "Date" FROM {_RIGHT} EXCEPT SELECT Site, "Date" FROM {_LEFT})""",
    "obs_daily",
)
def _(spark, sf):
    return co.two_way_difference(*sides(spark, sf), ["Site", "Date"])


@query(
    "u07_found_counts",
    "SELECT count(b.c) AS found, count(*) - count(b.c) AS not_found FROM (SELECT DISTINCT o_custkey AS c FROM orders) a LEFT JOIN (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS c FROM orders) b USING (c)",
)
def _(spark, sf):
    from skyweave.operators.audit import found_counts

    orders = fx.table(spark, sf, "orders")
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    return found_counts(orders, orders.withColumn("o_custkey", own), "o_custkey")


@query(
    "u08_validity_counts",
    """SELECT count(*) FILTER (x IS NULL AND y IS NULL) AS invalid_both, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS valid_left_only, count(*) FILTER (x IS NULL AND y IS NOT NULL) AS valid_right_only
 FROM (SELECT a.ds_ozone AS x, b.ds_ozone AS y FROM metrics_even a JOIN (SELECT ROW, COL, Period, Pair, CASE WHEN ds_ozone > 30 THEN ds_ozone END AS ds_ozone FROM metrics_odd) b USING (ROW, COL, Period, Pair))""",
    "metrics_even metrics_odd",
)
def _(spark, sf):
    from skyweave.operators.audit import validity_counts

    a, b = fx.metric_sides(spark, sf)
    b = b.withColumn("ds_ozone", F.when(F.col("ds_ozone") > 30, F.col("ds_ozone")))
    return validity_counts(a, b, ["ROW", "COL", "Period", "Pair"], "ds_ozone")


@query(
    "u09_common_and_missing",
    """, a AS (SELECT DISTINCT Site, Lat, Lon FROM obs_daily WHERE CAST(Site AS INTEGER) % 3 <> 0), b AS (SELECT DISTINCT CASE WHEN CAST(Site AS INTEGER) % 6 IN (1, 5) THEN CAST(CAST(Site AS INTEGER) + 6000000 AS VARCHAR) ELSE Site END AS Site, Lat + 1 AS Lat, Lon FROM obs_daily)
 SELECT * FROM a WHERE Site IN (SELECT Site FROM b) UNION ALL SELECT * FROM b WHERE Site NOT IN (SELECT Site FROM a)""",
    "obs_daily",
)
def _(spark, sf):
    sites = fx.obs_daily(spark, sf).select("Site", "Lat", "Lon").distinct()
    number = F.col("Site").cast("int")
    a = sites.filter(number % 3 != 0)
    renamed = F.when((number % 6).isin(1, 5), (number + 6000000).cast("string")).otherwise(F.col("Site"))
    b = sites.withColumns({"Site": renamed, "Lat": F.col("Lat") + 1})
    return co.common_and_missing(a, b, "Site")


@query(
    "u10_site_registry",
    """SELECT CAST(l_suppkey AS VARCHAR) AS Site, arg_max(lat, y) AS Lat, max(y) AS "Year" FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, 30 + l_suppkey % 100 / 64.0 + year(l_shipdate) % 10 AS lat FROM lineitem) GROUP BY l_suppkey""",
)
def _(spark, sf):
    rows = fx.columns(
        fx.table(spark, sf, "lineitem"),
        "Site = CAST(l_suppkey AS STRING)\nYear = CAST(year(l_shipdate) AS INT)\nLat = 30 + l_suppkey % 100 / 64D + year(l_shipdate) % 10",
    )
    yearly = [rows.filter(F.col("Year") == y) for y in range(1995, 2002)]
    return co.site_registry(yearly, "Site", ["Year", "Lat"])


@query(
    "u11_same_keys",
    f"""SELECT (SELECT count(*) FROM (SELECT "Date", Site FROM {_LEFT} EXCEPT ALL SELECT "Date", Site FROM {_RIGHT})) AS only_left,
 (SELECT count(*) FROM (SELECT "Date", Site FROM {_RIGHT} EXCEPT ALL SELECT "Date", Site FROM {_LEFT})) AS only_right, FALSE AS equal""",
    "obs_daily",
)
def _(spark, sf):
    return co.same_keys(*sides(spark, sf), ["Date", "Site"])


@query(
    "u12_synthetic_rows",
    """SELECT Site, "Date", POC, Lat, Lon, Conc FROM obs_daily UNION ALL SELECT Site, DATE '2000-01-01', 9, min(Lat), min(Lon), 0 FROM obs_daily GROUP BY Site""",
    "obs_daily",
)
def _(spark, sf):
    import datetime

    constants = {"Date": datetime.date(2000, 1, 1), "POC": 9, "Conc": 0.0}
    return co.synthetic_rows(fx.obs_daily(spark, sf), "Site", ["Lat", "Lon"], constants)
