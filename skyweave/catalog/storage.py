"""Queries: sources and sinks, on files written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.session import parts_of, scratch_path
from skyweave.sources import grids as gr
from skyweave.sources import sinks as sk
from skyweave.sources import tables as tb

DAY = 'ROW, COL, "Timestamp", vna_ozone, evna_ozone, avna_ozone, model'
_SCHEMA = "ROW INT, COL INT, Timestamp DATE, vna_ozone DOUBLE, evna_ozone DOUBLE, avna_ozone DOUBLE, model DOUBLE"


def daily_csv(spark, sf) -> str:
    path = scratch_path(spark, "daily") + ".csv"
    sk.write_csv(fx.fused_daily(spark, sf), path)
    return path


@query("s01_csv_inferred", f"SELECT {DAY} FROM fused_daily", "fused_daily")
def _(spark, sf):
    return tb.read_csv(spark, daily_csv(spark, sf))


@query("s02_csv_pruned", 'SELECT ROW, COL, model FROM fused_daily', "fused_daily")
def _(spark, sf):
    return tb.read_csv(spark, daily_csv(spark, sf), _SCHEMA, ["ROW", "COL", "model"])


def _lines(spark, sf):
    return fx.fused_daily(spark, sf).select(
        F.to_csv(F.struct("ROW", "COL", "Timestamp", "model")).alias("value")
    )


@query("s03_csv_with_preamble", 'SELECT ROW, COL, "Timestamp", model FROM fused_daily', "fused_daily")
def _(spark, sf):
    path = scratch_path(spark, "preamble")
    head = spark.range(4).select(F.concat(F.lit("# preamble line "), F.col("id").cast("string")).alias("value"))
    head.unionByName(_lines(spark, sf)).write.text(path)
    return tb.read_csv_body(spark, path, "ROW INT, COL INT, Timestamp DATE, model DOUBLE", "^[0-9]+,[0-9]+,")


@query("s03_csv_after_lines", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf):
    """Three lines before the data of each file: small ones, and files of ``TASK_ROWS`` rows, the more the larger the table."""
    path = scratch_path(spark, "skipped")
    items = fx.table(spark, sf, "lineitem")
    parts = parts_of(items.count())
    share = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts))
    file_no = (2 * share + (F.col("l_orderkey") % 10 == 0).cast("int")).alias("f")
    rows = items.select(
        file_no, F.lit(3).alias("o"), F.to_csv(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("value")
    )
    head = rows.select("f").distinct().withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "f", "o", F.concat(F.lit("header "), F.col("o").cast("string")).alias("value")
    )
    (
        rows.unionByName(head)
        .repartition(2 * parts, "f")
        .sortWithinPartitions("f", "o")
        .select("f", "value")
        .write.partitionBy("f")
        .text(path)
    )
    schema = "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE"
    return tb.read_csv_after(spark, path, schema, 3)


@query("s03_csv_without_header", 'SELECT ROW, COL, "Timestamp", model FROM fused_daily', "fused_daily")
def _(spark, sf):
    path = scratch_path(spark, "headerless")
    _lines(spark, sf).write.text(path)
    return spark.read.schema("ROW INT, COL INT, Timestamp DATE, model DOUBLE").csv(path)


def cube(spark, sf):
    """One nested rows x columns array per month: a cube has a fixed number of cells."""
    model = gr.surface_layer(fx.model_daily(spark, sf))
    cell = F.struct((F.col("ROW") * 100 + F.col("COL")).alias("k"), F.col("O3_MDA8").alias("v"))
    months = model.groupBy("Date").agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    nested = F.expr(
        f"transform(sequence(1, {fx.ROWS}), r -> transform(sequence(1, {fx.COLS}), c -> try_element_at(m, r * 100 + c)))"
    )
    return months.select("Date", (F.dayofyear("Date") - 1).alias("TSTEP"), F.lit(0).alias("LAY"), nested.alias("v"))


_CUBE = """SELECT d."Date", CAST(r AS INTEGER) AS ROW, CAST(c AS INTEGER) AS COL, m.O3_MDA8 FROM (SELECT DISTINCT "Date" FROM model_daily WHERE LAY = 0) d CROSS JOIN (SELECT unnest(range(1, 11)) AS r) CROSS JOIN (SELECT unnest(range(1, 13)) AS c)
 LEFT JOIN (SELECT * FROM model_daily WHERE LAY = 0) m ON m."Date" = d."Date" AND m.ROW = r AND m.COL = c"""


@query("s04_cube_to_rows", _CUBE, "model_daily", "O3_MDA8")
def _(spark, sf):
    return gr.cube_to_rows(cube(spark, sf), ["Date"], name="O3_MDA8")


_FLAG = "CAST(year(l_shipdate) * 1000 + dayofyear(l_shipdate) + CASE WHEN l_linenumber = 7 THEN 400 ELSE 0 END AS INT)"


@query(
    "s05_julian_flags",
    "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS \"Date\" FROM lineitem WHERE l_linenumber <> 7 AND year(l_shipdate) = 1997",
)
def _(spark, sf):
    flagged = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_FLAG).alias("TFLAG"))
    return gr.dated_by_flag(flagged, 1997).select("l_orderkey", "l_linenumber", "Date")


@query("s06_step_dates", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS \"Date\" FROM lineitem")
def _(spark, sf):
    steps = fx.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.year("l_shipdate").alias("y"),
        (F.dayofyear("l_shipdate") - 1).alias("TSTEP"),
    )
    return gr.dated_by_step(steps, F.col("y")).select("l_orderkey", "l_linenumber", "Date")


_DATES = 'SELECT DISTINCT CAST(date_trunc(\'month\', o_orderdate) AS DATE) AS "Date" FROM orders WHERE o_orderstatus = \'F\' AND year(o_orderdate) = 1998'


@query(
    "s07_time_slices",
    f'SELECT ROW, COL, LAY, "Date", O3_MDA8 FROM model_daily WHERE "Date" IN ({_DATES})',
    "model_daily",
    "O3_MDA8",
)
def _(spark, sf):
    dates = fx.columns(
        fx.table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1998)),
        "Date = CAST(trunc(o_orderdate, 'MONTH') AS DATE)",
    )
    return gr.slices_at_dates(fx.model_daily(spark, sf), dates)


@query(
    "s07_time_slices_by_index",
    f""", d AS ({_DATES}) SELECT m.ROW, m.COL, m.O3_MDA8, d."Date", CAST(dayofyear(m."Date") - 1 AS INTEGER) AS TSTEP FROM model_daily m JOIN d ON dayofyear(d."Date") = dayofyear(m."Date") WHERE LAY = 0""",
    "model_daily",
    "O3_MDA8",
)
def _(spark, sf):
    dates = fx.columns(
        fx.table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1998)),
        "Date = CAST(trunc(o_orderdate, 'MONTH') AS DATE)",
    )
    model = gr.surface_layer(fx.model_daily(spark, sf)).select(
        "ROW", "COL", "O3_MDA8", (F.dayofyear("Date") - 1).alias("TSTEP")
    )
    return gr.slices_at_dates(model, dates, by_index=True)


@query("s08_surface_layer", "SELECT * FROM model_daily WHERE LAY = 0", "model_daily", "O3_MDA8")
def _(spark, sf):
    return gr.surface_layer(fx.model_daily(spark, sf))


@query(
    "s09_yearly_files",
    'SELECT ROW, COL, Period, model, CAST("Year" + 10 AS INTEGER) AS "Year" FROM metrics',
    "metrics",
    "model",
)
def _(spark, sf):
    m = fx.metrics(spark, sf)
    root = scratch_path(spark, "years")
    for year in range(1992, 2002):
        rows = m.filter(F.col("Year") == year).select("ROW", "COL", "Period", "model")
        sk.write_csv(rows, f"{root}/{year + 10}_Metrics.csv")
    paths = [f"{root}/{y}_Metrics.csv" for y in range(2000, 2013)]
    return tb.read_years(spark, paths, "ROW INT, COL INT, Period STRING, model DOUBLE")


def model_store(spark, sf) -> str:
    """The hourly model partitioned by year and month."""
    path = scratch_path(spark, "hourly")
    model = fx.model_hourly(spark, sf)
    dated = model.withColumns({"year": F.year("TSTEP"), "month": F.month("TSTEP")})
    sk.write_by(dated, path, ["year", "month"])
    return path


@query(
    "s10_month_slices",
    """SELECT ROW, COL, TSTEP, O3, CAST(year(TSTEP) AS INTEGER) AS "year", CAST(month(TSTEP) AS INTEGER) AS "month" FROM model_hourly
 WHERE TSTEP IN (SELECT dateon + to_hours(6) FROM obs_hours WHERE hour(dateon) < 12)""",
    "model_hourly obs_hours",
    "O3",
)
def _(spark, sf):
    from skyweave.functions.calendar import shift_hours

    model = spark.read.parquet(model_store(spark, sf))
    hours = fx.obs_hours(spark, sf).filter(F.hour("dateon") < 12).select(shift_hours("dateon", 6).alias("TSTEP"))
    return tb.month_slices(model, hours, "TSTEP").select("ROW", "COL", "TSTEP", "O3", "year", "month")


@query(
    "s11_spill_years",
    """SELECT site_id, POCode, dateon, O3, Lat, Lon, CAST(year(dateon) AS INTEGER) AS "Year" FROM obs_hourly WHERE dateon BETWEEN TIMESTAMP '2010-12-31 16:00:00' AND TIMESTAMP '2011-03-01 04:00:00'""",
    "obs_hourly",
)
def _(spark, sf):
    path = scratch_path(spark, "obs")
    sk.write_by(fx.obs_hourly(spark, sf).withColumn("Year", F.year("dateon")), path, ["Year"])
    return tb.with_spill_years(spark.read.parquet(path), "dateon", "2011-01-01 00:00:00", "2011-03-01 08:00:00")


@query("s14_reader_by_format", f"SELECT {DAY} FROM fused_daily", "fused_daily")
def _(spark, sf):
    """The same table cut in three and stored as csv, json and parquet."""
    df = fx.fused_daily(spark, sf)
    parts = []
    for i, kind in enumerate(("csv", "json", "parquet")):
        path = f"{scratch_path(spark, 'any')}.{kind}"
        part = df.filter(F.col("ROW") % 3 == i)
        writer = part.write.option("header", True) if kind == "csv" else part.write
        writer.format(kind).save(path)
        parts.append(tb.read_any(spark, path, _SCHEMA))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k01_csv_sink", 'SELECT ROW, COL, "Timestamp", model FROM fused_daily', "fused_daily")
def _(spark, sf):
    path = scratch_path(spark, "sink")
    sk.write_csv(fx.fused_daily(spark, sf).select("ROW", "COL", "Timestamp", "model"), path)
    return tb.read_csv(spark, path, "ROW INT, COL INT, Timestamp DATE, model DOUBLE")


@query(
    "k02_files_per_day",
    """SELECT "Date", ROW, COL, O3_MDA8 FROM model_daily WHERE LAY = 0""",
    "model_daily",
    "O3_MDA8",
)
def _(spark, sf):
    path = scratch_path(spark, "days")
    sk.write_by(gr.surface_layer(fx.model_daily(spark, sf)).drop("LAY"), path, ["Date"])
    return spark.read.parquet(path)


@query(
    "k03_files_per_metric",
    "SELECT Period, ROW, COL, \"Year\", model FROM metrics",
    "metrics",
    "model",
)
def _(spark, sf):
    path = scratch_path(spark, "periods")
    rows = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "model")
    sk.write_by(rows, path, ["Period"])
    return spark.read.parquet(path)


@query(
    "k04_replace_table",
    'SELECT ROW, COL, "Year", Period, model, model * 2 AS twice FROM metrics',
    "metrics",
    "model twice",
)
def _(spark, sf):
    path = scratch_path(spark, "replaced")
    fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "model").write.parquet(path)
    sk.replace_table(spark.read.parquet(path).withColumn("twice", F.col("model") * 2), path)
    return spark.read.parquet(path)


@query("k05_append_rows", 'SELECT ROW, COL, "Year", Period, model FROM metrics', "metrics", "model")
def _(spark, sf):
    path = scratch_path(spark, "appended")
    m = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "model")
    sk.append_rows(m.filter(F.col("Year") < 1998), path)
    sk.append_rows(m.filter(F.col("Year") >= 1998), path)
    return spark.read.parquet(path)


@query(
    "k06_write_missing_only",
    """SELECT ROW, COL, "Year", Period, CASE WHEN Period = 'DJF' THEN 0.0::DOUBLE ELSE model END AS model FROM metrics""",
    "metrics",
    "model",
)
def _(spark, sf):
    path = scratch_path(spark, "resumed")
    m = fx.metrics(spark, sf).select("ROW", "COL", "Year", "Period", "model")
    sk.write_missing(m.filter(F.col("Period") == "DJF").withColumn("model", F.lit(0.0)), path, ["Period"])
    sk.write_missing(m, path, ["Period"])
    return spark.read.parquet(path)
