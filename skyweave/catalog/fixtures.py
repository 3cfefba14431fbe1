"""Domain tables derived from the driver tables, once for Spark and once for SQL.

Concentrations are multiples of 1/64, so sums of them are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.projection import LambertConic
from skyweave.plans.fusion import Grid

ROWS, COLS = 10, 12
#: 400 km cells over the contiguous states.
GRID = Grid(
    LambertConic(33.0, 45.0, 40.0, -97.0, 2_400_000.0, 2_000_000.0, 400_000.0), ROWS, COLS
)
METHODS = ["vna_ozone", "evna_ozone", "avna_ozone", "model"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, text: str) -> DataFrame:
    """Select one ``name = expression`` per line."""
    pairs = [line.split(" = ", 1) for line in text.strip().splitlines()]
    return df.select(*[F.expr(e.strip()).alias(n.strip()) for n, e in pairs])


_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT) % 6400 / 64.0"
_EVNA = "(l_orderkey * 37 + l_linenumber * 11) % 6400 / 64.0"
_AVNA = "CASE WHEN l_linenumber <> 7 THEN (l_partkey * 31 + l_suppkey * 17 + l_orderkey) % 6000 / 64.0 END"
_CELL = """
    ROW = CAST(l_partkey % 10 + 1 AS INT)
    COL = CAST(l_suppkey % 12 + 1 AS INT)"""


def _d(text: str) -> str:
    """Divisions by 64.0 as doubles (a bare 64.0 is a decimal in Spark SQL)."""
    return text.replace("64.0", "64D").replace("1.5", "1.5D")


def fused_daily(spark, sf):
    return columns(
        table(spark, sf, "lineitem"),
        _CELL
        + _d(
            f"""
    Timestamp = CAST(l_shipdate AS DATE)
    vna_ozone = {_PRICE}
    evna_ozone = {_EVNA}
    avna_ozone = {_AVNA}
    model = l_quantity * 1.5"""
        ),
    )


_SQL_CELL = "CAST(l_partkey % 10 + 1 AS INTEGER) AS ROW, CAST(l_suppkey % 12 + 1 AS INTEGER) AS COL"
SQL_VIEWS: dict[str, tuple[str, list[str]]] = {}
SQL_VIEWS["fused_daily"] = (
    f"""SELECT {_SQL_CELL}, CAST(l_shipdate AS DATE) AS "Timestamp",
    {_PRICE} AS vna_ozone, {_EVNA} AS evna_ozone, {_AVNA} AS avna_ozone,
    l_quantity * 1.5 AS model FROM lineitem""",
    [],
)

# Hourly fields of 2011: 3 x 2 cells, one row per cell and hour.  One cell-day
# of avna_ozone is missing.
_HOURS = "(dayofyear(l_shipdate) - 1) * 24 + (l_orderkey * 7 + l_linenumber * 5 + l_partkey) % 24"


def fused_hourly(spark, sf):
    raw = columns(
        table(spark, sf, "lineitem"),
        _d(
            f"""
    ROW = CAST(l_partkey % 3 + 1 AS INT)
    COL = CAST(l_suppkey % 2 + 1 AS INT)
    Timestamp = CAST(timestampadd(HOUR, CAST({_HOURS} AS INT), TIMESTAMP_NTZ'2011-01-01 00:00:00') AS TIMESTAMP_NTZ)
    vna_ozone = {_PRICE}
    evna_ozone = {_EVNA}
    avna_ozone = CASE WHEN NOT (l_partkey % 3 = 1 AND dayofyear(l_shipdate) = 160) THEN (l_partkey * 31 + l_suppkey * 17 + l_orderkey) % 6000 / 64.0 END
    model = l_quantity * 1.5"""
        ),
    )
    return raw.groupBy("ROW", "COL", "Timestamp").agg(*[F.avg(c).alias(c) for c in METHODS])


SQL_VIEWS["fused_hourly"] = (
    f"""SELECT CAST(l_partkey % 3 + 1 AS INTEGER) AS ROW, CAST(l_suppkey % 2 + 1 AS INTEGER) AS COL,
    TIMESTAMP '2011-01-01' + to_hours(CAST({_HOURS} AS INTEGER)) AS "Timestamp",
    avg({_PRICE}) AS vna_ozone, avg({_EVNA}) AS evna_ozone,
    avg(CASE WHEN NOT (l_partkey % 3 = 1 AND dayofyear(l_shipdate) = 160) THEN (l_partkey * 31 + l_suppkey * 17 + l_orderkey) % 6000 / 64.0 END) AS avna_ozone,
    avg(l_quantity * 1.5) AS model FROM lineitem GROUP BY ALL""",
    [],
)


def _with_cells(spark, sf, extra: str) -> DataFrame:
    cells = columns(table(spark, sf, "lineitem"), _CELL).distinct()
    return columns(cells, "ROW = ROW\nCOL = COL\n" + extra)


def region(spark, sf):
    return _with_cells(spark, sf, "Is = CASE WHEN (ROW * 7 + COL * 3) % 5 <> 0 THEN 1 END")


def tz_grid(spark, sf):
    return _with_cells(
        spark,
        sf,
        "Lat = 25 + ROW * 2.5D\nLon = -125 + COL * 5D\n"
        "gmt_offset = CASE WHEN (ROW * COL) % 11 <> 0 THEN CAST(-5 - (ROW + COL) % 4 AS DOUBLE) END",
    )


def climate_region(spark, sf):
    return _with_cells(
        spark,
        sf,
        "ClimateRegion = CASE WHEN (ROW * 3 + COL) % 10 = 9 THEN -999 ELSE (ROW * 3 + COL) % 10 END",
    )


SQL_VIEWS["cells"] = (f"SELECT DISTINCT {_SQL_CELL} FROM lineitem", [])
SQL_VIEWS["region"] = (
    "SELECT ROW, COL, CASE WHEN (ROW * 7 + COL * 3) % 5 <> 0 THEN 1 END AS \"Is\" FROM cells",
    ["cells"],
)
SQL_VIEWS["tz_grid"] = (
    """SELECT ROW, COL, CAST(25 + ROW * 2.5 AS DOUBLE) AS Lat, CAST(-125 + COL * 5 AS DOUBLE) AS Lon,
    CASE WHEN (ROW * COL) % 11 <> 0 THEN CAST(-5 - (ROW + COL) % 4 AS DOUBLE) END AS gmt_offset FROM cells""",
    ["cells"],
)
SQL_VIEWS["climate_region"] = (
    "SELECT ROW, COL, CASE WHEN (ROW * 3 + COL) % 10 = 9 THEN -999 ELSE (ROW * 3 + COL) % 10 END AS ClimateRegion FROM cells",
    ["cells"],
)

# Sites are suppliers, dates are true days.
_LAT = "30 + l_suppkey * 37 % 1000 / 64.0"
_LON = "-120 + l_suppkey * 91 % 2999 / 64.0"


def obs_daily(spark, sf):
    return columns(
        table(spark, sf, "lineitem"),
        _d(
            f"""
    Site = CAST(l_suppkey AS STRING)
    POC = CAST(l_linenumber % 3 + 1 AS INT)
    Date = CAST(l_shipdate AS DATE)
    Lat = {_LAT}
    Lon = {_LON}
    Conc = l_quantity"""
        ),
    )


SQL_VIEWS["obs_daily"] = (
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS Site, CAST(l_linenumber % 3 + 1 AS INTEGER) AS POC,
    CAST(l_shipdate AS DATE) AS "Date", {_LAT} AS Lat, {_LON} AS Lon,
    l_quantity AS Conc FROM lineitem""",
    [],
)


def model_daily(spark, sf):
    raw = columns(
        table(spark, sf, "lineitem"),
        _CELL
        + _d(
            f"""
    LAY = CAST(l_linenumber % 2 AS INT)
    Date = CAST(l_shipdate AS DATE)
    O3_MDA8 = {_PRICE}"""
        ),
    )
    return raw.groupBy("ROW", "COL", "LAY", "Date").agg(F.avg("O3_MDA8").alias("O3_MDA8"))


SQL_VIEWS["model_daily"] = (
    f"""SELECT {_SQL_CELL}, CAST(l_linenumber % 2 AS INTEGER) AS LAY,
    CAST(l_shipdate AS DATE) AS "Date", avg({_PRICE}) AS O3_MDA8
    FROM lineitem GROUP BY ALL""",
    [],
)


def cv_assignment(spark, sf):
    return (
        obs_daily(spark, sf)
        .groupBy("Site", "Date")
        .agg(F.avg(F.col("Conc") * 1.25).alias("Prediction"))
        .filter("(CAST(Site AS INT) + month(Date)) % 7 <> 0")
        .withColumn("CVgroup", F.expr("CAST((CAST(Site AS INT) * 7 + month(Date)) % 5 + 1 AS INT)"))
    )


SQL_VIEWS["cv_assignment"] = (
    """SELECT Site, "Date", avg(Conc * 1.25) AS Prediction,
    CAST((CAST(Site AS INTEGER) * 7 + month("Date")) % 5 + 1 AS INTEGER) AS CVgroup
    FROM obs_daily WHERE (CAST(Site AS INTEGER) + month("Date")) % 7 <> 0 GROUP BY Site, "Date" """,
    ["obs_daily"],
)

# A year of hourly monitor rows: 5 sites; some rows carry the missing-value code.
_O3 = "CASE WHEN l_linenumber = 7 AND l_orderkey % 11 = 0 THEN -999.0 ELSE " + _PRICE + " END"


def obs_hourly(spark, sf):
    return columns(
        table(spark, sf, "lineitem"),
        _d(
            f"""
    site_id = CAST(l_suppkey % 5 + 1 AS STRING)
    POCode = CAST(l_linenumber % 2 + 1 AS INT)
    dateon = CAST(timestampadd(HOUR, CAST({_HOURS} AS INT), TIMESTAMP_NTZ'2011-01-01 00:00:00') AS TIMESTAMP_NTZ)
    O3 = CAST({_O3} AS DOUBLE)
    Lat = CAST(30 + l_suppkey % 5 * 3 AS DOUBLE)
    Lon = CAST(-120 + l_suppkey % 5 * 9 AS DOUBLE)"""
        ),
    )


SQL_VIEWS["obs_hourly"] = (
    f"""SELECT CAST(l_suppkey % 5 + 1 AS VARCHAR) AS site_id, CAST(l_linenumber % 2 + 1 AS INTEGER) AS POCode,
    TIMESTAMP '2011-01-01' + to_hours(CAST({_HOURS} AS INTEGER)) AS dateon, CAST({_O3} AS DOUBLE) AS O3,
    CAST(30 + l_suppkey % 5 * 3 AS DOUBLE) AS Lat, CAST(-120 + l_suppkey % 5 * 9 AS DOUBLE) AS Lon
    FROM lineitem""",
    [],
)

# Sixty hours around a month border: 40 sites (local time) and the model (UTC).
_STEP = "(dayofyear(l_shipdate) * 5 + l_linenumber) % 60"


def obs_hours(spark, sf):
    return columns(
        table(spark, sf, "lineitem"),
        _d(
            f"""
    site_id = CAST(l_suppkey % 40 + 1 AS STRING)
    POCode = CAST(l_linenumber % 2 + 1 AS INT)
    dateon = CAST(timestampadd(HOUR, CAST({_STEP} AS INT), TIMESTAMP_NTZ'2011-06-29 12:00:00') AS TIMESTAMP_NTZ)
    O3 = l_quantity
    Lat = 30 + l_suppkey % 40 * 37 % 1000 / 64.0
    Lon = -120 + l_suppkey % 40 * 91 % 2999 / 64.0"""
        ),
    )


# The same on the true dates of the table.
_HOUR = "(l_orderkey * 7 + l_linenumber * 5) % 24"


def obs_dated(spark, sf):
    return columns(
        table(spark, sf, "lineitem"),
        _d(
            f"""
    site_id = CAST(l_suppkey % 40 + 1 AS STRING)
    POCode = CAST(l_linenumber % 2 + 1 AS INT)
    dateon = CAST(timestampadd(HOUR, CAST({_HOUR} AS INT), CAST(l_shipdate AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)
    O3 = l_quantity
    Lat = 30 + l_suppkey % 40 * 37 % 1000 / 64.0
    Lon = -120 + l_suppkey % 40 * 91 % 2999 / 64.0
    Year = CAST(year(l_shipdate) AS INT)"""
        ),
    )


def model_dated(spark, sf):
    raw = columns(
        table(spark, sf, "lineitem"),
        _CELL
        + _d(
            f"""
    TSTEP = CAST(timestampadd(HOUR, CAST({_HOUR} AS INT), CAST(l_shipdate AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)
    O3 = {_PRICE}"""
        ),
    )
    means = raw.groupBy("ROW", "COL", "TSTEP").agg(F.avg("O3").alias("O3"))
    return means.withColumn("Year", F.year("TSTEP"))


def tz_site(spark, sf):
    sites = columns(
        table(spark, sf, "lineitem"),
        _d(
            """
    n = CAST(l_suppkey % 40 + 1 AS INT)
    Lat = 30 + l_suppkey % 40 * 37 % 1000 / 64.0
    Lon = -120 + l_suppkey % 40 * 91 % 2999 / 64.0"""
        ),
    ).distinct()
    listed = columns(
        sites.filter("n % 4 <> 0"),
        """
    site_id = CAST(n AS STRING)
    Lat = Lat
    Lon = Lon
    gmt_offset = CAST(-5 - n % 4 AS DOUBLE)
    epa_region = concat('R', CAST(n % 10 AS STRING))""",
    )
    # Sites without observations, closer to the unlisted ones than any other.
    unobserved = columns(
        sites,
        """
    site_id = CAST(n + 1000 AS STRING)
    Lat = Lat + 1 / 64D
    Lon = Lon + 1 / 64D
    gmt_offset = -9D
    epa_region = 'X'""",
    )
    return listed.unionByName(unobserved)


def model_hourly(spark, sf):
    raw = columns(
        table(spark, sf, "lineitem"),
        _CELL
        + _d(
            f"""
    TSTEP = CAST(timestampadd(HOUR, CAST({_STEP} AS INT), TIMESTAMP_NTZ'2011-06-29 18:00:00') AS TIMESTAMP_NTZ)
    O3 = {_PRICE}"""
        ),
    )
    return raw.groupBy("ROW", "COL", "TSTEP").agg(F.avg("O3").alias("O3"))


SQL_VIEWS["obs_hours"] = (
    f"""SELECT CAST(l_suppkey % 40 + 1 AS VARCHAR) AS site_id, CAST(l_linenumber % 2 + 1 AS INTEGER) AS POCode,
    TIMESTAMP '2011-06-29 12:00:00' + to_hours(CAST({_STEP} AS INTEGER)) AS dateon, l_quantity AS O3,
    30 + l_suppkey % 40 * 37 % 1000 / 64.0 AS Lat, -120 + l_suppkey % 40 * 91 % 2999 / 64.0 AS Lon
    FROM lineitem""",
    [],
)
SQL_VIEWS["obs_dated"] = (
    f"""SELECT CAST(l_suppkey % 40 + 1 AS VARCHAR) AS site_id, CAST(l_linenumber % 2 + 1 AS INTEGER) AS POCode,
    CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST({_HOUR} AS INTEGER)) AS dateon, l_quantity AS O3,
    30 + l_suppkey % 40 * 37 % 1000 / 64.0 AS Lat, -120 + l_suppkey % 40 * 91 % 2999 / 64.0 AS Lon
    FROM lineitem""",
    [],
)
SQL_VIEWS["model_dated"] = (
    f"""SELECT {_SQL_CELL}, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST({_HOUR} AS INTEGER)) AS TSTEP,
    avg({_PRICE}) AS O3 FROM lineitem GROUP BY ALL""",
    [],
)
SQL_VIEWS["tz_site"] = (
    """SELECT CAST(n AS VARCHAR) AS site_id, Lat, Lon, CAST(-5 - n % 4 AS DOUBLE) AS gmt_offset,
    'R' || CAST(n % 10 AS VARCHAR) AS epa_region FROM tz_places WHERE n % 4 <> 0
    UNION ALL SELECT CAST(n + 1000 AS VARCHAR), Lat + 1 / 64.0, Lon + 1 / 64.0, CAST(-9 AS DOUBLE), 'X' FROM tz_places""",
    ["tz_places"],
)
SQL_VIEWS["tz_places"] = (
    """SELECT DISTINCT CAST(l_suppkey % 40 + 1 AS INTEGER) AS n,
    30 + l_suppkey % 40 * 37 % 1000 / 64.0 AS Lat, -120 + l_suppkey % 40 * 91 % 2999 / 64.0 AS Lon
    FROM lineitem""",
    [],
)
SQL_VIEWS["model_hourly"] = (
    f"""SELECT {_SQL_CELL}, TIMESTAMP '2011-06-29 18:00:00' + to_hours(CAST({_STEP} AS INTEGER)) AS TSTEP,
    avg({_PRICE}) AS O3 FROM lineitem GROUP BY ALL""",
    [],
)

# Metric table: one row per cell, period and year.
_PERIOD = """CASE WHEN l_linenumber = 7 THEN 'top-10' WHEN l_linenumber = 6 THEN 'W126'
    WHEN month(l_shipdate) IN (12, 1, 2) THEN 'DJF' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'MAM'
    WHEN month(l_shipdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""
_DS = "CASE WHEN l_orderkey % 13 <> 0 THEN (l_orderkey * 29 + l_suppkey * 5) % 6300 / 64.0 END"
METRIC_COLUMNS = [*METHODS, "ds_ozone", "harvard_ml"]


def metrics(spark, sf):
    raw = columns(
        table(spark, sf, "lineitem"),
        _CELL
        + _d(
            f"""
    Year = CAST(year(l_shipdate) AS INT)
    Period = {" ".join(_PERIOD.split())}
    vna_ozone = {_PRICE}
    evna_ozone = {_EVNA}
    avna_ozone = {_AVNA}
    model = l_quantity * 1.5
    ds_ozone = {_DS}
    harvard_ml = l_quantity + l_suppkey % 64 / 64.0"""
        ),
    )
    return raw.groupBy("ROW", "COL", "Year", "Period").agg(
        *[F.avg(c).alias(c) for c in METRIC_COLUMNS]
    )


SQL_VIEWS["metrics"] = (
    f"""SELECT {_SQL_CELL}, CAST(year(l_shipdate) AS INTEGER) AS "Year", {_PERIOD} AS Period,
    avg({_PRICE}) AS vna_ozone, avg({_EVNA}) AS evna_ozone, avg({_AVNA}) AS avna_ozone,
    avg(l_quantity * 1.5) AS model, avg({_DS}) AS ds_ozone,
    avg(l_quantity + l_suppkey % 64 / 64.0) AS harvard_ml FROM lineitem GROUP BY ALL""",
    [],
)


def metric_sides(spark, sf):
    """Even and odd years of the metric table; ``Pair`` joins each even year to the next one."""
    m = metrics(spark, sf).withColumn("Pair", F.expr("CAST(Year DIV 2 AS INT)"))
    return m.filter(F.col("Year") % 2 == 0).drop("Year"), m.filter(F.col("Year") % 2 == 1).drop("Year")


for _side, _rest in (("even", 0), ("odd", 1)):
    SQL_VIEWS[f"metrics_{_side}"] = (
        f'SELECT * EXCLUDE ("Year"), CAST("Year" // 2 AS INTEGER) AS Pair FROM metrics WHERE "Year" % 2 = {_rest}',
        ["metrics"],
    )


# Event stream as monitor hours: 8 sites in January 2024.
def event_hours(spark, sf):
    return columns(
        table(spark, sf, "events"),
        _d(
            """
    site_id = CAST(user_id % 8 + 1 AS STRING)
    dateon = CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ)
    O3 = CAST(round(value * 100) AS BIGINT) % 6400 / 64.0
    model = event_id * 37 % 6400 / 64.0"""
        ),
    )


SQL_VIEWS["event_hours"] = (
    """SELECT CAST(user_id % 8 + 1 AS VARCHAR) AS site_id, date_trunc('hour', ts) AS dateon,
    CAST(round(value * 100) AS BIGINT) % 6400 / 64.0 AS O3, event_id * 37 % 6400 / 64.0 AS model FROM events""",
    [],
)


# Validation results: one row per site and date.
def cv_result(spark, sf):
    raw = columns(
        table(spark, sf, "lineitem"),
        _d(
            f"""
    Site = CAST(l_suppkey AS STRING)
    Date = CAST(l_shipdate AS DATE)
    Conc = l_quantity
    model = {_PRICE}
    vna_ozone = {_EVNA}
    ds_ozone = {_DS}"""
        ),
    )
    means = raw.groupBy("Site", "Date").agg(
        *[F.avg(c).alias(c) for c in ("Conc", "model", "vna_ozone", "ds_ozone")]
    )
    return means.withColumn("CVgroup", F.expr("CAST(CAST(Site AS INT) % 5 + 1 AS INT)"))


SQL_VIEWS["cv_result"] = (
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS Site, CAST(l_shipdate AS DATE) AS "Date", avg(l_quantity) AS Conc,
    avg({_PRICE}) AS model, avg({_EVNA}) AS vna_ozone, avg({_DS}) AS ds_ozone,
    CAST(l_suppkey % 5 + 1 AS INTEGER) AS CVgroup FROM lineitem GROUP BY ALL""",
    [],
)
