"""Queries: interpolation, fusion and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.operators.combine import training_folds, with_site_offsets
from skyweave.operators.matching import model_at_sites
from skyweave.operators.rollup import calendar_means
from skyweave.plans import fusion as fu
from skyweave.plans import validation as va
from skyweave.session import scratch_path
from skyweave.sources import sinks as sk
from skyweave.sources.grids import surface_layer

G = fx.GRID
SETS = {"AMJ": [4, 5, 6], "JAS": [7, 8, 9], "DJF": [12, 1, 2]}
FUSED = "vna_ozone vna_mod vna_bias vna_r_n avna_ozone evna_ozone ievna_ozone model"
CV = "Conc model vna_ozone evna_ozone avna_ozone"


def xy(lon: str = "Lon", lat: str = "Lat") -> tuple[str, str]:
    """The projection as SQL text."""
    g = G.conic
    rho = f"({g.scale!r} / pow(tan(pi() / 4 + radians({lat}) / 2), {g.cone!r}))"
    theta = f"(radians({lon} - ({g.lon_0!r})) * {g.cone!r})"
    return (
        f"(({rho} * sin({theta}) + {g.x_0!r}) / {g.to_meter!r})",
        f"(({g.rho_0!r} - {rho} * cos({theta}) + {g.y_0!r}) / {g.to_meter!r})",
    )


def placed_sql(source: str, out: str) -> str:
    """Sites with plane coordinates and nearest cell."""
    x, y = xy()
    return f"""{out} AS (SELECT *, CAST(greatest(least(floor(y), {fx.ROWS - 1}), 0) + 1 AS INTEGER) AS ROW,
 CAST(greatest(least(floor(x), {fx.COLS - 1}), 0) + 1 AS INTEGER) AS COL FROM (SELECT *, {x} AS x, {y} AS y FROM {source}))"""


def monitors_sql(source: str, model: str, keys: str, limit: float | None = None) -> str:
    """CTE ``mon``: (keys, site, x, y, ROW, COL, ozone, mod, bias, r_n) from (keys, site, Lat, Lon, ozone)."""
    ratio = "CASE WHEN mod <> 0 THEN ozone / mod END"
    if limit:
        ratio = f"CASE WHEN {ratio} > {limit} THEN {limit} ELSE {ratio} END"
    using = ", ".join([*keys.split(", "), "ROW", "COL"]) if keys else "ROW, COL"
    return (
        placed_sql(source, "placed")
        + f""", mon AS (SELECT *, mod - ozone AS bias, {ratio} AS r_n FROM (SELECT p.*, m.v AS mod FROM placed p LEFT JOIN {model} m USING ({using})))"""
    )


def vna_sql(keys: str, targets: str = "tgt", monitors: str = "mon", k: int = 30) -> str:
    """CTE ``vna``: the k nearest by distance, then the pairwise bisector test."""
    c = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON TRUE"
    cell = f"{c}ROW, COL"
    measures = ["ozone", "mod", "bias", "r_n"]
    return f"""cand AS (SELECT * FROM (SELECT {c}t.ROW, t.COL, m.site, m.x - (t.COL - 0.5) AS dx, m.y - (t.ROW - 0.5) AS dy,
 {", ".join("m." + q for q in measures)}, row_number() OVER (PARTITION BY {c}t.ROW, t.COL ORDER BY (m.x - (t.COL - 0.5)) * (m.x - (t.COL - 0.5)) + (m.y - (t.ROW - 0.5)) * (m.y - (t.ROW - 0.5)), m.site) AS rn
 FROM {targets} t JOIN {monitors} m {on}) WHERE rn <= {k}),
 nb AS (SELECT {", ".join("i." + q.strip() for q in cell.split(","))}, i.site,
 coalesce(min(CASE WHEN i.dx * j.dy - i.dy * j.dx > 0 THEN ((j.dx * j.dx + j.dy * j.dy) / 2 - (i.dx * j.dx + i.dy * j.dy) / 2) / (i.dx * j.dy - i.dy * j.dx) END), 1e300) AS up,
 coalesce(max(CASE WHEN i.dx * j.dy - i.dy * j.dx < 0 THEN ((j.dx * j.dx + j.dy * j.dy) / 2 - (i.dx * j.dx + i.dy * j.dy) / 2) / (i.dx * j.dy - i.dy * j.dx) END), -1e300) AS lo,
 count(*) FILTER (i.dx * j.dy - i.dy * j.dx = 0 AND (j.dx * j.dx + j.dy * j.dy) / 2 - (i.dx * j.dx + i.dy * j.dy) / 2 < 0) AS hidden
 FROM cand i JOIN cand j USING ({cell}) GROUP BY {", ".join("i." + q.strip() for q in cell.split(","))}, i.site),
 wt AS (SELECT c.*, 1 / (c.dx * c.dx + c.dy * c.dy) AS w FROM cand c JOIN nb USING ({cell}, site) WHERE up - lo > 1e-9 AND hidden = 0),
 vna AS (SELECT {cell}, {", ".join(f"CASE WHEN count({q}) = count(*) THEN sum(w * {q}) / sum(w) END AS vna_{q}" for q in measures)} FROM wt GROUP BY {cell})"""


FUSED_SQL = """vna_ozone, vna_mod, vna_bias, vna_r_n, v - vna_bias AS avna_ozone, v * vna_r_n AS evna_ozone,
 CASE WHEN vna_mod <> 0 THEN v * vna_ozone / vna_mod END AS ievna_ozone, v AS model"""


def fused_sql(keys: str, time: str | None = None, region: bool = False) -> str:
    """CTEs ``tgt`` and ``vna`` and the final select over the model table ``mdl`` (keys, ROW, COL, v)."""
    c = f"{keys}, " if keys else ""
    semi = f" WHERE ({keys}) IN (SELECT {keys} FROM mon)" if keys else ""
    inner = ' JOIN region r ON r.ROW = m.ROW AND r.COL = m.COL AND r."Is" = 1' if region else ""
    first = f'{c[:-2]} AS "{time}", ' if time else c
    cols = ", ".join(f"m.{k.strip()}" for k in c.split(",") if k.strip())
    cols = f"{cols}, " if cols else ""
    return (
        f"cells_in AS (SELECT * FROM mdl{semi}), tgt AS (SELECT {cols}m.ROW, m.COL FROM cells_in m{inner}), "
        + vna_sql(keys)
        + f" SELECT {first}ROW, COL, {FUSED_SQL} FROM cells_in LEFT JOIN vna USING ({c}ROW, COL)"
    )


_MODEL = """mdl AS (SELECT "Date", ROW, COL, O3_MDA8 AS v FROM model_daily WHERE LAY = 0)"""
_SITES = """sites AS (SELECT Site AS site, "Date", avg(Conc) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY Site, "Date")"""
_DAILY = f", {_MODEL}, {_SITES}, " + monitors_sql("sites", "mdl", '"Date"') + ", "


def surface(spark, sf):
    return surface_layer(fx.model_daily(spark, sf)).drop("LAY")


@query("a01_site_day_means", 'SELECT Site, "Date", avg(Conc) AS Conc, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY Site, "Date"', "obs_daily", "Conc Lat Lon")
def _(spark, sf):
    return fu.site_means(fx.obs_daily(spark, sf), ["Date"])


@query("a03_site_means", "SELECT Site, avg(Conc) AS Conc, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY Site", "obs_daily", "Conc Lat Lon")
def _(spark, sf):
    return fu.site_means(fx.obs_daily(spark, sf), [])


@query(
    "j04_nearest_cell",
    _DAILY + 'SELECT site AS Site, "Date", ozone, x, y, ROW, COL, mod, bias, r_n FROM mon',
    "obs_daily model_daily",
    "ozone x y mod bias r_n",
)
def _(spark, sf):
    sites = fu.site_means(fx.obs_daily(spark, sf), ["Date"])
    mon = fu.matched_monitors(sites, surface(spark, sf), G, ["Date"], "Conc", "O3_MDA8")
    return mon.select("Site", "Date", "ozone", "x", "y", "ROW", "COL", "mod", "bias", "r_n")


@query(
    "f01_voronoi_average",
    f", {_MODEL.replace('mdl', 'layer')}, periods AS (SELECT * FROM (VALUES ('AMJ', 4), ('AMJ', 5), ('AMJ', 6), ('JAS', 7), ('JAS', 8), ('JAS', 9), ('DJF', 12), ('DJF', 1), ('DJF', 2)) p(Period, m)),"
    " mdl AS (SELECT Period, ROW, COL, avg(v) AS v FROM layer JOIN periods ON m = month(\"Date\") GROUP BY ALL),"
    " sites AS (SELECT Site AS site, Period, avg(Conc) AS ozone, min(Lat) AS Lat, min(Lon) AS Lon FROM obs_daily JOIN periods ON m = month(\"Date\") GROUP BY ALL), "
    + monitors_sql("sites", "mdl", "Period")
    + ", tgt AS (SELECT Period, ROW, COL FROM mdl), "
    + vna_sql("Period")
    + " SELECT * FROM vna",
    "obs_daily model_daily",
    "vna_ozone vna_mod vna_bias vna_r_n",
)
def _(spark, sf):
    from skyweave.operators.voronoi import voronoi_average

    obs = fx.obs_daily(spark, sf)
    means = calendar_means(surface(spark, sf), ["ROW", "COL"], "Date", ["O3_MDA8"], SETS).withColumnRenamed("label", "Period")
    sites = calendar_means(obs, ["Site"], "Date", ["Conc"], SETS).withColumnRenamed("label", "Period")
    where = obs.groupBy("Site").agg(F.min("Lat").alias("Lat"), F.min("Lon").alias("Lon"))
    mon = fu.matched_monitors(sites.join(where, "Site"), means, G, ["Period"], "Conc", "O3_MDA8")
    return voronoi_average(mon, means.select("Period", "ROW", "COL"), ["Period"], fu.MEASURES)


_F5 = _DAILY + fused_sql('"Date"', "Timestamp", region=True)


@query("f05_daily_fusion", _F5, "obs_daily model_daily region", FUSED)
def _(spark, sf):
    return fu.daily_fusion(fx.obs_daily(spark, sf), surface(spark, sf), G, fx.region(spark, sf))


for _name, _column in (("f02_additive_fusion", "avna_ozone"), ("f03_ratio_fusion", "evna_ozone"), ("f04_quotient_fusion", "ievna_ozone")):

    @query(
        _name,
        f'{_DAILY} {fused_sql(chr(34) + "Date" + chr(34), "Timestamp").replace(FUSED_SQL, FUSED_SQL)}'.replace(
            " SELECT \"Date\" AS \"Timestamp\", ROW, COL, " + FUSED_SQL,
            f" SELECT \"Timestamp\", ROW, COL, model, {_column} FROM (SELECT \"Date\" AS \"Timestamp\", ROW, COL, " + FUSED_SQL,
        )
        + ")",
        "obs_daily model_daily",
        f"model {_column}",
    )
    def _(spark, sf, column=_column):
        fused = fu.daily_fusion(fx.obs_daily(spark, sf), surface(spark, sf), G)
        return fused.select("Timestamp", "ROW", "COL", "model", column)


# Hourly fusion: offsets by site, missing ones from the nearest known site.
OFFSETS = """zoned AS (SELECT o.*, coalesce(t.gmt_offset, n.gmt_offset) AS gmt_offset, coalesce(t.epa_region, n.epa_region) AS epa_region FROM obs_hours o LEFT JOIN (SELECT * FROM tz_site WHERE gmt_offset IS NOT NULL) t USING (site_id)
 LEFT JOIN (SELECT m.site_id, arg_min(k.gmt_offset, {'d': (m.Lat - k.Lat) * (m.Lat - k.Lat) + (m.Lon - k.Lon) * (m.Lon - k.Lon), 's': k.site_id}) AS gmt_offset,
 arg_min(k.epa_region, {'d': (m.Lat - k.Lat) * (m.Lat - k.Lat) + (m.Lon - k.Lon) * (m.Lon - k.Lon), 's': k.site_id}) AS epa_region
 FROM (SELECT site_id, min(Lat) AS Lat, min(Lon) AS Lon FROM obs_hours GROUP BY site_id) m, tz_site k WHERE m.site_id NOT IN (SELECT site_id FROM tz_site WHERE gmt_offset IS NOT NULL) AND k.gmt_offset IS NOT NULL AND k.site_id IN (SELECT site_id FROM obs_hours) GROUP BY m.site_id) n USING (site_id))"""
_UTC = """sites AS (SELECT site_id AS site, dateon - to_hours(CAST(gmt_offset AS INTEGER)) AS TSTEP, avg(O3) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon, min(gmt_offset) AS gmt_offset FROM zoned GROUP BY ALL)"""
_HMODEL = "mdl AS (SELECT TSTEP, ROW, COL, O3 AS v FROM model_hourly)"
HOURLY_VIEWS = "obs_hours tz_site model_hourly"


def hourly(limit: float | None = None) -> str:
    return f", {OFFSETS}, {_UTC}, {_HMODEL}, " + monitors_sql("sites", "mdl", "TSTEP", limit)


def zoned(spark, sf):
    return with_site_offsets(fx.obs_hours(spark, sf), fx.tz_site(spark, sf))


@query("j03_nearest_offset_fill", f", {OFFSETS} SELECT * FROM zoned", "obs_hours tz_site")
def _(spark, sf):
    return zoned(spark, sf)


@query(
    "a02_site_hour_means",
    f", {OFFSETS}, {_UTC} SELECT site AS site_id, TSTEP, ozone AS O3, Lat, Lon, gmt_offset FROM sites",
    "obs_hours tz_site",
    "O3 Lat Lon gmt_offset",
)
def _(spark, sf):
    return fu.utc_sites(zoned(spark, sf))


_F6 = fused_sql("TSTEP").replace(" SELECT TSTEP, ROW", ' SELECT TSTEP, TSTEP AS "Timestamp", ROW')


@query("f06_hourly_fusion", hourly() + ", " + _F6, HOURLY_VIEWS, FUSED)
def _(spark, sf):
    return fu.hourly_fusion(zoned(spark, sf), fx.model_hourly(spark, sf), G)


@query("f06_hourly_fusion_capped", hourly(3.0) + ", " + _F6, HOURLY_VIEWS, FUSED)
def _(spark, sf):
    return fu.hourly_fusion(zoned(spark, sf), fx.model_hourly(spark, sf), G, ratio_limit=3.0)


# True dates over a year's end; offsets run from -9 to -5 hours.
_RANGE = ("1996-12-20 06:00:00", "1997-01-20 18:00:00")
_IN_RANGE = (
    f", obs_in_range AS (SELECT * FROM obs_dated WHERE dateon BETWEEN TIMESTAMP '{_RANGE[0]}' - INTERVAL 9 HOURS AND TIMESTAMP '{_RANGE[1]}' - INTERVAL 5 HOURS)"
    + hourly().replace("obs_hours", "obs_in_range").replace("model_hourly", f"model_dated WHERE TSTEP BETWEEN TIMESTAMP '{_RANGE[0]}' AND TIMESTAMP '{_RANGE[1]}'").replace(
        "FROM zoned GROUP BY ALL",
        f"FROM zoned WHERE dateon - to_hours(CAST(gmt_offset AS INTEGER)) BETWEEN TIMESTAMP '{_RANGE[0]}' AND TIMESTAMP '{_RANGE[1]}' GROUP BY ALL",
    )
)


def stored_by_year(spark, df):
    path = scratch_path(spark, "years")
    sk.write_by(df, path, ["Year"])
    return spark.read.parquet(path)


@query("f06_hourly_fusion_in_range", _IN_RANGE + ", " + _F6, "obs_dated tz_site model_dated", FUSED)
def _(spark, sf):
    obs, model = (stored_by_year(spark, d(spark, sf)) for d in (fx.obs_dated, fx.model_dated))
    return fu.hourly_fusion_in_range(obs, fx.tz_site(spark, sf), model, G, *_RANGE, year="Year")


@query(
    "f07_ratio_outliers",
    hourly()
    + """ SELECT site AS site_id, avg(ozone) AS ozone, avg(mod) AS mod, avg(bias) AS bias, avg(r_n) AS r_n, avg(Lat) AS Lat, avg(Lon) AS Lon, avg(x) AS x, avg(y) AS y,
 avg(ROW) AS ROW, avg(COL) AS COL, avg(gmt_offset) AS gmt_offset, count(*) AS n FROM mon WHERE r_n > 0.75 AND month(TSTEP + to_hours(CAST(gmt_offset AS INTEGER))) BETWEEN 3 AND 6 GROUP BY site""",
    HOURLY_VIEWS,
    "ozone mod bias r_n Lat Lon x y ROW COL gmt_offset",
)
def _(spark, sf):
    return fu.ratio_outliers(zoned(spark, sf), fx.model_hourly(spark, sf), G, months=(3, 6), limit=0.75)


_PERIODS = "periods AS (SELECT * FROM (VALUES ('AMJ', 4), ('AMJ', 5), ('AMJ', 6), ('JAS', 7), ('JAS', 8), ('JAS', 9), ('DJF', 12), ('DJF', 1), ('DJF', 2)) p(Period, m))"
_PMODEL = """mdl AS (SELECT Period, ROW, COL, avg(O3_MDA8) AS v FROM model_daily JOIN periods ON m = month("Date") WHERE LAY = 0 GROUP BY ALL)"""
_PSITES = """sites AS (SELECT Period, Site AS site, avg(Conc) AS ozone, min(Lat) AS Lat, min(Lon) AS Lon FROM obs_daily JOIN periods ON m = month("Date") GROUP BY ALL)"""


@query(
    "f08_period_fusion",
    f", {_PERIODS}, {_PMODEL}, {_PSITES}, " + monitors_sql("sites", "mdl", "Period") + ", " + fused_sql("Period", region=True),
    "obs_daily model_daily region",
    FUSED,
)
def _(spark, sf):
    return fu.period_fusion(fx.obs_daily(spark, sf), surface(spark, sf), G, SETS, fx.region(spark, sf))


@query(
    "f09_metric_fusion",
    """, mdl AS (SELECT ROW, COL, avg(model) AS v FROM metrics WHERE Period = 'W126' GROUP BY ALL),
 sites AS (SELECT Site AS site, avg(Conc) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY Site), """
    + monitors_sql("sites", "mdl", "")
    + ", "
    + fused_sql("", region=True),
    "obs_daily metrics region",
    FUSED,
)
def _(spark, sf):
    w126 = fx.metrics(spark, sf).filter(F.col("Period") == "W126").groupBy("ROW", "COL").agg(F.avg("model").alias("model"))
    sites = fu.site_means(fx.obs_daily(spark, sf), []).withColumnRenamed("Conc", "O3")
    return fu.metric_fusion(sites, w126, G, fx.region(spark, sf))


@query(
    "f10_top_fusion",
    """, tops AS (SELECT 'top-10' AS Period, Site AS site, avg(Conc) AS ozone FROM (SELECT Site, Conc, row_number() OVER (PARTITION BY Site ORDER BY Conc DESC) AS r FROM obs_daily WHERE Site <> '3') WHERE r <= 10 GROUP BY Site
 UNION ALL SELECT '98th', Site, min(Conc) FROM (SELECT Site, Conc, row_number() OVER (PARTITION BY Site ORDER BY Conc DESC) AS r FROM obs_daily WHERE Site <> '3') WHERE r <= 7 GROUP BY Site),
 sites AS (SELECT t.*, Lat, Lon FROM tops t JOIN (SELECT Site AS site, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY Site) USING (site)),
 mdl AS (SELECT 'top-10' AS Period, ROW, COL, avg(v) AS v FROM (SELECT ROW, COL, O3_MDA8 AS v, row_number() OVER (PARTITION BY ROW, COL ORDER BY O3_MDA8 DESC) AS r FROM model_daily WHERE LAY = 0) WHERE r <= 10 GROUP BY ALL
 UNION ALL SELECT '98th', ROW, COL, quantile_cont(O3_MDA8, 0.98) FROM model_daily WHERE LAY = 0 GROUP BY ROW, COL), """
    + monitors_sql("sites", "mdl", "Period")
    + ", "
    + fused_sql("Period"),
    "obs_daily model_daily",
    FUSED,
)
def _(spark, sf):
    return fu.top_fusion(fx.obs_daily(spark, sf), surface(spark, sf), G, excluded=["3"])


_RANKED = """, ranked AS (SELECT Site AS site, Conc AS ozone, row_number() OVER (PARTITION BY Site ORDER BY Conc DESC, "Date", POC) AS "rank" FROM obs_daily),
 sites AS (SELECT r.site, "rank", ozone, Lat, Lon FROM ranked r JOIN (SELECT Site AS site, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY Site) USING (site) WHERE "rank" <= 10 AND site IN (SELECT site FROM ranked WHERE "rank" = 10)),
 mdl AS (SELECT * FROM (SELECT ROW, COL, O3_MDA8 AS v, row_number() OVER (PARTITION BY ROW, COL ORDER BY O3_MDA8 DESC, "Date") AS "rank" FROM model_daily WHERE LAY = 0) WHERE "rank" <= 10), """


@query(
    "f11_rank_fusion",
    _RANKED
    + monitors_sql("sites", "mdl", '"rank"')
    + ", "
    + fused_sql('"rank"').replace(' SELECT "rank", ROW', ', fused AS (SELECT "rank", ROW')
    + ") SELECT ROW, COL, " + ", ".join(f"avg({c}) AS {c}" for c in fu.FUSED) + " FROM fused GROUP BY ROW, COL",
    "obs_daily model_daily",
    " ".join(fu.FUSED),
)
def _(spark, sf):
    return fu.rank_fusion(fx.obs_daily(spark, sf), surface(spark, sf), G)


@query(
    "f12_other_pollutant_fusion",
    """, mdl AS (SELECT "Date", ROW, COL, avg(vna_ozone) AS v FROM (SELECT ROW, COL, date_trunc('quarter', "Timestamp")::DATE AS "Date", vna_ozone FROM fused_daily) GROUP BY ALL),
 sites AS (SELECT Site AS site, date_trunc('quarter', "Date")::DATE AS "Date", avg(Conc * 0.25) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY ALL), """
    + monitors_sql("sites", "mdl", '"Date"')
    + ", "
    + fused_sql('"Date"', "Timestamp"),
    "obs_daily fused_daily",
    FUSED,
)
def _(spark, sf):
    quarter = lambda c: F.trunc(c, "quarter").alias("Date")
    obs = fx.obs_daily(spark, sf).select("Site", quarter("Date"), "Lat", "Lon", (F.col("Conc") * 0.25).alias("PM25"))
    model = (
        fx.fused_daily(spark, sf).select("ROW", "COL", quarter("Timestamp"), "vna_ozone")
        .groupBy("ROW", "COL", "Date").agg(F.avg("vna_ozone").alias("PM25_TOT"))
    )
    return fu.daily_fusion(obs, model, G, value="PM25", model_value="PM25_TOT")


_WIDE = [("DJF", (12, 1, 2)), ("MAM", (3, 4, 5)), ("JJA", (6, 7, 8)), ("SON", (9, 10, 11))]


@query(
    "f13_wide_fusion",
    ", mdl AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}_{v}' AS name, ROW, COL, avg(CASE WHEN month(\"Date\") IN {m} THEN {e} END) AS v FROM model_daily WHERE LAY = 0 GROUP BY ROW, COL"
        for s, m in _WIDE
        for v, e in (("O3", "O3_MDA8"), ("NO2", "O3_MDA8 / 2"))
    )
    + "), sites AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}_{v}' AS name, Site AS site, avg({e}) AS ozone, min(Lat) AS Lat, min(Lon) AS Lon FROM obs_daily WHERE month(\"Date\") IN {m} GROUP BY Site"
        for s, m in _WIDE
        for v, e in (("O3", "Conc"), ("NO2", "Conc / 4"))
    )
    + "), "
    + monitors_sql("sites", "mdl", "name")
    + ", "
    + fused_sql("name").replace(" SELECT name, ROW", " SELECT split_part(name, '_', 1) AS season, split_part(name, '_', 2) AS variable, ROW"),
    "obs_daily model_daily",
    FUSED,
)
def _(spark, sf):
    def wide(df, keys, value, scale):
        out = []
        for season, months in _WIDE:
            inside = F.when(F.month("Date").isin(*months), F.col(value))
            out += [F.avg(inside).alias(f"{season}_O3"), F.avg(inside / scale).alias(f"{season}_NO2")]
        return df.groupBy(*keys).agg(*out)

    obs = wide(fx.obs_daily(spark, sf), ["Site", "Lat", "Lon"], "Conc", 4)
    model = wide(surface(spark, sf), ["ROW", "COL"], "O3_MDA8", 2)
    return fu.wide_fusion(obs, model, G, [s for s, _ in _WIDE], ["O3", "NO2"])


# Cross-validation.
def folds_sql(keys: str) -> str:
    """CTE ``pred``: predictions at test cells from monitors ``mon`` that carry CVgroup."""
    return (
        f"""train AS (SELECT a.* EXCLUDE (CVgroup), g.CVgroup FROM mon a JOIN (SELECT DISTINCT {keys}, CVgroup FROM mon) g USING ({keys}) WHERE a.CVgroup <> g.CVgroup),
 tgt AS (SELECT DISTINCT {keys}, CVgroup, ROW, COL FROM mon), """
        + vna_sql(f"{keys}, CVgroup", monitors="train")
        + f""", pred AS (SELECT {keys}, site AS Site, Lat, Lon, ozone AS Conc, CVgroup, mod AS model, vna_ozone, mod * vna_r_n AS evna_ozone, mod - vna_bias AS avna_ozone, ROW, COL
 FROM mon LEFT JOIN vna USING ({keys}, CVgroup, ROW, COL))"""
    )


_LISTED = """sites AS (SELECT o.Site AS site, "Date", avg(Conc) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon, min(c.CVgroup) AS CVgroup FROM obs_daily o JOIN (SELECT Site, "Date", min(CVgroup) AS CVgroup FROM cv_assignment GROUP BY ALL) c USING (Site, "Date") GROUP BY o.Site, "Date")"""
_CV = f", {_MODEL}, {_LISTED}, " + monitors_sql("sites", "mdl", '"Date"') + ", " + folds_sql('"Date"')


@query(
    "j06_sites_in_assignment",
    f", {_LISTED} SELECT site AS Site, \"Date\", ozone AS Conc, Lat, Lon, CVgroup FROM sites",
    "obs_daily cv_assignment",
    "Conc Lat Lon",
)
def _(spark, sf):
    return va.listed_sites(fu.site_means(fx.obs_daily(spark, sf), ["Date"]), fx.cv_assignment(spark, sf), ["Date"])


@query(
    "j08_training_folds",
    """, f AS (SELECT DISTINCT "Date", CVgroup AS fold FROM cv_assignment) SELECT Site, a."Date", Prediction, CVgroup, fold FROM cv_assignment a JOIN f ON a."Date" = f."Date" AND a.CVgroup <> f.fold""",
    "cv_assignment",
    "Prediction",
)
def _(spark, sf):
    return training_folds(fx.cv_assignment(spark, sf), ["Date"], "CVgroup")


@query(
    "f14_daily_validation",
    _CV + ' SELECT p.*, Prediction AS ds_ozone FROM pred p LEFT JOIN cv_assignment a ON a.Site = p.Site AND a."Date" = p."Date"',
    "obs_daily model_daily cv_assignment",
    CV + " ds_ozone Lat Lon",
)
def _(spark, sf):
    return va.daily_validation(fx.obs_daily(spark, sf), surface(spark, sf), fx.cv_assignment(spark, sf), G)


@query(
    "f19_validation_long",
    _CV
    + """ SELECT "Date" AS "Timestamp", CVgroup AS Fold, 'vna_ozone' AS "Method", Conc AS y_true, vna_ozone AS y_pred, ROW, COL FROM pred
 UNION ALL SELECT "Date", CVgroup, 'avna_ozone', Conc, avna_ozone, ROW, COL FROM pred UNION ALL SELECT "Date", CVgroup, 'evna_ozone', Conc, evna_ozone, ROW, COL FROM pred""",
    "obs_daily model_daily cv_assignment",
    "y_true y_pred",
)
def _(spark, sf):
    result = va.daily_validation(fx.obs_daily(spark, sf), surface(spark, sf), fx.cv_assignment(spark, sf), G)
    return va.long_scores(result, "Date")


_HCV = (
    f", {OFFSETS}, {_UTC.replace('sites AS', 'utc AS')}, {_HMODEL}, "
    + """assign AS (SELECT CAST(site AS VARCHAR) AS site, "Date", CAST((CAST(site AS INTEGER) + day("Date")) % 4 + 1 AS INTEGER) AS CVgroup, CAST(CAST(site AS INTEGER) AS DOUBLE) AS Prediction
 FROM (SELECT DISTINCT site, TSTEP::DATE AS "Date" FROM utc)),
 sites AS (SELECT u.*, a.CVgroup FROM utc u JOIN assign a ON a.site = u.site AND a."Date" = u.TSTEP::DATE), """
    + monitors_sql("sites", "mdl", "TSTEP")
    + ", "
    + folds_sql("TSTEP")
)


def hourly_assignment(utc):
    days = utc.select(F.col("site_id").alias("Site"), F.col("TSTEP").cast("date").alias("Date")).distinct()
    number = F.col("Site").cast("int")
    return days.withColumns(
        {
            "CVgroup": ((number + F.dayofmonth("Date")) % 4 + 1).cast("int"),
            "Prediction": number.cast("double"),
        }
    )


@query(
    "f15_hourly_validation",
    _HCV + ' SELECT p.*, Prediction AS ds_ozone FROM pred p LEFT JOIN assign a ON a.site = p.Site AND CAST(a."Date" AS TIMESTAMP) = p.TSTEP',
    HOURLY_VIEWS,
    CV + " ds_ozone Lat Lon",
)
def _(spark, sf):
    utc = fu.utc_sites(zoned(spark, sf))
    sites = utc.select(F.col("site_id").alias("Site"), "TSTEP", F.col("O3").alias("Conc"), "Lat", "Lon")
    return va.hourly_validation(sites, fx.model_hourly(spark, sf), hourly_assignment(utc), G)


_HASH = "('0x' || substr(md5(concat_ws('|', {key}, '42')), 1, 8))::BIGINT"
_KFOLD = f"CAST({_HASH.format(key='site, strftime(' + chr(34) + 'Date' + chr(34) + ', ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} % 5 + 1 AS INTEGER)"
_KCV = (
    f", {_MODEL}, plain AS (SELECT Site AS site, \"Date\", avg(Conc) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon FROM obs_daily GROUP BY ALL), sites AS (SELECT *, {_KFOLD} AS CVgroup FROM plain), "
    + monitors_sql("sites", "mdl", '"Date"')
    + ", "
    + folds_sql('"Date"')
)


@query("f16_random_fold_validation", _KCV + " SELECT * FROM pred", "obs_daily model_daily", CV + " Lat Lon")
def _(spark, sf):
    sites = va.hash_folds(fu.site_means(fx.obs_daily(spark, sf), ["Date"]), ["Site", "Date"], 5)
    mon = fu.matched_monitors(sites, surface(spark, sf), G, ["Date"], "Conc", "O3_MDA8")
    return va.predict_folds(mon, ["Date"])


@query(
    "f17_site_list_validation",
    f""", {_MODEL}, sites AS (SELECT Site AS site, "Date", avg(Conc) AS ozone, avg(Lat) AS Lat, avg(Lon) AS Lon, CAST(CASE WHEN CAST(Site AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS CVgroup FROM obs_daily GROUP BY ALL), """
    + monitors_sql("sites", "mdl", '"Date"')
    + ", "
    + folds_sql('"Date"')
    + " SELECT * FROM pred WHERE CVgroup = 1",
    "obs_daily model_daily",
    CV + " Lat Lon",
)
def _(spark, sf):
    obs = fu.site_means(fx.obs_daily(spark, sf), ["Date"])
    third = F.col("s_suppkey") % 3 == 0
    lists = fx.table(spark, sf, "supplier")
    names = lambda keep: lists.filter(keep).select(F.col("s_suppkey").cast("string").alias("Site"))
    split = va.split_sites(obs, names(~third), names(third))
    mon = fu.matched_monitors(split, surface(spark, sf), G, ["Date"], "Conc", "O3_MDA8")
    return va.predict_folds(mon, ["Date"]).filter(F.col("CVgroup") == 1)


@query(
    "f18_period_validation",
    f", {_PERIODS}, {_PMODEL}, "
    + _PSITES.replace("sites AS (SELECT Period, Site AS site,", "sites AS (SELECT Period, Site AS site, CAST(CAST(Site AS INTEGER) % 5 + 1 AS INTEGER) AS CVgroup,")
    + ", "
    + monitors_sql("sites", "mdl", "Period")
    + ", "
    + folds_sql("Period")
    + " SELECT * FROM pred",
    "obs_daily model_daily",
    CV + " Lat Lon",
)
def _(spark, sf):
    folds = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("Site"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("CVgroup")
    )
    return va.period_validation(fx.obs_daily(spark, sf), surface(spark, sf), folds, G, SETS)


@query(
    "f20_site_day_table",
    _DAILY
    + """ last AS (SELECT Site AS site, arg_max(CVgroup, "Date") AS CVgroup FROM cv_assignment GROUP BY Site)
 SELECT site AS Site, "Date", Lat, Lon, ozone AS Conc, mod AS model, ROW, COL, CVgroup FROM mon LEFT JOIN last USING (site)""",
    "obs_daily model_daily cv_assignment",
    "Conc model Lat Lon",
)
def _(spark, sf):
    return va.site_day_table(fx.obs_daily(spark, sf), surface(spark, sf), fx.cv_assignment(spark, sf), G)


@query(
    "f26_equal_site_folds",
    f"""SELECT Site, "Date", CAST(ntile(10) OVER (PARTITION BY "Date" ORDER BY {_HASH.format(key="Site, strftime(" + chr(34) + "Date" + chr(34) + ", '%Y-%m-%d')")}, Site) AS INTEGER) AS CVgroup
 FROM (SELECT DISTINCT Site, "Date" FROM obs_daily)""",
    "obs_daily",
)
def _(spark, sf):
    return va.equal_site_folds(fx.obs_daily(spark, sf), "Date", "Site", 10)


_LON = f"degrees(atan2((COL - 0.5) * {G.conic.to_meter!r} - {G.conic.x_0!r}, {G.conic.rho_0!r} - ((ROW - 0.5) * {G.conic.to_meter!r} - {G.conic.y_0!r})) / {G.conic.cone!r}) + ({G.conic.lon_0!r})"
_LAT = f"degrees(2 * atan(pow({G.conic.scale!r} / sqrt(pow((COL - 0.5) * {G.conic.to_meter!r} - {G.conic.x_0!r}, 2) + pow({G.conic.rho_0!r} - ((ROW - 0.5) * {G.conic.to_meter!r} - {G.conic.y_0!r}), 2)), {1 / G.conic.cone!r})) - pi() / 2)"


@query(
    "f27_fused_month_sets",
    _F5.replace(' SELECT "Date" AS "Timestamp", ROW', ', fused AS (SELECT "Date" AS "Timestamp", ROW')
    + f"), {_PERIODS} SELECT ROW, COL, Period AS label, avg(vna_ozone) AS vna_ozone, avg(avna_ozone) AS avna_ozone, avg(evna_ozone) AS evna_ozone, avg(ievna_ozone) AS ievna_ozone, avg(vna_mod) AS vna_mod, avg(model) AS model, {_LON} AS Lon, {_LAT} AS Lat"
    + ' FROM fused JOIN periods ON m = month("Timestamp") GROUP BY ROW, COL, Period',
    "obs_daily model_daily region",
    "vna_ozone avna_ozone evna_ozone ievna_ozone vna_mod model Lon Lat",
)
def _(spark, sf):
    fused = fu.daily_fusion(fx.obs_daily(spark, sf), surface(spark, sf), G, fx.region(spark, sf))
    return fu.fused_month_sets(fused, G, SETS)
