"""Fusion of monitors with the gridded model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions.calendar import local_to_utc, shift_hours
from skyweave.functions.ozone import (
    OUTLIER_RATIO,
    additive_fusion,
    cap_ratio,
    model_bias,
    quotient_fusion,
    ratio_fusion,
    response_ratio,
)
from skyweave.functions.projection import LambertConic
from skyweave.operators.combine import with_site_offsets
from skyweave.operators.matching import locate_sites, model_at_sites
from skyweave.operators.quantiles import nth_largest, ranked_rows, smallest_of_top, top_n_mean
from skyweave.operators.rollup import calendar_means
from skyweave.operators.voronoi import voronoi_average
from skyweave.session import cut_lineage
from skyweave.sources.tables import with_spill_years

MEASURES = ["ozone", "mod", "bias", "r_n"]
FUSED = ["vna_ozone", "vna_mod", "vna_bias", "vna_r_n", "avna_ozone", "evna_ozone", "model"]


class Grid:
    """A projected grid: its conic and its size."""

    def __init__(self, conic: LambertConic, rows: int, cols: int):
        self.conic, self.rows, self.cols = conic, rows, cols

    def place(self, sites: DataFrame) -> DataFrame:
        return locate_sites(sites, self.conic, self.rows, self.cols)


def site_means(obs: DataFrame, keys: list[str], site: str = "Site", value: str = "Conc") -> DataFrame:
    """Mean over repeated rows (POC) of each site and key."""
    return obs.groupBy(site, *keys).agg(
        F.avg(value).alias(value), F.avg("Lat").alias("Lat"), F.avg("Lon").alias("Lon")
    )


def matched_monitors(
    sites: DataFrame,
    model: DataFrame,
    grid: Grid,
    keys: list[str],
    value: str,
    model_value: str,
    ratio_limit: float | None = None,
) -> DataFrame:
    """Sites with plane coordinates, nearest cell, model value, bias and ratio.

    The placed sites are written out first: they are read twice, and their real
    size decides whether the model is streamed past them or shuffled.
    """
    placed = cut_lineage(grid.place(sites.withColumnRenamed(value, "ozone")))
    matched = model_at_sites(placed, model, model_value, keys)
    ratio = response_ratio("ozone", "mod")
    return matched.withColumns(
        {
            "bias": model_bias("mod", "ozone"),
            "r_n": cap_ratio(ratio, ratio_limit) if ratio_limit else ratio,
        }
    )


def fuse(
    monitors: DataFrame,
    model: DataFrame,
    keys: list[str],
    model_value: str,
    region: DataFrame | None = None,
    site: str = "Site",
    k: int = 30,
) -> DataFrame:
    """Fused grid for every key that has monitors; NULL outside the region.

    The model value travels with the targets, so the fused columns need no join
    back to the grid.  Cells outside the region skip the interpolation.  The
    monitors (the small side, read several times) are written out once.
    """
    monitors = cut_lineage(monitors.select(*keys, site, "x", "y", *MEASURES))
    cells = model.select(*keys, "ROW", "COL", F.col(model_value).alias("model"))
    if keys:
        cells = cells.join(monitors.select(*keys).distinct(), keys, "left_semi")
    if region is not None:
        marks = region.filter(F.col("Is") == 1).select("ROW", "COL", F.lit(True).alias("inside"))
        cells = cells.join(marks, ["ROW", "COL"], "left")
    by = keys
    if not keys:
        by = ["_all"]
        cells, monitors = (d.withColumn("_all", F.lit(0)) for d in (cells, monitors))
    averaged = voronoi_average(
        monitors,
        cells,
        by,
        MEASURES,
        carry=["model"],
        where="inside" if region is not None else None,
        site=site,
        k=k,
    )
    return averaged.select(
        *keys,
        "ROW",
        "COL",
        *[f"vna_{m}" for m in MEASURES],
        additive_fusion("model", "vna_bias").alias("avna_ozone"),
        ratio_fusion("model", "vna_r_n").alias("evna_ozone"),
        quotient_fusion("model", "vna_ozone", "vna_mod").alias("ievna_ozone"),
        "model",
    )


def daily_fusion(
    obs: DataFrame,
    model: DataFrame,
    grid: Grid,
    region: DataFrame | None = None,
    value: str = "Conc",
    model_value: str = "O3_MDA8",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """All days of one pollutant in one job."""
    if start and end:
        bounds = [F.lit(d).cast("date") for d in (start, end)]
        obs = obs.filter(F.col("Date").between(*bounds))
        model = model.filter(F.col("Date").between(*bounds))
    sites = site_means(obs, ["Date"], value=value)
    monitors = matched_monitors(sites, model, grid, ["Date"], value, model_value)
    return fuse(monitors, model, ["Date"], model_value, region).withColumnRenamed("Date", "Timestamp")


def utc_sites(obs: DataFrame, site: str = "site_id", ts: str = "dateon", value: str = "O3") -> DataFrame:
    """Hourly site means at UTC hours; ``obs`` carries the offset of each site."""
    return (
        obs.withColumn("TSTEP", local_to_utc(ts, "gmt_offset"))
        .groupBy(site, "TSTEP")
        .agg(
            F.avg(value).alias(value),
            F.avg("Lat").alias("Lat"),
            F.avg("Lon").alias("Lon"),
            F.min("gmt_offset").alias("gmt_offset"),
        )
    )


def hourly_fusion(
    obs: DataFrame,
    model: DataFrame,
    grid: Grid,
    region: DataFrame | None = None,
    value: str = "O3",
    model_value: str = "O3",
    ratio_limit: float | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Fusion of every UTC hour that the model has; other hours are skipped."""
    if start and end:
        bounds = [F.lit(t).cast("timestamp_ntz") for t in (start, end)]
        obs = obs.filter(local_to_utc("dateon", "gmt_offset").between(*bounds))
        model = model.filter(F.col("TSTEP").between(*bounds))
    sites = utc_sites(obs, value=value)
    monitors = matched_monitors(sites, model, grid, ["TSTEP"], value, model_value, ratio_limit)
    fused = fuse(monitors, model, ["TSTEP"], model_value, region, site="site_id")
    return fused.withColumn("Timestamp", F.col("TSTEP"))


def local_rows_in_range(
    obs: DataFrame, offsets: DataFrame, start: str, end: str, ts: str = "dateon", year: str | None = None
) -> DataFrame:
    """Local-time rows that can fall in the UTC range: it is widened by the offsets that ``offsets`` has.

    Only the least and the greatest offset reach the driver; they become literal
    bounds of the scan and, with ``year``, of its partitions.
    """
    span = offsets.agg(F.min("gmt_offset").alias("low"), F.max("gmt_offset").alias("high")).first()
    low, high = (0, 0) if span.low is None else (math.floor(span.low), math.ceil(span.high))
    return with_spill_years(obs, ts, start, end, year, low, high)


def hourly_fusion_in_range(
    obs: DataFrame,
    tz_site: DataFrame,
    model: DataFrame,
    grid: Grid,
    start: str,
    end: str,
    region: DataFrame | None = None,
    year: str | None = None,
    **options,
) -> DataFrame:
    """Fusion of the UTC hours [start, end] from local-time rows without offsets.

    Both tables are cut to the range before anything is joined or averaged, and to
    its years where they are partitioned by ``year``.
    """
    near = local_rows_in_range(obs, tz_site, start, end, year=year)
    hours = with_spill_years(model, "TSTEP", start, end, year, 0, 0)
    return hourly_fusion(with_site_offsets(near, tz_site), hours, grid, region, start=start, end=end, **options)


def ratio_outliers(
    obs: DataFrame, model: DataFrame, grid: Grid, months: tuple[int, int] = (3, 10), limit: float = OUTLIER_RATIO
) -> DataFrame:
    """Mean of the numeric columns by site over hours with an outlying ratio."""
    monitors = matched_monitors(utc_sites(obs), model, grid, ["TSTEP"], "O3", "O3")
    local = monitors.filter(F.col("r_n") > limit).withColumn(
        "local_time", shift_hours("TSTEP", "gmt_offset")
    )
    kept = local.filter(F.month("local_time").between(*months))
    numeric = ["ozone", "mod", "bias", "r_n", "Lat", "Lon", "x", "y", "ROW", "COL", "gmt_offset"]
    return kept.groupBy("site_id").agg(
        *[F.avg(c).alias(c) for c in numeric], F.count("*").alias("n")
    )


def period_fusion(
    obs: DataFrame,
    model: DataFrame,
    grid: Grid,
    sets: dict[str, list[int]],
    region: DataFrame | None = None,
    value: str = "Conc",
    model_value: str = "O3_MDA8",
) -> DataFrame:
    """Average over month sets first, then fuse, keyed by ``Period``."""
    sites = calendar_means(obs, ["Site"], "Date", [value], sets).withColumnRenamed("label", "Period")
    where = obs.groupBy("Site").agg(F.avg("Lat").alias("Lat"), F.avg("Lon").alias("Lon"))
    means = calendar_means(model, ["ROW", "COL"], "Date", [model_value], sets).withColumnRenamed(
        "label", "Period"
    )
    monitors = matched_monitors(sites.join(where, "Site"), means, grid, ["Period"], value, model_value)
    one_per_place = monitors.groupBy("Period", "x", "y").agg(
        F.min("Site").alias("Site"), *[F.min_by(m, "Site").alias(m) for m in MEASURES]
    )
    return fuse(one_per_place, means, ["Period"], model_value, region)


def metric_fusion(
    obs: DataFrame,
    model: DataFrame,
    grid: Grid,
    region: DataFrame | None = None,
    keys: list[str] | None = None,
    value: str = "O3",
    model_value: str = "model",
) -> DataFrame:
    """Fuse tables that are already metrics (no time axis), optionally keyed."""
    keys = keys or []
    usable = obs.filter(F.col(value).isNotNull() & F.col("Lat").isNotNull() & F.col("Lon").isNotNull())
    monitors = matched_monitors(site_means(usable, keys, value=value), model, grid, keys, value, model_value)
    return fuse(monitors, model, keys, model_value, region)


def top_fusion(obs: DataFrame, model: DataFrame, grid: Grid, value: str = "Conc", model_value: str = "O3_MDA8", excluded: list[str] | None = None) -> DataFrame:
    """Top-10 mean and 98th percentile of both sides, then fuse each."""
    from skyweave.operators.quantiles import exact_percentiles

    if excluded:
        obs = obs.filter(~F.col("Site").isin(*excluded))
    where = obs.groupBy("Site").agg(F.avg("Lat").alias("Lat"), F.avg("Lon").alias("Lon"))
    tops = top_n_mean(obs, ["Site"], [value], 10).withColumn("Period", F.lit("top-10"))
    sevenths = smallest_of_top(obs, ["Site"], value, 7, value).withColumn("Period", F.lit("98th"))
    sites = tops.unionByName(sevenths).join(where, "Site")
    cell = ["ROW", "COL"]
    m_tops = top_n_mean(model, cell, [model_value], 10).withColumn("Period", F.lit("top-10"))
    m_98 = exact_percentiles(model, cell, {model_value: (model_value, 0.98)}).withColumn(
        "Period", F.lit("98th")
    )
    means = m_tops.unionByName(m_98)
    monitors = matched_monitors(sites, means, grid, ["Period"], value, model_value)
    return fuse(monitors, means, ["Period"], model_value)


def rank_fusion(obs: DataFrame, model: DataFrame, grid: Grid, value: str = "Conc", model_value: str = "O3_MDA8", n: int = 10) -> DataFrame:
    """Fuse the r-th highest monitor value with the r-th highest model value, average over ranks.

    Sites with fewer than n values take no part.
    """
    where = obs.groupBy("Site").agg(F.avg("Lat").alias("Lat"), F.avg("Lon").alias("Lon"))
    ranked = ranked_rows(obs, ["Site"], value, n, ["Date", "POC"]).select("Site", "rank", value)
    enough = ranked.filter(F.col("rank") == n).select("Site")
    sites = ranked.join(enough, "Site", "left_semi").join(where, "Site")
    cells = ranked_rows(model, ["ROW", "COL"], model_value, n, ["Date"]).select(
        "ROW", "COL", "rank", model_value
    )
    monitors = matched_monitors(sites, cells, grid, ["rank"], value, model_value)
    fused = fuse(monitors, cells, ["rank"], model_value)
    return fused.groupBy("ROW", "COL").agg(*[F.avg(c).alias(c) for c in FUSED])


def wide_fusion(
    obs: DataFrame, model: DataFrame, grid: Grid, seasons: list[str], variables: list[str]
) -> DataFrame:
    """Season x variable fusion of wide tables (columns ``<season>_<variable>``)."""
    names = [f"{s}_{v}" for s in seasons for v in variables]
    long_obs = obs.unpivot(["Site", "Lat", "Lon"], names, "name", "Conc")
    long_model = model.unpivot(["ROW", "COL"], names, "name", "value")
    return metric_fusion(long_obs, long_model, grid, keys=["name"], value="Conc", model_value="value").withColumns(
        {"season": F.split("name", "_")[0], "variable": F.split("name", "_")[1]}
    ).drop("name")


def fused_month_sets(
    fused: DataFrame, grid: Grid, sets: dict[str, list[int]], ts: str = "Timestamp"
) -> DataFrame:
    """Average daily fused grids over month sets, with the longitude and latitude of each cell."""
    columns = ["vna_ozone", "avna_ozone", "evna_ozone", "ievna_ozone", "vna_mod", "model"]
    means = calendar_means(fused, ["ROW", "COL"], ts, columns, sets)
    x, y = F.col("COL") - 0.5, F.col("ROW") - 0.5
    return means.withColumns({"Lon": grid.conic.lon(x, y), "Lat": grid.conic.lat(x, y)})
