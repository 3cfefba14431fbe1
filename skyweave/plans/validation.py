"""Cross-validation of the fusion methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.ozone import additive_fusion, ratio_fusion
from skyweave.operators.audit import positions
from skyweave.operators.reshape import methods_to_rows
from skyweave.operators.rollup import calendar_means
from skyweave.operators.voronoi import voronoi_average
from skyweave.plans.fusion import MEASURES, Grid, matched_monitors, site_means
from skyweave.session import cut_lineage


def listed_sites(sites: DataFrame, assignment: DataFrame, keys: list[str], site: str = "Site") -> DataFrame:
    """Sites that the assignment knows for the same key, with their group."""
    groups = assignment.groupBy(*keys, site).agg(F.min("CVgroup").alias("CVgroup"))
    return sites.join(groups, [*keys, site])


def predict_folds(monitors: DataFrame, keys: list[str], site: str = "Site", k: int = 30) -> DataFrame:
    """Predictions at the cell of each test site from the monitors of the other groups.

    ``monitors`` carry ``CVgroup`` and the matched model value ``mod``.  Folds
    without training sites give NULL predictions.
    """
    monitors = cut_lineage(monitors)
    monitors = monitors.withColumn("CVgroup", F.col("CVgroup").cast("int"))
    cells = monitors.select(*keys, "CVgroup", "ROW", "COL").distinct()
    by = [*keys, "CVgroup"]
    averaged = voronoi_average(monitors, cells, keys, MEASURES, site=site, k=k, fold="CVgroup")
    joined = monitors.join(averaged, [*by, "ROW", "COL"], "left")
    return joined.select(
        *keys,
        site,
        "Lat",
        "Lon",
        F.col("ozone").alias("Conc"),
        "CVgroup",
        F.col("mod").alias("model"),
        "vna_ozone",
        ratio_fusion("mod", "vna_r_n").alias("evna_ozone"),
        additive_fusion("mod", "vna_bias").alias("avna_ozone"),
        "ROW",
        "COL",
    )


def daily_validation(obs: DataFrame, model: DataFrame, assignment: DataFrame, grid: Grid, value: str = "Conc", model_value: str = "O3_MDA8") -> DataFrame:
    """Group cross-validation per day, with the downscaler's prediction attached."""
    listed = listed_sites(site_means(obs, ["Date"], value=value), assignment, ["Date"])
    monitors = matched_monitors(listed, model, grid, ["Date"], value, model_value)
    result = predict_folds(monitors, ["Date"])
    downscaler = assignment.groupBy("Date", "Site").agg(F.avg("Prediction").alias("ds_ozone"))
    return result.join(downscaler, ["Date", "Site"], "left")


def hourly_validation(sites: DataFrame, model: DataFrame, assignment: DataFrame, grid: Grid) -> DataFrame:
    """The same per hour; groups are assigned per day, the downscaler meets hour 00 only."""
    dated = sites.withColumn("Date", F.col("TSTEP").cast("date"))
    listed = listed_sites(dated, assignment, ["Date"]).drop("Date")
    monitors = matched_monitors(listed, model, grid, ["TSTEP"], "Conc", "O3")
    result = predict_folds(monitors, ["TSTEP"])
    downscaler = assignment.groupBy(F.col("Date").cast("timestamp_ntz").alias("TSTEP"), "Site").agg(
        F.avg("Prediction").alias("ds_ozone")
    )
    return result.join(downscaler, ["TSTEP", "Site"], "left")


def fold_hash(key: list[str], seed: int) -> Column:
    """A 32-bit number of a row key, the same in every engine that has MD5."""
    parts = [F.col(c).cast("string") for c in key]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_folds(df: DataFrame, key: list[str], folds: int, seed: int = 42) -> DataFrame:
    """Random fold 1..k of each row from a hash of its key: repeatable, no shuffle."""
    return df.withColumn("CVgroup", (fold_hash(key, seed) % folds + 1).cast("int"))


def equal_site_folds(sites: DataFrame, date: str, site: str, folds: int = 10, seed: int = 42) -> DataFrame:
    """Random site folds of equal size per day (larger ones first), redrawn daily."""
    day = cut_lineage(sites.select(date, site).distinct().withColumn("_h", fold_hash([site, date], seed)))
    sizes = cut_lineage(day.groupBy(date).agg(F.count("*").alias("_n")))
    placed = positions(day, [date], "_h", [site]).join(sizes, date)
    small, larger = F.floor(F.col("_n") / folds), F.pmod(F.col("_n"), F.lit(folds))
    cut = larger * (small + 1)
    fold = F.when(F.col("_p") < cut, F.floor(F.col("_p") / (small + 1))).otherwise(
        larger + F.floor((F.col("_p") - cut) / F.greatest(small, F.lit(1)))
    )
    return placed.select(date, site, (fold + 1).cast("int").alias("CVgroup"))


def split_sites(df: DataFrame, train: DataFrame, test: DataFrame, site: str = "Site") -> DataFrame:
    """Given training and test site lists as groups 0 and 1."""
    return (
        df.join(train.select(site), site, "left_semi").withColumn("CVgroup", F.lit(0)).unionByName(
            df.join(test.select(site), site, "left_semi").withColumn("CVgroup", F.lit(1))
        )
    )


def period_validation(
    obs: DataFrame, model: DataFrame, folds: DataFrame, grid: Grid, sets: dict[str, list[int]], value: str = "Conc", model_value: str = "O3_MDA8"
) -> DataFrame:
    """Average over month sets, then cross-validate by site fold within each period."""
    sites = calendar_means(obs, ["Site"], "Date", [value], sets).withColumnRenamed("label", "Period")
    where = obs.groupBy("Site").agg(F.avg("Lat").alias("Lat"), F.avg("Lon").alias("Lon"))
    means = calendar_means(model, ["ROW", "COL"], "Date", [model_value], sets).withColumnRenamed("label", "Period")
    placed = sites.join(where, "Site").join(folds, "Site")
    monitors = matched_monitors(placed, means, grid, ["Period"], value, model_value)
    return predict_folds(monitors, ["Period"])


def long_scores(result: DataFrame, time: str, methods: list[str] | None = None) -> DataFrame:
    """Validation results as (Timestamp, Fold, Method, y_true, y_pred, ROW, COL)."""
    base = result.select(
        F.col(time).alias("Timestamp"),
        F.col("CVgroup").alias("Fold"),
        F.col("Conc").alias("y_true"),
        "ROW",
        "COL",
        *(methods or ["vna_ozone", "avna_ozone", "evna_ozone"]),
    )
    return methods_to_rows(
        base, ["Timestamp", "Fold", "y_true", "ROW", "COL"], methods or ["vna_ozone", "avna_ozone", "evna_ozone"]
    )


def site_day_table(obs: DataFrame, model: DataFrame, groups: DataFrame, grid: Grid, value: str = "Conc", model_value: str = "O3_MDA8") -> DataFrame:
    """Site-days with the nearest model value and the group of the site (last date wins)."""
    sites = matched_monitors(site_means(obs, ["Date"], value=value), model, grid, ["Date"], value, model_value)
    last = groups.groupBy("Site").agg(F.max_by("CVgroup", "Date").alias("CVgroup"))
    return sites.select("Site", "Date", "Lat", "Lon", F.col("ozone").alias("Conc"), F.col("mod").alias("model"), "ROW", "COL").join(
        last, "Site", "left"
    )
