"""Row and column cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.ozone import ppb_to_ppm
from skyweave.schemas import SENTINEL


def scale_to_ppm(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: ppb_to_ppm(c) for c in columns})


def keep_region(df: DataFrame, region: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows whose cell is marked for fusion."""
    return df.join(region.filter(F.col("Is") == 1), on or ["ROW", "COL"], "left_semi")


def blank_outside_region(df: DataFrame, region: DataFrame, columns: list[str]) -> DataFrame:
    """Rows outside the region stay, their ``columns`` become NULL."""
    mask = region.select("ROW", "COL", "Is")
    return (
        df.join(mask, ["ROW", "COL"], "left")
        .withColumns({c: F.when(F.col("Is") == 1, F.col(c)) for c in columns})
        .drop("Is")
    )


def copy_missing(df: DataFrame, other: DataFrame, keys: list[str], source: str, columns: list[str]) -> DataFrame:
    """Blank ``columns`` wherever ``source`` of the other table has no value."""
    mask = other.select(*keys, F.col(source).alias("_m"))
    return (
        df.join(mask, keys, "left")
        .withColumns({c: F.when(F.col("_m").isNotNull(), F.col(c)) for c in columns})
        .drop("_m")
    )


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Inclusive range; bounds of the column's own type are pushed to the scan."""
    return df.filter(F.col(column).between(start, end))


def drop_sentinel(df: DataFrame, column: str, sentinel: float = SENTINEL) -> DataFrame:
    return df.filter(F.col(column) != sentinel)


def valid_measurements(df: DataFrame, column: str, flag: str | None = None) -> DataFrame:
    """Non-negative values, not marked by the agency's exclusion flag."""
    ok = F.col(column).isNotNull() & (F.col(column) >= 0)
    if flag:
        ok = ok & (F.col(flag).isNull() | (F.col(flag) != 1))
    return df.filter(ok)


def valid_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter((F.col(x) >= 0) & (F.col(y) >= 0))


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Names that contain every part, compared without case."""
    return [c for c in df.columns if all(p.lower() in c.lower() for p in parts)]


def in_box(lon: str, lat: str, west: float, east: float, south: float, north: float) -> Column:
    return F.col(lon).between(west, east) & F.col(lat).between(south, north)


def model_without_fusion(df: DataFrame, model: str = "model", fused: str = "vna_ozone") -> DataFrame:
    """Cells with a model value but no fused one."""
    return df.filter(F.col(model).isNotNull() & F.col(fused).isNull())


def large_groups(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows.

    Counts are formed with partial aggregation and joined back, so a group is
    never gathered to be counted.
    """
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return df.join(enough.select(*keys), keys, "left_semi")


def standard_offset(df: DataFrame, column: str = "gmt_offset") -> DataFrame:
    """Daylight-saving offset to standard offset."""
    return df.withColumn(column, (F.col(column) - 1).cast("int"))
