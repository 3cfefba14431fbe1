"""Gridded model sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.calendar import day_index, julian_date, step_date
from skyweave.schemas import GRID_COLS, GRID_ROWS


def regular_grid(spark: SparkSession, rows: int = GRID_ROWS, cols: int = GRID_COLS) -> DataFrame:
    """Every 1-based cell of a grid."""
    return spark.range(rows * cols).select(
        (F.floor(F.col("id") / cols) + 1).cast("int").alias("ROW"),
        (F.col("id") % cols + 1).cast("int").alias("COL"),
    )


def cube_to_rows(cube: DataFrame, keys: list[str], values: str = "v", name: str = "value") -> DataFrame:
    """Nested rows x columns arrays to one row per cell, 1-based."""
    rows = cube.select(*keys, F.posexplode(values).alias("r", "line"))
    cells = rows.select(*keys, "r", F.posexplode("line").alias("c", name))
    return cells.select(
        *keys,
        (F.col("r") + 1).cast("int").alias("ROW"),
        (F.col("c") + 1).cast("int").alias("COL"),
        name,
    )


def surface_layer(model: DataFrame) -> DataFrame:
    return model.filter(F.col("LAY") == 0)


def dated_by_flag(model: DataFrame, year: int | None = None, flag: str = "TFLAG") -> DataFrame:
    """Dates from yyyyddd flags; undecodable rows go, optionally other years too."""
    dated = model.withColumn("Date", julian_date(flag)).filter(F.col("Date").isNotNull())
    return dated.filter(F.year("Date") == year) if year else dated


def dated_by_step(model: DataFrame, year: int | Column, step: str = "TSTEP") -> DataFrame:
    return model.withColumn("Date", step_date(year, step))


def slices_at_dates(model: DataFrame, dates: DataFrame, by_index: bool = False, step: str = "TSTEP") -> DataFrame:
    """Model rows at the given dates, matched by date or by day-of-year index."""
    days = dates.select("Date").distinct()
    if by_index:
        return model.join(days.withColumn(step, day_index("Date")), step)
    return model.join(days, "Date", "left_semi")
