"""Hourly grids to daily maxima to period metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.hourly import daily_max_8h, grid_local_time, grid_w126
from skyweave.operators.rollup import metric_table


def hourly_to_mda8(hourly: DataFrame, tz_grid: DataFrame, columns: list[str]) -> DataFrame:
    local = grid_local_time(hourly, tz_grid, drop_unknown=True)
    days = daily_max_8h(local, ["ROW", "COL"], "local_time", columns)
    return days.withColumns({"Year": F.year("Date"), "Month": F.month("Date")})


def hourly_to_metrics(
    hourly: DataFrame, tz_grid: DataFrame, columns: list[str], year: int | None = None, with_98th: bool = False
) -> DataFrame:
    """8-hour maxima of each local day, then the period metrics of one local year."""
    days = hourly_to_mda8(hourly, tz_grid, columns)
    if year:
        days = days.filter(F.col("Year") == year)
    return metric_table(days.drop("Year", "Month"), ["ROW", "COL"], "Date", columns, with_98th)


def hourly_to_w126(hourly: DataFrame, tz_grid: DataFrame, columns: list[str], year: int, cells: DataFrame | None = None) -> DataFrame:
    return grid_w126(grid_local_time(hourly, tz_grid), columns, year, cells)
