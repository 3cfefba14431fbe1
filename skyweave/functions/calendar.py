"""Dates, hours and the period calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.functions.ozone import col
from skyweave.schemas import SEASONS, WARM_SEASON


def shift_hours(ts: str | Column, hours: str | Column | int) -> Column:
    """Move a timestamp by a whole number of hours; NULL offset gives NULL."""
    amount = F.lit(hours) if isinstance(hours, int) else col(hours)
    return F.timestamp_add("HOUR", amount.cast("int"), col(ts)).cast("timestamp_ntz")


def utc_to_local(ts: str | Column, gmt_offset: str | Column) -> Column:
    return shift_hours(ts, gmt_offset)


def local_to_utc(ts: str | Column, gmt_offset: str | Column) -> Column:
    return shift_hours(ts, -col(gmt_offset).cast("int"))


def julian_date(tflag: str | Column) -> Column:
    """Date of an integer yyyyddd; codes outside the year give NULL."""
    code = col(tflag).cast("int")
    year, day = F.floor(code / 1000).cast("int"), F.pmod(code, F.lit(1000))
    first = F.make_date(year, F.lit(1), F.lit(1))
    last_day = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.when(day.between(1, last_day), F.date_add(first, day - 1))


def step_date(year: int | Column, index: str | Column) -> Column:
    """Date of a zero-based daily time step."""
    first = F.make_date(F.lit(year) if isinstance(year, int) else year, F.lit(1), F.lit(1))
    return F.date_add(first, col(index).cast("int"))


def day_index(date: str | Column) -> Column:
    """Zero-based daily time step of a date."""
    return F.dayofyear(col(date)) - 1


def days_in_month(ts: str | Column) -> Column:
    return F.dayofmonth(F.last_day(col(ts).cast("date")))


def season(month: Column) -> Column:
    """Season of a calendar month; December counts with its own calendar year."""
    out = None
    for label, months in SEASONS.items():
        out = (F if out is None else out).when(month.isin(*months), F.lit(label))
    return out


def period_labels(month: Column) -> Column:
    """Every period a month belongs to: Annual, its season, and the warm season."""
    warm, months = WARM_SEASON
    return F.when(
        month.isin(*months), F.array(F.lit("Annual"), season(month), F.lit(warm))
    ).otherwise(F.array(F.lit("Annual"), season(month)))


def is_daytime(ts: str | Column, inclusive: bool = False) -> Column:
    """08:00 up to, or with ``inclusive`` also including, the 20:00 hour."""
    hour = F.hour(col(ts))
    return hour.between(8, 20) if inclusive else (hour >= 8) & (hour < 20)


def in_wrapping_range(date: str | Column, start: str, end: str) -> Column:
    """Month-day range (``MM-dd``) that may run over the year end."""
    day = F.date_format(col(date), "MM-dd")
    if start <= end:
        return day.between(start, end)
    return (day >= start) | (day <= end)


def month_set_label(months: list[int] | None, year: int | str | None = None, dates: list | None = None) -> str:
    """Name of a selection: a month set with its year (empty: to be added per row), else the first and last date, else unspecified."""
    # Names of month sets.
    named = {
        (1, 2, 3): "JFM",
        (4, 5, 6): "AMJ",
        (7, 8, 9): "JAS",
        (10, 11, 12): "OND",
        (4, 5, 6, 7, 8, 9): "AS",
        tuple(range(1, 13)): "ALL",
    }
    if months:
        name = named.get(tuple(sorted(set(months))))
        return f"{name}_{year}" if name else f"{year}{list(months)}"
    return f"{dates[0]:%Y%m%d}_{dates[-1]:%Y%m%d}" if dates else "UNSPECIFIED"
