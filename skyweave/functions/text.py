"""Identifiers, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.functions.ozone import col

# Display labels by the first matching part of a column name.
METHOD_LABELS = [
    ("model", "EQUATES"),
    ("harvard_ml", "Harvard ML"),
    ("evna_ozone", "eVNA"),
    ("avna_ozone", "aVNA"),
    ("ds_ozone", "Downscaler"),
    ("vna_ozone", "VNA"),
    ("Conc", "Monitor"),
    ("O3", "Monitor (Hourly)"),
]
# Period keys in matching order, spellings of the same period.
PERIOD_KEYS = ["DJF", "MAM", "JJA", "SON", "Annual", "Apr-Sep", "top-10", "W126"]
PERIOD_SPELLINGS = {"Apr - Sep": "Apr-Sep", "top - 10": "top-10"}
# Hours behind UTC of the named standard zones.
ZONE_HOURS = {"Eastern": -5, "Central": -6, "Mountain": -7, "Pacific": -8}
YEAR_PATTERN = "(20[0-2][0-9])"


def canonical_site(c: str | Column) -> Column:
    """Digits of an identifier without leading zeros."""
    return F.regexp_replace(F.regexp_replace(col(c), "[^0-9]", ""), "^0+", "")


def has_letters(c: str | Column) -> Column:
    return col(c).rlike("[a-zA-Z]")


def is_nine_digit_8(c: str | Column) -> Column:
    """Nine-digit identifiers that begin with 8."""
    return col(c).rlike("^8[0-9]{8}$")


def cell_of_compound_id(c: str | Column) -> tuple[Column, Column]:
    """ROW and COL of an identifier whose last three digits are the row."""
    text = col(c).cast("string")
    row = F.right(text, F.lit(3)).cast("int")
    column = F.left(text, F.length(text) - 3).cast("int")
    return row, column


def year_in_name(c: str | Column) -> Column:
    found = F.regexp_extract(col(c), YEAR_PATTERN, 1)
    return F.when(found != "", found.cast("int"))


def _first_match(c: str | Column, pairs: list[tuple[str, str]]) -> Column:
    out = None
    for part, label in pairs:
        out = (F if out is None else out).when(col(c).contains(part), F.lit(label))
    return out


def period_key(c: str | Column) -> Column:
    """First known period contained in a longer label."""
    return _first_match(c, [(key, key) for key in PERIOD_KEYS])


def method_label(c: str | Column) -> Column:
    return F.coalesce(_first_match(c, METHOD_LABELS), F.lit("unknown"))


def canonical_period(c: str | Column) -> Column:
    out = col(c)
    for spelling, label in PERIOD_SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(label))
    return out


def matches_period(c: str | Column, part: str) -> Column:
    """Case-insensitive containment; NULL does not match."""
    return F.coalesce(F.lower(col(c)).contains(part.lower()), F.lit(False))


def zone_hours(c: str | Column) -> Column:
    """Hours from UTC of a zone name, NULL for an unknown one."""
    pairs = [F.lit(v) for kv in ZONE_HOURS.items() for v in kv]
    return F.element_at(F.create_map(*pairs), col(c))


def mapped(c: str | Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), col(c))
