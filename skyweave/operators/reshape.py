"""Long and wide forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions.text import mapped


def metric_rows_to_columns(long: DataFrame, keys: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One column per named metric; the list is given, so no extra pass finds it."""
    return long.groupBy(*keys).pivot(metric, metrics).agg(F.max(value))


def split_names(wide: DataFrame, keys: list[str], columns: list[str], separator: str, parts: list[str], pivot: str, values: list[str]) -> DataFrame:
    """Melt, split each name into ``parts``, and spread one part back to columns."""
    long = wide.unpivot(keys, columns, "name", "v")
    pieces = F.split("name", separator)
    named = long.withColumns({p: pieces[i] for i, p in enumerate(parts)}).drop("name")
    others = [p for p in parts if p != pivot]
    return named.groupBy(*keys, *others).pivot(pivot, values).agg(F.max("v"))


def day_columns_to_rows(wide: DataFrame, keys: list[str], year: int, names: dict[str, str]) -> DataFrame:
    """Columns ``<VARIABLE>_dMMDD`` to one row per day and a column per variable."""
    days = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, days, "name", "v")
    code = F.regexp_extract("name", "_d([0-9]{4})$", 1)
    stamped = long.select(
        *keys,
        F.to_date(F.concat(F.lit(str(year)), code), "yyyyMMdd").alias("Timestamp"),
        mapped(F.regexp_replace("name", "_d[0-9]{4}$", ""), names).alias("variable"),
        "v",
    )
    return stamped.groupBy(*keys, "Timestamp").pivot("variable", list(names.values())).agg(F.max("v"))


def day_code_date(df: DataFrame, code: str, year: int) -> DataFrame:
    """Date from an MMDD number that may have lost its leading zero."""
    text = F.concat(F.lit(str(year)), F.lpad(F.col(code).cast("string"), 4, "0"))
    return df.withColumn("Timestamp", F.to_date(text, "yyyyMMdd"))


def period_columns_to_rows(tables: dict[str, DataFrame], key: str, periods: list[str]) -> DataFrame:
    """Tables with a column per period, joined into one row per key and period."""
    out = None
    for name, table in tables.items():
        long = table.select(key, *periods).unpivot([key], periods, "Period", name)
        out = long if out is None else out.join(long, [key, "Period"])
    return out


def collapse_sparse(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key out of rows that each fill some of the columns."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def methods_to_rows(df: DataFrame, keys: list[str], columns: list[str], name: str = "Method", value: str = "y_pred") -> DataFrame:
    return df.unpivot(keys, columns, name, value)
