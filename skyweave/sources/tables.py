"""Text and table sources."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.text import YEAR_PATTERN
from skyweave.sources.lines import numbered_lines


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; a schema avoids the inference pass, ``columns`` prune the parser."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_csv_body(spark: SparkSession, path: str | list[str], schema: str, is_data: str) -> DataFrame:
    """CSV whose preamble, headers or comments do not look like data.

    Data lines match the pattern ``is_data``; files stay splittable because no
    line needs to know its own number.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike(is_data))
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def read_csv_after(spark: SparkSession, path: str | list[str], schema: str, skip: int) -> DataFrame:
    """CSV after a fixed number of lines per file; files of any size stay splittable."""
    body = numbered_lines(spark, path).filter((F.col("line_no") >= skip) & (F.col("value") != ""))
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reader by file ending: csv, json, parquet or orc."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in {"csv", "json", "parquet", "orc"}:
        raise ValueError(f"unknown table format: {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(kind).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return where.getFileSystem(conf).exists(where)


def year_of_path(path: str) -> int | None:
    """The year in the last part of a path."""
    found = re.search(YEAR_PATTERN, path.rstrip("/").rsplit("/", 1)[-1])
    return int(found.group(1)) if found else None


def read_years(spark: SparkSession, paths: list[str], schema: str, fmt: str = "csv") -> DataFrame:
    """One table over yearly files; the year comes from the name, absent files are skipped."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    out = spark.createDataFrame([], schema).withColumn("Year", F.lit(None).cast("int"))
    for path in paths:
        if path_exists(spark, path):
            part = reader.format(fmt).load(path)
            out = out.unionByName(part.withColumn("Year", F.lit(year_of_path(path)).cast("int")))
    return out


def month_slices(model: DataFrame, hours: DataFrame, ts: str) -> DataFrame:
    """Model rows of the wanted hours from a table partitioned by year and month.

    The join carries the partition columns, so only their folders are read;
    hours outside the table find nothing.
    """
    wanted = hours.select(F.col(ts), F.year(ts).alias("year"), F.month(ts).alias("month")).distinct()
    return model.join(wanted, [ts, "year", "month"], "left_semi")


def with_spill_years(
    obs: DataFrame, ts: str, start: str, end: str, year: str | None = "Year", low: int = -8, high: int = -4
) -> DataFrame:
    """Local-time rows that can fall in the UTC range [start, end].

    Offsets run from ``low`` to ``high`` hours, so the local range is [start + low,
    end + high].  Its years prune the partitions ``year``, its bounds are pushed
    to the scan.
    """
    first = datetime.fromisoformat(start) + timedelta(hours=low)
    last = datetime.fromisoformat(end) + timedelta(hours=high)
    bounds = [F.lit(str(b)).cast("timestamp_ntz") for b in (first, last)]
    kept = obs if year is None else obs.filter(F.col(year).isin(*range(first.year, last.year + 1)))
    return kept.filter(F.col(ts).between(*bounds))
