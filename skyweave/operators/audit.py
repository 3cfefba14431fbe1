"""Completeness counts and key audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.shelves import running, shelved
from skyweave.session import dealt


def distinct_sites(df: DataFrame, site: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.countDistinct(site).alias("sites"))


def leading_sites(df: DataFrame, site: str, date: str, value: str, least: int = 10, n: int = 10) -> DataFrame:
    """Distinct sites among the n highest rows of sites with enough dates."""
    dates = df.groupBy(site).agg(F.countDistinct(date).alias("d")).filter(F.col("d") >= least)
    top = (
        df.join(dates.select(site), site, "left_semi")
        .orderBy(F.desc_nulls_last(value), site, date)
        .limit(n)
    )
    return top.select(site).distinct()


def full_days(df: DataFrame, site: str, ts: str) -> DataFrame:
    """Numbers of site-days with all 24 hours and with fewer."""
    days = df.groupBy(site, F.col(ts).cast("date").alias("Date")).agg(
        F.countDistinct(F.hour(ts)).alias("h")
    )
    return days.agg(
        F.count(F.when(F.col("h") == 24, 1)).alias("complete"),
        F.count(F.when(F.col("h") < 24, 1)).alias("incomplete"),
    )


def period_calendar(spark, year: int, periods: dict[str, list[int]]) -> DataFrame:
    """Days per period of a year, from the calendar (a handful of rows)."""
    days = spark.range(366).select(F.date_add(F.lit(f"{year}-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    labels = F.filter(
        F.array(*[F.when(F.month("d").isin(*m), F.lit(p)) for p, m in periods.items()]),
        lambda v: v.isNotNull(),
    )
    return (
        days.filter(F.year("d") == year)
        .select(F.explode(labels).alias("Period"))
        .groupBy("Period")
        .agg(F.count("*").alias("days"))
    )


def missing_time(
    df: DataFrame,
    sites: DataFrame,
    site: str,
    ts: str,
    year: int,
    periods: dict[str, list[int]],
    hourly: bool = True,
) -> DataFrame:
    """Missing hours (distinct) or days (rows) per site and period.

    Sites without a single row count as missing throughout.  Period labels are
    laid out per site as an array, the observations are pre-aggregated.
    """
    labels = lambda m: F.filter(
        F.array(*[F.when(m.isin(*months), F.lit(p)) for p, months in periods.items()]),
        lambda v: v.isNotNull(),
    )
    within = df.filter(F.year(ts) == year)
    present = within.select(site, ts, F.explode(labels(F.month(ts))).alias("Period")).groupBy(
        site, "Period"
    ).agg((F.countDistinct(ts) if hourly else F.count("*")).alias("present"))
    expected = period_calendar(df.sparkSession, year, periods).withColumn(
        "expected", F.col("days") * (24 if hourly else 1)
    )
    frame = (
        sites.select(site)
        .distinct()
        .withColumn("Period", F.explode(F.array(*[F.lit(p) for p in periods])))
        .join(expected.select("Period", "expected"), "Period")
    )
    return frame.join(present, [site, "Period"], "left").select(
        site, "Period", (F.col("expected") - F.coalesce("present", F.lit(0))).alias("missing")
    )


def site_set_audit(left: DataFrame, right: DataFrame, date: str, site: str) -> DataFrame:
    """Common, left-only and right-only sites per date, and whether left covers right."""
    none = F.lit(None).cast("int")
    a = left.select(date, site, F.lit(1).alias("_l"), none.alias("_r"))
    b = right.select(date, site, none.alias("_l"), F.lit(1).alias("_r"))
    met = dealt(a.unionByName(b), [date, site]).groupBy(date, site).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    # A NULL equals no other.
    common = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col(date).isNotNull() & F.col(site).isNotNull()
    only_right = F.count(F.when(F.col("_r").isNotNull() & ~common, 1))
    return met.groupBy(date).agg(
        F.count(F.when(common, 1)).alias("common"),
        F.count(F.when(F.col("_l").isNotNull() & ~common, 1)).alias("only_left"),
        only_right.alias("only_right"),
        (only_right == 0).alias("left_covers"),
    )


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def arg_max_rows(df: DataFrame, value: str) -> DataFrame:
    """All rows that hold the overall maximum."""
    return df.filter(F.col(value) == df.agg(F.max(value).alias("m")).scalar())


def extreme_rows(df: DataFrame, column: str, valid: str, n: int, then: list[str]) -> DataFrame:
    """n highest and n lowest rows by column among rows with a ``valid`` value."""
    rows = df.filter(F.col(valid).isNotNull())
    top = rows.orderBy(F.desc_nulls_last(column), *then).limit(n).withColumn("end", F.lit("top"))
    low = rows.orderBy(F.asc_nulls_last(column), *then).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)


def found_counts(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that the other table has and lacks."""
    mine = df.select(key).distinct()
    other_keys = other.select(key).distinct().withColumn("_o", F.lit(1))
    return mine.join(other_keys, key, "left").agg(
        F.count("_o").alias("found"), F.count(F.when(F.col("_o").isNull(), 1)).alias("not_found")
    )


def validity_counts(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shared keys invalid in both tables, and valid in exactly one."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    no_a, no_b = F.col("_a").isNull(), F.col("_b").isNull()
    return both.agg(
        F.count(F.when(no_a & no_b, 1)).alias("invalid_both"),
        F.count(F.when(no_b & ~no_a, 1)).alias("valid_left_only"),
        F.count(F.when(no_a & ~no_b, 1)).alias("valid_right_only"),
    )


def key_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Type, distinct values per side and common distinct values of each key column."""
    out = None
    for k in keys:
        x = a.select(F.col(k).cast("string").alias("v")).distinct().withColumn("_l", F.lit(1))
        y = b.select(F.col(k).cast("string").alias("v")).distinct().withColumn("_r", F.lit(1))
        row = (
            x.join(y, "v", "full")
            .agg(
                F.count("_l").alias("left_distinct"),
                F.count("_r").alias("right_distinct"),
                F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("common"),
            )
            .select(
                F.lit(k).alias("column"),
                F.lit(a.schema[k].dataType.simpleString() == b.schema[k].dataType.simpleString()).alias("same_type"),
                "left_distinct",
                "right_distinct",
                "common",
            )
        )
        out = row if out is None else out.unionByName(row)
    return out


def sign_counts(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.when(F.col(column) < 0, 1)).alias("negative"), F.count("*").alias("total")
    )


def grouped_range(df: DataFrame, column: str, periods: list[str] | None = None) -> DataFrame:
    """Minimum, maximum and mean, rounded to two places."""
    rows = df.filter(F.col("Period").isin(*periods)) if periods else df
    return rows.agg(
        F.round(F.min(column), 2).alias("min"),
        F.round(F.max(column), 2).alias("max"),
        F.round(F.avg(column), 2).alias("mean"),
    )


def grid_days_complete(df: DataFrame, date: str, cells: int) -> DataFrame:
    """Rows per day, and whether the day covers the whole grid."""
    return df.groupBy(date).agg(F.count("*").alias("n")).withColumn("complete", F.col("n") == cells)


def positions(df: DataFrame, by: list[str], order: str, then: list[str] | None = None) -> DataFrame:
    """Zero-based position ``_p`` of each row in its group by a numeric column.

    A group is ranked shelf by shelf, and each shelf starts where the counts of
    the shelves before it end: no task orders a whole group.
    """
    sort = [order, *(then or [])]
    ranked = running(shelved(df.withColumn("_1", F.lit(1)), by, sort), by, sort, "_1", "_p")
    return ranked.withColumn("_p", F.col("_p") - 1).drop("_1", "_total")


def numbered(df: DataFrame, by: list[str], order: str, rows: int, column_major: bool = True) -> DataFrame:
    """ROW and COL from the position of each row within its group.

    Column-major counts down ``rows`` rows first; row-major takes ``rows`` as
    the length of a row.
    """
    inner, outer = F.pmod("_p", F.lit(rows)) + 1, F.floor(F.col("_p") / rows) + 1
    row, column = (inner, outer) if column_major else (outer, inner)
    return (
        positions(df, by, order)
        .withColumns({"ROW": row.cast("int"), "COL": column.cast("int")})
        .drop("_p")
    )
