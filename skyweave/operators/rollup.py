"""Daily fields to period metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions.calendar import period_labels
from skyweave.operators.periodstate import top_and_period_means
from skyweave.operators.quantiles import exact_percentiles, ranked_rows, top_n_mean


def monthly_sums(df: DataFrame, keys: list[str], date: str, columns: list[str]) -> DataFrame:
    """Sum and count per key and month: all that any period mean needs.

    The only pass over the daily rows; every period is built from this result.
    """
    parts = []
    for c in columns:
        parts += [F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}")]
    return df.groupBy(
        *keys, F.year(date).alias("Year"), F.month(date).alias("Month")
    ).agg(*parts)


def period_means(
    df: DataFrame, keys: list[str], date: str, columns: list[str], by_year: bool = True
) -> DataFrame:
    """Annual (per year), Apr-Sep and seasonal means per key in one pass.

    Only the Annual rows carry their ``Year``; with ``by_year`` false the
    annual mean runs over all years and there is no ``Year`` column.
    """
    months = monthly_sums(df, keys, date, columns)
    long = months.withColumn("Period", F.explode(period_labels(F.col("Month"))))
    year = F.when(F.col("Period") == "Annual", F.col("Year"))
    by = [*keys, "Period"] + ([year.alias("Year")] if by_year else [])
    means = [
        (F.sum(f"s_{c}") / F.when(F.sum(f"n_{c}") > 0, F.sum(f"n_{c}"))).alias(c) for c in columns
    ]
    return long.groupBy(*by).agg(*means)


def period_mean(
    df: DataFrame, keys: list[str], date: str, columns: list[str], period: str, year: bool = False
) -> DataFrame:
    """One period only; its months are filtered before the aggregation."""
    label = F.array_contains(period_labels(F.month(date)), period)
    by = [*keys] + ([F.year(date).alias("Year")] if year else [])
    return (
        df.filter(label)
        .groupBy(*by)
        .agg(*[F.avg(c).alias(c) for c in columns])
        .withColumn("Period", F.lit(period))
    )


def percentile_98(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return exact_percentiles(df, keys, {c: (c, 0.98) for c in columns}).withColumn(
        "Period", F.lit("98th")
    )


def top_10(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return top_n_mean(df, keys, columns, 10).withColumn("Period", F.lit("top-10"))


def metric_table(
    df: DataFrame, keys: list[str], date: str, columns: list[str], with_98th: bool = True
) -> DataFrame:
    """98th percentile, top-10, annual, warm-season and seasonal rows per key."""
    parts = [top_and_period_means(df, keys, date, columns)]
    if with_98th:
        parts.insert(0, percentile_98(df, keys, columns))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.select(*keys, "Period", "Year", *columns)


def top_days_mean(
    df: DataFrame, site: list[str], leader: str, columns: list[str], then: list[str], n: int = 10
) -> DataFrame:
    """Mean of every column over the n days with the highest ``leader`` value."""
    return (
        ranked_rows(df, site, leader, n, then)
        .groupBy(*site)
        .agg(*[F.avg(c).alias(c) for c in columns])
        .withColumn("Period", F.lit("top-10"))
    )


def site_metrics(
    df: DataFrame, site: list[str], date: str, leader: str, columns: list[str], then: list[str]
) -> DataFrame:
    """Period means of every column per site plus the top-10-day row."""
    means = period_means(df, site, date, columns, by_year=False)
    return means.unionByName(top_days_mean(df, site, leader, columns, then))


def calendar_means(
    df: DataFrame, keys: list[str], date: str, columns: list[str], sets: dict[str, list[int]]
) -> DataFrame:
    """Means over named month sets, built from the monthly sums."""
    months = monthly_sums(df, keys, date, columns)
    labels = F.filter(
        F.array(*[F.when(F.col("Month").isin(*m), F.lit(name)) for name, m in sets.items()]),
        lambda v: v.isNotNull(),
    )
    long = months.withColumn("label", F.explode(labels))
    return long.groupBy(*keys, "label").agg(
        *[(F.sum(f"s_{c}") / F.when(F.sum(f"n_{c}") > 0, F.sum(f"n_{c}"))).alias(c) for c in columns]
    )
