"""Exact percentiles and ranked values that survive a dominating group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.radix import selected


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Linear-interpolated percentiles, ``wanted`` maps output to (column, p).

    Groups without any value keep their row; a NULL key is a group like others.
    """
    return selected(df, keys, wanted)


def long_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key and column: ``keys, name, v``."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keys, columns, "name", "v")


def top_n_mean(df: DataFrame, keys: list[str], columns: list[str], n: int = 10) -> DataFrame:
    """Mean of the n highest values, each column on its own.

    The rank filter is applied before the shuffle as well as after it, so a
    group sends at most n rows per column and task, whatever its size.  NULLs
    come last; a group without any value keeps its row.
    """
    order = Window.partitionBy(*keys, "name").orderBy(F.desc_nulls_last("v"))
    top = long_values(df, keys, columns).withColumn("r", F.row_number().over(order)).filter(
        F.col("r") <= n
    )
    return top.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns]
    )


def nth_largest(df: DataFrame, keys: list[str], column: str, n: int, name: str) -> DataFrame:
    """The n-th largest value of each group; groups that are too small give no row."""
    order = Window.partitionBy(*keys).orderBy(F.desc(column))
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn("r", F.row_number().over(order))
        .filter((F.col("r") <= n))
        .filter(F.col("r") == n)
        .select(*keys, F.col(column).alias(name))
    )


def smallest_of_top(df: DataFrame, keys: list[str], column: str, n: int, name: str) -> DataFrame:
    """Least of the n largest values (all of them in a smaller group)."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(column))
    return (
        df.withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= n)
        .groupBy(*keys)
        .agg(F.min(column).alias(name))
    )


def ranked_rows(df: DataFrame, keys: list[str], column: str, n: int, then: list[str]) -> DataFrame:
    """The n highest rows of each group with their rank; ``then`` breaks ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(column), *then)
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
