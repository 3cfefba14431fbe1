"""Ranks and running totals of groups of any size.

Rows are sorted once across the cluster by (group, order) into shelves: ranges
of about equally many rows, whose borders Spark samples from the data.  One far
outlier or one dominating group changes nothing: a group simply spans several
shelves.  Totals per shelf are few, so a running total is the total of the
shelves before plus a running total inside one shelf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import cut_lineage


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the keys of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def shelved(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number ``_shelf`` of the range that holds (by, order).

    Written to the shared folder, as sampled borders must be the same for every
    reader.  ``by`` and ``order`` together should tell rows apart.
    """
    return cut_lineage(df.repartitionByRange(*by, *order).withColumn("_shelf", F.spark_partition_id()))


def shelf_totals(shelves: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Per group and shelf: ``_sum``, ``_before`` (of the shelves before) and ``_total`` of the group."""
    whole = Window.partitionBy(*by)
    return (
        shelves.groupBy(*by, "_shelf")
        .agg(F.sum(weight).alias("_sum"))
        .withColumns(
            {
                "_before": F.sum("_sum").over(whole.orderBy("_shelf")) - F.col("_sum"),
                "_total": F.sum("_sum").over(whole),
            }
        )
    )


def running(shelves: DataFrame, by: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """Add the running total ``name`` of ``weight`` and the group's ``_total``; rows in ``order``."""
    starts = shelf_totals(shelves, by, weight).select(*by, "_shelf", "_before", "_total")
    inside = Window.partitionBy(*by, "_shelf").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_null_safe(shelves.withColumn("_in", F.sum(weight).over(inside)), starts, [*by, "_shelf"])
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_before", "_in", "_shelf")
    )


def next_value(shelves: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Add ``name``: ``column`` of the following row of the group, NULL for the last; rows in ``order``.

    Inside a shelf it is the next row; the last row of a shelf takes the first row
    that the group has on a later one.
    """
    own = F.struct(F.col(column).alias("v"))
    inside = Window.partitionBy(*by, "_shelf").orderBy(*order)
    firsts = shelves.groupBy(*by, "_shelf").agg(F.min_by(own, F.struct(*order)).alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy(*by).orderBy("_shelf")))
    return (
        join_null_safe(shelves.withColumn("_next", F.lead(own).over(inside)), later.drop("_first"), [*by, "_shelf"])
        .withColumn(name, F.coalesce("_next", "_later")["v"])
        .drop("_next", "_later", "_shelf")
    )


def running_blocks(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "block") -> DataFrame:
    """Number of the block each row lies in: how many rows up to it open one; groups of any size."""
    marked = df.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("bigint"))
    return running(shelved(marked, by, order), by, order, "_starts", name).drop("_starts", "_total")


def step_to_next(df: DataFrame, by: list[str], order: list[str], column: str, name: str = "step") -> DataFrame:
    """Each row's value less the following one's, NULL at the end of a group; groups of any size."""
    met = next_value(shelved(df, by, order), by, order, column, "_following")
    return met.withColumn(name, F.col(column) - F.col("_following")).drop("_following")
