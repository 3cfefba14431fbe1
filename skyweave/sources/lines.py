"""Line numbers of text files that stay splittable.

Lines are counted per split (file and start of the split); the counts of the
splits before a split are where its numbers begin.  A line's place inside its
split is its row number in the task that reads it, so no file is ever read by one
task as a whole and no line is moved to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.session import cut_lineage


def numbered_lines(spark: SparkSession, path: str | list[str], blank: bool = True) -> DataFrame:
    """``file, split, line_no, value``: the lines of each file, numbered from 0.

    Without ``blank`` empty lines are left out before they are numbered.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )
    if not blank:
        lines = lines.filter(F.col("value") != "")
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    splits = cut_lineage(lines.groupBy("file", "split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    shift = before_split(splits, "_n") - F.col("_first")
    return (
        lines.join(splits.select("file", "split", shift.alias("_shift")), ["file", "split"])
        .withColumn("line_no", F.col("_id") + F.col("_shift"))
        .select("file", "split", "line_no", "value")
    )


def before_split(splits: DataFrame, count: str) -> Column:
    """Sum of ``count`` over the splits before each split of its file (a row per split)."""
    return F.sum(count).over(Window.partitionBy("file").orderBy("split")) - F.col(count)


def numbered_blocks(lines: DataFrame, header: Column) -> DataFrame:
    """Add ``block``, counted from 0 per file: a line that is a ``header`` opens the next one; -1 stands before the first.

    Headers are counted per split and the counts summed over the splits before.
    """
    marked = lines.withColumn("_head", header.cast("bigint"))
    splits = cut_lineage(marked.groupBy("file", "split").agg(F.sum("_head").alias("_heads")))
    starts = splits.select("file", "split", before_split(splits, "_heads").alias("_before"))
    inside = F.sum("_head").over(Window.partitionBy("file", "split").orderBy("line_no"))
    return (
        marked.withColumn("_in", inside)
        .join(starts, ["file", "split"])
        .withColumn("block", F.col("_before") + F.col("_in") - 1)
        .drop("_head", "_in", "_before")
    )
