"""Shared helpers: narrow inputs, bounded Arrow batches, distributed row numbers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.session import ship_package

#: Rows and bytes of an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Rows that one task numbers at most (on average).
BUCKET_ROWS = 20_000


def prepare(spark: SparkSession) -> None:
    """Settings every operator here relies on."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no further column can clash."""
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )


def free_memory() -> None:
    """Give what a task no longer needs back to the system: the worker that ran it stays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns one batch, several, or none."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        free_memory()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def about(id_col: str, total: Column | int, wanted: int) -> Column:
    """Whether a row is among about ``wanted`` of ``total``: its hashed id lies below a bound.

    No row has to be sorted or moved; where no more than ``wanted`` exist all are taken.
    """
    share = F.lit(float(wanted)) / F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(1))
    return F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30)


def numbered_within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: a gapless number from 0 within the groups ``by``.

    A group is dealt into hash buckets by ``order``; each bucket is numbered in
    its own task and starts where the buckets before it end, so that no task
    sees a whole group.  ``df`` is read twice: pass a written table.
    """
    rows = df.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    running = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bucket"))
    starts = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_bucket").alias("_kb"),
        (running - F.col("_c")).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    on = F.col("_bucket") == F.col("_kb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (
        keyed.withColumn("_in", inside)
        .join(starts, on)
        .withColumn(name, (F.col("_start") + F.col("_in") - 1).cast("bigint"))
        .drop("_bucket", "_kb", "_start", "_in", *[f"_k{i}" for i in range(len(by))])
    )
