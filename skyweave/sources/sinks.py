"""Table sinks."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_by(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per value of ``columns`` (per day, per metric).

    Rows are brought together by those columns so that each folder gets few
    files; adaptive execution splits a value that dominates by its size.
    """
    writer = df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def _files(spark, path: str):
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, as_path


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


def recover_table(spark, path: str) -> None:
    """Bring back the old version where a replacement stopped between its two renames."""
    fs, as_path = _files(spark, path)
    live, old = as_path(path), as_path(f"{path}.old")
    if not fs.exists(live) and fs.exists(old):
        _moved(fs, old, live)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may itself read.

    The new version is complete before the old one is touched, and the old one
    stays as ``<path>.old`` until the new one has its name: whatever stops in
    between, one whole version is left, and the next call (or
    ``recover_table``) puts it back.
    """
    spark = df.sparkSession
    fs, as_path = _files(spark, path)
    live, fresh, old = as_path(path), as_path(f"{path}.new"), as_path(f"{path}.old")
    recover_table(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    had = fs.exists(live)
    if had:
        _moved(fs, live, old)
    try:
        _moved(fs, fresh, live)
    except Exception:
        if had:
            _moved(fs, old, live)
        raise
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def _partitions(fs, as_path, path: str, keys: list[str]) -> list[str]:
    """Partition folders below ``path``, as ``k=v/...``, by listing folders only."""
    found = fs.globStatus(as_path(path + "".join(f"/{k}=*" for k in keys)))
    return ["/".join(str(f.getPath()).split("/")[-len(keys) :]) for f in found or []]


def _value(folder: str) -> str | None:
    text = unquote(folder.split("=", 1)[1])
    return None if text == "__HIVE_DEFAULT_PARTITION__" else text


def write_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write only the partitions that the output does not have yet (resume).

    What is there is known from the folder names.  New partitions are written
    aside and moved into place one by one, so a folder that exists is whole.
    """
    spark = df.sparkSession
    fs, as_path = _files(spark, path)
    done = [[_value(part) for part in folder.split("/")] for folder in _partitions(fs, as_path, path, keys)]
    todo = df
    if done:
        there = spark.createDataFrame(done, ", ".join(f"`_d{i}` string" for i in range(len(keys))))
        on = [df[k].cast("string").eqNullSafe(there[f"_d{i}"]) for i, k in enumerate(keys)]
        todo = df.join(there, on, "left_anti")
    stage = f"{path}/_stage-{uuid.uuid4().hex}"
    todo.write.partitionBy(*keys).parquet(stage)
    for folder in _partitions(fs, as_path, stage, keys):
        target = as_path(f"{path}/{folder}")
        fs.mkdirs(target.getParent())
        _moved(fs, as_path(f"{stage}/{folder}"), target)
    fs.delete(as_path(stage), True)
    spark.catalog.refreshByPath(path)
