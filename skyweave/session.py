"""Session settings, shared scratch space, lineage cuts and code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package relies on.  Join strategies are left to
#: the size estimates and to adaptive execution; no operator forces a broadcast.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def build_session(app: str = "skyweave", master: str | None = None, **extra: str) -> SparkSession:
    """Start (or reuse) a session; ``extra`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The UDFs call functions of the package, and a worker has neither the
    driver's working directory nor its ``sys.path``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "skyweave.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may fall back to a
    folder of its own machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that one task of ``dealt`` gets on average.
TASK_ROWS = 500_000


def parts_of(rows: int) -> int:
    """Number of parts for ``rows`` rows, which grows with them, so that a part does not."""
    return -(-rows // TASK_ROWS) or 1


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` to a number of tasks that grows with its rows; a grouping by them stays in these tasks."""
    return df.repartition(parts_of(df.count()), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    A reliable cut: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
