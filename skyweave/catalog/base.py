"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.catalog.fixtures import SQL_VIEWS
from skyweave.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str, views: str) -> str:
    """The SQL text with its domain views in front; ``body`` may add CTEs after a comma."""
    names: list[str] = []

    def need(name: str) -> None:
        text, uses = SQL_VIEWS[name]
        for u in uses:
            need(u)
        if name not in names:
            names.append(name)

    for view in views.split():
        need(view)
    if not names:
        return body
    head = ",\n".join(f"{n} AS ({SQL_VIEWS[n][0]})" for n in names)
    return f"WITH {head}\n{body}"


#: Added before rounding on both sides, so that no value sits on a rounding tie.
OFF_TIE = 1.3e-9


def rounded(df: DataFrame, floats: str, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + OFF_TIE, digits) + F.lit(0.0) for c in floats.split()})


def query(name: str, sql: str | None = None, views: str = "", floats: str = "", digits: int = 6):
    """Register a query and its SQL; both sides round the ``floats`` columns."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            df = fn(spark, sf_dir)
            return rounded(df, floats, digits) if floats else df

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql, views)
            if floats:
                parts = ", ".join(f"ROUND({c} + {OFF_TIE}, {digits}) + 0.0 AS {c}" for c in floats.split())
                text = f"SELECT * REPLACE ({parts}) FROM ({text}) AS q"
            ORACLES[name] = text
        return fn

    return register
