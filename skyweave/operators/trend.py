"""Trends, regional series and display ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.operators.quantiles import exact_percentiles


def _median(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def median_slope(
    df: DataFrame, keys: list[str], columns: list[str], year: str = "Year", last_year: dict[str, int] | None = None
) -> DataFrame:
    """Theil-Sen slope per key: the median slope between any two years.

    One value per key and year is formed first (a mean with partial
    aggregation), so a group is as long as the record has years.  A missing
    year value inside the group makes the slope NULL.
    """
    last_year = last_year or {}

    def kept(c: str) -> Column:
        return F.col(year) <= last_year[c] if c in last_year else F.lit(True)

    yearly = df.groupBy(*keys, year).agg(
        *[F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c) for c in columns]
    )
    series = yearly.groupBy(*keys).agg(
        *[
            F.array_sort(
                F.collect_list(F.when(kept(c), F.struct(F.col(year).alias("t"), F.col(c).alias("v"))))
            ).alias(c)
            for c in columns
        ]
    )

    def slope(c: str) -> Column:
        pairs = F.flatten(
            F.transform(
                F.col(c),
                lambda a, i: F.transform(
                    F.slice(F.col(c), i + 2, F.size(F.col(c))),
                    lambda b: (b["v"] - a["v"]) / (b["t"] - a["t"]),
                ),
            )
        )
        void = F.exists(F.col(c), lambda p: p["v"].isNull())
        return F.when(~void & (F.size(F.col(c)) > 1), _median(pairs))

    return series.select(*keys, *[slope(c).alias(c) for c in columns])


def region_series(
    df: DataFrame, regions: DataFrame, columns: list[str], last_year: dict[str, int] | None = None, whole: int = 9
) -> DataFrame:
    """Yearly mean per climate region and for the whole domain, by period.

    Cells are summed per (Period, region, Year); the whole-domain rows are the
    sum of those few totals, so the table is aggregated once.
    """
    last_year = last_year or {}
    joined = df.join(regions.select("ROW", "COL", "ClimateRegion"), ["ROW", "COL"], "left")

    def limited(c: str) -> Column:
        return F.when(F.col("Year") <= last_year[c], F.col(c)) if c in last_year else F.col(c)

    parts = []
    for c in columns:
        parts += [F.sum(limited(c)).alias(f"s_{c}"), F.count(limited(c)).alias(f"n_{c}")]
    totals = joined.groupBy("Period", "ClimateRegion", "Year").agg(*parts)
    spread = totals.withColumn(
        "Region",
        F.explode(
            F.when(F.col("ClimateRegion").between(0, 8), F.array(F.col("ClimateRegion"), F.lit(whole)))
            .otherwise(F.array(F.lit(whole)))
        ),
    )
    return spread.groupBy("Period", "Region", "Year").agg(
        *[
            (F.sum(f"s_{c}") / F.when(F.sum(f"n_{c}") > 0, F.sum(f"n_{c}"))).alias(c)
            for c in columns
        ]
    )


def all_years(series: DataFrame, first: int, last: int, columns: list[str]) -> DataFrame:
    """Long (Period, Region, method, Year) series with a row for every year."""
    long = series.unpivot(["Period", "Region", "Year"], columns, "method", "v")
    lines = long.select("Period", "Region", "method").distinct()
    dense = lines.withColumn("Year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return dense.join(long, ["Period", "Region", "method", "Year"], "left")


def year_matrix(series: DataFrame, first: int, last: int, columns: list[str]) -> DataFrame:
    """Methods by years, one column ``y<year>`` each."""
    long = series.unpivot(["Period", "Region", "Year"], columns, "method", "v")
    wide = long.groupBy("Period", "Region", "method").pivot("Year", list(range(first, last + 1))).agg(
        F.first("v", ignorenulls=True)
    )
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in range(first, last + 1)})


def legend_bounds(series: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest regional mean: one range for top-10, one for all else."""
    low, high = F.least(*columns), F.greatest(*columns)
    group = F.when(F.col("Period") == "top-10", F.lit("top-10")).otherwise(F.lit("other"))
    return series.groupBy(group.alias("legend")).agg(
        F.min(low).alias("low"), F.max(high).alias("high")
    )


def pooled_ranges(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Percentile and full ranges of the pooled columns by Year and class, plus class means."""
    group = F.when(F.col("Period") == "top-10", F.lit("top-10")).otherwise(F.lit("not top-10"))
    long = (
        df.withColumn("class", group)
        .select("Year", "class", *columns)
        .unpivot(["Year", "class"], columns, "name", "v")
        .filter(F.col("v").isNotNull())
    )
    by = ["Year", "class"]
    span = long.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"))
    yearly = exact_percentiles(long, by, {"p_low": ("v", low), "p_high": ("v", high)}).join(span, by)
    measures = ["p_low", "p_high", "min", "max"]
    mean = yearly.groupBy("class").agg(*[F.avg(m).alias(m) for m in measures])
    rows = yearly.select(F.col("Year").cast("string").alias("Year"), "class", *measures)
    return rows.unionByName(mean.withColumn("Year", F.lit("Mean")))


def display_range(df: DataFrame, keys: list[str], column: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    return exact_percentiles(df, keys, {"v_min": (column, low), "v_max": (column, high)})


def looked_up_range(
    df: DataFrame, keys: list[str], column: str, ranges: DataFrame, low: float = 0.005, high: float = 0.995
) -> DataFrame:
    """Range of (Year, class) from a stored table, else the grid's own percentiles.

    ``keys`` include Year and Period; only keys without a stored range matter for
    the percentiles, but both are computed in one aggregation.
    """
    own = display_range(df, keys, column, low, high)
    group = F.when(F.col("Period") == "top-10", F.lit("top-10")).otherwise(F.lit("not top-10"))
    stored = ranges.select(
        "Year", "class", F.col("p_low").alias("s_min"), F.col("p_high").alias("s_max")
    )
    return own.withColumn("class", group).join(stored, ["Year", "class"], "left").select(
        *keys, F.coalesce("s_min", "v_min").alias("v_min"), F.coalesce("s_max", "v_max").alias("v_max")
    )
