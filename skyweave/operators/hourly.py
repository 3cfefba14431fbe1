"""Hourly fields: local time, 8-hour maxima and the W126 index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.calendar import days_in_month, is_daytime, utc_to_local
from skyweave.functions.ozone import ppb_to_ppm, w126_weight

TRIPLES = [(m, m + 1, m + 2) for m in range(3, 9)]


def hourly_means(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """One row per key and hour; repeated hours are averaged before the shuffle."""
    return df.groupBy(*keys, ts).agg(*[F.avg(c).alias(c) for c in columns])


def grid_local_time(df: DataFrame, tz_grid: DataFrame, ts: str = "Timestamp", drop_unknown: bool = False) -> DataFrame:
    """Local time columns from the offset of each cell."""
    how = "inner" if drop_unknown else "left"
    offsets = tz_grid.select("ROW", "COL", "gmt_offset")
    if drop_unknown:
        offsets = offsets.filter(F.col("gmt_offset").isNotNull())
    joined = df.join(offsets, ["ROW", "COL"], how).withColumn(
        "local_time", utc_to_local(ts, "gmt_offset")
    )
    return joined.withColumns(
        {
            "Year": F.year("local_time"),
            "Month": F.month("local_time"),
            "Day": F.dayofmonth("local_time"),
            "hour": F.hour("local_time"),
        }
    )


def rolling_mean(column: str, by: list[str], order: str, width: int) -> Column:
    """Mean of the last ``width`` rows, NULL until full or with a missing value inside."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)
    return F.when(F.count(column).over(frame) == width, F.avg(column).over(frame))


def sliding_sum(column: str, by: list[str], order: list[str], width: int) -> Column:
    """Sum of the last ``width`` rows, NULL until the window is full."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - width, 0)
    return F.when(
        (F.count(F.lit(1)).over(frame) == width) & (F.count(column).over(frame) == width),
        F.sum(column).over(frame),
    )


def daily_max_8h(
    df: DataFrame, keys: list[str], ts: str, columns: list[str], keep_first: list[str] | None = None
) -> DataFrame:
    """Highest 8-row mean within each local day of each key (windows stay inside the day).

    The window and the maximum share one partitioning, so this is one shuffle.
    ``keep_first`` columns take the value of the first hour of the day.
    """
    keep_first = keep_first or []
    day = df.withColumn("Date", F.col(ts).cast("date"))
    by = [*keys, "Date"]
    rolled = day.select(
        *by, ts, *keep_first, *[rolling_mean(c, by, ts, 8).alias(f"r_{c}") for c in columns]
    )
    return rolled.groupBy(*by).agg(
        *[F.min_by(c, ts).alias(c) for c in keep_first],
        *[F.max(f"r_{c}").alias(c) for c in columns],
    )


def guarded_max_8h(
    df: DataFrame, keys: list[str], ts: str, columns: list[str], per_day: bool = False
) -> DataFrame:
    """Highest 8-hour mean of a whole series, NULL with fewer than 8 values.

    ``per_day`` restricts the windows to a day.  Otherwise a series may be as
    long as the table, so it is cut into month pieces that overlap by seven
    rows' worth of hours: every window lies in one piece, none is lost.
    """
    if per_day:
        return daily_max_8h(df, keys, ts, columns)
    return _series_max(df, keys, ts, columns)


def _series_max(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    # Each month also needs the last seven rows before it, wherever they are:
    # number the rows by month totals, then hand the border rows to the next piece.
    month = F.trunc(F.col(ts).cast("date"), "month")
    rows = df.withColumn("piece", month)
    sizes = rows.groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("piece")
    offsets = sizes.withColumn("skip", F.sum("n").over(before) - F.col("n")).drop("n")
    within = Window.partitionBy(*keys, "piece").orderBy(ts)
    numbered = rows.join(offsets, [*keys, "piece"]).withColumn(
        "pos", F.col("skip") + F.row_number().over(within) - 1
    )
    size = 4096
    block = F.floor(F.col("pos") / size)
    homes = F.when(
        F.pmod(F.col("pos"), F.lit(size)) >= size - 7, F.array(block, block + 1)
    ).otherwise(F.array(block))
    copies = numbered.withColumn("b", F.explode(homes))
    by = [*keys, "b"]
    rolled = copies.select(*by, *[rolling_mean(c, by, "pos", 8).alias(c) for c in columns])
    return rolled.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def sum_or_null(c: str) -> Column:
    """Sum that a single missing value makes missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def weighted_months(
    df: DataFrame, keys: list[str], columns: list[str], ts: str = "local_time"
) -> DataFrame:
    """Monthly sums of the weighted daytime hours; a missing hour voids its month."""
    ppm = df.filter(is_daytime(ts)).select(
        *keys,
        F.year(ts).alias("Year"),
        F.month(ts).alias("Month"),
        *[w126_weight(ppb_to_ppm(c)).alias(c) for c in columns],
    )
    return ppm.groupBy(*keys, "Year", "Month").agg(*[sum_or_null(c).alias(c) for c in columns])


def max_triple(months: DataFrame, keys: list[str], columns: list[str], strict: bool = True) -> DataFrame:
    """Largest sum of three successive calendar months between March and October.

    ``strict``: a void month inside a complete triple makes the result NULL;
    otherwise such triples are left out.
    """
    wanted = [F.max(F.when(F.col("Month") == m, 1)).alias(f"has_{m}") for m in range(3, 11)]
    for c in columns:
        wanted += [
            F.max(F.when(F.col("Month") == m, F.col(c))).alias(f"{c}_{m}") for m in range(3, 11)
        ]
    wide = months.groupBy(*keys).agg(*wanted)

    def best(c: str) -> Column:
        sums, void = [], F.lit(False)
        for triple in TRIPLES:
            present = reduce(lambda a, b: a & b, [F.col(f"has_{m}").isNotNull() for m in triple])
            total = reduce(lambda a, b: a + b, [F.col(f"{c}_{m}") for m in triple])
            sums.append(total)
            void = void | (present & total.isNull())
        top = F.greatest(*sums)
        return F.when(~void, top) if strict else top

    return wide.select(*keys, *[best(c).alias(c) for c in columns], F.lit("W126").alias("Period"))


def grid_w126(
    local: DataFrame, columns: list[str], year: int, cells: DataFrame | None = None
) -> DataFrame:
    """W126 of every cell for one local year; ``cells`` makes the result dense."""
    keys = ["ROW", "COL"]
    months = weighted_months(local.filter(F.year("local_time") == year), keys, columns)
    result = max_triple(months, keys, columns)
    if cells is None:
        return result
    dense = cells.select("ROW", "COL").withColumn("Period", F.lit("W126"))
    return dense.join(result, ["ROW", "COL", "Period"], "left")


def running_w126(months: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Largest sum over any three months that follow each other in the table."""
    order = ["Year", "Month"]
    slid = months.select(*keys, *[sliding_sum(c, keys, order, 3).alias(c) for c in columns])
    return slid.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns]).withColumn(
        "Period", F.lit("W126")
    )


def complete_months(
    df: DataFrame,
    keys: list[str],
    column: str,
    ts: str,
    threshold: float = 0.75,
    fixed_days: int | None = None,
    only_below_one: bool = False,
) -> DataFrame:
    """Monthly weighted sums scaled up to full months, void below the threshold.

    A month has 12 daytime hours a day; ``fixed_days`` sets its length.
    """
    hours = F.lit(fixed_days) if fixed_days else F.max(days_in_month(ts))
    ratio = F.count(column) / (hours * 12)
    months = (
        df.filter(is_daytime(ts))
        .groupBy(*keys, F.year(ts).alias("Year"), F.month(ts).alias("Month"))
        .agg(F.sum(w126_weight(ppb_to_ppm(column))).alias("s"), ratio.alias("ratio"))
    )
    scale = F.lit(1.0) / F.col("ratio")
    if only_below_one:
        scale = F.when(F.col("ratio") < 1, scale).otherwise(F.lit(1.0))
    value = F.when(F.col("ratio") >= threshold, F.col("s") * scale)
    return months.withColumn(column, value).drop("s", "ratio")


def monitor_w126(df: DataFrame, keys: list[str], column: str, ts: str) -> DataFrame:
    """Monitor W126 with the completeness rule; void months drop their triples."""
    return max_triple(complete_months(df, keys, column, ts), keys, [column], strict=False)


def plain_months(df: DataFrame, keys: list[str], column: str, ts: str) -> DataFrame:
    """Monthly weighted sums of the daytime hours as they are, however few; a month without values sums to 0."""
    months = df.filter(is_daytime(ts)).groupBy(*keys, F.year(ts).alias("Year"), F.month(ts).alias("Month"))
    return months.agg(F.coalesce(F.sum(w126_weight(ppb_to_ppm(column))), F.lit(0.0)).alias(column))


def domain_w126(df: DataFrame, columns: list[str], ts: str, complete: bool = True) -> DataFrame:
    """One W126 per column over the whole domain, 31-day months.

    Without ``complete`` every month that has a daytime row counts as it is, on the
    ground that a gridded hour is rarely missing.
    """
    long = df.select(ts, *columns).unpivot([ts], columns, "name", "v")
    if not complete:
        best = max_triple(plain_months(long, ["name"], "v", ts), ["name"], ["v"], strict=False)
        named = best.select(F.concat(F.lit("W126_"), "name").alias("Period"), F.col("v").alias("Value"))
        return named.filter(F.col("Value").isNotNull())
    long = long.filter(F.col("v").isNotNull())
    months = complete_months(long, ["name"], "v", ts, fixed_days=31, only_below_one=True)
    best = max_triple(months.filter(F.col("v").isNotNull()), ["name"], ["v"], strict=False)
    return best.select(F.concat(F.lit("W126_"), "name").alias("Period"), F.col("v").alias("Value")).filter(
        F.col("Value").isNotNull()
    )


def daily_extremes(df: DataFrame, keys: list[str], ts: str, column: str) -> DataFrame:
    """Daily maximum and minimum with the first hour at which each occurs.

    ``df`` has one row per key and hour.
    """
    high = F.struct(F.col(column).alias("v"), (-F.unix_timestamp(F.col(ts).cast("timestamp"))).alias("t"))
    low = F.struct(F.col(column).alias("v"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t"))
    present = F.col(column).isNotNull()
    return df.groupBy(*keys, F.col(ts).cast("date").alias("Date")).agg(
        F.max(column).alias("max_value"),
        F.hour(F.max_by(F.when(present, F.col(ts)), F.when(present, high))).cast("int").alias("max_hour"),
        F.min(column).alias("min_value"),
        F.hour(F.min_by(F.when(present, F.col(ts)), F.when(present, low))).cast("int").alias("min_hour"),
        F.count("*").alias("hours"),
        (24 - F.count(column)).alias("missing_hours"),
    )
