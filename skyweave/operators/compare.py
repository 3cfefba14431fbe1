"""Method comparison: spread, regression, error and distribution statistics."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.ozone import exposure_bin, row_spread
from skyweave.operators.quantiles import exact_percentiles
from skyweave.operators.shelves import running, shelved
from skyweave.session import cut_lineage

#: Steps of a lattice line that are smoothed at once.
LINE_BLOCK = 512


def method_spread(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean row-wise SD and CV% across the methods, per key."""
    sd, mean = row_spread(columns)
    stats = df.select(*keys, sd.alias("sd"), mean.alias("mean")).groupBy(*keys).agg(
        F.avg("sd").alias("SD"), F.avg("mean").alias("Mean")
    )
    return stats.select(
        *keys, "SD", F.when(F.col("Mean") != 0, F.col("SD") / F.col("Mean") * 100).alias("CV")
    )


def regression(x: str, y: str) -> list[Column]:
    """Slope, intercept and squared correlation of y on x."""
    return [
        F.regr_slope(y, x).alias("Slope"),
        F.regr_intercept(y, x).alias("Intercept"),
        F.regr_r2(y, x).alias("R_squared"),
    ]


def errors(x: str, y: str) -> list[Column]:
    """Root mean square, mean and mean absolute difference of y from x."""
    diff = F.col(y) - F.col(x)
    return [
        F.sqrt(F.avg(diff * diff)).alias("RMSE"),
        F.avg(diff).alias("MB"),
        F.avg(F.abs(diff)).alias("MAE"),
    ]


def r2_score(truth: str, predicted: str) -> Column:
    """Coefficient of determination, 1 - SSE / SST."""
    diff = F.col(truth) - F.col(predicted)
    spread = F.var_pop(truth) * F.count(truth)
    return F.when(spread > 0, 1 - F.sum(diff * diff) / spread)


def paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def fit_statistics(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return paired(df, x, y).groupBy(*keys).agg(
        F.count("*").alias("n"), *regression(x, y), *errors(x, y)
    )


def score_cube(df: DataFrame, truth: str, predicted: str, time: str = "Timestamp", fold: str = "Fold") -> DataFrame:
    """Scores per (time, fold), per time, per fold and overall, each from its own rows.

    The rows are summed once per (time, fold); the cube then only repeats those
    sums, and every level's scores follow from its totals.  The spread of the
    truth is carried as count, mean and sum of squares around the mean, which
    merge without cancellation: around the level's own mean, the squares are
    those within the parts plus those of the parts' means.
    """
    y, d = F.col(truth), F.col(predicted) - F.col(truth)
    sums = paired(df, truth, predicted).groupBy(
        F.col(time).cast("string").alias(time), F.col(fold).cast("string").alias(fold)
    ).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count("*")).alias("within"),
        F.sum(d).alias("d"),
        F.sum(d * d).alias("dd"),
        F.sum(F.abs(d)).alias("ad"),
    )
    label = lambda c: F.when(F.grouping(c) == 1, F.lit("Mean")).otherwise(F.col(c))
    # Means are taken from a value of the column, so that their squares stay small.
    anchor = one_value(sums.agg(F.min("mean").alias("anchor")), "anchor")
    shift = F.col("mean") - F.col("anchor")
    totals = sums.withColumn("anchor", anchor).cube(time, fold).agg(
        label(time).alias("t"),
        label(fold).alias("f"),
        F.sum("within").alias("within"),
        F.sum(F.col("n") * shift).alias("s"),
        F.sum(F.col("n") * shift * shift).alias("ss"),
        *[F.sum(c).alias(c) for c in ("n", "d", "dd", "ad")],
    )
    between = F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    spread = F.col("within") + between
    return totals.select(
        F.col("t").alias(time),
        F.col("f").alias(fold),
        "n",
        F.when(spread > 0, 1 - F.col("dd") / spread).alias("R2"),
        F.sqrt(F.col("dd") / F.col("n")).alias("RMSE"),
        (F.col("d") / F.col("n")).alias("MB"),
        (F.col("ad") / F.col("n")).alias("MAE"),
    )


def method_pairs(columns: list[str]) -> Column:
    """Every pair of methods of a row as (pair, x, y)."""
    return F.array(
        *[
            F.struct(
                F.lit(f"{a} vs {b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")
            )
            for a, b in combinations(columns, 2)
        ]
    )


def comparison_table(df: DataFrame, columns: list[str], period: str = "Period") -> DataFrame:
    """Statistics of all method pairs per period, rounded to two places.

    All pairs are accumulated side by side in one aggregation, so the rows are
    never multiplied by the number of pairs; only the result is made long.
    """
    pairs = list(combinations(columns, 2))
    measures = []
    for i, (a, b) in enumerate(pairs):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
        diff = y - x
        measures.append(
            F.struct(
                F.lit(f"{a} vs {b}").alias("pair"),
                F.round(F.regr_r2(y, x), 2).alias("R_squared"),
                F.round(F.sqrt(F.avg(diff * diff)), 2).alias("RMSE"),
                F.round(F.avg(diff), 2).alias("MB"),
                F.round(F.regr_slope(y, x), 2).alias("Slope"),
                F.count(diff).alias("n"),
            ).alias(f"p{i}")
        )
    wide = df.groupBy(period).agg(*measures)
    long = wide.select(period, F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("s"))
    return long.filter(F.col("s.n") > 0).select(
        F.col("s.pair").alias("Variable_Pair"), period, "s.R_squared", "s.RMSE", "s.MB", "s.Slope"
    )


def pair_differences(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Difference grid y - x of every method pair."""
    return df.select(*keys, F.explode(method_pairs(columns)).alias("p")).select(
        *keys, "p.pair", (F.col("p.y") - F.col("p.x")).alias("diff")
    )


def year_over_base(
    base: DataFrame, current: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """Current minus base on equal keys; ``matched`` tells keys found on one side only."""
    left = base.select(*keys, F.lit(1).alias("in_base"), *[F.col(c).alias(f"b_{c}") for c in columns])
    right = current.select(*keys, F.lit(1).alias("in_current"), *columns)
    both = left.join(right, keys, "full")
    return both.select(
        *keys,
        *[(F.col(c) - F.col(f"b_{c}")).alias(c) for c in columns],
        (F.col("in_base").isNotNull() & F.col("in_current").isNotNull()).alias("matched"),
    )


def unmatched_keys(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys that keep two tables from being subtracted."""
    both = year_over_base(base, current, keys, [])
    return both.agg(
        F.count("*").alias("keys"), F.count(F.when(~F.col("matched"), 1)).alias("unmatched")
    )


def base_and_delta(
    base: DataFrame,
    delta: DataFrame,
    keys: list[str],
    columns: list[str],
    periods: list[str] | None = None,
    drop: tuple[str, ...] = ("W126",),
) -> DataFrame:
    """Base-year and delta columns side by side, keeping keys of either table.

    ``periods`` selects some periods; those in ``drop`` are left out.
    """
    left = base.select(*keys, *[F.col(c).alias(f"{c}_base") for c in columns])
    right = delta.select(*keys, *[F.col(c).alias(f"{c}_delta") for c in columns])
    both = left.join(right, keys, "full").filter(~F.col("Period").isin(*drop)) if drop else left.join(right, keys, "full")
    return both.filter(F.col("Period").isin(*periods)) if periods else both


def binned_deltas(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows (bin of the base value, delta, method) for every method."""
    triples = F.array(
        *[
            F.struct(
                exposure_bin(f"{c}_base").alias("bin"),
                F.col(f"{c}_delta").alias("delta"),
                F.lit(c).alias("method"),
            )
            for c in columns
        ]
    )
    return (
        df.select(*keys, F.explode(triples).alias("t"))
        .select(*keys, "t.*")
        .filter(F.col("bin").isNotNull() & F.col("delta").isNotNull())
    )


def box_statistics(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and the outlier count."""
    box = exact_percentiles(
        long, keys, {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)}
    )
    fence = (F.col("q3") - F.col("q1")) * 1.5
    box = cut_lineage(box)
    inside = F.col(value).between(F.col("q1") - fence, F.col("q3") + fence)
    return long.join(box, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def one_value(totals: DataFrame, name: str) -> Column:
    """A column of a one-row table as a scalar subquery (evaluated once, no join)."""
    return totals.select(name).scalar()


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """Distinct values, their row count and the first and last step of the curve.

    Rows are counted per value first; the running total is taken shelf by shelf
    (ranges with about as many values each), so no task orders the column.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    upto = running(shelved(counts, [], [value]), [], [value], "c", "upto")
    return upto.select(
        value,
        F.col("c").alias("n"),
        ((F.col("upto") - F.col("c") + 1) / F.col("_total")).alias("cdf_first"),
        (F.col("upto") / F.col("_total")).alias("cdf_last"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, mean, SD, extremes and quartiles of each column."""
    long = df.unpivot([], columns, "column", "v")
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_percentiles(
        long, ["column"], {"q25": ("v", 0.25), "q50": ("v", 0.5), "q75": ("v", 0.75)}
    )
    return basic.join(quartiles, "column")


def describe_both(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of two tables side by side, with the distinct values each has and both share.

    Every value is counted once with the sides it stands on (partial sums before one
    exchange by column and value); all but the quartiles comes from those counts.
    """
    sides = [t.unpivot([], columns, "column", "v").select("column", F.col("v").cast("double").alias("v"), F.lit(s).alias("side")) for s, t in enumerate((a, b), 1)]
    long = sides[0].unionAll(sides[1])
    on = lambda s: F.count(F.when(F.col("side") == s, 1))
    values = long.groupBy("column", "v").agg(on(1).alias("n1"), on(2).alias("n2"))
    valued, out = F.col("v").isNotNull(), []
    for s in (1, 2):
        n, here = F.col(f"n{s}"), valued & (F.col(f"n{s}") > 0)
        v = F.when(here, F.col("v"))
        total = F.sum(F.when(here, n)).cast("double")
        mean = F.sum(v * n) / total
        out += [
            F.coalesce(F.sum(F.when(here, n)), F.lit(0)).alias(f"count{s}"),
            F.coalesce(F.sum(F.when(~valued, n)), F.lit(0)).alias(f"nulls{s}"),
            mean.alias(f"mean{s}"),
            F.sum(v * v * n).alias(f"_q{s}"),
            F.min(v).alias(f"min{s}"),
            F.max(v).alias(f"max{s}"),
            F.count(v).alias(f"distinct{s}"),
        ]
    both = F.count(F.when(valued & (F.col("n1") > 0) & (F.col("n2") > 0), 1)).alias("common_distinct")
    basic = values.groupBy("column").agg(*out, both)
    for s in (1, 2):
        n, mean = F.col(f"count{s}"), F.col(f"mean{s}")
        square = F.greatest(F.col(f"_q{s}") - n * mean * mean, F.lit(0.0))
        basic = basic.withColumn(f"std{s}", F.when(n > 1, F.sqrt(square / (n - 1)))).drop(f"_q{s}")
    wanted = {"q25": ("v", 0.25), "q50": ("v", 0.5), "q75": ("v", 0.75)}
    quartiles = exact_percentiles(long, ["column", "side"], wanted)
    spread = quartiles.groupBy("column").agg(
        *[F.max(F.when(F.col("side") == s, F.col(q))).alias(f"{q}_{s}") for s in (1, 2) for q in wanted]
    )
    return basic.join(spread, "column")


def smoothed_lines(nodes: DataFrame, line: str, along: str, weight: str, kernel: np.ndarray) -> DataFrame:
    """``line, along, weight`` after each line of a lattice is convolved with ``kernel`` (odd, symmetric).

    Lines are cut into blocks of ``LINE_BLOCK`` steps with a halo of the kernel's
    reach: a node goes to its own block and to those it reaches into, and a block is
    one convolution.  A block holds at most its length and two halos.
    """
    reach = len(kernel) // 2
    at = F.col(along)
    touched = F.sequence(F.floor((at - reach) / LINE_BLOCK), F.floor((at + reach) / LINE_BLOCK))
    blocks = (
        nodes.select(F.col(line).alias("line"), at.alias("at"), F.col(weight).alias("w"), F.explode(touched).alias("b"))
        .groupBy("line", "b")
        .agg(F.collect_list(F.struct("at", "w")).alias("n"))
        .select("line", "b", F.col("n.at").alias("at"), F.col("n.w").alias("w"))
    )

    def run(batches):
        for batch in batches:
            edges = np.r_[0, np.cumsum(np.asarray(batch.column("at").value_lengths()))]
            place, w = (np.asarray(batch.column(c).flatten()) for c in ("at", "w"))
            lines, numbers = (np.asarray(batch.column(c)) for c in ("line", "b"))
            found = []
            for i in range(batch.num_rows):
                start = numbers[i] * LINE_BLOCK
                dense = np.zeros(LINE_BLOCK + 2 * reach)
                np.add.at(dense, place[edges[i] : edges[i + 1]] - start + reach, w[edges[i] : edges[i + 1]])
                out = np.convolve(dense, kernel, "valid")
                hit = np.flatnonzero(out)
                found.append((np.full(len(hit), lines[i]), hit + start, out[hit]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=[line, along, weight])

    return blocks.mapInArrow(run, f"{line} bigint, {along} bigint, {weight} double")


def kernel_density(df: DataFrame, x: str, y: str, per_band: int = 4) -> DataFrame:
    """Gaussian kernel density of the (x, y) cloud, scaled to 0-1.

    The bandwidth matrix is the sample covariance times n**(-1/3).  In whitened
    coordinates the kernel is a product of two one-dimensional ones, so the
    points are counted on a lattice with ``per_band`` steps per bandwidth and
    smoothed along one axis after the other.  Work grows with the points once
    and otherwise with the lattice only; no pair of points is ever formed.  A
    point moves by at most half a step, so a single kernel changes by less than
    ``0.31 / per_band`` of its peak per axis; over many points the shifts cancel
    and the error falls with the square of the step.
    """
    pairs = paired(df, x, y).select(x, y)
    moments = cut_lineage(
        pairs.agg(
            F.count("*").alias("n"),
            F.avg(x).alias("mx"),
            F.avg(y).alias("my"),
            F.var_samp(x).alias("sxx"),
            F.covar_samp(x, y).alias("sxy"),
            F.var_samp(y).alias("syy"),
        )
    )
    n, mx, my, sxx, sxy, syy = (one_value(moments, c) for c in moments.columns)
    per_unit = F.pow(n.cast("double"), F.lit(1.0 / 6.0)) * per_band
    dx, dy = F.col(x) - mx, F.col(y) - my
    lattice = (
        pairs.groupBy(x, y)
        .agg(F.count("*").alias("c"))
        .withColumns(
            {
                "iu": F.round(dx / F.sqrt(sxx) * per_unit).cast("bigint"),
                "iv": F.round((dy - sxy / sxx * dx) / F.sqrt(syy - sxy * sxy / sxx) * per_unit).cast("bigint"),
            }
        )
    )
    steps = np.arange(-9 * per_band, 9 * per_band + 1) / per_band
    kernel = np.exp(-(steps**2) / 2)
    nodes = cut_lineage(lattice.groupBy("iu", "iv").agg(F.sum("c").cast("double").alias("w")))
    one_way = smoothed_lines(nodes, "iv", "iu", "w", kernel)
    both_ways = smoothed_lines(one_way, "iu", "iv", "w", kernel).withColumnRenamed("w", "density")
    at_nodes = nodes.join(both_ways, ["iu", "iv"]).select("iu", "iv", "density")
    at_nodes = cut_lineage(at_nodes)
    bounds = at_nodes.agg(F.min("density").alias("lo"), F.max("density").alias("hi"))
    lo, hi = one_value(bounds, "lo"), one_value(bounds, "hi")
    scaled = F.when(hi > lo, (F.col("density") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return lattice.join(at_nodes, ["iu", "iv"]).select(x, y, scaled.alias("density"))
