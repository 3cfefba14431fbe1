"""Joins and set operations between domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.matching import nearest_known
from skyweave.session import cut_lineage, dealt


def with_site_offsets(obs: DataFrame, tz_site: DataFrame, fill: bool = True) -> DataFrame:
    """Offset and region of each observation's site.

    A site's own entry wins.  ``fill`` gives sites without one the values of the
    nearest observed site that has one (distance in degrees): only sites that
    occur in the observations are candidates.
    """
    take = ["gmt_offset", "epa_region"]
    zones = tz_site.select("site_id", *take)
    if not fill:
        return obs.join(zones, "site_id", "left")
    sites = cut_lineage(
        obs.groupBy("site_id").agg(F.min("Lat").alias("Lat"), F.min("Lon").alias("Lon"))
    )
    known = tz_site.filter(F.col("gmt_offset").isNotNull()).join(sites, "site_id", "left_semi")
    missing = sites.join(known, "site_id", "left_anti")
    found = nearest_known(missing, known, "site_id", "site_id", "Lon", "Lat", take)
    resolved = cut_lineage(known.select("site_id", *take).unionByName(found))
    return obs.join(resolved, "site_id", "left")


def nearest_entries(missing: DataFrame, known: DataFrame, take: list[str]) -> DataFrame:
    """Fill ``take`` of rows that lack them from the nearest row that has them."""
    return nearest_known(missing, known, "site_id", "site_id", "Lon", "Lat", take)


def first_station(stations: DataFrame, site: str, columns: list[str], order: str) -> DataFrame:
    """One row per site: the first by ``order``."""
    first = F.min_by(F.struct(*columns), F.col(order)).alias("s")
    return stations.groupBy(site).agg(first).select(site, "s.*")


def fill_from(df: DataFrame, other: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replace missing values of ``column`` by those of a second table."""
    second = other.select(*keys, F.col(column).alias("_o"))
    return (
        df.join(second, keys, "left")
        .withColumn(column, F.coalesce(column, "_o"))
        .drop("_o")
    )


def densify(df: DataFrame, cells: DataFrame, label: str, labels: DataFrame | list) -> DataFrame:
    """Every cell for every label, missing values NULL.

    The distinct labels are laid out beside each cell as one array (a scalar
    subquery), so no pair of tables is crossed and nothing reaches the driver.
    """
    if isinstance(labels, list):
        names = F.array(*[F.lit(n) for n in sorted(labels)])
    else:
        names = labels.agg(F.array_sort(F.collect_set(label)).alias("names")).scalar()
    grid = cells.select("ROW", "COL").withColumn(label, F.explode(names))
    return grid.join(df, ["ROW", "COL", label], "left")


def training_folds(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Each row once for every fold of its key that it may train (all but its own).

    The folds of a key are a set as small as the number of groups; rows are
    copied to the other folds instead of being paired with test rows.
    """
    folds = cut_lineage(df.groupBy(*keys).agg(F.collect_set(group).alias("folds")))
    return (
        df.join(folds, keys)
        .withColumn("fold", F.explode(F.array_remove(F.col("folds"), F.col(group))))
        .drop("folds")
    )


def key_flags(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with Flag 1 in both, 2 only left, 3 only right."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    flag = (
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)
        .when(F.col("_l").isNotNull(), 2)
        .otherwise(3)
    )
    return a.join(b, keys, "full").select(*keys, flag.alias("Flag"))


def one_sided_sites(left: DataFrame, right: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Keys on one side only, Flag 1 left and 2 right, with least attributes."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.lit(1).alias(tag), *[F.min(a).alias(f"{tag}{a}") for a in attributes]
        )

    both = side(left, "_l").join(side(right, "_r"), keys, "full")
    one = both.filter(F.col("_l").isNull() | F.col("_r").isNull())
    return one.select(
        *keys,
        F.when(F.col("_l").isNotNull(), 1).otherwise(2).alias("Flag"),
        *[F.coalesce(f"_l{a}", f"_r{a}").alias(a) for a in attributes],
    )


def two_way_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on one side only, as ``side`` left or right; NULL keys are equal, as in EXCEPT."""
    sided = left.select(*keys, F.lit("left").alias("side")).unionByName(right.select(*keys, F.lit("right").alias("side")))
    met = dealt(sided, keys).groupBy(*keys).agg(F.min("side").alias("side"), F.max("side").alias("_last"))
    return met.filter(F.col("side") == F.col("_last")).drop("_last")


def common_and_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key ``b`` knows, plus the rows of ``b`` that ``a`` lacks."""
    return a.join(b, key, "left_semi").unionByName(b.join(a, key, "left_anti"))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of rows on one side only, and whether the tables agree."""
    x, y = a.select(*keys), b.select(*keys)
    tally = (
        x.withColumn("_n", F.lit(1))
        .unionByName(y.withColumn("_n", F.lit(-1)))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("d"))
    )
    return tally.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_right"),
        (F.count(F.when(F.col("d") != 0, 1)) == 0).alias("equal"),
    )


def site_registry(tables: list[DataFrame], site: str, columns: list[str]) -> DataFrame:
    """One row per site over several tables; the last table that has it wins."""
    tagged = None
    for i, t in enumerate(tables):
        part = t.select(site, *columns).withColumn("_order", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    row = F.struct(*columns)
    return (
        tagged.groupBy(site)
        .agg(F.max_by(row, F.struct("_order", *columns)).alias("r"))
        .select(site, "r.*")
    )


def splice(before: DataFrame, after: DataFrame, ts: str, at) -> DataFrame:
    """Rows of ``before`` up to the moment, rows of ``after`` from it on."""
    return before.filter(F.col(ts) < at).unionByName(after.filter(F.col(ts) >= at))


def append_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def synthetic_rows(df: DataFrame, site: str, keep: list[str], constants: dict[str, object]) -> DataFrame:
    """The table plus one made-up row per site with given constants."""
    per_site = df.groupBy(site).agg(*[F.min(c).alias(c) for c in keep])
    made = per_site.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in constants.items()})
    return df.unionByName(made, allowMissingColumns=True)
