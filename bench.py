"""Headline queries at one scale: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every query
is run to completion (all rows and columns computed, none kept).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a04_percentile_98",
    "a05_top10_mean",
    "a08_period_means",
    "a09_metric_table",
    "a13_mda8_grid",
    "f22_hourly_to_metrics",
    "a17_w126_triples",
    "a19_w126_monitor",
    "a22_site_period_means",
    "a23_site_top10_days",
    "a25_median_slope",
    "a29_score_cube",
    "a30_comparison_table",
    "a38_region_series",
    "a40_pooled_ranges",
    "a52_kernel_density",
    "j03_nearest_offset_fill",
    "j22_containing_polygon",
    "j24_time_zone_of_point",
    "f05_daily_fusion",
    "f06_hourly_fusion",
    "f08_period_fusion",
    "f14_daily_validation",
    "f27_fused_month_sets",
]


def us_grid_fusion(spark, sf_dir):
    """Fusion of four quarters on the whole 12 km grid (299 x 459 cells)."""
    from pyspark.sql import functions as F

    from skyweave.catalog import fixtures as fx
    from skyweave.functions.projection import CONUS_12KM
    from skyweave.plans import fusion as fu
    from skyweave.sources.grids import regular_grid

    quarter = F.quarter("Date").alias("q")
    obs = fx.obs_daily(spark, sf_dir).groupBy("Site", quarter).agg(*[F.avg(c).alias(c) for c in ("Conc", "Lat", "Lon")])
    cell = [(F.col("l_partkey") % 299 + 1).cast("int").alias("ROW"), (F.col("l_suppkey") % 459 + 1).cast("int").alias("COL")]
    values = fx.table(spark, sf_dir, "lineitem").groupBy(*cell).agg(F.avg("l_quantity").alias("v"))
    cells = regular_grid(spark).join(values, ["ROW", "COL"], "left").withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4))))
    model = cells.select("q", "ROW", "COL", (F.coalesce("v", F.lit(25.0)) + F.col("q")).alias("model"))
    grid = fu.Grid(CONUS_12KM, 299, 459)
    return fu.metric_fusion(obs, model, grid, keys=["q"], value="Conc", model_value="model")


def main() -> None:
    from skyweave.catalog import QUERIES
    from skyweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    runs = {name: QUERIES[name] for name in HEADLINE} | {"us_grid_fusion": us_grid_fusion}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("/sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
