"""The package reaches the Python workers without any path set for them."""

import os
import subprocess
import sys
import textwrap


def test_interpolation_from_another_directory(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(
        f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "4").getOrCreate()
        import __spark_entry__ as entry
        print("ROWS", entry.queries()["f01_voronoi_average"](spark, "/root/testdata/sf0.001").count())
        """
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("ROWS")[1]) > 0
