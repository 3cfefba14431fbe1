"""Line numbers over splits, blocks over splits, and windows over shelves."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators.shelves import running_blocks, step_to_next
from skyweave.sources.boundaries import read_zone_lines
from skyweave.sources.lines import numbered_lines
from skyweave.sources.tables import read_csv_after

SPLITS = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield
    for k in SPLITS:
        spark.conf.unset(k)


def test_one_file_over_several_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    texts = {"a.csv": 900, "b.csv": 3, "c.csv": 250}
    want = {}
    for name, count in texts.items():
        want[name] = [f"{i},{'x' * rng.randrange(40)}" if i % 7 else "" for i in range(count)]
        (tmp_path / name).write_bytes("".join(line + ("\r\n" if name == "c.csv" else "\n") for line in want[name]).encode())
    rows = numbered_lines(spark, str(tmp_path)).collect()
    assert len({(r.file, r.split) for r in rows if r.file.endswith("a.csv")}) > 5
    for name, lines in want.items():
        own = sorted((r.line_no, r.value) for r in rows if r.file.endswith(name))
        assert own == list(enumerate(lines))
    body = read_csv_after(spark, str(tmp_path), "i INT, t STRING", 5)
    assert sorted(r.i for r in body.collect()) == sorted(i for n in texts.values() for i in range(5, n) if i % 7)


def test_zone_blocks_over_several_splits(spark, tmp_path, small_splits):
    lines, want = [], []
    for zone in range(40):
        lines.append(f"{zone % 9 + 3},{zone - 8}, Zone {zone} ")
        for pos in range(zone % 9 + 3):
            want.append((zone, f"Zone {zone}", float(zone - 8), pos, float(-100 + pos), 30.5 + zone))
            lines += [f"{-100 + pos},{30.5 + zone}"] + [""] * (pos % 3 == 0)
    (tmp_path / "zones.csv").write_text("\n".join(lines))
    got = read_zone_lines(spark, str(tmp_path / "zones.csv"))
    assert got.rdd.getNumPartitions() >= 1 and sorted(map(tuple, got.collect())) == sorted(want)


def test_a_dominating_group_spans_shelves(spark):
    """One site with nearly all rows: blocks and steps cross the borders of the shelves."""
    rng = random.Random(2)
    rows = [("hot", i, rng.choice([None, *range(60)])) for i in range(4000)] + [("b", i, i) for i in range(5)] + [(None, i, 40 - i) for i in range(3)]
    df = spark.createDataFrame(rows, "site string, t int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    blocks = {(r.site, r.t): r.block for r in running_blocks(df, ["site"], ["t"], F.col("v") >= 30).collect()}
    steps = {(r.site, r.t): r.step for r in step_to_next(df, ["site"], ["t"], "v").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(blocks) == len(steps) == len(rows)
    count = {}
    for i, (site, t, v) in enumerate(rows):
        count[site] = count.get(site, 0) + (v is not None and v >= 30)
        assert blocks[site, t] == count[site]
        after = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == site else None
        assert steps[site, t] == (None if after is None or v is None or after[2] is None else v - after[2])
