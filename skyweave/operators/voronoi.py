"""Voronoi neighbour averaging (VNA) of monitors onto grid cells.

A monitor among the k nearest of a target is a neighbour when its Voronoi cell
touches the target's own.  Neighbours weigh ``d**-power``; a monitor at the
target itself takes all the weight.  Spark finds the candidates (tile joins)
and moves them once, grouped by block of cells; inside a task each block is a
handful of small arrays.

A block gathers its cells and the monitors that can be among the k nearest of
one of them: those within the k-th distance from its centre plus its diagonal.
Their number follows the local density, not the size of the network.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions.ozone import nan_to_null
from skyweave.operators.matching import add_blocks
from skyweave.session import cut_lineage

#: Length of a shared cell edge (relative to the offset scale) that counts as contact.
EDGE_TOLERANCE = 1e-9
#: Side of a block of cells is 2**BLOCK cells.
BLOCK = 3
#: Monitors of a key, in multiples of k, up to which a block takes all of them without a search.
FEW = 16
#: Tiles along the longer side of a crowded key's network, and blocks held against them at a time.
SIDE, PLACED = 128, 64
#: Weights of blocks that a task remembers, least recently used first to go.
REMEMBERED = 256


def neighbour_weights(dx: np.ndarray, dy: np.ndarray, power: float) -> np.ndarray:
    """Weights of n x k candidates given as offsets from their target."""
    d2 = dx * dx + dy * dy
    half_cross = (dx[:, :, None] * dx[:, None, :] + dy[:, :, None] * dy[:, None, :]) / 2
    along = dx[:, :, None] * dy[:, None, :] - dy[:, :, None] * dx[:, None, :]
    room = d2[:, None, :] / 2 - half_cross
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = room / along
        upper = np.where(along > 0, bound, np.inf).min(axis=2)
        lower = np.where(along < 0, bound, -np.inf).max(axis=2)
        touches = (upper - lower > EDGE_TOLERANCE) & ~((along == 0) & (room < 0)).any(axis=2)
        weight = np.where(touches, d2 ** (-power / 2), 0.0)
    at_target = d2 == 0
    weight = np.where(at_target.any(axis=1)[:, None], at_target.astype(float), weight)
    total = weight.sum(axis=1, keepdims=True)
    return np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)


def block_weights(tx, ty, cx, cy, k: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest candidates of each target and their weights; candidates come in id order."""
    dx, dy = cx[None, :] - tx[:, None], cy[None, :] - ty[:, None]
    d2 = dx * dx + dy * dy
    if d2.shape[1] > k:
        pick = np.argsort(d2, axis=1, kind="stable")[:, :k]
        dx, dy = np.take_along_axis(dx, pick, 1), np.take_along_axis(dy, pick, 1)
    else:
        pick = np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
    return pick, neighbour_weights(dx, dy, power)


def weighted_means(pick: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Averages (targets x measures); a target without neighbours has none."""
    weight = weight[:, :, None]
    parts = np.where(weight > 0, weight * values[pick], 0.0)
    return np.where(weight.sum(axis=1) > 0, parts.sum(axis=1), np.nan)


def average_block(tx, ty, cx, cy, values, k: int, power: float) -> np.ndarray:
    """Averages of one block."""
    return weighted_means(*block_weights(tx, ty, cx, cy, k, power), values)


def voronoi_average(
    monitors: DataFrame,
    targets: DataFrame,
    keys: list[str],
    measures: list[str],
    carry: list[str] | None = None,
    where: str | None = None,
    site: str = "Site",
    k: int = 30,
    power: float = 2.0,
    fold: str | None = None,
) -> DataFrame:
    """Interpolate ``measures`` of the monitors at the targets of the same key.

    ``monitors``: one row per ``keys, site`` with plane coordinates ``x, y``.
    ``targets``: distinct cells ``keys, ROW, COL`` with any ``carry`` columns.
    Adds ``vna_<measure>``; a NULL measure of a neighbour makes the average
    NULL.  Targets whose key has no monitor give no row; targets whose flag
    ``where`` is false stay NULL.

    ``fold`` names a column of both sides: a target of fold g is served by the
    monitors of the other folds, NULL if there are none.  Monitors are not copied
    to folds unless their key is crowded.

    The monitors of a key with few of them are laid side by side once per key and
    every block takes all; keys with many search candidates per block.  Blocks with
    the same cells and monitors share their weights; where site sets recur over the
    keys, such blocks are brought together, so weights are found once per set.
    """
    carry = carry or []
    names = [f"vna_{m}" for m in measures]
    none = F.lit(None).cast("int")
    bare = monitors.select(
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)],
        F.col(site).alias("site"),
        "x",
        "y",
        (F.col(fold).cast("int") if fold else none).alias("g"),
        *[F.coalesce(F.col(m), F.lit(float("nan"))).alias(f"m_{m}") for m in measures],
    )
    wanted = F.coalesce(F.col(where), F.lit(False)) if where else F.lit(True)
    cells = targets.select(
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)],
        "ROW",
        "COL",
        wanted.alias("_in"),
        (F.col(fold).cast("int") if fold else none).alias("_g"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    by = [f"_k{i}" for i in range(len(keys))]
    # Counts and fingerprints of the site sets, summed before they move.
    where_is = F.xxhash64("site", "x", "y")
    sets = cut_lineage(
        bare.groupBy(*by).agg(
            F.count("*").alias("_n"),
            F.sum(F.shiftright(where_is, 20)).alias("_set"),
            F.bit_xor(where_is).alias("_xor"),
            *[f(F.when(F.abs(c) < 1e300, F.col(c))).alias(f"_{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))],
        )
    )
    limit = FEW * k
    sizes = sets.agg(F.max("_n").alias("most"), F.min("_n").alias("least"), F.count("*").alias("keys")).first()
    recur = sets.select("_n", "_set", "_xor").distinct().count() * 2 <= (sizes["keys"] or 0)
    columns = ["ROW", "COL", "_in", "_g", *[f"_c{i}" for i in range(len(carry))]]
    payload = ["x", "y", "g", *[f"m_{m}" for m in measures]]
    placed = add_blocks(cells, F.col("COL") - 0.5, F.col("ROW") - 0.5, BLOCK)
    works = []
    if sizes.least is None or sizes.least <= limit:
        few = sets.filter(F.col("_n") <= limit).select(*by)
        mine = bare if sizes.most is None or sizes.most <= limit else bare.join(few, by, "left_semi")
        near = mine.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("site", *payload))).alias("c"))
        blocks = placed.groupBy(*by, "bx", "by").agg(F.collect_list(F.struct(*columns)).alias("cells"))
        works.append(blocks.join(near, by))
    if sizes.most is not None and sizes.most > limit:
        works.append(_crowded(bare, cells, sets.filter(F.col("_n") > limit), by, columns, payload, k, bool(fold)))
    work = works[0] if len(works) == 1 else works[0].unionByName(works[1])
    work = work.select(*by, "bx", "by", "cells", *[F.col(f"c.{p}").alias(f"c_{p}") for p in payload])
    if recur:
        same = F.xxhash64("bx", "by", "c_x", "c_y")
        work = work.withColumn("_same", same).repartition("_same").sortWithinPartitions("_same").drop("_same")
    cell_type = work.schema["cells"].dataType.elementType
    out = ["ROW", "COL", *[f"_c{i}" for i in range(len(carry))]]
    schema = T.StructType(
        [work.schema[b] for b in by]
        + [T.StructField(c, cell_type[c].dataType) for c in out]
        + ([T.StructField("_g", T.IntegerType())] if fold else [])
        + [T.StructField(f"_v{i}", T.DoubleType()) for i in range(len(names))]
    )
    results = work.mapInArrow(_averages(by, out + (["_g"] if fold else []), payload, len(names), k, power), schema)
    return results.select(
        *[F.col(b).alias(key) for b, key in zip(by, keys)],
        *([F.col("_g").alias(fold)] if fold else []),
        "ROW",
        "COL",
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        *[nan_to_null(F.col(f"_v{i}")).alias(n) for i, n in enumerate(names)],
    )


def _crowded(
    bare: DataFrame, cells: DataFrame, sets: DataFrame, by: list[str], columns: list[str], payload: list[str], k: int, folded: bool
) -> DataFrame:
    """``by, bx, by, cells, c`` of keys with many monitors: the candidates of each block.

    A key's monitors are counted on tiles about as wide as the k-th neighbour is far,
    ``SIDE`` tiles a side at most; the counts prove how far each block has to look.
    Dense keys have blocks of one cell, whose candidates are the k nearest of its centre.

    With folds, candidates are the k nearest of each fold: who is among the k nearest
    of all folds but one is so in its own.  So monitors are not copied to folds.
    """
    wide, high = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    longest = F.coalesce(F.greatest(wide, high, F.lit(1e-6)), F.lit(1.0))
    area = F.coalesce(F.greatest(wide * high, longest * longest / SIDE), F.lit(1.0))
    radius = F.sqrt(area * k / (F.col("_n") * 3.1416))
    finest = F.ceil(F.log2(longest / SIDE))
    shape = cut_lineage(
        sets.select(
            *by,
            F.greatest(F.ceil(F.log2(radius)), finest).cast("int").alias("_t"),
            F.least(F.greatest(F.floor(F.log2(radius)), F.lit(0)), F.lit(BLOCK)).cast("int").alias("_b"),
        )
    )
    power = lambda c: F.pow(F.lit(2.0), F.col(c))
    tiled = bare.filter((F.abs("x") < 1e300) & (F.abs("y") < 1e300)).join(shape.select(*by, "_t"), by)
    tiled = tiled.withColumns({"tx": F.floor(F.col("x") / power("_t")), "ty": F.floor(F.col("y") / power("_t"))}).drop("_t")
    # Of each tile only the fewest that any fold finds there are counted on.
    counts = tiled.groupBy(*by, "tx", "ty", "g").agg(F.count("*").alias("n"))
    sure = F.sum("n") - F.max("n") if folded else F.sum("n")
    tiles = counts.groupBy(*by, "tx", "ty").agg(sure.alias("n")).groupBy(*by).agg(F.collect_list(F.struct("tx", "ty", "n")).alias("tiles"))
    placed = cells.join(shape, by)
    placed = placed.withColumns(
        {"bx": F.floor((F.col("COL") - 0.5) / power("_b")), "by": F.floor((F.col("ROW") - 0.5) / power("_b"))}
    )
    asked = placed.groupBy(*by, "_t", "_b").agg(F.collect_set(F.struct("bx", "by")).alias("blocks")).join(tiles, by)
    group = [*by, "bx", "by"]
    kinds = {"bx": "bigint", "by": "bigint", "tx": "bigint", "ty": "bigint", "cx": "double", "cy": "double", "reach": "double", "slack": "double"}
    schema = T.StructType([asked.schema[b] for b in by] + [T.StructField(n, T.LongType() if t == "bigint" else T.DoubleType()) for n, t in kinds.items()])
    needed = asked.mapInArrow(_tiles_in_reach(by, k), schema)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    pairs = needed.join(tiled, [*by, "tx", "ty"]).withColumn("_far", F.sqrt(dx * dx + dy * dy)).filter("_far <= reach")
    ranked = Window.partitionBy(*group, "g").orderBy("_far")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.nth_value("_far", k).over(whole)
    near = (
        pairs.withColumn("_kth", kth)
        .filter(F.col("_kth").isNull() | (F.col("_far") <= F.col("_kth") * (1 + 1e-9) + F.col("slack")))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("site", *payload))).alias("c"))
    )
    blocks = placed.groupBy(*group).agg(F.collect_list(F.struct(*columns)).alias("cells"))
    return blocks.join(near, group, "left").select(*group, "cells", "c")


def _tiles_in_reach(by: list[str], k: int):
    """A key with its blocks and counted tiles in, out every tile a block needs and how far the block looks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                size, side = (2.0 ** row.column(c)[0].as_py() for c in ("_t", "_b"))
                part = lambda name: [np.asarray(f) for f in row.column(name).flatten().flatten()]  # noqa: B023, E731
                (bx, by_), (tx, ty, n) = part("blocks"), part("tiles")
                slack = 0.0 if side == 1 else side * 1.4142136 * (1 + 1e-9)
                for at in range(0, len(bx), PLACED):
                    x, y = bx[at : at + PLACED], by_[at : at + PLACED]
                    cx, cy = (x + 0.5) * side, (y + 0.5) * side
                    lows, highs = [], []
                    for c, t in ((cx, tx), (cy, ty)):
                        before, behind = t * size - c[:, None], c[:, None] - (t + 1) * size
                        lows.append(np.maximum(np.maximum(before, behind), 0))
                        highs.append(np.maximum(np.abs(before), np.abs(behind)))
                    low, high = np.hypot(*lows), np.hypot(*highs)
                    order = np.argsort(high, axis=1)
                    enough = np.cumsum(n[order], axis=1) >= k
                    last = np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1)
                    proof = np.take_along_axis(high, last, 1)[:, 0]
                    reach = np.where(enough[:, -1], proof, np.inf) * (1 + 1e-9) + slack
                    b, t = np.nonzero(low <= reach[:, None] * (1 + 1e-9))
                    arrays = [row.column(c).take(pa.array(np.zeros(len(b), np.int64))) for c in by]
                    arrays += [pa.array(a) for a in (x[b], y[b], tx[t], ty[t], cx[b], cy[b], reach[b], np.full(len(b), slack))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*by, "bx", "by", "tx", "ty", "cx", "cy", "reach", "slack"])

    return run


def _averages(by: list[str], out: list[str], payload: list[str], n_values: int, k: int, power: float):
    """Blocks in, one row per cell out, as flat buffers."""

    def run(batches):
        known: OrderedDict[tuple, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def weights(*place):
            key = tuple(p.tobytes() for p in place)
            if key in known:
                known.move_to_end(key)
                return known[key]
            if len(known) >= REMEMBERED:
                known.popitem(last=False)
            known[key] = block_weights(*place, k, power)
            return known[key]

        for batch in batches:
            cells = batch.column("cells")
            sizes = np.asarray(cells.value_lengths())
            bounds = np.r_[0, np.cumsum(sizes)]
            flat = cells.flatten()
            part = {c: flat.field(flat.type.get_field_index(c)) for c in {*out, "_in", "_g"}}
            tx, ty = (np.asarray(part[c], dtype=float) - 0.5 for c in ("COL", "ROW"))
            inside = np.asarray(part["_in"], dtype=bool)
            fold = part["_g"].fill_null(-1).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.cumsum(np.asarray(batch.column(f"c_{payload[0]}").value_lengths().fill_null(0)))]
            flats = {p: batch.column(f"c_{p}").flatten() for p in payload}
            cx, cy, *values = (np.asarray(flats[p], dtype=float) for p in payload if p != "g")
            group = flats["g"].fill_null(-2).to_numpy(zero_copy_only=False)
            table = np.column_stack(values)
            done = np.full((len(flat), n_values), np.nan)
            for i in range(batch.num_rows):
                a, b = edges[i], edges[i + 1]
                at = bounds[i] + np.flatnonzero(inside[bounds[i] : bounds[i + 1]])
                if not len(at) or a == b:
                    continue
                for g in np.unique(fold[at]):
                    mine = at[fold[at] == g]
                    sites = a + np.flatnonzero(group[a:b] != g)
                    if len(sites):
                        done[mine] = weighted_means(*weights(tx[mine], ty[mine], cx[sites], cy[sites]), table[sites])
            owner = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            arrays = [batch.column(b).take(owner) for b in by]
            arrays += [part[c] for c in out] + [pa.array(done[:, j]) for j in range(n_values)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*by, *out, *[f"_v{j}" for j in range(n_values)]])

    return run
