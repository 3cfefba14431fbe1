"""Spatial matching: nearest cell, neighbour candidates, nearest site.

Candidates come from two trees of square tiles that are walked down together, one
of the points and one of the sites.  A round holds pairs of a block of points and
a tile of sites; the next one halves the sides of both, several times while the
pairs are few.  The first tiles of a
block that hold k sites bound it: a tile whose every place is farther from each
corner of the block than all of these sites has k nearer sites at every point of
the block, since the difference of two squared distances is linear in the point.
Such tiles are dropped, and a block with few sites left is done.  So the depth
follows the local density, and a block beyond the sites' range keeps a few tiles
of their edge.  Everything is an equi-join on tile numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.projection import LambertConic, nearest_index
from skyweave.session import cut_lineage

#: Tiles along the longer side of all points and sites in the first round, and the last round there can be.
SIDE, ROUNDS = 8, 48
#: A round halves the sides more than once, ``LEAP`` times at most, while it cannot make more than ``FREE`` pairs.
LEAP, FREE = 12, 100_000
#: Blocks that are done go on with the others while their pairs are fewer than one in ``SPARSE``.
SPARSE = 50
#: A block is done with ``FEW + 4 * k`` sites left, or when its points times its sites are ``WORTH`` times its tiles.
FEW, WORTH = 12, 16


def locate_sites(
    sites: DataFrame, grid: LambertConic, rows: int, cols: int, lon: str = "Lon", lat: str = "Lat"
) -> DataFrame:
    """Add plane coordinates x, y and the nearest cell ROW, COL."""
    placed = sites.withColumns(
        {"x": grid.x(F.col(lon), F.col(lat)), "y": grid.y(F.col(lon), F.col(lat))}
    )
    return placed.withColumns(
        {"ROW": nearest_index(F.col("y"), rows), "COL": nearest_index(F.col("x"), cols)}
    )


def model_at_sites(sites: DataFrame, model: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Attach the model value of each site's cell as ``mod`` (NULL without one).

    The model table is reduced by a semi join first: the site cells are the
    small side, so the large table is streamed past them and not shuffled.
    """
    on = [*keys, "ROW", "COL"]
    cells = sites.select(on).distinct()
    hit = model.select(*on, F.col(value).alias("mod")).join(cells, on, "left_semi")
    return sites.join(hit, on, "left")


def tile(coordinate: Column, level: int) -> Column:
    return F.floor(coordinate / F.lit(float(2.0**level)))


def add_blocks(points: DataFrame, x: Column, y: Column, finest: int) -> DataFrame:
    """Number of the finest tile each point lies in, as bx, by."""
    return points.withColumns({"bx": tile(x, finest), "by": tile(y, finest)})


def _finite(df: DataFrame) -> DataFrame:
    """Rows with a place, as doubles."""
    placed = df.withColumns({c: F.col(c).cast("double") for c in "xy"})
    return placed.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


class Frame:
    """The square around all points and sites; each round halves the sides of its tiles."""

    def __init__(self, *places: DataFrame):
        ends = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
        every = places[0].select("x", "y")
        for p in places[1:]:
            every = every.unionByName(p.select("x", "y"))
        e = every.agg(*ends).first()
        self.x, self.y = e.x0 or 0.0, e.y0 or 0.0
        longest = max((e.x1 or 0.0) - self.x, (e.y1 or 0.0) - self.y)
        self.tiles = SIDE / longest if SIDE / (longest or 1.0) < float("inf") and longest else 1.0

    def tile(self, x: Column, y: Column, step: Column) -> list[Column]:
        """Tile numbers in round ``step``; doubling is exact, so a tile lies in its parent."""
        number = lambda c, start: F.floor((c - F.lit(start)) * F.lit(self.tiles) * F.pow(F.lit(2.0), step))
        return [number(x, self.x), number(y, self.y)]


def _boxes(rows: DataFrame, keys: list[str], frame: Frame, step: int, names: tuple[str, str], mark: str, extra: list[Column]) -> DataFrame:
    """Tiles of ``rows`` in round ``step`` with the bounds of their rows and their count."""
    tx, ty = frame.tile(F.col("x"), F.col("y"), F.lit(step))
    ends = [f(c).alias(f"{mark}{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
    return rows.groupBy(*keys, tx.alias(names[0]), ty.alias(names[1])).agg(*ends, F.count("*").alias(f"{mark}n"), *extra)


def _corner_bounds(pairs: DataFrame, block: list[str], k: int) -> DataFrame:
    """Pairs whose tile can hold one of the k nearest sites of a point of the block, with ``open``."""
    low = lambda at, c: F.greatest(F.col(f"t{c}0") - at, at - F.col(f"t{c}1"), F.lit(0.0))
    high = lambda at, c: F.greatest(F.abs(at - F.col(f"t{c}0")), F.abs(F.col(f"t{c}1") - at))
    if k == 1:  # one site of the tile is nearer than the far end of its bounds
        high = lambda at, c: F.abs(at - F.col(f"one.{c}"))
    square = lambda f, x, y: f(x, "x") * f(x, "x") + f(y, "y") * f(y, "y")
    middle = [(F.col(f"b{c}0") + F.col(f"b{c}1")) / 2 for c in "xy"]
    corners = [(F.col(f"bx{i}"), F.col(f"by{j}")) for i in (0, 1) for j in (0, 1)]
    whole = Window.partitionBy(*block)
    before = whole.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    sites = F.lit(1) if k == 1 else F.col("tn")
    first = F.coalesce(F.sum(sites).over(before), F.lit(0)) < k
    ranked = pairs.withColumn("_far", square(high, *middle)).withColumn("_first", first)
    reach = {f"_u{i}": F.max(F.when(F.col("_first"), square(high, *c))).over(whole) for i, c in enumerate(corners)}
    near = F.lit(False)
    for i, c in enumerate(corners):
        near = near | (square(low, *c) <= F.col(f"_u{i}") * (1 + 1e-9))
    left, tiles = F.sum("tn").over(whole), F.count("*").over(whole)
    single = lambda m: (F.col(f"{m}x0") == F.col(f"{m}x1")) & (F.col(f"{m}y0") == F.col(f"{m}y1"))
    split = F.max(~(single("b") & single("t"))).over(whole)
    done = (left <= FEW + 4 * k) | (F.col("bn") * left <= WORTH * tiles) | ~split
    return ranked.withColumns(reach).filter(near).withColumn("open", ~done)


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that no broadcast serves: the size of its file says little about points on several rounds."""
    return df.hint("merge")


#: Names of a block beside the keys: its round and its tile there.
BLOCK = ["step", "bx", "by"]


def block_candidates(points: DataFrame, sites: DataFrame, keys: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of points, and the sites that can be among the k nearest of any point of each block.

    ``points`` and ``sites`` hold ``keys, x, y`` and any payload.  The first result
    has the points with their place as ``px, py``, each once per round that a block
    was done in; the second one row per block and candidate.  Joined on the keys and
    ``BLOCK`` every point meets its candidates once.  Points and sites without a
    finite place are left out.
    """
    points, sites = cut_lineage(_finite(points)), cut_lineage(_finite(sites))
    frame = Frame(points, sites)
    one = [F.min(F.struct("x", "y")).alias("one")]
    block = [*keys, "bx", "by"]
    done, steps, above, step, leap = [], [], None, 0, 0
    while True:
        blocks = _boxes(points, keys, frame, step, ("bx", "by"), "b", [])
        tiles = _boxes(sites, keys, frame, step, ("tx", "ty"), "t", one)
        if above is None:
            pairs = blocks.join(_shuffled(tiles), keys)
        else:
            wanted = above.select(*[F.col(c).alias(c if c in keys else f"_{c}") for c in [*block, "tx", "ty"]])
            pairs = wanted.join(_shuffled(blocks.withColumns({f"_{c}": F.shiftright(c, leap) for c in ("bx", "by")})), [*keys, "_bx", "_by"])
            pairs = pairs.join(_shuffled(tiles.withColumns({f"_{c}": F.shiftright(c, leap) for c in ("tx", "ty")})), [*keys, "_tx", "_ty"])
        near = _corner_bounds(pairs, block, k)
        opened = F.col("open") if step < ROUNDS else F.lit(False)
        near = cut_lineage(near.select(*block, "tx", "ty", "bn", "tn", opened.alias("open")))
        after = {}
        for n in range(1, LEAP + 1):
            child = lambda name: F.least(F.lit(float(4**n)), F.col(name).cast("double"))  # noqa: B023, E731
            after[n] = child("bn") * child("tn")
        state = near.agg(
            F.count("*").alias("rows"),
            F.count_if("open").alias("open"),
            *[F.sum(a).alias(f"all{n}") for n, a in after.items()],
            *[F.sum(F.when(F.col("open"), a)).alias(f"open{n}") for n, a in after.items()],
        ).first()
        on_with_all = state.open and (state.rows - state.open) * SPARSE < state.rows
        if not on_with_all:
            done.append(near.filter(~F.col("open")).select(F.lit(step).alias("step"), *block, "tx", "ty"))
            steps.append(step)
        if not state.open:
            break
        above, which = (near, "all") if on_with_all else (near.filter("open"), "open")
        leap = max([1, *[n for n in after if state[f"{which}{n}"] <= FREE and step + n <= ROUNDS]])
        step += leap
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    # A point and a site stand once on each round that some block ended in.
    ended = F.explode(F.array(*[F.lit(i) for i in steps])).alias("step")
    on = lambda df, names: df.select("*", ended).withColumns(
        dict(zip(names, frame.tile(F.col("x"), F.col("y"), F.col("step"))))
    )
    near = chosen.join(_shuffled(on(sites, ("tx", "ty"))), [*keys, "step", "tx", "ty"]).drop("tx", "ty")
    return on(points, ("bx", "by")).withColumnsRenamed({"x": "px", "y": "py"}), near


def nearest_known(
    missing: DataFrame, known: DataFrame, point_id: str, known_id: str, x: str, y: str, take: list[str]
) -> DataFrame:
    """Columns ``take`` of the nearest known site for every missing one; equal distances go by site."""
    points = missing.select(point_id, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0).alias("all"))
    entry = F.struct(F.col(known_id).alias("known_site"), *take)
    sites = known.select(F.lit(0).alias("all"), F.col(x).alias("x"), F.col(y).alias("y"), entry.alias("entry"))
    # Of the sites at one place only the first can win.
    sites = sites.groupBy("all", "x", "y").agg(F.min_by("entry", F.struct("entry.known_site")).alias("entry"))
    placed, near = block_candidates(points, sites, ["all"], 1)
    # A block has few candidates: they are laid side by side, and a point stays one row.
    beside = near.groupBy("all", *BLOCK).agg(F.collect_list(F.struct("x", "y", "entry")).alias("near"))
    d2 = lambda e: (F.col("px") - e["x"]) ** 2 + (F.col("py") - e["y"]) ** 2
    order = F.transform("near", lambda e, i: F.struct(d2(e).alias("d2"), e["entry"]["known_site"].alias("site"), i.alias("at")))
    first = placed.join(_shuffled(beside), ["all", *BLOCK]).select(point_id, "near", F.array_min(order).alias("o"))
    found = first.select(point_id, "o", F.col("near")[F.col("o.at")]["entry"].alias("entry"))
    best = F.min_by("entry", F.struct("o.d2", "o.site"))
    return found.groupBy(point_id).agg(best.alias("best")).select(point_id, *[F.col(f"best.{c}") for c in take])


def nearest_k(points: DataFrame, sites: DataFrame, keys: list[str], point: str, site: str, k: int = 30) -> DataFrame:
    """The ``k`` nearest sites of each point with their rank and distance, per key.

    Both sides hold ``keys`` (at least one) and plane coordinates ``x, y``;
    equal distances go by site.  Fewer than ``k`` rows mean fewer sites.
    """
    there = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy(site))
    first = sites.select(*keys, site, "x", "y").withColumn("_there", there).filter(F.col("_there") <= k).drop("_there")
    placed, near = block_candidates(points.select(*keys, point, "x", "y"), first, keys, k)
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    order = Window.partitionBy(*keys, point).orderBy("d2", site)
    ranked = placed.join(_shuffled(near), [*keys, *BLOCK]).withColumn("d2", d2).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(*keys, point, site, "rank", F.sqrt("d2").alias("distance"))
