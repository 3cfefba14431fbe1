"""Polygons and time zones: which area holds a point.

Square tiles that no edge touches lie wholly inside or outside every polygon, so
one point of a tile decides all of them; only points of border tiles meet edges.
Edges and points meet on strips of one coordinate (an equi-join), and an edge
is stored once for each strip it crosses.  The points of a strip are dealt to as
many shares as their number asks for and the edges of the strip copied to each, so
that a crowded strip is not one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.session import cut_lineage


def ring_edges(vertices: DataFrame, keys: list[str], order: str = "pos", x: str = "x", y: str = "y") -> DataFrame:
    """Edges (x1, y1) - (x2, y2) of ordered vertices; rings repeat their first vertex."""
    following = Window.partitionBy(*keys).orderBy(order)
    return (
        vertices.withColumns({"x2": F.lead(x).over(following), "y2": F.lead(y).over(following)})
        .filter(F.col("x2").isNotNull())
        .select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1"), "x2", "y2")
    )


#: Points of a strip that meet its edges in one share.
SHARE = 50_000


def _strips(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def _meet(points: DataFrame, edges: DataFrame, point: list[str]) -> DataFrame:
    """Every point with the edges of its strip."""
    counted = points.groupBy("strip").agg(F.ceil(F.count("*") / SHARE).alias("_shares"))
    shares = cut_lineage(counted)
    dealt = points.join(shares, "strip").withColumn("_salt", F.pmod(F.xxhash64(*point), F.col("_shares"))).drop("_shares")
    copied = edges.join(shares, "strip").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)))
    return dealt.join(copied.drop("_shares"), ["strip", "_salt"]).drop("_salt")


def border_tiles(edges: DataFrame, width: float) -> DataFrame:
    """``tx, ty`` of every square tile that an edge touches (a hair's breadth around it included)."""
    pad = width * 1e-6
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("x1", "y1", "x2", "y2", _strips(low - pad, high + pad, width).alias("ty"))
    run = F.col("y2") - F.col("y1")
    # Where the edge enters and leaves the strip; a level edge runs along it.
    at = lambda y: F.col("x1") + (F.least(F.greatest(y, low), high) - F.col("y1")) / run * (F.col("x2") - F.col("x1"))
    enter, leave = at(F.col("ty") * width - pad), at((F.col("ty") + 1) * width + pad)
    left = F.when(run == 0, F.least("x1", "x2")).otherwise(F.least(enter, leave))
    right = F.when(run == 0, F.greatest("x1", "x2")).otherwise(F.greatest(enter, leave))
    return rows.select(_strips(left - pad, right + pad, width).alias("tx"), "ty").distinct()


def containing_polygon(
    points: DataFrame,
    edges: DataFrame,
    point: list[str],
    x: str = "x",
    y: str = "y",
    poly: str = "poly_id",
    width: float = 1.0,
    outside: int | None = -999,
    name: str = "region",
) -> DataFrame:
    """Lowest polygon number that holds each point, else ``outside``.

    Crossing parity over all rings of a polygon, so holes cancel; an edge counts
    its lower but not its upper end.  ``point`` must identify a point.  Tiles of
    side ``width`` without an edge are decided by their middle.
    """
    borders = cut_lineage(border_tiles(edges, width)).withColumn("_edge", F.lit(True))
    tx, ty = F.floor(F.col(x) / width), F.floor(F.col(y) / width)
    at = points.select(*point, F.col(x).alias("px"), F.col(y).alias("py"), tx.alias("tx"), ty.alias("ty"))
    placed = at.join(borders, ["tx", "ty"], "left")
    plain = placed.filter(F.col("_edge").isNull())
    middle = lambda c: (F.col(c) + 0.5) * F.lit(width)
    tiles = plain.select("tx", "ty").distinct().withColumns({"px": middle("tx"), "py": middle("ty")})
    whole = cut_lineage(_crossed(tiles, edges, ["tx", "ty"], poly, width))
    close = placed.filter("_edge").select(*point, "px", "py")
    found = _crossed(close, edges, point, poly, width).unionByName(plain.join(whole, ["tx", "ty"]).select(*point, "_found"))
    return points.join(found.withColumnRenamed("_found", name), point, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(outside).cast("int"))
    )


def _crossed(at: DataFrame, edges: DataFrame, point: list[str], poly: str, width: float) -> DataFrame:
    """``point, _found``: the lowest polygon whose edges a ray from the point crosses an odd number of times."""
    striped = edges.filter(F.col("y1") != F.col("y2")).withColumn(
        "strip", _strips(F.least("y1", "y2"), F.greatest("y1", "y2"), width)
    )
    spans = (F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py"))
    where = F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (
        F.col("y2") - F.col("y1")
    )
    return (
        _meet(at.withColumn("strip", F.floor(F.col("py") / width)), striped, point)
        .filter(spans & (F.col("px") < where))
        .groupBy(*point, poly)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") % 2 == 1)
        .groupBy(*point)
        .agg(F.min(poly).alias("_found"))
    )


def keep_inside(points: DataFrame, edges: DataFrame, point: list[str], **kw) -> DataFrame:
    """Only the points inside any polygon."""
    found = containing_polygon(points, edges, point, outside=None, name="_region", **kw)
    return found.filter(F.col("_region").isNotNull()).drop("_region")


def blank_outside(
    points: DataFrame,
    edges: DataFrame,
    point: list[str],
    columns: list[str],
    fixed: float | None = None,
    only: Column | None = None,
    **kw,
) -> DataFrame:
    """Replace columns of points outside every polygon by a fixed value.

    ``only`` restricts the replacement to some rows, such as given timestamps.
    """
    cells = points.select(*point, kw.get("x", "x"), kw.get("y", "y")).distinct()
    found = containing_polygon(cells, edges, point, outside=None, name="_region", **kw)
    marked = points.join(found.select(*point, "_region"), point, "left")
    outside = F.col("_region").isNull() & (only if only is not None else F.lit(True))
    return marked.withColumns(
        {c: F.when(outside, F.lit(fixed).cast("double")).otherwise(F.col(c)) for c in columns}
    ).drop("_region")


def time_zone(
    points: DataFrame,
    edges: DataFrame,
    point: list[str],
    lon: str = "Lon",
    lat: str = "Lat",
    width: float = 1.0,
    valid: str | None = None,
    west_plus_one: bool = False,
) -> DataFrame:
    """Hours from UTC of each point from zone boundary lines.

    ``valid`` names a flag of the points: only flagged ones meet the boundaries, the
    others have no offset.  ``west_plus_one`` gives hours west of UTC plus one
    instead (summer time of a positive-west table).

    ``edges``: zone_id (file order), offset, ymin, ymax, x1, y1, x2, y2.
    A vertical line through the point is cut by the boundaries.  First rule: the
    first zone whose sorted crossings enclose the point pairwise.  Second rule:
    the point lies between two neighbouring crossings of equal offset less than
    two degrees apart.  Otherwise the hour of the meridian.
    """
    striped = edges.filter(F.col("x1") != F.col("x2")).withColumn(
        "strip", _strips(F.least("x1", "x2"), F.greatest("x1", "x2"), width)
    )
    asked = points if valid is None else points.filter(F.col(valid))
    at = asked.select(*point, F.col(lon).alias("px"), F.col(lat).alias("py")).withColumn(
        "strip", F.floor(F.col("px") / width)
    )
    px = F.col("px")
    spans = ((px >= F.col("x1")) & (px < F.col("x2"))) | ((px <= F.col("x1")) & (px > F.col("x2")))
    slope = (F.col("y1") - F.col("y2")) / (F.col("x1") - F.col("x2"))
    cuts = (
        _meet(at, striped, point)
        .filter(spans)
        .select(
            *point, "py", "zone_id", "offset", "ymin", "ymax",
            (F.col("y1") + slope * (px - F.col("x1"))).alias("cut"),
        )
    )
    in_zone = Window.partitionBy(*point, "zone_id").orderBy("cut")
    pooled = Window.partitionBy(*point).orderBy("cut", "offset")
    marked = cuts.withColumns(
        {
            "no": F.row_number().over(in_zone),
            "next_in_zone": F.lead("cut").over(in_zone),
            "next_cut": F.lead("cut").over(pooled),
            "next_offset": F.lead("offset").over(pooled),
        }
    )
    py = F.col("py")
    encloses = (
        (F.col("no") % 2 == 1)
        & py.between(F.col("cut"), F.col("next_in_zone"))
        & py.between(F.col("ymin"), F.col("ymax"))
    )
    gap = (
        py.between(F.col("cut"), F.col("next_cut"))
        & (F.col("offset") == F.col("next_offset"))
        & (F.col("next_cut") - F.col("cut") < 2.0)
    )
    found = marked.groupBy(*point).agg(
        F.min_by(F.when(encloses, F.col("offset")), F.when(encloses, F.col("zone_id"))).alias("by_zone"),
        F.min_by(F.when(gap, F.col("offset")), F.when(gap, F.col("cut"))).alias("by_gap"),
    )
    hour = F.floor((F.abs(F.col(lon)) + 7.5) / 15).cast("int")
    meridian = F.when(F.col(lon) > 0, hour).otherwise(-hour)
    hours = F.coalesce(F.coalesce("by_zone", "by_gap").cast("int"), meridian)
    if west_plus_one:
        hours = F.lit(1) - hours
    if valid is not None:
        hours = F.when(F.col(valid), hours)
    return points.join(found, point, "left").select(points["*"], hours.alias("gmt_offset"))
