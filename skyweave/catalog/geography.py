"""Queries: projection, polygons, time zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.catalog import fixtures as fx
from skyweave.catalog.base import query
from skyweave.catalog.fusions import xy
from skyweave.operators import regions as rg
from skyweave.session import scratch_path
from skyweave.sources import boundaries as bd

G = fx.GRID.conic
_POINTS = "(SELECT o_orderkey, o_orderkey * 37 % 1009 / 64.0 + 0.003 AS x, o_orderkey * 53 % 997 / 64.0 + 0.003 AS y, o_totalprice AS v FROM orders)"


def points(spark, sf):
    return fx.columns(
        fx.table(spark, sf, "orders"),
        "o_orderkey = o_orderkey\nx = o_orderkey * 37 % 1009 / 64D + 0.003D\ny = o_orderkey * 53 % 997 / 64D + 0.003D\nv = o_totalprice",
    )


_LONLAT = "(SELECT o_orderkey, -125 + o_orderkey * 17 % 3001 / 64.0 AS Lon, 25 + o_orderkey * 53 % 1999 / 64.0 AS Lat FROM orders)"


def lonlat(spark, sf):
    return fx.columns(
        fx.table(spark, sf, "orders"),
        "o_orderkey = o_orderkey\nLon = -125 + o_orderkey * 17 % 3001 / 64D\nLat = 25 + o_orderkey * 53 % 1999 / 64D",
    )


@query(
    "geo_projection",
    f"SELECT o_orderkey, {xy()[0]} AS x, {xy()[1]} AS y, Lon AS lon_back, Lat AS lat_back FROM {_LONLAT}",
    floats="x y lon_back lat_back",
)
def _(spark, sf):
    plane = lonlat(spark, sf).select(
        "o_orderkey", G.x(F.col("Lon"), F.col("Lat")).alias("x"), G.y(F.col("Lon"), F.col("Lat")).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    return plane.withColumns({"lon_back": G.lon(x, y), "lat_back": G.lat(x, y)})


def _ring(x: str, y: str, w: int, h: int) -> str:
    corners = [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
    return "array(" + ", ".join(f"array({x} + {a}D, {y} + {b}D)" for a, b in corners) + ")"


def geojson(spark, sf) -> str:
    """A feature file drawn from the region table: squares with a hole, odd ones in two parts."""
    k = "r_regionkey"
    outer, hole = _ring(f"2 * {k}", k, 3, 4), _ring(f"2 * {k} + 1", f"{k} + 1", 1, 1)
    second = _ring(f"2 * {k} + 3", f"{k} + 6", 2, 2)
    geometry = f"""CASE WHEN {k} % 2 = 0 THEN to_json(named_struct('type', 'Polygon', 'coordinates', array({outer}, {hole})))
        ELSE to_json(named_struct('type', 'MultiPolygon', 'coordinates', array(array({outer}, {hole}), array({second})))) END"""
    features = fx.table(spark, sf, "region").select(
        F.concat(
            F.lit('{"type": "Feature", "properties": {"id": '),
            F.when(F.col(k) == 4, F.lit(12)).otherwise(F.col(k) * 2).cast("string"),
            F.lit('}, "geometry": '),
            F.expr(geometry),
            F.lit("}"),
        ).alias("f")
    )
    whole = features.agg(
        F.concat(F.lit('{"features": ['), F.concat_ws(", ", F.collect_list("f")), F.lit("]}")).alias("value")
    )
    path = scratch_path(spark, "geojson")
    whole.write.text(path)
    return path


def edges(spark, sf):
    vertices = bd.read_geojson_rings(spark, geojson(spark, sf))
    return rg.ring_edges(vertices, ["poly_id", "part", "ring"])


_INSIDE = """((p.x > 2 * r AND p.x < 2 * r + 3 AND p.y > r AND p.y < r + 4 AND NOT (p.x > 2 * r + 1 AND p.x < 2 * r + 2 AND p.y > r + 1 AND p.y < r + 2))
 OR (r % 2 = 1 AND p.x > 2 * r + 3 AND p.x < 2 * r + 5 AND p.y > r + 6 AND p.y < r + 8))"""
_FOUND = f"found AS (SELECT p.o_orderkey, min(r * 2) AS region FROM {_POINTS} p JOIN (SELECT r_regionkey AS r FROM region WHERE r_regionkey < 4) ON {_INSIDE} GROUP BY p.o_orderkey)"


@query(
    "s12_polygon_rings",
    """SELECT CAST(r * 2 AS INTEGER) AS poly_id, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, CAST(pos AS INTEGER) AS pos, (ox + CASE WHEN pos IN (1, 2) THEN w ELSE 0 END)::DOUBLE AS x, (oy + CASE WHEN pos IN (2, 3) THEN h ELSE 0 END)::DOUBLE AS y
 FROM (SELECT r, 0 AS part, 0 AS ring, 2 * r AS ox, r AS oy, 3 AS w, 4 AS h FROM (SELECT r_regionkey AS r FROM region WHERE r_regionkey < 4)
 UNION ALL SELECT r, 0, 1, 2 * r + 1, r + 1, 1, 1 FROM (SELECT r_regionkey AS r FROM region WHERE r_regionkey < 4)
 UNION ALL SELECT r, 1, 0, 2 * r + 3, r + 6, 2, 2 FROM (SELECT r_regionkey AS r FROM region WHERE r_regionkey < 4 AND r_regionkey % 2 = 1)), (SELECT unnest(range(5)) AS pos)""",
)
def _(spark, sf):
    return bd.read_geojson_rings(spark, geojson(spark, sf))


@query(
    "j22_containing_polygon",
    f"WITH {_FOUND} SELECT p.*, CAST(coalesce(region, -999) AS INTEGER) AS region FROM {_POINTS} p LEFT JOIN found USING (o_orderkey)",
)
def _(spark, sf):
    return rg.containing_polygon(points(spark, sf), edges(spark, sf), ["o_orderkey"])


@query("j23_keep_inside", f"WITH {_FOUND} SELECT p.* FROM {_POINTS} p JOIN found USING (o_orderkey)")
def _(spark, sf):
    return rg.keep_inside(points(spark, sf), edges(spark, sf), ["o_orderkey"])


@query(
    "j23_blank_outside",
    f"WITH {_FOUND} SELECT p.o_orderkey, p.x, p.y, CASE WHEN region IS NULL AND p.v > 200000 THEN 0.0::DOUBLE ELSE v END AS v FROM {_POINTS} p LEFT JOIN found USING (o_orderkey)",
)
def _(spark, sf):
    return rg.blank_outside(
        points(spark, sf), edges(spark, sf), ["o_orderkey"], ["v"], fixed=0.0, only=F.col("v") > 200000
    )


# Zone boundaries: per region two slanted blocks stacked with a one-degree gap.
def _zone(half: int) -> list[tuple[str, float]]:
    x0, x1 = "-120 + 9 * r", "-113 + 9 * r"
    lat = [28, 28, 36, 35, 28] if half == 0 else [37, 38, 45, 45, 37]
    return [(x, y) for x, y in zip([x0, x1, x1, x0, x0], lat)]


_OFFSETS = ["-5 - r % 4", "CASE WHEN r % 2 = 0 THEN -5 - r % 4 ELSE -4 - r % 4 END"]


def zone_file(spark, sf) -> str:
    """The boundary file drawn from the region table (ten blocks)."""
    regions = fx.table(spark, sf, "region").select(F.col("r_regionkey").alias("r"))
    blocks = []
    for half in (0, 1):
        lines = [f"concat('5,', CAST({_OFFSETS[half]} AS STRING), ',Zone', CAST(2 * r + {half} AS STRING))"]
        lines += [f"concat(CAST({x} AS STRING), ',{y}')" for x, y in _zone(half)]
        blocks.append(f"concat_ws('\\n', {', '.join(lines)})")
    texts = regions.select("r", F.expr(f"concat_ws('\\n', {', '.join(blocks)})").alias("t"))
    whole = texts.agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda s: s["t"])).alias("value")
    )
    path = scratch_path(spark, "zones")
    whole.write.text(path)
    return path


def _vertices_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(2 * r + {h} AS INTEGER) AS zone_id, 'Zone' || CAST(2 * r + {h} AS VARCHAR) AS name, CAST({_OFFSETS[h]} AS DOUBLE) AS \"offset\", CAST({i} AS INTEGER) AS pos, CAST({x} AS DOUBLE) AS lon, CAST({y} AS DOUBLE) AS lat FROM (SELECT r_regionkey AS r FROM region)"
        for h in (0, 1)
        for i, (x, y) in enumerate(_zone(h))
    )


@query("s13_zone_lines", _vertices_sql())
def _(spark, sf):
    return bd.read_zone_lines(spark, zone_file(spark, sf))


_TZ = f"""WITH v AS ({_vertices_sql()}), e AS (SELECT a.zone_id, a."offset" AS off, min(a.lat) OVER (PARTITION BY a.zone_id) AS ya, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM v a JOIN v b ON a.zone_id = b.zone_id AND b.pos = a.pos + 1),
 span AS (SELECT zone_id, min(lat) AS ymin, max(lat) AS ymax FROM v GROUP BY zone_id),
 c AS (SELECT p.o_orderkey, p.Lat AS py, e.zone_id, off, ymin, ymax, y1 + (y1 - y2) / (x1 - x2) * (p.Lon - x1) AS cut FROM {_LONLAT} p JOIN e ON x1 <> x2 AND ((p.Lon >= x1 AND p.Lon < x2) OR (p.Lon <= x1 AND p.Lon > x2)) JOIN span USING (zone_id)),
 per_zone AS (SELECT o_orderkey, py, zone_id, off, ymin, ymax, list_sort(list(cut)) AS cuts FROM c GROUP BY ALL),
 rule1 AS (SELECT o_orderkey, arg_min(off, zone_id) AS off FROM per_zone WHERE py BETWEEN ymin AND ymax AND len(list_filter(range(1, len(cuts), 2), lambda i: py >= cuts[i] AND py <= cuts[i + 1])) > 0 GROUP BY o_orderkey),
 pooled AS (SELECT *, lead(cut) OVER w AS cut2, lead(off) OVER w AS off2 FROM c WINDOW w AS (PARTITION BY o_orderkey ORDER BY cut, off)),
 rule2 AS (SELECT o_orderkey, arg_min(off, cut) AS off FROM pooled WHERE py BETWEEN cut AND cut2 AND off = off2 AND cut2 - cut < 2 GROUP BY o_orderkey)
 SELECT p.*, CAST(coalesce(rule1.off, rule2.off, CASE WHEN Lon > 0 THEN 1 ELSE -1 END * floor((abs(Lon) + 7.5) / 15)) AS INTEGER) AS gmt_offset FROM {_LONLAT} p LEFT JOIN rule1 USING (o_orderkey) LEFT JOIN rule2 USING (o_orderkey)"""


@query("j24_time_zone_of_point", _TZ)
def _(spark, sf):
    zones = bd.zone_edges(bd.read_zone_lines(spark, zone_file(spark, sf)))
    return rg.time_zone(lonlat(spark, sf), zones, ["o_orderkey"])


@query(
    "j24_time_zone_of_valid_points",
    f"SELECT o_orderkey, Lon, Lat, o_orderkey % 3 = 0 AS ok, CASE WHEN o_orderkey % 3 = 0 THEN gmt_offset END AS gmt_offset, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 - gmt_offset AS INTEGER) END AS hours_west FROM ({_TZ})",
)
def _(spark, sf):
    zones = bd.zone_edges(bd.read_zone_lines(spark, zone_file(spark, sf)))
    points = lonlat(spark, sf).withColumn("ok", F.col("o_orderkey") % 3 == 0)
    east = rg.time_zone(points, zones, ["o_orderkey"], valid="ok")
    west = rg.time_zone(points, zones, ["o_orderkey"], valid="ok", west_plus_one=True)
    return east.join(west.select("o_orderkey", F.col("gmt_offset").alias("hours_west")), "o_orderkey")


@query(
    "s15_regular_grid",
    """SELECT CAST(r AS INTEGER) AS ROW, CAST(c AS INTEGER) AS COL, n FROM (SELECT unnest(range(1, 300)) AS r) CROSS JOIN (SELECT unnest(range(1, 460)) AS c)
 LEFT JOIN (SELECT l_partkey % 299 + 1 AS r, l_suppkey % 459 + 1 AS c, count(*) AS n FROM lineitem GROUP BY ALL) USING (r, c)""",
)
def _(spark, sf):
    from skyweave.sources.grids import regular_grid

    counts = fx.table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % 299 + 1).cast("int").alias("ROW"), (F.col("l_suppkey") % 459 + 1).cast("int").alias("COL")
    ).agg(F.count("*").alias("n"))
    return regular_grid(spark).join(counts, ["ROW", "COL"], "left")
