"""Polygon and boundary-line sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.sources.lines import numbered_blocks, numbered_lines

_RINGS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
_FEATURES = (
    "features ARRAY<STRUCT<properties: STRUCT<id: INT>, "
    "geometry: STRUCT<type: STRING, coordinates: STRING>>>"
)


def read_geojson_rings(spark: SparkSession, path: str, ids: tuple[int, int] = (0, 8)) -> DataFrame:
    """Vertices (poly_id, part, ring, pos, x, y) of Polygon and MultiPolygon features.

    Features with an id outside ``ids`` are left out.
    """
    features = (
        spark.read.schema(_FEATURES)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("f"))
        .select(
            F.col("f.properties.id").alias("poly_id"),
            F.col("f.geometry.type").alias("type"),
            F.col("f.geometry.coordinates").alias("c"),
        )
        .filter(F.col("poly_id").between(*ids))
    )
    single = F.array(F.from_json("c", _RINGS))
    many = F.from_json("c", f"ARRAY<{_RINGS}>")
    parts = features.select(
        "poly_id", F.posexplode(F.when(F.col("type") == "Polygon", single).otherwise(many)).alias("part", "rings")
    )
    rings = parts.select("poly_id", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("poly_id", "part", "ring", F.posexplode("points").alias("pos", "p")).select(
        "poly_id", "part", "ring", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")
    )


def read_zone_lines(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a blocked boundary file: ``npts,offset,name`` then npts lon/lat lines.

    A header is a line with three fields; the headers before a line number its
    block within the file.  Lines and blocks are numbered over the splits of a file,
    and a block takes its header's fields by its number.
    """
    lines = numbered_lines(spark, path, blank=False)
    fields = F.split("value", ",")
    parsed = numbered_blocks(lines, F.size(fields) == 3).withColumn("f", fields)
    heads = parsed.filter(F.size("f") == 3).select(
        "file",
        "block",
        F.col("line_no").alias("_head_no"),
        F.col("f")[1].cast("double").alias("offset"),
        F.trim(F.col("f")[2]).alias("name"),
    )
    return (
        parsed.filter(F.size("f") != 3)
        .join(heads, ["file", "block"])
        .select(
            F.col("block").cast("int").alias("zone_id"),
            "name",
            "offset",
            (F.col("line_no") - F.col("_head_no") - 1).cast("int").alias("pos"),
            F.col("f")[0].cast("double").alias("lon"),
            F.col("f")[1].cast("double").alias("lat"),
        )
    )


def zone_edges(vertices: DataFrame) -> DataFrame:
    """Edges of boundary lines with the latitude range of their zone."""
    along = Window.partitionBy("zone_id").orderBy("pos")
    whole = Window.partitionBy("zone_id")
    return (
        vertices.withColumns(
            {
                "x2": F.lead("lon").over(along),
                "y2": F.lead("lat").over(along),
                "ymin": F.min("lat").over(whole),
                "ymax": F.max("lat").over(whole),
            }
        )
        .filter(F.col("x2").isNotNull())
        .select("zone_id", "offset", "ymin", "ymax", F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    )
