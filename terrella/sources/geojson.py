"""GeoJSON in and out, through Spark's own JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import geojson, geometry, vertex


def parse(text: Column, crs: str = "EPSG:4326") -> Column:
    """Geometry of a GeoJSON geometry or feature; heights are dropped; null where the kind is unknown."""
    inner = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    kind, body = F.get_json_object(inner, "$.type"), F.get_json_object(inner, "$.coordinates")
    p = lambda c: vertex(c[0], c[1])
    ring = lambda r: F.transform(r, p)
    read = lambda depth: F.from_json(body, "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(p(read(1)))))).when(kind == "MultiPoint", F.transform(read(2), lambda c: F.array(F.array(p(c)))))
        .when(kind == "LineString", F.array(F.array(ring(read(2))))).when(kind == "MultiLineString", F.transform(read(3), lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(read(3), ring))).when(kind == "MultiPolygon", F.transform(read(4), lambda part: F.transform(part, ring)))
    )
    return F.when(parts.isNotNull(), geometry(kind, parts, crs))


def read(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """One row per line of newline-delimited features: properties (JSON text) and geometry."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.get_json_object("value", "$.properties").alias("properties"), parse(F.col("value"), crs).alias("geometry"))


def feature(geom: Column, properties: Column | None = None) -> Column:
    props = F.lit("{}") if properties is None else F.coalesce(properties, F.lit("{}"))
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geojson(geom), F.lit("}"))


def write(df: DataFrame, geom: str, path: str, properties: list[str] | None = None) -> None:
    """Newline-delimited features."""
    props = F.to_json(F.struct(*(properties or [c for c in df.columns if c != geom])))
    df.select(feature(F.col(geom), props).alias("value")).write.text(path)
