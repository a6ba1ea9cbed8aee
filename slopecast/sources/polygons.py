"""Boundaries: GeoJSON features to vertex tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"


def parse_features(df: DataFrame, text: str) -> DataFrame:
    """Vertex table of the exterior rings of every Polygon and of every MultiPolygon part.

    The feature number comes from ``properties.feature_id``.
    """
    doc = F.from_json(text, "properties struct<feature_id: int>, geometry struct<type: string, coordinates: string>")
    read = df.select(doc.alias("d")).select("d.properties.feature_id", "d.geometry.type", "d.geometry.coordinates")
    single = F.array(F.from_json("coordinates", RINGS))
    multi = F.from_json("coordinates", f"array<{RINGS}>")
    parts = F.when(F.col("type") == "Polygon", single).when(F.col("type") == "MultiPolygon", multi)
    exterior = read.select("feature_id", F.posexplode(parts).alias("part_id", "rings"))
    vertices = exterior.select("feature_id", "part_id", F.posexplode(F.col("rings")[0]).alias("seq", "xy"))
    return vertices.select("feature_id", "part_id", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Vertex table of a folder of GeoJSON feature lines."""
    return parse_features(spark.read.text(path), "value")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Vertex table of a GeoJSON FeatureCollection document."""
    whole = spark.read.option("wholetext", True).text(path)
    doc = F.from_json("value", "features array<string>")
    return parse_features(whole.select(F.explode(doc["features"]).alias("feature")), "feature")
