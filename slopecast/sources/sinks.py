"""Writers: tables, pixel tables, GeoJSON, dashboard state and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators.pixels import PIXEL
from ..session import shared_dir

TILE = 512


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result table as CSV with a header, or as Parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def with_tile(pixels: DataFrame, side: int = TILE) -> DataFrame:
    """Add the row and column of the map tile that a pixel lies in."""
    place = {"tile_row": "row_id", "tile_col": "col_id"}
    return pixels.withColumns({tile: F.floor(F.col(at) / side).cast("int") for tile, at in place.items()})


def write_pixels(
    pixels: DataFrame, spark: SparkSession, value: str, nodata: float, path: str | None = None, kind: str = "float", side: int = TILE
) -> str:
    """Pixel table as Parquet, tile by tile, missing values as the sentinel.

    Files hold ranges of tiles and rows lie in tile order, so the statistics of files and row
    groups bound a region; ``read_region`` opens only those that meet it.
    """
    path = path or shared_dir(spark, "pixels")
    filled = pixels.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float(nodata))).cast(kind))
    order = ["tile_row", "tile_col", *PIXEL]
    with_tile(filled, side).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return path


def read_region(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], side: int = TILE) -> DataFrame:
    """Pixels of a window of rows and columns, both ends included, pruned by tile."""
    found = spark.read.parquet(path)
    for tile, at, (low, high) in (("tile_row", "row_id", rows), ("tile_col", "col_id", cols)):
        found = found.where(F.col(tile).between(low // side, high // side) & F.col(at).between(low, high))
    return found.drop("tile_row", "tile_col")


def point_feature(lon: str, lat: str, properties: list[str]) -> Column:
    """One GeoJSON point feature as JSON text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return F.to_json(feature, {"ignoreNullFields": "false"})


def feature_lines(points: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One feature per row (GeoJSON text lines), for point sets of any size."""
    return points.select(point_feature(lon, lat, properties).alias("feature"))


def feature_collection(points: DataFrame, lon: str, lat: str, properties: list[str], order: str) -> DataFrame:
    """One-row FeatureCollection of a display-sized point set, in key order."""
    keyed = points.select(F.struct(F.col(order).alias("o"), point_feature(lon, lat, properties).alias("f")).alias("s"))
    features = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))
    return keyed.agg(text.alias("geojson"))


def polygon_features(vertices: DataFrame) -> DataFrame:
    """(feature_id, geojson): one polygon feature per boundary, rings closed and in order."""
    corner = F.struct("seq", F.array("x", "y").alias("xy"))
    ring = F.transform(F.array_sort(F.collect_list(corner)), lambda s: s["xy"])
    rings = vertices.groupBy("feature_id", "part_id").agg(ring.alias("ring"))
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(
        F.concat("ring", F.array(F.element_at("ring", 1)))
    )
    part = F.struct("part_id", F.array(closed).alias("rings"))
    parts = rings.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["rings"]).alias("parts"))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.element_at("parts", 1).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates")))
    geometry = F.when(F.size("parts") == 1, single).otherwise(multi)
    text = F.concat(
        F.lit('{"type":"Feature","properties":{"feature_id":'), F.col("feature_id"), F.lit('},"geometry":'), geometry, F.lit("}")
    )
    return parts.select("feature_id", text.alias("geojson"))


def markdown_rows(df: DataFrame, order: str) -> DataFrame:
    """(line_no, line): header, separator and one pipe row per record of a summary table."""
    columns = df.columns
    kinds = dict(df.dtypes)
    cells = [fixed(c, 3) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join(["---"] * len(columns)) + " |")]
    top = df.sparkSession.createDataFrame(head, "line_no long, line string")
    return top.unionByName(df.select((F.col(order).cast("long") + 1).alias("line_no"), body.alias("line")))


def app_state(
    cards: DataFrame,
    tables: dict[str, DataFrame],
    order: dict[str, str],
    bounds: list[list[float]],
    overlays: dict[str, str],
    generated_at: str,
    latest_time: str,
) -> DataFrame:
    """One-row dashboard document from display-sized summaries."""

    def records(df: DataFrame, by: str) -> Column:
        keyed = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.struct(*df.columns).alias("r"))))
        return df.agg(F.transform(keyed, lambda s: s["r"]).alias("r")).scalar()

    corner = F.array(*[F.array(*[F.lit(v) for v in pair]) for pair in bounds])
    document = F.struct(
        F.lit(generated_at).alias("generatedAt"),
        F.lit(latest_time).alias("rainfallLatestTime"),
        F.struct(corner.alias("susceptibility"), corner.alias("risk")).alias("bounds"),
        F.struct(*[F.lit(path).alias(name) for name, path in overlays.items()]).alias("overlays"),
        F.struct(*cards.columns).alias("cards"),
        F.struct(*[records(df, order[name]).alias(name) for name, df in tables.items()]).alias("summaries"),
    )
    return cards.select(F.to_json(document).alias("app_state"))
