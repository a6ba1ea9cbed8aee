"""Operators on pixel tables: sampling at points, stacking, masks and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import all_of, digitize, lonlat_to_pixel, null_sentinels, usable
from ..settings import CATEGORICAL, FEATURES, NODATA_CODES, Grid

PIXEL = ["row_id", "col_id"]


def clean_layers(pixels: DataFrame, columns: list[str], codes=NODATA_CODES, mode: str = "close") -> DataFrame:
    """Turn in-band NoData of the given layers into NULL."""
    return pixels.withColumns({c: null_sentinels(c, codes, mode) for c in columns})


def melt_layers(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Wide pixel table to (layer, row_id, col_id, value)."""
    wide = pixels.select(*PIXEL, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(PIXEL, columns, "layer", "value").select("layer", *PIXEL, "value")


def stack_layers(long: DataFrame, columns: list[str]) -> DataFrame:
    """Long pixel table to one row per pixel with one column per layer."""
    return long.groupBy(*PIXEL).pivot("layer", columns).agg(F.first("value"))


def raster_meta(long: DataFrame, grid: Grid) -> DataFrame:
    """Shape, bounds, resolution and missing share of each layer."""
    height, width = F.max("row_id") + 1, F.max("col_id") + 1
    meta = long.groupBy("layer").agg(
        height.cast("int").alias("height"),
        width.cast("int").alias("width"),
        (F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_percent"),
    )
    return meta.select(
        "*",
        F.lit(grid.a).alias("res_x"),
        F.lit(abs(grid.e)).alias("res_y"),
        F.lit(grid.c).alias("left"),
        (F.lit(grid.f) + F.lit(grid.e) * F.col("height")).alias("bottom"),
        (F.lit(grid.c) + F.lit(grid.a) * F.col("width")).alias("right"),
        F.lit(grid.f).alias("top"),
    )


def sample_pixels(
    points: DataFrame,
    pixels: DataFrame,
    grid: Grid,
    columns: list[str],
    xy: tuple[str, str] = ("longitude", "latitude"),
) -> DataFrame:
    """Value of every co-registered layer at every point; NULL outside the grid.

    The pixel table first shrinks to the distinct cells that hold a point, so it is
    only shuffled if those cells are themselves large, and copies of a point never
    pile up against it.
    """
    row, col = lonlat_to_pixel(*xy, grid)
    keyed = points.withColumn("row_id", row).withColumn("col_id", col)
    cells = keyed.select(*PIXEL).distinct()
    hit = pixels.select(*PIXEL, *columns).join(cells, PIXEL, "left_semi")
    return keyed.join(hit, PIXEL, "left").drop(*PIXEL)


def sample_layers(
    points: DataFrame, long: DataFrame, grids: dict[str, Grid], point_id: str, xy: tuple[str, str] = ("longitude", "latitude")
) -> DataFrame:
    """Sampling where every layer has its own grid; one wide row per point.

    A point meets the cells of each grid once, however many layers share it; a cell's layers are gathered
    to one row first. Of several values of one cell, or of one point id, the largest counts.
    """
    kinds = list(dict.fromkeys(grids.values()))
    keys = []
    for n, grid in enumerate(kinds):
        row, col = lonlat_to_pixel(*xy, grid)
        keys.append(F.struct(F.lit(n).alias("_grid"), row.alias("row_id"), col.alias("col_id")))
    keyed = points.select(point_id, F.explode(F.array(*keys)).alias("k")).select(point_id, "k.*")
    key = ["_grid", *PIXEL]
    grid_of = F.coalesce(*[F.when(F.col("layer").isin([name for name, g in grids.items() if g == kind]), n) for n, kind in enumerate(kinds)])
    hit = long.withColumn("_grid", grid_of).join(keyed.select(*key).distinct(), key, "left_semi")
    cells = hit.groupBy(*key).agg(*[F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name) for name in grids])
    wide = keyed.join(cells, key, "left").groupBy(point_id).agg(*[F.max(name).alias(name) for name in grids])
    return points.join(wide, point_id, "left")


def valid_mask(pixels: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Raw or cleaned pixels where every layer is present and inside its domain."""
    return pixels.where(all_of(usable(c) for c in columns))


def classify_map(pixels: DataFrame, score: str = "score", name: str = "class_value") -> DataFrame:
    return pixels.withColumn(name, digitize(score))


def at_least(pixels: DataFrame, column: str, threshold: float, name: str) -> DataFrame:
    """Mark pixels whose value reaches a threshold."""
    return pixels.withColumn(name, F.coalesce(F.col(column) >= F.lit(threshold), F.lit(False)))


def resample_rule(meta: DataFrame, reference: Grid, ratio: float) -> DataFrame:
    """Kernel per layer from its type and its resolution against the reference grid."""
    coarse = (F.abs("a") >= F.lit(abs(reference.a) * ratio)) | (F.abs("e") >= F.lit(abs(reference.e) * ratio))
    kernel = F.when(F.col("layer").isin(CATEGORICAL), "nearest").when(coarse, "cubic_spline").otherwise("bilinear")
    return meta.withColumn("kernel", kernel)
