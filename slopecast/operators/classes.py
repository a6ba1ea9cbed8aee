"""Class schemes, area and point shares, capture rates and overlay colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import as_col, class_label, digitize
from ..functions.text import hex_channel
from ..settings import CLASS_NODATA, OVERLAY_ALPHA, SCORE_SCHEME, ClassScheme, Grid
from .pixels import sample_pixels


def class_table(like: DataFrame, scheme: ClassScheme) -> DataFrame:
    """(class_value, label, lo, hi, color) rows of a scheme; hi is capped at 1."""
    rows = [
        (i, label, scheme.edges[i - 1], min(scheme.edges[i], 1.0), scheme.colors[i - 1])
        for i, label in enumerate(scheme.labels, start=1)
    ]
    return like.sparkSession.createDataFrame(rows, "class_value int, label string, lo double, hi double, color string")


def class_counts(df: DataFrame, class_column: str, name: str) -> DataFrame:
    return df.groupBy(F.col(class_column).alias("class_value")).agg(F.count(F.lit(1)).alias(name))


def _with_share(df: DataFrame, count: str, share: str, empty: float | None) -> DataFrame:
    total = F.sum(count).over(W.partitionBy())  # over the few rows of a class table
    percent = F.try_divide(F.col(count), total) * 100
    return df.withColumn(share, percent if empty is None else F.coalesce(percent, F.lit(empty)))


def validate_points(
    points: DataFrame, pixels: DataFrame, grid: Grid, score: str = "score", scheme: ClassScheme = SCORE_SCHEME
) -> DataFrame:
    """Score, class and label at each point; points on NoData drop out."""
    sampled = sample_pixels(points, pixels, grid, [score])
    classed = sampled.withColumn("susceptibility_class", digitize(score, scheme.edges))
    return classed.where(F.col("susceptibility_class") != CLASS_NODATA).select(
        *points.columns,
        F.col(score).alias("susceptibility_probability"),
        "susceptibility_class",
        class_label("susceptibility_class", scheme).alias("susceptibility_label"),
    )


def class_summary(
    classified: DataFrame, validation: DataFrame, class_column: str = "class_value", scheme: ClassScheme = SCORE_SCHEME
) -> DataFrame:
    """Pixel and point counts and shares for every class, empty classes included."""
    area = class_counts(classified.where(F.col(class_column) != CLASS_NODATA), class_column, "pixel_count")
    hits = class_counts(validation, "susceptibility_class", "landslide_count")
    table = class_table(classified, scheme)
    both = table.join(area, "class_value", "left").join(hits, "class_value", "left")
    filled = both.fillna(0, ["pixel_count", "landslide_count"])
    shared = _with_share(filled, "pixel_count", "area_percent", None)
    shared = _with_share(shared, "landslide_count", "landslide_percent", 0.0)
    return shared.select(
        "class_value",
        F.col("label").alias("class_label"),
        F.col("lo").alias("probability_min"),
        F.col("hi").alias("probability_max"),
        "pixel_count",
        "area_percent",
        "landslide_count",
        "landslide_percent",
    )


def risk_summary(risk: DataFrame, maxima: DataFrame, scheme: ClassScheme, run_time: str, column: str = "risk") -> DataFrame:
    """Pixel count and area share per risk class with the run's rainfall maxima on every row."""
    classed = risk.where(as_col(column).isNotNull()).select(digitize(column, scheme.edges).alias("class_value"))
    counted = class_table(risk, scheme).join(class_counts(classed, "class_value", "pixel_count"), "class_value", "left")
    shared = _with_share(counted.fillna(0, ["pixel_count"]), "pixel_count", "area_percent", None)
    top = maxima.select(F.struct(*maxima.columns)).scalar()
    return shared.withColumn("_top", top).select(
        F.col("label").alias("risk_label"),
        F.col("lo").alias("risk_min"),
        F.col("hi").alias("risk_max"),
        "pixel_count",
        "area_percent",
        F.lit(run_time).alias("generated_at"),
        "_top.*",
    )


def capture_share(summary: DataFrame, label: str, high: list[str], shares: dict[str, str]) -> DataFrame:
    """One row: summed shares over the high classes, and over the last of them alone."""
    parts = []
    for column, name in shares.items():
        for suffix, wanted in (("high", high), ("top", high[-1:])):
            picked = F.when(F.col(label).isin(wanted), F.col(column))
            parts.append(F.coalesce(F.sum(picked), F.lit(0.0)).alias(f"{name}_{suffix}"))
    return summary.agg(*parts)


def color_pixels(classified: DataFrame, scheme: ClassScheme, class_column: str = "class_value") -> DataFrame:
    """Red, green, blue and alpha of each pixel; NoData is fully transparent black."""
    palette = class_table(classified, scheme).select(
        F.col("class_value").alias(class_column),
        *[hex_channel("color", at).alias(name) for name, at in (("red", 2), ("green", 4), ("blue", 6))],
        F.lit(OVERLAY_ALPHA).alias("alpha"),
    )
    colored = classified.join(F.broadcast(palette), class_column, "left")
    return colored.fillna(0, ["red", "green", "blue", "alpha"])


def score_distribution(pixels: DataFrame, score: str = "score") -> DataFrame:
    return pixels.agg(
        F.count(score).alias("valid_pixels"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )
