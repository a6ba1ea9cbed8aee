"""Resampling of one pixel table onto a finer grid.

The kernel neighbourhood is gathered once per source cell, at the size of the
coarse source. Each destination pixel then needs one equi-join to its base cell
and a weighted sum in the projection, with no aggregation on the fine grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import lonlat_to_pixel, pixel_to_lonlat
from ..settings import Grid
from .pixels import PIXEL


def _bilinear(t: Column) -> dict[int, Column]:
    return {0: F.lit(1.0) - t, 1: t}


def _basis(distance: Column) -> Column:
    """Cubic B-spline."""
    d = F.abs(distance)
    inner = (F.lit(4.0) - F.lit(6.0) * d * d + F.lit(3.0) * d * d * d) / F.lit(6.0)
    rest = F.lit(2.0) - d
    return F.when(d < 1, inner).when(d < 2, rest * rest * rest / F.lit(6.0)).otherwise(F.lit(0.0))


def _cubic(t: Column) -> dict[int, Column]:
    return {k: _basis(t - F.lit(float(k))) for k in (-1, 0, 1, 2)}


KERNELS = {"bilinear": _bilinear, "cubic_spline": _cubic}


def resample_nearest(target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, value: str = "value") -> DataFrame:
    """Destination pixels with the value of the source pixel that holds their centre."""
    row, col = lonlat_to_pixel(*pixel_to_lonlat("row_id", "col_id", target_grid), source_grid)
    base = source.select(F.col("row_id").alias("_r"), F.col("col_id").alias("_c"), value)
    return target.withColumn("_r", row).withColumn("_c", col).join(base, ["_r", "_c"], "left").drop("_r", "_c")


def _neighbourhoods(source: DataFrame, value: str, offsets: list[int]) -> DataFrame:
    """One row per base cell with the values at (base + dr, base + dc) as columns."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in offsets for c in offsets])
    spread = (
        source.where(F.col(value).isNotNull())
        .withColumn("_o", F.explode(steps))
        .select(
            (F.col("row_id") - F.col("_o.dr")).alias("_r"),
            (F.col("col_id") - F.col("_o.dc")).alias("_c"),
            F.col("_o.dr").alias("dr"),
            F.col("_o.dc").alias("dc"),
            F.col(value).alias("v"),
        )
    )
    gathered = [
        F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("v"))).alias(_slot(r, c)) for r in offsets for c in offsets
    ]
    return spread.groupBy("_r", "_c").agg(*gathered)


def _slot(r: int, c: int) -> str:
    return f"_v_{r + 1}_{c + 1}"


def resample_smooth(
    target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, kernel: str, value: str = "value"
) -> DataFrame:
    """Weighted mean over the kernel; missing neighbours drop out and weights renormalise."""
    weights = KERNELS[kernel]
    offsets = list(weights(F.lit(0.0)))
    x, y = pixel_to_lonlat("row_id", "col_id", target_grid)
    u = (x - F.lit(source_grid.c)) / F.lit(source_grid.a) - F.lit(0.5)
    v = (y - F.lit(source_grid.f)) / F.lit(source_grid.e) - F.lit(0.5)
    placed = (
        target.withColumn("_u", u)
        .withColumn("_v", v)
        .withColumn("_r", F.floor("_v").cast("int"))
        .withColumn("_c", F.floor("_u").cast("int"))
    )
    by_row, by_col = weights(F.col("_v") - F.col("_r")), weights(F.col("_u") - F.col("_c"))
    weighted = placed.select(
        *target.columns,
        "_r",
        "_c",
        *[w.alias(_weight("r", k)) for k, w in by_row.items()],
        *[w.alias(_weight("c", k)) for k, w in by_col.items()],
    )
    joined = weighted.join(_neighbourhoods(source, value, offsets), ["_r", "_c"], "left")
    totals, masses = [], []
    for r in offsets:
        for c in offsets:
            w, cell = F.col(_weight("r", r)) * F.col(_weight("c", c)), F.col(_slot(r, c))
            totals.append(F.when(cell.isNotNull(), w * cell).otherwise(F.lit(0.0)))
            masses.append(F.when(cell.isNotNull(), w).otherwise(F.lit(0.0)))
    summed = joined.select(*target.columns, sum(totals[1:], totals[0]).alias("_total"), sum(masses[1:], masses[0]).alias("_mass"))
    mean = F.when(F.col("_mass") > 0, F.col("_total") / F.col("_mass"))
    return summed.withColumn(value, mean).drop("_total", "_mass")


def _weight(axis: str, offset: int) -> str:
    return f"_w{axis}_{offset + 1}"


def resample(target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, kernel: str, value: str = "value") -> DataFrame:
    cells = target.select(*PIXEL)
    if kernel == "nearest":
        return resample_nearest(cells, target_grid, source, source_grid, value)
    return resample_smooth(cells, target_grid, source, source_grid, kernel, value)
