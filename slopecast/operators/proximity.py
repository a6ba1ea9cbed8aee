"""Exact distance from every pixel to the nearest marked pixel, however far it is.

The squared distance is separable: first the vertical gap in each column by running
windows over row chunks that are handed the last marked row above and the next below,
then along each row the minimum of gap**2 + offset**2 with NumPy inside tasks that hold
a few whole rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import METRES_PER_PIXEL
from .pixels import PIXEL

CHUNK_ROWS = 4096
BLOCK_ROWS = 32
FAR = 1 << 60


def nearest_marked_gap(pixels: DataFrame, marked: str, name: str = "gap") -> DataFrame:
    """Rows between a pixel and the nearest marked pixel of its column, NULL in a column without any.

    Columns are cut into row chunks, so tall grids spread too. A small table of one row per
    column and chunk carries the marked rows nearest to each chunk's ends.
    """
    row = F.col("row_id")
    chunked = pixels.withColumn("_chunk", F.floor(row / CHUNK_ROWS))
    at = F.when(F.col(marked), row)
    column = W.partitionBy("col_id").orderBy("_chunk")
    ends = chunked.groupBy("col_id", "_chunk").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    ends = ends.select(
        "col_id",
        "_chunk",
        F.last("_last", ignorenulls=True).over(column.rowsBetween(W.unboundedPreceding, -1)).alias("_above_chunk"),
        F.last("_first", ignorenulls=True).over(W.partitionBy("col_id").orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)).alias("_below_chunk"),
    )
    line = W.partitionBy("col_id", "_chunk")
    above = F.last(at, ignorenulls=True).over(line.orderBy("row_id").rowsBetween(W.unboundedPreceding, 0))
    below = F.last(at, ignorenulls=True).over(line.orderBy(F.desc("row_id")).rowsBetween(W.unboundedPreceding, 0))
    placed = chunked.join(ends, ["col_id", "_chunk"]).withColumn("_above", above).withColumn("_below", below)
    gap = F.least(row - F.coalesce("_above", "_above_chunk"), F.coalesce("_below", "_below_chunk") - row)
    return placed.withColumn(name, gap.cast("int")).select(*pixels.columns, name)


def row_minimum(squared: np.ndarray) -> np.ndarray:
    """For each row of [row, column] costs the minimum over c of cost[c] + (column - c)**2.

    The best c never falls as the column grows, so columns are settled from coarse to fine
    strides, each searched only between the best places of its settled neighbours.
    """
    rows, width = squared.shape
    stride = 1 << max(0, (width - 1).bit_length())
    place = np.zeros((rows, width + 1), np.int64)
    best = np.empty((rows, width), np.int64)
    settled = np.zeros(width, bool)
    while stride:
        todo = np.arange(0, width, stride)
        todo = todo[~settled[todo]]
        if len(todo):
            low = np.where(todo >= stride, place[:, np.maximum(todo - stride, 0)], 0)
            after = todo + stride
            high = np.where(after < width, place[:, np.minimum(after, width)], width - 1)
            if stride >= width:
                high = np.full_like(high, width - 1)
            count = (high - low + 1).ravel()
            starts = np.cumsum(count) - count
            owner = np.repeat(np.arange(len(count)), count)
            tried = low.ravel()[owner] + np.arange(len(owner)) - starts[owner]
            row, column = np.divmod(owner, len(todo))
            cost = squared[row, tried] + (todo[column] - tried) ** 2
            least = np.minimum.reduceat(cost, starts)
            first = np.minimum.reduceat(np.where(cost == least[owner], tried, width), starts)
            best[:, todo] = least.reshape(rows, -1)
            place[:, todo] = first.reshape(rows, -1)
            settled[todo] = True
        stride //= 2
    return best


def _row_distances(meters: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        rows, row = np.unique(block["row_id"].to_numpy(), return_inverse=True)
        left = int(block["col_id"].min())
        col = block["col_id"].to_numpy().astype(np.int64) - left
        gap = block["gap"].to_numpy(dtype=float)
        squared = np.full((len(rows), int(col.max()) + 1), FAR, np.int64)
        squared[row, col] = np.where(np.isnan(gap), FAR, np.nan_to_num(gap).astype(np.int64) ** 2)
        value = row_minimum(squared)[row, col]
        distance = np.where(value >= FAR, np.nan, np.sqrt(value.astype(float)) * meters)
        return pd.DataFrame({"row_id": block["row_id"], "col_id": block["col_id"], "distance": distance})

    return run


def proximity(pixels: DataFrame, marked: str, meters: float = METRES_PER_PIXEL) -> DataFrame:
    """(row_id, col_id, distance) with sqrt(squared pixel distance) * meters, NULL only if nothing is marked.

    A task holds ``BLOCK_ROWS`` rows of the grid's width.
    """
    gaps = nearest_marked_gap(pixels.select(*PIXEL, marked), marked).select(*PIXEL, "gap")
    blocks = gaps.withColumn("_block", F.floor(F.col("row_id") / BLOCK_ROWS)).groupBy("_block")
    found = blocks.applyInPandas(_row_distances(meters), "row_id int, col_id int, distance double")
    return found.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))
