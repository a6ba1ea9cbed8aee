"""Piecewise-linear surfaces over a station network, on a pixel table; both of any size.

Stations are triangulated block by block. Every triangle is cut into runs of pixel centres, row by row, and the
runs of a stretch of ``STRETCH`` pixels of a row are one short list, because nearly every pixel lies in one triangle only
and triangles between pixel centres leave no run. A pixel finds its triangle in the list of its stretch
by one equi-join, whose side Spark chooses by size. Pixels outside the hull take the nearest station.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalar import as_col, pixel_to_lonlat, risk_formula
from ..session import materialise
from ..settings import Grid
from . import delaunay
from .nearest import nearest_neighbour
from .pixels import PIXEL

STRETCH = 64
EDGE_SLACK = 1e-9
#: Stations up to which they are one broadcast row for the nearest search; more go through the cell pyramid.
FEW_STATIONS = 256

triangulate, hidden_stations = delaunay.triangulate, delaunay.hidden_stations


def network(stations: DataFrame, values: list[str]) -> DataFrame:
    """``station_id, x, y`` and the values of one station for each position, landed."""
    kept = delaunay.positions(stations).select("station_id")
    return materialise(stations.select("station_id", "x", "y", *values).join(kept, "station_id"), "network")


def triangle_vertices(triangles: DataFrame, stations: DataFrame, values: list[str]) -> DataFrame:
    """Triangles with the coordinates and values of their three stations."""
    out = triangles
    for n, corner in enumerate(("i", "j", "k")):
        at = F.array(*[F.col(c).cast("double") for c in values]) if values else F.array().cast("array<double>")
        named = [F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), at.alias(f"v{n}")]
        out = out.join(stations.select(F.col("station_id").alias(corner), *named), corner)
    return out


def pixel_runs(t: pd.Series, grid: Grid, shape: tuple[int, int]) -> pd.DataFrame:
    """Rows and column ranges of the pixel centres in a triangle, its edges included."""
    x0, y0 = t["x0"], t["y0"]
    det = (t["x1"] - x0) * (t["y2"] - y0) - (t["x2"] - x0) * (t["y1"] - y0)
    a1, b1, a2, b2 = (t["y2"] - y0) / det, (x0 - t["x2"]) / det, (y0 - t["y1"]) / det, (t["x1"] - x0) / det
    ends = (np.array([t["y0"], t["y1"], t["y2"]]) - grid.f) / grid.e
    rows = np.arange(max(0, int(np.floor(ends.min())) - 1), min(shape[0] - 1, int(np.ceil(ends.max())) + 1) + 1)
    dy = grid.f + (rows + 0.5) * grid.e - y0
    start = grid.c + 0.5 * grid.a - x0
    low, high = np.zeros(len(rows)), np.full(len(rows), shape[1] - 1.0)
    # Each of the three weights is at least -EDGE_SLACK: slope * column + rest >= 0.
    for a, b, plus in ((a1, b1, 0.0), (a2, b2, 0.0), (-a1 - a2, -b1 - b2, 1.0)):
        slope, rest = a * grid.a, a * start + b * dy + plus + EDGE_SLACK
        if slope > 0:
            low = np.maximum(low, np.ceil(-rest / slope))
        elif slope < 0:
            high = np.minimum(high, np.floor(-rest / slope))
        else:
            high = np.where(rest >= 0, high, -1.0)
    good = low <= high
    rows, low, high = rows[good], low[good].astype(np.int64), high[good].astype(np.int64)
    pieces = high // STRETCH - low // STRETCH + 1
    at = np.repeat(np.arange(len(rows)), pieces)
    stretch = low[at] // STRETCH + np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return pd.DataFrame(
        {
            "row_id": rows[at], "stretch": stretch, "c0": np.maximum(low[at], stretch * STRETCH), "c1": np.minimum(high[at], stretch * STRETCH + STRETCH - 1),
            "a1": a1, "b1": b1, "a2": a2, "b2": b2,
        }
    )


class SurfaceIndex:
    """Runs of one station network's triangles over a grid, and its stations."""

    def __init__(self, stations: DataFrame, values: list[str], grid: Grid, shape: tuple[int, int]):
        self.values, self.grid = values, grid
        self.stations = network(stations, values)
        corners = triangle_vertices(triangulate(self.stations), self.stations, values)
        kind = corners.schema["i"].dataType.simpleString()
        named = [c for c in corners.columns if c not in ("x1", "y1", "x2", "y2")]

        def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, t in batch.iterrows():
                    found = pixel_runs(t, grid, shape)
                    if len(found):
                        for c in named:
                            found[c] = [t[c]] * len(found)
                        yield found

        kinds = dict(corners.dtypes)
        schema = "row_id int, stretch int, c0 int, c1 int, a1 double, b1 double, a2 double, b2 double, " + ", ".join(f"{c} {kind if c in 'ijk' else kinds[c]}" for c in named)
        order = ["i", "j", "k", "c0", "c1", "x0", "y0", "a1", "b1", "a2", "b2", "v0", "v1", "v2"]
        lists = corners.mapInPandas(runs, schema).groupBy("row_id", "stretch").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_runs"))
        self.frame = materialise(lists, "runs")

    def locate(self, pixels: DataFrame) -> DataFrame:
        """Add ``_hit``, the containing triangle (of several the least i, j, k) or NULL."""
        x, y = pixel_to_lonlat("row_id", "col_id", self.grid)
        keyed = pixels.withColumns({"_x": x, "_y": y, "_stretch": F.floor(F.col("col_id") / STRETCH).cast("int")})
        lists = self.frame.select(F.col("row_id").alias("_row"), F.col("stretch").alias("_stretch"), "_runs")
        found = keyed.join(lists, (F.col("row_id") == F.col("_row")) & (keyed["_stretch"] == lists["_stretch"]), "left")
        hit = F.get(F.filter("_runs", lambda r: (F.col("col_id") >= r["c0"]) & (F.col("col_id") <= r["c1"])), F.lit(0))
        return found.select(*keyed.columns[:-1], hit.alias("_hit"))

    def nearest(self, outside: DataFrame) -> DataFrame:
        """Add ``_values``, those of the station nearest to each pixel centre; ties go to the lowest id. For any number of stations."""
        values = F.array(*[F.col(c).cast("double") for c in self.values]) if self.values else F.array().cast("array<double>")
        asked = outside.withColumn("_pixel", F.shiftleft(F.col("row_id").cast("long"), 32) + F.col("col_id"))
        found = nearest_neighbour(asked, self.stations, "_pixel", "station_id", ("_x", "_y"), ("x", "y")).drop("distance")
        return asked.join(found.join(self.stations.select("station_id", values.alias("_values")), "station_id"), "_pixel").select(*outside.columns, "_values")

    def interpolate(self, pixels: DataFrame, nearest: bool = True) -> DataFrame:
        """Add every value, linear inside the hull and, if asked, from the nearest station elsewhere."""
        located = self.locate(pixels)
        t = F.col("_hit")
        dx, dy = F.col("_x") - t["x0"], F.col("_y") - t["y0"]
        w1, w2 = t["a1"] * dx + t["b1"] * dy, t["a2"] * dx + t["b2"] * dy
        keep = [F.col(c) for c in pixels.columns]
        linear = [t["v0"][n] + w1 * (t["v1"][n] - t["v0"][n]) + w2 * (t["v2"][n] - t["v0"][n]) for n, c in enumerate(self.values)]
        inner = [value.alias(c) for value, c in zip(linear, self.values)]
        if not nearest:
            return located.select(*keep, *inner, t.isNotNull().alias("in_hull"))
        few = self.stations.orderBy("station_id").limit(FEW_STATIONS + 1).collect()
        if 0 < len(few) <= FEW_STATIONS:  # one pass: each pixel is located once, inside or not
            site = nearest_site(few)("_x", "_y", t.isNull())
            sited = located.where(F.col("row_id").isNotNull()).withColumn("_site", site)
            known = [F.array(*[F.lit(r[c]).cast("double") for r in few]) for c in self.values]
            either = [F.when(t.isNotNull(), value).otherwise(F.get(at, F.col("_site"))).alias(c) for value, at, c in zip(linear, known, self.values)]
            return sited.select(*keep, *either, t.isNotNull().alias("in_hull"))
        inside = located.where(t.isNotNull()).select(*keep, *inner, F.lit(True).alias("in_hull"))
        outside = self.nearest(located.where(t.isNull()).drop("_hit"))
        taken = [F.col("_values")[n].alias(c) for n, c in enumerate(self.values)]
        return inside.unionAll(outside.select(*keep, *taken, F.lit(False).alias("in_hull")))


def nearest_site(sites: list[Row]):
    """The place in a short list, in the order of ids, of the site nearest to (x, y); ties go to the first, NULL where it is not asked for."""
    sx, sy = (np.array([[r[c]] for r in sites], float) for c in "xy")

    @F.pandas_udf("int")
    def place(x: pd.Series, y: pd.Series, asked: pd.Series) -> pd.Series:
        wanted = asked.to_numpy(bool)
        out = np.full(len(x), -1, np.int32)
        if wanted.any():
            dx, dy = x.to_numpy()[wanted] - sx, y.to_numpy()[wanted] - sy
            far = dx * dx + dy * dy
            out[wanted] = np.where(np.isnan(far), np.inf, far).argmin(0)  # NaN is larger than any number
        return pd.Series(out).mask(~wanted)

    return place.asNondeterministic()  # else a condition on the result is pushed below and locates each pixel again


def grid_shape(pixels: DataFrame) -> tuple[int, int]:
    row = pixels.agg(F.max("row_id").alias("r"), F.max("col_id").alias("c")).first()
    return row["r"] + 1, row["c"] + 1


def containing_triangle(pixels: DataFrame, stations: DataFrame, grid: Grid, shape: tuple[int, int] | None = None) -> DataFrame:
    """(row_id, col_id, i, j, k) of the triangle that holds each pixel centre."""
    index = SurfaceIndex(stations, [], grid, shape or grid_shape(pixels))
    located = index.locate(pixels.select(*PIXEL)).where("_hit is not null")
    return located.select(*PIXEL, "_hit.i", "_hit.j", "_hit.k")


def interpolate(
    pixels: DataFrame,
    stations: DataFrame,
    values: list[str],
    grid: Grid,
    shape: tuple[int, int] | None = None,
    nearest: bool = True,
) -> DataFrame:
    """Pixel table with station values interpolated to every pixel; all values share one lookup."""
    return SurfaceIndex(stations, values, grid, shape or grid_shape(pixels)).interpolate(pixels, nearest)


def risk_layers(
    pixels: DataFrame, stations: DataFrame, layers: dict[str, str], grid: Grid, score: str = "score", shape=None
) -> DataFrame:
    """(row_id, col_id, layer, risk) for each named trigger column, from one interpolation."""
    base = pixels.select(*PIXEL, score).where(as_col(score).isNotNull())
    surface = interpolate(base, stations, list(layers.values()), grid, shape)
    fused = surface.select(*PIXEL, *[risk_formula(score, trigger).alias(name) for name, trigger in layers.items()])
    return fused.unpivot(PIXEL, list(layers), "layer", "risk")


def risk_map(pixels: DataFrame, stations: DataFrame, grid: Grid, trigger: str, score: str = "score", shape=None) -> DataFrame:
    """Pixels with interpolated trigger and fused risk; pixels without a score drop out."""
    base = pixels.select(*PIXEL, score).where(as_col(score).isNotNull())
    surface = interpolate(base, stations, [trigger], grid, shape)
    return surface.withColumn("risk", risk_formula(score, trigger))
