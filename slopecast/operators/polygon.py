"""Vertex-table polygons and line segments: edges, containment, lattices and burning.

A vertex table has (feature_id, part_id, seq, x, y) with seq dense from 0 in each ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..settings import Grid
from .pixels import PIXEL

RING = ["feature_id", "part_id"]
EDGE = ["x1", "y1", "x2", "y2"]


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(feature_id, part_id, x1, y1, x2, y2) with every ring closed.

    Neighbours meet by an equi-join on the position, so a ring of any length spreads
    over all tasks.
    """
    here = vertices.select(*RING, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    after = vertices.select(*RING, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    steps = here.join(after, [*RING, "seq"]).select(*RING, *EDGE)
    ends = vertices.groupBy(*RING).agg(
        F.max(F.struct("seq", "x", "y")).alias("last"), F.min(F.struct("seq", "x", "y")).alias("first")
    )
    closing = ends.select(
        *RING,
        F.col("last.x").alias("x1"),
        F.col("last.y").alias("y1"),
        F.col("first.x").alias("x2"),
        F.col("first.y").alias("y2"),
    ).where("x1 != x2 or y1 != y2")
    return steps.unionByName(closing)


def extent(points: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(by or [])).agg(
        F.min(x).alias("min_x"),
        F.max(x).alias("max_x"),
        F.min(y).alias("min_y"),
        F.max(y).alias("max_y"),
        F.count(F.lit(1)).alias("rows"),
    )


def centroid(edges: DataFrame, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Area-weighted centroid of each feature; a near origin keeps the sums accurate."""
    ox, oy = F.lit(origin[0]), F.lit(origin[1])
    x1, y1, x2, y2 = F.col("x1") - ox, F.col("y1") - oy, F.col("x2") - ox, F.col("y2") - oy
    cross = x1 * y2 - x2 * y1
    sums = edges.groupBy("feature_id").agg(
        F.sum(cross).alias("a"), F.sum((x1 + x2) * cross).alias("mx"), F.sum((y1 + y2) * cross).alias("my")
    )
    return sums.where("a != 0").select(
        "feature_id",
        (ox + F.col("mx") / (F.lit(3.0) * F.col("a"))).alias("x"),
        (oy + F.col("my") / (F.lit(3.0) * F.col("a"))).alias("y"),
        (F.abs("a") / F.lit(2.0)).alias("area"),
    )


def _cells(lo: Column, hi: Column, side: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / F.lit(side)).cast("long"), F.floor(hi / F.lit(side)).cast("long")))


def _strictly_inside(pairs: DataFrame, edges: DataFrame, point_id: str, band: float) -> DataFrame:
    """(point_id, feature_id) pairs whose point (px, py) is strictly inside its feature.

    Edges are listed under each horizontal band they touch, so a point only meets
    the edges of its own band.
    """
    banded = edges.select("feature_id", *EDGE, _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), band).alias("_band"))
    px, py = F.col("px"), F.col("py")
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    crosses = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / F.when(y1 != y2, y2 - y1))
    on_edge = (
        ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1))
        & px.between(F.least(x1, x2), F.greatest(x1, x2))
        & py.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    met = (
        pairs.withColumn("_band", F.floor(py / F.lit(band)).cast("long"))
        .join(banded, ["feature_id", "_band"])
        .where(px <= F.greatest(x1, x2))  # an edge wholly to the left of a point neither crosses its ray nor holds it
        .select(point_id, "feature_id", F.coalesce(crosses, F.lit(False)).alias("crosses"), on_edge.alias("on_edge"))
        .where("crosses or on_edge")
    )
    odd = met.groupBy(point_id, "feature_id").agg(
        F.count_if("crosses").alias("n"), F.count_if("on_edge").alias("touching")
    )
    return odd.where("n % 2 = 1 and touching = 0").select(point_id, "feature_id")


def points_in_polygons(
    points: DataFrame, edges: DataFrame, point_id: str, cell: float, xy: tuple[str, str] = ("longitude", "latitude")
) -> DataFrame:
    """(point_id, feature_id) for every polygon that strictly contains a point."""
    boxes = edges.groupBy("feature_id").agg(
        F.min(F.least("x1", "x2")).alias("bx1"),
        F.max(F.greatest("x1", "x2")).alias("bx2"),
        F.min(F.least("y1", "y2")).alias("by1"),
        F.max(F.greatest("y1", "y2")).alias("by2"),
    )
    columns = boxes.withColumn("_ix", _cells(F.col("bx1"), F.col("bx2"), cell))
    covered = columns.withColumn("_iy", _cells(F.col("by1"), F.col("by2"), cell))
    placed = points.select(F.col(point_id), F.col(xy[0]).alias("px"), F.col(xy[1]).alias("py"))
    placed = placed.withColumn("_ix", F.floor(F.col("px") / F.lit(cell)).cast("long"))
    placed = placed.withColumn("_iy", F.floor(F.col("py") / F.lit(cell)).cast("long"))
    in_box = F.col("px").between(F.col("bx1"), F.col("bx2")) & F.col("py").between(F.col("by1"), F.col("by2"))
    pairs = placed.join(covered, ["_ix", "_iy"]).where(in_box).select(point_id, "feature_id", "px", "py")
    return _strictly_inside(pairs, edges, point_id, cell)


def row_spans(edges: DataFrame, grid: Grid) -> DataFrame:
    """Open x intervals inside each feature along the centre line of each pixel row."""
    first = F.floor((F.greatest("y1", "y2") - F.lit(grid.f)) / F.lit(grid.e)).cast("int")
    last = F.floor((F.least("y1", "y2") - F.lit(grid.f)) / F.lit(grid.e)).cast("int") + 1
    crossing = (
        edges.withColumn("row_id", F.explode(F.sequence(first, last)))
        .withColumn("py", F.lit(grid.f) + (F.col("row_id") + F.lit(0.5)) * F.lit(grid.e))
        .where((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py")))
        .withColumn("x", F.expr("x1 + (py - y1) * (x2 - x1) / (y2 - y1)"))
    )
    line = W.partitionBy("feature_id", "row_id").orderBy("x")
    paired = crossing.withColumn("n", F.row_number().over(line)).withColumn("x_to", F.lead("x").over(line))
    return paired.where("n % 2 = 1").select("feature_id", "row_id", F.col("x").alias("x_from"), "x_to")


def _touched_rows(edges: DataFrame, grid: Grid) -> DataFrame:
    """Vertices and level edges that lie exactly on a row's centre line."""
    tips = edges.select("x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    flat = edges.where("y1 = y2").select(*EDGE)
    rows = tips.unionByName(flat).withColumn("row_id", F.floor((F.col("y1") - F.lit(grid.f)) / F.lit(grid.e)).cast("int"))
    on_line = F.col("y1") == F.lit(grid.f) + (F.col("row_id") + F.lit(0.5)) * F.lit(grid.e)
    return rows.where(on_line).select("row_id", F.least("x1", "x2").alias("t1"), F.greatest("x1", "x2").alias("t2"))


def clip_to_polygon(pixels: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """Pixels whose centre is strictly inside the polygons.

    The boundary becomes a few intervals per pixel row; pixels then need one join on
    the row and no aggregation.
    """
    px = F.lit(grid.c) + (F.col("col_id") + F.lit(0.5)) * F.lit(grid.a)
    spans = row_spans(edges, grid).select(F.col("row_id").alias("_r"), "x_from", "x_to")
    inside = pixels.join(spans, (F.col("row_id") == F.col("_r")) & (px > F.col("x_from")) & (px < F.col("x_to")), "left_semi")
    touched = _touched_rows(edges, grid).withColumnRenamed("row_id", "_r")
    on_line = (F.col("row_id") == F.col("_r")) & (px >= F.col("t1")) & (px <= F.col("t2"))
    return inside.join(touched, on_line, "left_anti")


def _axis(lo: Column, hi: Column, i: Column, n: int) -> Column:
    """The i-th of n evenly spaced positions, both ends exact."""
    return F.when(i == n - 1, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(n - 1))))


def sample_lattice(vertices: DataFrame, n: int, band: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Distinct (feature_id, x, y): lattice points inside each feature, and its centroid.

    A box is a small row that becomes n * n points. Spark knows only the rows' size, so it would make all
    points of a whole table in one task or broadcast them: boxes are dealt out first, and the join sorts.
    """
    edges = ring_edges(vertices)
    box = extent(vertices, "x", "y", ["feature_id"]).drop("rows")
    dealt = box.repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by a key, Spark would drop it
    px = _axis(F.col("min_x"), F.col("max_x"), F.col("i"), n)
    py = _axis(F.col("min_y"), F.col("max_y"), F.col("j"), n)
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lattice = dealt.withColumn("i", steps).withColumn("j", steps).select("feature_id", (F.col("i") * n + F.col("j")).alias("lattice_id"), px.alias("px"), py.alias("py"))
    inside = _strictly_inside(lattice.hint("merge"), edges, "lattice_id", band)
    kept = inside.withColumn("i", F.expr(f"lattice_id div {n}")).withColumn("j", F.col("lattice_id") % n).join(box, "feature_id")
    points = kept.select("feature_id", px.alias("x"), py.alias("y"))
    return points.unionByName(centroid(edges, origin).select("feature_id", "x", "y")).distinct()


def bbox_filter(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Segments whose bounding box meets (min_x, min_y, max_x, max_y)."""
    min_x, min_y, max_x, max_y = (F.lit(v) for v in box)
    return segments.where(
        (F.greatest("x1", "x2") >= min_x)
        & (F.least("x1", "x2") <= max_x)
        & (F.greatest("y1", "y2") >= min_y)
        & (F.least("y1", "y2") <= max_y)
    )


def line_cells(segments: DataFrame, grid: Grid) -> DataFrame:
    """Distinct pixels that segments pass through, however short the cut corner.

    A segment is clipped to each pixel row that it meets, and the columns of the clipped part
    follow from its two ends. A pixel holds its first row and column edge and not its last, so
    a line through a corner burns the pixel that owns the corner. A segment with a missing
    coordinate burns nothing; one of no length burns its own pixel.
    """
    ends = segments.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in EDGE)).select(
        *[((F.col(x) - F.lit(grid.c)) / F.lit(grid.a)).alias(u) for x, u in (("x1", "u1"), ("x2", "u2"))],
        *[((F.col(y) - F.lit(grid.f)) / F.lit(grid.e)).alias(v) for y, v in (("y1", "v1"), ("y2", "v2"))],
    )
    down = F.col("v1") <= F.col("v2")
    upper, lower = F.struct(F.col("v1").alias("v"), F.col("u1").alias("u")), F.struct(F.col("v2").alias("v"), F.col("u2").alias("u"))
    turned = ends.select(F.when(down, upper).otherwise(lower).alias("s"), F.when(down, lower).otherwise(upper).alias("t"))
    rows = F.sequence(F.floor("s.v").cast("int"), F.floor("t.v").cast("int"))
    cut = turned.select("s", "t", F.explode(rows).alias("row_id"))

    def across(v: Column) -> Column:
        return F.col("s.u") + (F.col("t.u") - F.col("s.u")) * ((v - F.col("s.v")) / (F.col("t.v") - F.col("s.v")))

    # Only a row's last edge is open, and only where the segment goes on below it.
    level = F.col("s.v") == F.col("t.v")
    enters = F.when(F.col("row_id") <= F.col("s.v"), F.col("s.u")).otherwise(across(F.col("row_id")))
    goes_on = ~level & (F.col("row_id") + 1 <= F.col("t.v"))
    leaves = F.when(goes_on, across(F.col("row_id") + 1)).otherwise(F.col("t.u"))
    met = cut.select("row_id", enters.alias("a"), leaves.alias("b"), goes_on.alias("open"))
    first = F.floor(F.least("a", "b"))
    last = F.when(F.col("open") & (F.col("b") > F.col("a")), F.greatest(F.ceil("b") - 1, first)).otherwise(F.floor(F.greatest("a", "b")))
    return met.select("row_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("col_id")).distinct()


def rasterize_lines(pixels: DataFrame, segments: DataFrame, grid: Grid, name: str = "burned") -> DataFrame:
    """Pixel table with 1 where a segment passes and 0 elsewhere."""
    burned = line_cells(segments, grid).withColumn(name, F.lit(1))
    return pixels.select(*PIXEL).join(burned, PIXEL, "left").withColumn(name, F.coalesce(name, F.lit(0)))
