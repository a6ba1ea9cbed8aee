"""Exact nearest neighbour and distance joins over unbounded point sets.

Sites are summarised in a pyramid of grid cells, each four times finer per axis
than the one above. The cells of the query points walk down it together and keep
only the site cells that can still hold a nearest site of one of their points. A
cell with a short list of such sites is settled, and each of its points is then
compared with that list by one equi-join. So a point is shuffled once or twice
however deep the pyramid is, and never meets all sites of a dense cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import all_of, lonlat_to_pixel, pixel_to_lonlat
from ..session import materialise
from ..settings import Grid

FAN = 4
LEAF_SITES = 16
MAX_LEVEL = 24
BROADCAST_LEVEL = 4  # at most FAN**(2*4) = 65,536 cells
#: A cell of queries goes no deeper once so few sites are left to it.
SHORT_LIST = 48
#: At the last level longer lists are settled too; queries of a cell with still more sites walk on one by one.
LONG_LIST = 1024


def _cell(value: Column, origin: float, side: float) -> Column:
    return F.floor((value - F.lit(origin)) / F.lit(side)).cast("long")


def _with_cell(points: DataFrame, extent: tuple[float, float, float], level: int) -> DataFrame:
    x0, y0, side = extent
    s = side / FAN**level
    return points.withColumn("ix", _cell(F.col("sx"), x0, s)).withColumn("iy", _cell(F.col("sy"), y0, s))


def _pyramid(sites: DataFrame) -> tuple[tuple[float, float, float], int]:
    """Extent and the level at which no cell holds more than LEAF_SITES sites."""
    e = sites.agg(
        F.min("sx").alias("x1"),
        F.max("sx").alias("x2"),
        F.min("sy").alias("y1"),
        F.max("sy").alias("y2"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not e["n"]:
        raise ValueError("nearest-neighbour search needs at least one site")
    side = max(e["x2"] - e["x1"], e["y2"] - e["y1"]) * (1 + 1e-9) or 1.0
    extent = (e["x1"], e["y1"], side)
    level, full = 0, e["n"]
    while level < 1 or (full > LEAF_SITES and level < MAX_LEVEL):
        level += 1
        if FAN ** (2 * level) * LEAF_SITES < e["n"]:
            continue  # too coarse even for an even spread
        cells = _with_cell(sites, extent, level).groupBy("ix", "iy").count()
        full = cells.agg(F.max("count")).first()[0]
    return extent, level


def _asked_cell(extent: tuple[float, float, float], level: int) -> list[Column]:
    """Cell of a query point; points over FAN**6 extents away share the outermost cells."""
    x0, y0, side = extent
    s, far = side / FAN**level, float(FAN ** (level + 6))

    def cell(value: str, origin: float) -> Column:
        at = (F.col(value) - F.lit(origin)) / F.lit(s)
        return F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), at)))

    return [cell("qx", x0).alias("ax"), cell("qy", y0).alias("ay")]


def _box(x: str, y: str, names: list[str]) -> list[Column]:
    return [f(v).alias(name) for (f, v), name in zip(((F.min, x), (F.max, x), (F.min, y), (F.max, y)), names)]


SITE_BOX, ASKED_BOX = ["x1", "x2", "y1", "y2"], ["u1", "u2", "v1", "v2"]


def _merged(leaves: DataFrame, cell: list[str], box: list[str], up: int) -> DataFrame:
    """Cells ``up`` levels above the leaves, with their boxes and, for sites, their counts."""
    above = [F.shiftright(c, 2 * up).alias(c) for c in cell]
    lows = [f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max), box)]
    count = [F.sum("n").alias("n")] if "n" in leaves.columns else []
    return leaves.groupBy(*above).agg(*lows, *count)


def _settle(asked: DataFrame, sites: DataFrame, depth: int, reach: Column) -> tuple[dict[int, DataFrame], DataFrame | None]:
    """Pairs (ax, ay, cx, cy) of settled query cells and the site cells left to them by level, and the pairs never settled."""
    settled: dict[int, DataFrame] = {}
    open_pairs = None
    for level in range(1, depth + 1):
        cells = _merged(sites, ["cx", "cy"], SITE_BOX, depth - level)
        boxes = _merged(asked, ["ax", "ay"], ASKED_BOX, depth - level)
        if open_pairs is None:
            top = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long")))
            met = boxes.withColumn("cx", top).withColumn("cy", top).join(cells, ["cx", "cy"])
        else:
            above = open_pairs.select(*[F.col(c).alias(f"_{c}") for c in ("ax", "ay", "cx", "cy")])
            for part, x, y in ((boxes, "ax", "ay"), (cells, "cx", "cy")):
                parents = part.withColumn(f"_{x}", F.shiftright(x, 2)).withColumn(f"_{y}", F.shiftright(y, 2))
                above = above.join(parents, [f"_{x}", f"_{y}"])
            met = above
        gap_x = F.greatest(F.col("x1") - F.col("u2"), F.col("u1") - F.col("x2"), F.lit(0.0))
        gap_y = F.greatest(F.col("y1") - F.col("v2"), F.col("v1") - F.col("y2"), F.lit(0.0))
        far_x = F.greatest(F.abs(F.col("u2") - F.col("x1")), F.abs(F.col("x2") - F.col("u1")))
        far_y = F.greatest(F.abs(F.col("v2") - F.col("y1")), F.abs(F.col("y2") - F.col("v1")))
        one = W.partitionBy("ax", "ay")
        pairs = (
            met.withColumn("_near", gap_x * gap_x + gap_y * gap_y)
            .withColumn("_far", far_x * far_x + far_y * far_y)
            .where(F.col("_near") <= reach * F.lit(1 + 1e-9))
            .withColumn("_bound", F.min("_far").over(one))
            .where(F.col("_near") <= F.col("_bound") * F.lit(1 + 1e-9))
            .select("ax", "ay", "cx", "cy", F.sum("n").over(one).alias("_left"))
        )
        pairs = materialise(pairs, "nearest-pairs")
        short = F.col("_left") <= F.lit(SHORT_LIST if level < depth else LONG_LIST)
        done, more = pairs.agg(F.count_if(short), F.count_if(~short)).first()
        if done:
            settled[level] = pairs.where(short).drop("_left")
        open_pairs = pairs.where(~short).drop("_left")
        if not more:
            return settled, None
    return settled, open_pairs


def _walk(front: DataFrame, unique: DataFrame, extent: tuple[float, float, float], depth: int, reach: Column) -> DataFrame:
    """(_query, b) for queries that go down the pyramid one by one."""
    top = F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))
    front = front.withColumn("ix", top).withColumn("iy", top)  # the cells of level 1
    for level in range(1, depth + 1):
        cells = (
            _with_cell(unique, extent, level)
            .groupBy(F.col("ix").alias("cx"), F.col("iy").alias("cy"))
            .agg(F.min("sx").alias("x1"), F.max("sx").alias("x2"), F.min("sy").alias("y1"), F.max("sy").alias("y2"))
            .withColumn("ix", F.floor(F.col("cx") / FAN) if level > 1 else F.col("cx"))
            .withColumn("iy", F.floor(F.col("cy") / FAN) if level > 1 else F.col("cy"))
        )
        if level <= BROADCAST_LEVEL:
            cells = F.broadcast(cells)
        gap_x = F.greatest(F.col("x1") - F.col("qx"), F.col("qx") - F.col("x2"), F.lit(0.0))
        gap_y = F.greatest(F.col("y1") - F.col("qy"), F.col("qy") - F.col("y2"), F.lit(0.0))
        far_x = F.greatest(F.abs(F.col("qx") - F.col("x1")), F.abs(F.col("qx") - F.col("x2")))
        far_y = F.greatest(F.abs(F.col("qy") - F.col("y1")), F.abs(F.col("qy") - F.col("y2")))
        bound = F.min("_far").over(W.partitionBy("_query"))
        front = (
            front.join(cells, ["ix", "iy"])
            .withColumn("_near", gap_x * gap_x + gap_y * gap_y)
            .withColumn("_far", far_x * far_x + far_y * far_y)
            .where(F.col("_near") <= reach * F.lit(1 + 1e-9))
            .withColumn("_bound", bound)
            .where(F.col("_near") <= F.col("_bound") * F.lit(1 + 1e-9))
            .select("_query", "qx", "qy", F.col("cx").alias("ix"), F.col("cy").alias("iy"))
        )
    dx, dy = F.col("qx") - F.col("sx"), F.col("qy") - F.col("sy")
    met = front.join(_with_cell(unique, extent, depth), ["ix", "iy"]).withColumn("_d", F.sqrt(dx * dx + dy * dy))
    return met.groupBy("_query").agg(F.min(F.struct("_d", "_site")).alias("b"))


def nearest_neighbour(
    queries: DataFrame,
    sites: DataFrame,
    query_id: str,
    site_id: str,
    query_xy: tuple[str, str] = ("longitude", "latitude"),
    site_xy: tuple[str, str] = ("longitude", "latitude"),
    within: float | None = None,
) -> DataFrame:
    """(query_id, site_id, distance) of the nearest site; ties go to the lowest site id.

    With ``within`` only pairs at most that far apart are returned.
    """
    unique = (
        sites.select(F.col(site_xy[0]).alias("sx"), F.col(site_xy[1]).alias("sy"), F.col(site_id).alias("_site"))
        .where("sx is not null and sy is not null")
        .groupBy("sx", "sy")
        .agg(F.min("_site").alias("_site"))
    )
    unique = materialise(unique, "nearest-sites")
    extent, depth = _pyramid(unique)
    front = queries.select(
        F.col(query_id).alias("_query"), F.col(query_xy[0]).alias("qx"), F.col(query_xy[1]).alias("qy")
    ).where("qx is not null and qy is not null")
    reach = F.lit(float("inf") if within is None else within * within)
    asked = front.groupBy(*_asked_cell(extent, depth)).agg(*_box("qx", "qy", ASKED_BOX))
    cells = _with_cell(unique, extent, depth).groupBy(F.col("ix").alias("cx"), F.col("iy").alias("cy"))
    leaves = cells.agg(*_box("sx", "sy", SITE_BOX), F.count(F.lit(1)).alias("n"))
    settled, open_pairs = _settle(materialise(asked, "nearest-asked"), materialise(leaves, "nearest-leaves"), depth, reach)

    def ranked(s: Column) -> Column:
        dx, dy = F.col("qx") - s["sx"], F.col("qy") - s["sy"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("_d"), s["_site"].alias("_site"))

    found = []
    for level, pairs in settled.items():
        placed = _with_cell(unique, extent, level).withColumnsRenamed({"ix": "cx", "iy": "cy"})
        lists = pairs.join(placed, ["cx", "cy"]).groupBy("ax", "ay").agg(F.collect_list(F.struct("sx", "sy", "_site")).alias("_sites"))
        met = front.select("*", *_asked_cell(extent, level)).join(lists, ["ax", "ay"])
        found.append(met.select("_query", F.array_min(F.transform("_sites", ranked)).alias("b")))
    if open_pairs is not None or not found:
        rest = front.select("*", *_asked_cell(extent, depth))
        rest = rest.limit(0) if open_pairs is None else rest.join(open_pairs.select("ax", "ay").distinct(), ["ax", "ay"], "left_semi")
        found.append(_walk(rest.select("_query", "qx", "qy"), unique, extent, depth, reach))
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    best = (
        every.groupBy("_query")
        .agg(F.min("b").alias("b"))
        .select(F.col("_query").alias(query_id), F.col("b._site").alias(site_id), F.col("b._d").alias("distance"))
    )
    return best if within is None else best.where(F.col("distance") <= F.lit(within))


def distance_anti_join(
    candidates: DataFrame, sites: DataFrame, candidate_id: str, site_id: str, distance: float, **xy: tuple[str, str]
) -> DataFrame:
    """Candidates with no site within ``distance`` (inclusive)."""
    if sites.isEmpty():
        return candidates
    near = nearest_neighbour(candidates, sites, candidate_id, site_id, within=distance, **xy)
    return candidates.join(near.select(candidate_id), candidate_id, "left_anti")


def pixels_near_points(points: DataFrame, grid: Grid, distance: float, xy: tuple[str, str]) -> DataFrame:
    """Distinct (row_id, col_id) whose centre is within ``distance`` of a point.

    Each point marks the few pixels around it, so work is linear in the points and
    copies collapse before the shuffle.
    """
    x, y = F.col(xy[0]), F.col(xy[1])
    row, col = lonlat_to_pixel(x, y, grid)
    reach_row = int(distance / abs(grid.e)) + 1
    reach_col = int(distance / abs(grid.a)) + 1
    marked = (
        points.where(all_of([x.isNotNull(), y.isNotNull()]))
        .select(x.alias("x"), y.alias("y"), row.alias("r"), col.alias("c"))
        .withColumn("row_id", F.explode(F.sequence(F.col("r") - reach_row, F.col("r") + reach_row)))
        .withColumn("col_id", F.explode(F.sequence(F.col("c") - reach_col, F.col("c") + reach_col)))
    )
    px, py = pixel_to_lonlat("row_id", "col_id", grid)
    dx, dy = px - F.col("x"), py - F.col("y")
    return marked.where(F.sqrt(dx * dx + dy * dy) <= F.lit(distance)).select("row_id", "col_id").distinct()
