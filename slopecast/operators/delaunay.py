"""Delaunay triangulation of station networks of any size, block by block.

Stations are put in Morton order and cut into blocks of at most ``BLOCK`` with a bounding box each, so a dense cluster
has many small blocks. A task holds one block and the blocks it has asked for, and finds the triangles
around each of its stations. A triangle counts once every block that its circle meets is held; the
circles of the others name the blocks that are fetched for the next round. The corners of the
convex hull are in every candidate set, so a station with an open side lies on the hull.

Equal circles are settled by a tiny weight per station, proportional to the squared distance of its own nearest
neighbour, so that it is small beside the local spacing everywhere. Every task uses the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = 256
#: Blocks that each open circle asks for in a round, those nearest to its centre first, and neighbours held from the start.
ASKED, NEIGHBOURS = 4, 9
TIE_SHARE = 1e-6  # of the squared distance of the nearest neighbour
TIE_RATIO = 0.6180339887
#: A corner area below this share of the squared longest side is a sliver along the hull.
FLAT_SHARE = 1e-11
NEAR_SEEDS = 24


def positions(stations: DataFrame) -> DataFrame:
    """One station for each position: the lowest id. Rows without a coordinate have no position."""
    placed = stations.where("x IS NOT NULL AND y IS NOT NULL")
    return placed.groupBy("x", "y").agg(F.min("station_id").alias("station_id"))


def hidden_stations(stations: DataFrame) -> DataFrame:
    """``station_id, kept_id`` of the stations that give way to one with a lower id at the same position."""
    kept = positions(stations).withColumnRenamed("station_id", "kept_id")
    return stations.join(kept, ["x", "y"]).where("station_id <> kept_id").select("station_id", "kept_id")


def morton(x: np.ndarray, y: np.ndarray, extent: tuple[float, float, float]) -> np.ndarray:
    """Interleaved bits of the position in the extent."""
    x0, y0, side = extent
    code = np.zeros(len(x), np.int64)
    for shift, values in enumerate(((x - x0) / side, (y - y0) / side)):
        cell = np.clip(values * ((1 << 31) - 1), 0, (1 << 31) - 1).astype(np.int64)
        for bit in range(31):
            code |= (cell >> bit & 1) << (2 * bit + shift)
    return code


def blocked(stations: DataFrame, block: int) -> DataFrame:
    """``block, station_id, x, y``, landed: runs of the Morton order."""
    unique = materialise(positions(stations).select(F.col("station_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")), "stations")
    e = unique.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("n")).first()
    if not e["n"]:
        return unique.select(F.lit(0).cast("long").alias("block"), "station_id", "x", "y")
    extent = (e["x1"], e["y1"], max(e["x2"] - e["x1"], e["y2"] - e["y1"]) or 1.0)

    @F.pandas_udf("long")
    def code(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(morton(x.to_numpy(), y.to_numpy(), extent))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, base = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            batch["block"] = base + (seen + np.arange(len(batch))) // block
            seen += len(batch)
            yield batch[["block", "station_id", "x", "y"]]

    slices = max(1, ceil(e["n"] / (64 * block)))
    ordered = unique.withColumn("code", code("x", "y")).repartitionByRange(slices, "code", "x", "y").sortWithinPartitions("code", "x", "y")
    return materialise(ordered.mapInPandas(numbered, "block long, station_id long, x double, y double"), "blocks")


def hull(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull, counter-clockwise (monotone chain)."""
    order = np.lexsort((y, x))

    def chain(seq: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in seq.tolist():
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1] or order[:1].tolist(), np.int64)


def hull_rows(stations: DataFrame) -> pd.DataFrame:
    """Corners of the hull of all stations, from the hulls of the partitions."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = held.iloc[hull(*(held[c].to_numpy() for c in ("station_id", "x", "y")))].reset_index(drop=True)
        if held is not None:
            yield held

    rows = stations.select("station_id", "x", "y").mapInPandas(partial, "station_id long, x double, y double").collect()
    frame = pd.DataFrame(rows, columns=["station_id", "x", "y"])
    return frame.iloc[hull(*(frame[c].to_numpy() for c in frame))].reset_index(drop=True) if len(frame) else frame


def gaps(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Distance of every point (rows) to every box ``x1, x2, y1, y2`` (columns)."""
    gx = np.maximum(0, np.maximum(boxes[None, :, 0] - x[:, None], x[:, None] - boxes[None, :, 1]))
    gy = np.maximum(0, np.maximum(boxes[None, :, 2] - y[:, None], y[:, None] - boxes[None, :, 3]))
    return np.hypot(gx, gy)


def star(p: int, x: np.ndarray, y: np.ndarray, lift: np.ndarray) -> list[tuple[int, int]]:
    """Opposite edges of the triangles around p: inverted about it, their empty circles are hull edges."""
    dx, dy = x - x[p], y - y[p]
    flat = dx * dx + dy * dy
    w = flat + lift - lift[p]
    w[p] = np.inf
    u, v = dx / w, dy / w
    flat[p] = np.inf
    seeds = set(np.argpartition(flat, min(NEAR_SEEDS, len(x) - 1))[:NEAR_SEEDS].tolist()) | {int(f(a)) for f in (np.argmin, np.argmax) for a in (u, v)}
    seeds.discard(p)
    while True:
        own = np.array(sorted(seeds))
        ring = own[hull(own, u[own], v[own])]
        a, b = ring, np.roll(ring, -1)
        side = (u[b] - u[a])[:, None] * (v[None] - v[a][:, None]) - (v[b] - v[a])[:, None] * (u[None] - u[a][:, None])
        side[:, p] = 0
        far = side.argmin(axis=1)
        added = {int(f) for f, s in zip(far, side[np.arange(len(far)), far]) if s < 0} - seeds
        if not added:
            break
        seeds |= added
    longest = np.maximum(np.maximum(dx[a] ** 2 + dy[a] ** 2, dx[b] ** 2 + dy[b] ** 2), (dx[a] - dx[b]) ** 2 + (dy[a] - dy[b]) ** 2)
    good = (u[a] * v[b] - u[b] * v[a] > 0) & (np.abs(dx[a] * dy[b] - dx[b] * dy[a]) > FLAT_SHARE * longest)
    return list(zip(a[good].tolist(), b[good].tolist()))


def circles(p: int, edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of the circles through p and each edge."""
    ax, ay, bx, by = (c[edges[:, k]] - c[p] for k in (0, 1) for c in (x, y))
    twice = 2 * (ax * by - ay * bx)
    a2, b2 = ax * ax + ay * ay, bx * bx + by * by
    cx, cy = (by * a2 - ay * b2) / twice, (ax * b2 - bx * a2) / twice
    return x[p] + cx, y[p] + cy, np.hypot(cx, cy)


def triangulate(stations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Delaunay triangles ``i < j < k`` of ``station_id, x, y``.

    Of several stations at one position the lowest id counts; ``hidden_stations`` lists the others. Fewer than three
    positions, or positions on one line, have no triangles.
    """
    spark = stations.sparkSession
    kind = stations.schema["station_id"].dataType
    placed = blocked(stations, block)
    directory = placed.groupBy("block").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).collect()  # one row for a block
    names = np.array([r[0] for r in directory], np.int64)
    boxes = np.array([r[1:5] for r in directory], float).reshape(-1, 4)
    # A single block holds all there is: no rounds, and nothing that several jobs read.
    single = len(names) <= 1
    land = (lambda df, purpose: df) if single else materialise
    corners = pd.DataFrame() if single else hull_rows(placed)
    shared = spark.sparkContext.broadcast((names, boxes))

    def nearby(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, boxes = shared.value
        for batch in batches:
            for one in batch["block"]:
                x1, x2, y1, y2 = boxes[np.flatnonzero(names == one)[0]]
                gap = np.hypot(np.maximum(0, np.maximum(boxes[:, 0] - x2, x1 - boxes[:, 1])), np.maximum(0, np.maximum(boxes[:, 2] - y2, y1 - boxes[:, 3])))
                near = np.lexsort((names != one, gap))[:NEIGHBOURS]
                yield pd.DataFrame({"block": one, "other": names[near]})

    def gathered(pairs: DataFrame, table: DataFrame):
        return pairs.join(table.withColumnRenamed("block", "other"), "other").groupBy("block")

    def spacing(rows: pd.DataFrame) -> pd.DataFrame:
        """Distance of each own station to the nearest one held, and the blocks that could hold a nearer one."""
        names, boxes = shared.value
        one = rows["block"].iloc[0]
        held = rows["other"].unique()
        own = rows[rows["other"] == one]
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        away = np.hypot(own["x"].to_numpy()[:, None] - x, own["y"].to_numpy()[:, None] - y)
        away[own["station_id"].to_numpy()[:, None] == rows["station_id"].to_numpy()] = np.inf
        near = away.min(axis=1)
        reach = near
        if np.isinf(near).any():  # alone: some station lies in the next box
            far = np.hypot(*(np.maximum(np.abs(own[c].to_numpy()[:, None] - boxes[:, k]), np.abs(own[c].to_numpy()[:, None] - boxes[:, k + 1])) for c, k in (("x", 0), ("y", 2))))
            far[:, names == one] = np.inf
            reach = np.minimum(near, far.min(axis=1))
        wanted = names[(gaps(own["x"].to_numpy(), own["y"].to_numpy(), boxes) <= reach[:, None]).any(axis=0)]
        wanted = np.setdiff1d(wanted, held)
        known = pd.DataFrame({"block": one, "station_id": own["station_id"].to_numpy(), "x": own["x"].to_numpy(), "y": own["y"].to_numpy(), "near": near, "other": pd.array([None] * len(own), "Int64")})
        return pd.concat([known, pd.DataFrame({"block": one, "other": pd.array(wanted, "Int64")})])[["block", "station_id", "x", "y", "near", "other"]].astype({"station_id": "Int64"})

    start = land(placed.select("block").distinct().mapInPandas(nearby, "block long, other long"), "neighbours")
    schema = "block long, station_id long, x double, y double, near double, other long"
    first = land(gathered(start, placed).applyInPandas(spacing, schema), "spacing")
    wider = first.where("other IS NOT NULL").select("block", "other")
    spaced = first.where("station_id IS NOT NULL")
    if not single and wider.limit(1).count():
        again = start.join(wider.select("block").distinct(), "block", "left_semi").unionByName(wider)
        second = gathered(again, placed).applyInPandas(spacing, schema).where("station_id IS NOT NULL")
        spaced = spaced.unionByName(second).groupBy("block", "station_id", "x", "y").agg(F.min("near").alias("near"))
    squared = F.col("station_id").cast("double") * F.col("station_id") * TIE_RATIO
    lift = TIE_SHARE * F.col("near") * F.col("near") * (squared - F.floor(squared))
    weighted = land(spaced.select("block", "station_id", "x", "y", F.when(F.col("near") < float("inf"), lift).otherwise(0.0).alias("lift")), "weighted")

    ends = weighted.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"station_id": corners["station_id"].astype("int64")}))), "station_id").collect() if len(corners) else []
    shared_hull = spark.sparkContext.broadcast(pd.DataFrame([(r.station_id, r.x, r.y, r.lift) for r in ends], columns=["station_id", "x", "y", "lift"]))

    def around(rows: pd.DataFrame) -> pd.DataFrame:
        """The settled triangles whose lowest id is in the block, and the blocks that open circles ask for."""
        names, boxes = shared.value
        one = rows["block"].iloc[0]
        waiting = ~np.isin(names, rows["other"].unique())
        names, boxes = names[waiting], boxes[waiting]
        own_ids = rows.loc[rows["other"] == one, "station_id"].to_numpy()
        held = rows[["station_id", "x", "y", "lift"]]
        if len(shared_hull.value):
            held = pd.concat([held, shared_hull.value])
        held = held.drop_duplicates("station_id").sort_values("station_id")
        ids, x, y, lift = (held[c].to_numpy() for c in ("station_id", "x", "y", "lift"))
        found, asked = [], set()
        for p in np.searchsorted(ids, own_ids) if len(ids) > 2 else ():
            edges = np.array(star(int(p), x, y, lift), np.int64).reshape(-1, 2)
            if not len(edges):
                continue
            if len(names):
                cx, cy, radius = circles(int(p), edges, x, y)
                gap = gaps(cx, cy, boxes)
                gap[gap > radius[:, None] * (1 + 1e-9)] = np.inf
                open_ = np.isfinite(gap).any(axis=1)
                for row in gap[open_]:
                    order = np.argsort(row)[:ASKED]
                    asked.update(names[order[np.isfinite(row[order])]].tolist())
                edges = edges[~open_]
            low, high = edges.min(axis=1), edges.max(axis=1)
            mine = low > p
            found += zip([ids[p]] * int(mine.sum()), ids[low[mine]], ids[high[mine]])
        triangles = pd.DataFrame(found, columns=["i", "j", "k"], dtype="Int64")
        wanted = pd.DataFrame({"other": sorted(asked)}, dtype="Int64")
        return pd.concat([triangles, wanted]).assign(block=one)[["block", "other", "i", "j", "k"]].astype("Int64")

    pairs, triangles = start, None
    while True:
        made = land(gathered(pairs, weighted).applyInPandas(around, "block long, other long, i long, j long, k long"), "triangles")
        settled = made.where("i IS NOT NULL").select(*[F.col(c).cast(kind).alias(c) for c in "ijk"])
        triangles = settled if triangles is None else triangles.unionByName(settled)
        more = made.where("other IS NOT NULL").select("block", "other")
        if single or more.limit(1).count() == 0:
            return triangles.distinct()
        # Blocks with open circles go again, with what they hold and what they ask for.
        pairs = materialise(pairs.join(more.select("block").distinct(), "block", "left_semi").unionByName(more), "held")
