"""Polygon and line queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import polygon
from ..session import materialise, shared_dir
from ..sources import polygons, sinks
from .cleaning_queries import tidy
from .fixtures import GRID, ORIGIN, Tables
from .pixel_queries import X, Y
from .registry import query

BAND = 0.005
EDGES = """{n} AS (SELECT feature_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
FROM {v} WINDOW w AS (PARTITION BY feature_id, part_id ORDER BY seq))"""
RING_EDGES = ", " + EDGES.format(n="re", v="fx_rings")
DISTRICT_EDGES = ", " + EDGES.format(n="de", v="fx_polygon")
INSIDE = """SELECT {k}, e.feature_id FROM {p} p JOIN {e} e ON {on} GROUP BY {k}, e.feature_id
HAVING sum(CASE WHEN (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1
 AND sum(CASE WHEN (x2 - x1) * (py - y1) = (y2 - y1) * (px - x1) AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0"""


@query(
    "s4_scan_polygon",
    "SELECT feature_id, part_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM fx_rings UNION ALL SELECT feature_id, part_id, 5, round(x, 6), round(y, 6) FROM fx_rings WHERE seq = 0",
    ("fx_rings",),
)
def s4(t: Tables) -> DataFrame:
    """Boundaries written as GeoJSON text and parsed back to a (closed) vertex table."""
    text = sinks.polygon_features(t.view("fx_rings"))
    return tidy(polygons.parse_features(text, "geojson"))


CLOSED = "SELECT feature_id, part_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM {v} UNION ALL SELECT feature_id, part_id, 5, round(x, 6), round(y, 6) FROM {v} WHERE seq = 0"


@query("s4_read_geojson_files", f"{CLOSED.format(v='fx_rings')} UNION ALL {CLOSED.format(v='fx_polygon')}", ("fx_rings", "fx_polygon"))
def s4_files(t: Tables) -> DataFrame:
    """Service areas read back from a folder of feature lines, the district from one collection document."""
    lines, document = shared_dir(t.spark, "features"), shared_dir(t.spark, "collection")
    sinks.polygon_features(t.view("fx_rings")).select("geojson").write.text(lines)
    district = sinks.polygon_features(t.view("fx_polygon"))  # one feature
    district.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "geojson", F.lit("]}"))).write.text(document)
    return tidy(polygons.read_features(t.spark, lines).unionByName(polygons.read_collection(t.spark, document)))


@query(
    "k8_polygon_geojson",
    """SELECT feature_id, 'Polygon' AS kind, CAST(6 AS INTEGER) AS corners, round(max(CASE WHEN seq = 0 THEN x END), 6) AS first_x, round(max(CASE WHEN seq = 4 THEN y END), 6) AS fifth_y FROM fx_rings GROUP BY feature_id""",
    ("fx_rings",),
)
def k8(t: Tables) -> DataFrame:
    doc = F.from_json("geojson", "geometry struct<type: string, coordinates: array<array<array<double>>>>")
    parsed = sinks.polygon_features(t.view("fx_rings")).withColumn("g", doc["geometry"])
    ring = F.col("g.coordinates")[0]
    return tidy(
        parsed.select(
            "feature_id",
            F.col("g.type").alias("kind"),
            F.size(ring).alias("corners"),
            ring[0][0].alias("first_x"),
            ring[4][1].alias("fifth_y"),
        )
    )


@query(
    "a16_polygon_centroid",
    f"""{RING_EDGES}
SELECT feature_id, round(85.0::DOUBLE + sum((u1 + u2) * (u1 * v2 - u2 * v1)) / (3 * sum(u1 * v2 - u2 * v1)), 6) AS x, round(28.5::DOUBLE + sum((v1 + v2) * (u1 * v2 - u2 * v1)) / (3 * sum(u1 * v2 - u2 * v1)), 6) AS y, round(abs(sum(u1 * v2 - u2 * v1)) / 2, 6) AS area
FROM (SELECT feature_id, x1 - 85.0::DOUBLE AS u1, x2 - 85.0::DOUBLE AS u2, y1 - 28.5::DOUBLE AS v1, y2 - 28.5::DOUBLE AS v2 FROM re) e GROUP BY feature_id""",
    ("fx_rings",),
)
def a16(t: Tables) -> DataFrame:
    return tidy(polygon.centroid(polygon.ring_edges(t.view("fx_rings")), ORIGIN))


@query(
    "j6_point_in_polygon",
    RING_EDGES
    + "\n"
    + INSIDE.format(k="site_id", p="(SELECT site_id, longitude AS px, latitude AS py FROM fx_sites)", e="re", on="true"),
    ("fx_rings", "fx_sites"),
)
def j6(t: Tables) -> DataFrame:
    """Every service area that holds each site."""
    edges = materialise(polygon.ring_edges(t.view("fx_rings")), "edges")
    return polygon.points_in_polygons(t.view("fx_sites"), edges, "site_id", BAND).select("site_id", "feature_id")


@query(
    "f10_in_polygon",
    DISTRICT_EDGES
    + "\nSELECT sample_id FROM ("
    + INSIDE.format(k="sample_id", p="(SELECT sample_id, longitude AS px, latitude AS py FROM fx_points)", e="de", on="true")
    + ") i",
    ("fx_polygon", "fx_points"),
)
def f10(t: Tables) -> DataFrame:
    edges = materialise(polygon.ring_edges(t.view("fx_polygon")), "edges")
    return polygon.points_in_polygons(t.view("fx_points"), edges, "sample_id", BAND).select("sample_id")


@query(
    "f13_clip_to_polygon",
    DISTRICT_EDGES
    + "\nSELECT row_id, col_id FROM ("
    + INSIDE.format(k="row_id, col_id", p=f"(SELECT row_id, col_id, {X} AS px, {Y} AS py FROM fx_grid)", e="de", on="true")
    + ") i",
    ("fx_polygon", "fx_grid"),
)
def f13(t: Tables) -> DataFrame:
    edges = materialise(polygon.ring_edges(t.view("fx_polygon")), "edges")
    return polygon.clip_to_polygon(t.grid, edges, GRID).select("row_id", "col_id")


@query(
    "f11_bbox_filter",
    "SELECT road_id FROM fx_roads WHERE greatest(x1, x2) >= 85.02::DOUBLE AND least(x1, x2) <= 85.06::DOUBLE AND greatest(y1, y2) >= 28.4::DOUBLE AND least(y1, y2) <= 28.47::DOUBLE",
    ("fx_roads",),
)
def f11(t: Tables) -> DataFrame:
    return polygon.bbox_filter(t.view("fx_roads"), (85.02, 28.4, 85.06, 28.47)).select("road_id")


@query(
    "r5_sample_lattice",
    f"""{RING_EDGES},
box AS (SELECT feature_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM fx_rings GROUP BY feature_id),
lattice AS (SELECT feature_id, i, j, CASE WHEN i = 7 THEN max_x ELSE min_x + i * ((max_x - min_x) / 7.0::DOUBLE) END AS px, CASE WHEN j = 7 THEN max_y ELSE min_y + j * ((max_y - min_y) / 7.0::DOUBLE) END AS py
  FROM box, (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(0, 8)) AS j) b),
inside AS (
  {INSIDE.format(k='i, j, px, py', p='lattice', e='re', on='p.feature_id = e.feature_id')}),
mid AS (SELECT feature_id, 85.0::DOUBLE + sum((u1 + u2) * (u1 * v2 - u2 * v1)) / (3 * sum(u1 * v2 - u2 * v1)) AS x, 28.5::DOUBLE + sum((v1 + v2) * (u1 * v2 - u2 * v1)) / (3 * sum(u1 * v2 - u2 * v1)) AS y
  FROM (SELECT feature_id, x1 - 85.0::DOUBLE AS u1, x2 - 85.0::DOUBLE AS u2, y1 - 28.5::DOUBLE AS v1, y2 - 28.5::DOUBLE AS v2 FROM re) e GROUP BY feature_id)
SELECT feature_id, round(px, 6) AS x, round(py, 6) AS y FROM inside UNION ALL SELECT feature_id, round(x, 6), round(y, 6) FROM mid""",
    ("fx_rings",),
)
def r5(t: Tables) -> DataFrame:
    return tidy(polygon.sample_lattice(t.view("fx_rings"), 8, BAND, ORIGIN))
