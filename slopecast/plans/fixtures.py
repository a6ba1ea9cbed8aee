"""Views derived from the input tables, as SQL that Spark and DuckDB both accept.

Every view keeps all rows of its tables and grows with them. The grid is 100
columns wide and one row tall per hundred orders; points and stations spread over
the whole grid at every scale.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..settings import Grid

GRID = Grid(c=85.0, a=0.001, f=28.5, e=-0.001)
COARSE = Grid(c=85.0, a=0.01, f=28.5, e=-0.01)
MEDIUM = Grid(c=85.0, a=0.002, f=28.5, e=-0.002)
ORIGIN = (85.0, 28.5)
ANCHOR = "2024-01-15 09:15:00"
RUN_TIME = "2024-01-15T09:23:00+00:00"

# view -> (views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_grid": (
        (),
        """SELECT CAST(floor(o_orderkey / 100.0) AS INT) AS row_id, CAST(o_orderkey % 100 AS INT) AS col_id,
  CASE WHEN o_orderkey % 37 = 0 THEN CAST(-9999 AS DOUBLE) ELSE CAST((o_orderkey * 6151) % 9001 AS DOUBLE) / 100 END AS slope,
  CASE WHEN o_orderkey % 43 = 0 THEN CAST(8900 AS DOUBLE) ELSE CAST(500 + (o_custkey * 13) % 4000 AS DOUBLE) END AS elevation,
  CAST((o_orderkey * 37) % 360 AS DOUBLE) AS aspect,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST((o_orderkey * 7919) % 2001 - 1000 AS DOUBLE) / 1000 END AS ndvi,
  CAST(CASE o_custkey % 8 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 40 WHEN 3 THEN 50 WHEN 4 THEN 60 WHEN 5 THEN 70 WHEN 6 THEN 80 ELSE 100 END AS INT) AS lulc,
  4 + CAST(o_orderkey % 97 AS DOUBLE) / 50 AS rainfall,
  30 * sqrt(CAST(o_orderkey % 1000 AS DOUBLE)) AS river_m,
  30 * sqrt(CAST((o_orderkey * 31) % 400 AS DOUBLE)) AS road_m,
  13 + CAST((o_orderkey * 3571) % 4001 AS DOUBLE) / 1000 AS twi,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10006 END AS score
FROM orders""",
    ),
    # One event per order at its customer's position: many exact copies, some outside the grid.
    "fx_points": (
        (),
        """SELECT o_orderkey AS sample_id,
  85.0D + (CAST((o_custkey * 7919) % 102000 AS DOUBLE) + 0.5D) / 1000000 AS longitude,
  28.5D - (CAST(o_custkey AS DOUBLE) + (CAST((o_custkey * 104729) % 1000 AS DOUBLE) + 0.5D) / 1000) / 10000 AS latitude
FROM orders""",
    ),
    "fx_sites": (
        (),
        """SELECT c_custkey AS site_id,
  85.0D + (CAST((c_custkey * 7919) % 102000 AS DOUBLE) + 0.5D) / 1000000 AS longitude,
  28.5D - (CAST(c_custkey AS DOUBLE) + (CAST((c_custkey * 104729) % 1000 AS DOUBLE) + 0.5D) / 1000) / 10000 AS latitude
FROM customer""",
    ),
    "fx_readings": ((), "SELECT user_id AS loc_id, ts, value / 10 AS mm FROM events"),
    "fx_area_readings": ((), "SELECT CAST(user_id % 25 AS INT) AS station_id, ts, value / 10 AS mm FROM events"),
    # One gauge per nation, spread over the grid's real height; amounts scale with its customers.
    "fx_gauges": (
        (),
        """SELECT c_nationkey AS station_id, CAST(count(*) AS DOUBLE) AS customers,
  85.0D + (CAST((c_nationkey * c_nationkey * 11 + c_nationkey * 37) % 97 AS DOUBLE) + 0.5D) / 970 AS x,
  28.5D - CAST(max(c_custkey) AS DOUBLE) / 10000 * (CAST((c_nationkey * 7 + 3) % 25 AS DOUBLE) + 0.5D) / 25 AS y
FROM customer GROUP BY c_nationkey""",
    ),
    "fx_station_totals": (
        ("fx_gauges", "fx_area_readings"),
        """SELECT g.station_id, g.x, g.y,
  coalesce(sum(CASE WHEN r.ts > TIMESTAMP '2024-01-15 08:15:00' THEN r.mm END), 0) * 60 / max(g.customers) AS rain_1h_mm,
  coalesce(sum(CASE WHEN r.ts > TIMESTAMP '2024-01-15 06:15:00' THEN r.mm END), 0) * 60 / max(g.customers) AS rain_3h_mm,
  coalesce(sum(CASE WHEN r.ts > TIMESTAMP '2024-01-14 09:15:00' THEN r.mm END), 0) * 60 / max(g.customers) AS rain_24h_mm,
  coalesce(sum(r.mm), 0) * 60 / max(g.customers) AS rain_72h_mm
FROM fx_gauges g LEFT JOIN (SELECT * FROM fx_area_readings WHERE ts > TIMESTAMP '2024-01-12 09:15:00' AND ts <= TIMESTAMP '2024-01-15 09:15:00') r
  ON g.station_id = r.station_id GROUP BY g.station_id, g.x, g.y""",
    ),
    "fx_stations": (
        ("fx_station_totals",),
        """SELECT *, greatest(least(rain_1h_mm / 20, 1), least(rain_3h_mm / 40, 1), least(rain_24h_mm / 100, 1), least(rain_72h_mm / 180, 1)) AS rainfall_trigger_score
FROM fx_station_totals""",
    ),
    # One non-convex district ring over the grid's real height.
    "fx_polygon": (
        (),
        """SELECT CAST(0 AS INT) AS feature_id, part_id, seq, CAST(x AS DOUBLE) AS x,
  28.5D - CAST(down AS DOUBLE) * (SELECT CAST(floor(max(o_orderkey) / 100.0) + 1 AS DOUBLE) FROM orders) / 100 AS y
FROM (VALUES (0,0,85.0102,0.0019),(0,1,85.0903,0.0018),(0,2,85.0904,0.0979),(0,3,85.0502,0.0397),(0,4,85.0101,0.0978)) AS t(part_id, seq, x, down)""",
    ),
    # A notched five-vertex service area around every supplier.
    "fx_rings": (
        (),
        """SELECT CAST(s_suppkey AS INT) AS feature_id, CAST(0 AS INT) AS part_id, seq,
  85.0D + (CAST((s_suppkey * 577) % 90000 AS DOUBLE) + 5000.25D) / 1000000 + dx * (1 + s_suppkey % 3) AS x,
  28.5D - (CAST(s_suppkey AS DOUBLE) + 0.3D) / 670 + dy * (1 + s_suppkey % 4) AS y
FROM (
  SELECT s_suppkey, CAST(0 AS INT) AS seq, -0.0021D AS dx, 0.0019D AS dy FROM supplier
  UNION ALL SELECT s_suppkey, CAST(1 AS INT), 0.0023D, 0.0017D FROM supplier
  UNION ALL SELECT s_suppkey, CAST(2 AS INT), 0.0019D, -0.0022D FROM supplier
  UNION ALL SELECT s_suppkey, CAST(3 AS INT), 0.0003D, -0.0002D FROM supplier
  UNION ALL SELECT s_suppkey, CAST(4 AS INT), -0.0018D, -0.0020D FROM supplier
) v""",
    ),
    # One straight road per customer.
    "fx_roads": (
        ("fx_sites",),
        """SELECT site_id AS road_id, longitude AS x1, latitude AS y1,
  longitude + CAST((site_id * 31) % 41 - 20 AS DOUBLE) / 10000 AS x2, latitude + CAST((site_id * 17) % 41 - 20 AS DOUBLE) / 10000 AS y2
FROM fx_sites""",
    ),
    "fx_scored": (
        (),
        """SELECT d.doc_id AS sample_id, quality AS label, CAST(floor(n_chars / 50.0) AS DOUBLE) / 1000 AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "fx_train": (
        ("fx_grid",),
        """SELECT row_id * 100 + col_id AS sample_id, slope, elevation, aspect, ndvi, lulc, rainfall, river_m, road_m, twi,
  CASE WHEN slope / 90 + (rainfall - 4) / 2 + CAST((row_id * 31 + col_id * 17) % 40 AS DOUBLE) / 100 > 1.2 THEN 1 ELSE 0 END AS landslide
FROM fx_grid WHERE slope >= 0 AND ndvi <= 1""",
    ),
    # Block means of the grid on coarser grids, for resampling back.
    "fx_coarse": (
        ("fx_grid",),
        """SELECT CAST(floor(row_id / 10) AS INT) AS row_id, CAST(floor(col_id / 10) AS INT) AS col_id, avg(rainfall) AS value
FROM fx_grid GROUP BY CAST(floor(row_id / 10) AS INT), CAST(floor(col_id / 10) AS INT)""",
    ),
    # The small constant keeps block means off exact rounding ties.
    "fx_medium": (
        ("fx_grid",),
        """SELECT CAST(floor(row_id / 2) AS INT) AS row_id, CAST(floor(col_id / 2) AS INT) AS col_id,
  CASE WHEN min(slope) < 0 THEN NULL ELSE avg(slope) + 0.00000031D END AS value, CAST(max(lulc) AS DOUBLE) AS land
FROM fx_grid GROUP BY CAST(floor(row_id / 2) AS INT), CAST(floor(col_id / 2) AS INT)""",
    ),
}

FEATURE_LIST = "slope, elevation, aspect, ndvi, lulc, rainfall, river_m, road_m, twi"
RULES = {
    "longitude": "longitude BETWEEN 80 AND 90",
    "latitude": "latitude BETWEEN 25 AND 31",
    "slope": "slope BETWEEN 0 AND 90",
    "elevation": "elevation BETWEEN 0 AND 9000",
    "aspect": "aspect BETWEEN 0 AND 360",
    "ndvi": "ndvi BETWEEN -1 AND 1",
    "rainfall": "rainfall >= 0",
    "river_m": "river_m >= 0",
    "road_m": "road_m >= 0",
    "twi": "twi >= 0",
}
FENCED = ["slope", "elevation", "ndvi", "rainfall", "river_m", "road_m", "twi"]
ANY_MISSING = " OR ".join(f"{c} IS NULL" for c in ["longitude", "latitude", *FEATURE_LIST.split(", ")])
ANY_BAD = " OR ".join(f"NOT ({rule})" for rule in RULES.values())


def _fence(column: str) -> str:
    q1, q3 = f"quantile_cont({column}, 0.25)", f"quantile_cont({column}, 0.75)"
    return f"{q1} - 1.5 * ({q3} - {q1}) AS {column}_lo, {q3} + 1.5 * ({q3} - {q1}) AS {column}_hi"


# Steps that only the SQL twins need as views.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sq_unique": (
        ("fx_points",),
        "SELECT min(sample_id) AS sample_id, longitude, latitude, count(*) AS copies FROM fx_points GROUP BY longitude, latitude",
    ),
    "sq_sampled": (
        ("sq_unique", "fx_grid"),
        f"""SELECT u.*, CASE WHEN g.slope > -9998 THEN g.slope END AS slope, {FEATURE_LIST.replace('slope, ', '')}, g.score
FROM sq_unique u LEFT JOIN fx_grid g ON CAST(floor((u.latitude - 28.5::DOUBLE) / -0.001::DOUBLE) AS INTEGER) = g.row_id
  AND CAST(floor((u.longitude - 85.0::DOUBLE) / 0.001::DOUBLE) AS INTEGER) = g.col_id""",
    ),
    "sq_fences": (
        ("sq_sampled",),
        f"SELECT {', '.join(_fence(c) for c in FENCED)} FROM sq_sampled WHERE NOT ({ANY_MISSING}) AND NOT ({ANY_BAD})",
    ),
    "sq_tagged": (
        ("sq_sampled", "sq_fences"),
        f"""SELECT *, CASE stage WHEN 'missing_value_removal' THEN 'missing_or_nodata_raster_value'
  WHEN 'domain_rule_filtering' THEN concat_ws(';', {', '.join(f"CASE WHEN NOT ({r}) THEN '{c}_outside_domain' END" for c, r in RULES.items())})
  WHEN 'eda_iqr_outlier_removal' THEN concat_ws(';', {', '.join(f"CASE WHEN NOT ({c} BETWEEN {c}_lo AND {c}_hi) THEN '{c}_iqr_outlier' END" for c in FENCED)}) END AS removal_reason
FROM (SELECT *, CASE WHEN {ANY_MISSING} THEN 'missing_value_removal' WHEN {ANY_BAD} THEN 'domain_rule_filtering'
  WHEN {' OR '.join(f"NOT ({c} BETWEEN {c}_lo AND {c}_hi)" for c in FENCED)} THEN 'eda_iqr_outlier_removal' END AS stage FROM sq_sampled, sq_fences) s""",
    ),
    "sq_clean": (("sq_tagged",), f"SELECT sample_id, longitude, latitude, {FEATURE_LIST} FROM sq_tagged WHERE stage IS NULL"),
    # Eligible background pixels, their draw order, and the balanced training table.
    "sq_eligible": (
        ("fx_grid", "sq_clean"),
        f"""SELECT *, 85.0::DOUBLE + (col_id + 0.5::DOUBLE) * 0.001::DOUBLE AS longitude, 28.5::DOUBLE + (row_id + 0.5::DOUBLE) * -0.001::DOUBLE AS latitude
FROM fx_grid g WHERE slope BETWEEN 0 AND 90 AND elevation BETWEEN 0 AND 9000 AND ndvi BETWEEN -1 AND 1 AND NOT EXISTS (
  SELECT 1 FROM sq_clean c WHERE abs(c.latitude - (28.5::DOUBLE + (g.row_id + 0.5::DOUBLE) * -0.001::DOUBLE)) <= 0.001::DOUBLE
  AND CAST(floor((c.latitude - 28.5::DOUBLE) / -0.001::DOUBLE) AS INTEGER) BETWEEN g.row_id - 1 AND g.row_id + 1
  AND sqrt(power(85.0::DOUBLE + (g.col_id + 0.5::DOUBLE) * 0.001::DOUBLE - c.longitude, 2) + power(28.5::DOUBLE + (g.row_id + 0.5::DOUBLE) * -0.001::DOUBLE - c.latitude, 2)) <= 0.0009::DOUBLE)""",
    ),
    "sq_background": (
        ("sq_eligible", "sq_clean"),
        f"""SELECT 'bg_' || CAST(draw AS VARCHAR) AS sample_id, longitude, latitude, {FEATURE_LIST} FROM
(SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id || ':' || col_id), row_id || ':' || col_id) - 1 AS draw FROM sq_eligible) e WHERE draw < (SELECT count(*) FROM sq_clean)""",
    ),
    "sq_training": (
        ("sq_clean", "sq_background"),
        f"SELECT CAST(sample_id AS VARCHAR) AS sample_id, longitude, latitude, {FEATURE_LIST}, 1 AS landslide FROM sq_clean UNION ALL SELECT *, 0 FROM sq_background",
    ),
    # Delaunay triangles as lifted planes with no station below, then the surface over the grid.
    "sq_lift": (
        ("fx_stations",),
        """SELECT s.*, s.x - m.mx AS u, s.y - m.my AS v, m.cell, power(s.x - m.mx, 2) + power(s.y - m.my, 2) + 0.000001::DOUBLE * m.cell * (s.station_id * s.station_id * 0.6180339887::DOUBLE - floor(s.station_id * s.station_id * 0.6180339887::DOUBLE)) AS z
FROM fx_stations s, (SELECT avg(x) AS mx, avg(y) AS my, (max(x) - min(x)) * (max(y) - min(y)) / count(*) AS cell FROM fx_stations) m""",
    ),
    "sq_triples": (
        ("sq_lift",),
        """SELECT *, (bz - az) * (cv - av) - (cz - az) * (bv - av) AS pn, (bu - au) * (cz - az) - (cu - au) * (bz - az) AS qn FROM (
SELECT a.station_id AS i, b.station_id AS j, c.station_id AS k, a.u AS au, a.v AS av, a.z AS az, b.u AS bu, b.v AS bv, b.z AS bz, c.u AS cu, c.v AS cv, c.z AS cz,
  (b.u - a.u) * (c.v - a.v) - (c.u - a.u) * (b.v - a.v) AS o, a.cell FROM sq_lift a JOIN sq_lift b ON a.station_id < b.station_id JOIN sq_lift c ON b.station_id < c.station_id) t WHERE abs(o) > 0.000000001::DOUBLE * cell""",
    ),
    "sq_triangles": (
        ("sq_triples", "sq_lift"),
        "SELECT i, j, k FROM sq_triples t WHERE NOT EXISTS (SELECT 1 FROM sq_lift s WHERE s.station_id NOT IN (t.i, t.j, t.k) AND s.z - t.az - (t.pn * (s.u - t.au) + t.qn * (s.v - t.av)) / t.o < 0)",
    ),
    "sq_corners": (
        ("sq_triangles", "fx_stations"),
        """SELECT i, j, k, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS det
FROM sq_triangles t JOIN fx_stations a ON a.station_id = i JOIN fx_stations b ON b.station_id = j JOIN fx_stations c ON c.station_id = k""",
    ),
    "sq_hits": (
        ("sq_corners", "fx_grid"),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, col_id ORDER BY i, j, k) AS n FROM (
SELECT g.row_id, g.col_id, g.px, g.py, g.score, t.i, t.j, t.k, ((y2 - y0) * (px - x0) + (x0 - x2) * (py - y0)) / det AS w1, ((y0 - y1) * (px - x0) + (x1 - x0) * (py - y0)) / det AS w2
FROM (SELECT row_id, col_id, score, 85.0::DOUBLE + (col_id + 0.5::DOUBLE) * 0.001::DOUBLE AS px, 28.5::DOUBLE + (row_id + 0.5::DOUBLE) * -0.001::DOUBLE AS py FROM fx_grid) g, sq_corners t) h
WHERE w1 >= -0.000000001::DOUBLE AND w2 >= -0.000000001::DOUBLE AND w1 + w2 <= 1.000000001::DOUBLE) f WHERE n = 1""",
    ),
    "sq_values": (
        ("fx_stations",),
        """SELECT station_id, x, y, rainfall_trigger_score AS combined, least(rain_1h_mm / 20, 1) AS t1, least(rain_3h_mm / 40, 1) AS t3, least(rain_24h_mm / 100, 1) AS t24, least(rain_72h_mm / 180, 1) AS t72 FROM fx_stations""",
    ),
    "sq_linear": (
        ("sq_hits", "sq_values"),
        """SELECT row_id, col_id, """
        + ", ".join(f"a.{v} + w1 * (b.{v} - a.{v}) + w2 * (c.{v} - a.{v}) AS {v}" for v in ("combined", "t1", "t3", "t24", "t72"))
        + " FROM sq_hits h JOIN sq_values a ON a.station_id = i JOIN sq_values b ON b.station_id = j JOIN sq_values c ON c.station_id = k",
    ),
    "sq_nearest": (
        ("sq_hits", "sq_values", "fx_grid"),
        """SELECT row_id, col_id, combined, t1, t3, t24, t72 FROM (SELECT g.row_id, g.col_id, v.*, row_number() OVER (PARTITION BY g.row_id, g.col_id
  ORDER BY power(v.x - (85.0::DOUBLE + (g.col_id + 0.5::DOUBLE) * 0.001::DOUBLE), 2) + power(v.y - (28.5::DOUBLE + (g.row_id + 0.5::DOUBLE) * -0.001::DOUBLE), 2), station_id) AS n
FROM fx_grid g, sq_values v WHERE NOT EXISTS (SELECT 1 FROM sq_hits h WHERE h.row_id = g.row_id AND h.col_id = g.col_id)) f WHERE n = 1""",
    ),
    "sq_surface": (
        ("sq_linear", "sq_nearest"),
        "SELECT *, true AS in_hull FROM sq_linear UNION ALL SELECT *, false FROM sq_nearest",
    ),
    "sq_risk": (
        ("sq_surface", "fx_grid"),
        "SELECT s.row_id, s.col_id, g.score, s.in_hull, s.combined, "
        + ", ".join(
            f"least(1, 0.65::DOUBLE * g.score + 0.35::DOUBLE * s.{v} + 0.25::DOUBLE * g.score * s.{v}) AS risk_{v}"
            for v in ("combined", "t1", "t3", "t24", "t72")
        )
        + " FROM sq_surface s JOIN fx_grid g ON g.row_id = s.row_id AND g.col_id = s.col_id WHERE g.score IS NOT NULL",
    ),
}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _view(name: str) -> tuple[tuple[str, ...], str]:
    return VIEWS.get(name) or SQL_VIEWS[name]


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for n in [*_closure(_view(name)[0]), name]:
            if n not in ordered:
                ordered.append(n)
    return ordered


def cte(names: tuple[str, ...]) -> str:
    """WITH clause that defines the views (and what they read) for DuckDB."""
    if not names:
        return ""
    parts = [f"{n} AS (\n{_view(n)[1]}\n)" for n in _closure(names)]
    return _ansi("WITH " + ",\n".join(parts) + "\n")


def _ansi(text: str) -> str:
    """Spark's double literals (85.0D) as DuckDB casts."""
    return re.sub(r"(?<![\w.])(-?)(\d+\.\d+)D\b", r"CAST(\1\2 AS DOUBLE)", text)


class Tables:
    """The input tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name][1])

    def sql(self, text: str) -> DataFrame:
        """Run a text that may name input tables and views."""
        frames, query = {}, text
        for name in [*VIEWS, *BASE_TABLES]:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", query, re.IGNORECASE):
                query = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", query, flags=re.IGNORECASE)
                frames[name] = self.view(name) if name in VIEWS else self.base(name)
        return self.spark.sql(query, **frames) if frames else self.spark.sql(query)

    @cached_property
    def grid(self) -> DataFrame:
        return self.view("fx_grid")

    @cached_property
    def shape(self) -> tuple[int, int]:
        """Height and width of the grid, from the highest order key."""
        top = self.base("orders").agg({"o_orderkey": "max"}).first()[0]
        return top // 100 + 1, 100
