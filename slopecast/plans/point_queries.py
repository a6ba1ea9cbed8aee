"""Point queries: ids, sampling at pixels, nearest neighbours, dedupe and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo_cache_key
from ..operators import classes, nearest, pixels, polygon, ranking
from ..sources import points as sources
from ..settings import FEATURES, SCORE_SCHEME, Grid
from .cleaning_queries import PLACE, tidy
from .fixtures import COARSE, GRID, Tables
from .pixel_queries import CLASS, SCORE_LABEL
from .registry import query

PIXEL_OF = "CAST(floor((latitude - 28.5::DOUBLE) / -{s}::DOUBLE) AS INTEGER) = {a}.row_id AND CAST(floor((longitude - 85.0::DOUBLE) / {s}::DOUBLE) AS INTEGER) = {a}.col_id"


@query(
    "s3_scan_points",
    f"SELECT CAST(sample_id AS VARCHAR) AS sample_id, {PLACE} FROM fx_points",
    ("fx_points",),
)
def s3(t: Tables) -> DataFrame:
    """Write the inventory as CSV and read it back with a declared schema."""
    return tidy(sources.landed_csv(t.view("fx_points")))


@query(
    "k1_write_table_csv",
    "SELECT loc_id, count(*) AS readings, round(sum(mm), 6) AS mm FROM fx_readings GROUP BY loc_id",
    ("fx_readings",),
)
def k1(t: Tables) -> DataFrame:
    totals = t.view("fx_readings").groupBy("loc_id").agg(F.count(F.lit(1)).alias("readings"), F.sum("mm").alias("mm"))
    return tidy(sources.round_trip_csv(totals))


@query("p1_surrogate_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_id FROM orders")
def p1(t: Tables) -> DataFrame:
    return ranking.surrogate_id(t.base("orders").select("o_orderkey"), "o_orderkey", "sample_id")


@query(
    "p2_prefixed_id",
    "SELECT c_custkey, 'bg_' || CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR) AS sample_id FROM customer",
)
def p2(t: Tables) -> DataFrame:
    placed = ranking.surrogate_id(t.base("customer").select("c_custkey"), "c_custkey", "n")
    return placed.select("c_custkey", F.concat(F.lit("bg_"), F.col("n").cast("string")).alias("sample_id"))


@query("p3_label_literal", "SELECT sample_id, 1 AS landslide FROM fx_points", ("fx_points",))
def p3(t: Tables) -> DataFrame:
    return t.view("fx_points").select("sample_id", F.lit(1).alias("landslide"))


@query("p24_select_columns", f"SELECT sample_id, {PLACE} FROM fx_points", ("fx_points",))
def p24(t: Tables) -> DataFrame:
    return tidy(sources.select_columns(t.view("fx_points"), ["sample_id", "longitude", "latitude"]))


@query(
    "p20_geo_cache_key",
    """SELECT round_even(latitude, 4) AS lat_key, round_even(longitude, 4) AS lon_key, count(*) AS lookups, min(sample_id) AS sample_id FROM fx_points GROUP BY 1, 2""",
    ("fx_points",),
)
def p20(t: Tables) -> DataFrame:
    lat, lon = geo_cache_key("latitude", "longitude")
    keyed = t.view("fx_points").select("sample_id", lat.alias("lat_key"), lon.alias("lon_key"))
    return keyed.groupBy("lat_key", "lon_key").agg(F.count(F.lit(1)).alias("lookups"), F.min("sample_id").alias("sample_id"))


#: Layers on the fine grid; rainfall also comes on a coarser one.
FINE = [c for c in FEATURES if c != "rainfall"]


@query(
    "j1_sample_raster_at_points",
    f"SELECT p.sample_id, {', '.join('g.lulc' if c == 'lulc' else f'round(g.{c}, 6) AS {c}' for c in FEATURES)}, round(c.value, 6) AS coarse_rainfall FROM fx_points p LEFT JOIN fx_grid g ON {PIXEL_OF.format(s='0.001', a='g')} LEFT JOIN fx_coarse c ON {PIXEL_OF.format(s='0.01', a='c')}",
    ("fx_points", "fx_grid", "fx_coarse"),
)
def j1(t: Tables) -> DataFrame:
    fine = pixels.sample_pixels(t.view("fx_points"), t.grid, GRID, FEATURES)
    coarse = t.view("fx_coarse").withColumnRenamed("value", "coarse_rainfall")
    both = pixels.sample_pixels(fine, coarse, COARSE, ["coarse_rainfall"])
    return tidy(both.drop("longitude", "latitude"))


@query(
    "j1_sample_layers",
    f"SELECT p.site_id, {', '.join(f'round(g.{c}::DOUBLE, 6) AS {c}' for c in FINE)}, round(c.value, 6) AS rainfall FROM fx_sites p LEFT JOIN fx_grid g ON {PIXEL_OF.format(s='0.001', a='g')} LEFT JOIN fx_coarse c ON {PIXEL_OF.format(s='0.01', a='c')}",
    ("fx_sites", "fx_grid", "fx_coarse"),
)
def j1_layers(t: Tables) -> DataFrame:
    """Every layer on its own grid."""
    fine = pixels.melt_layers(t.grid, FINE)
    rain = t.view("fx_coarse").select(F.lit("rainfall").alias("layer"), "row_id", "col_id", "value")
    grids: dict[str, Grid] = {c: GRID for c in FINE} | {"rainfall": COARSE}
    sampled = pixels.sample_layers(t.view("fx_sites"), fine.unionByName(rain), grids, "site_id")
    return tidy(sampled.select("site_id", *FINE, "rainfall"))


SCORED_POINTS = f"SELECT sample_id, longitude, latitude, g.score, {CLASS.format(v='g.score')} AS k FROM fx_points p LEFT JOIN fx_grid g ON {PIXEL_OF.format(s='0.001', a='g')}"


@query(
    "r14_validate_points",
    f"SELECT sample_id, {PLACE}, round(score, 6) AS susceptibility_probability, k AS susceptibility_class, {SCORE_LABEL.format(k='k')} AS susceptibility_label FROM ({SCORED_POINTS}) s WHERE k <> 0",
    ("fx_points", "fx_grid"),
)
def r14(t: Tables) -> DataFrame:
    return tidy(classes.validate_points(t.view("fx_points"), t.grid, GRID))


@query("f8_valid_class_only", f"SELECT sample_id FROM ({SCORED_POINTS}) s WHERE k <> 0", ("fx_points", "fx_grid"))
def f8(t: Tables) -> DataFrame:
    return classes.validate_points(t.view("fx_points"), t.grid, GRID).select("sample_id")


@query(
    "f9_label_in",
    f"SELECT sample_id, {SCORE_LABEL.format(k='k')} AS label FROM ({SCORED_POINTS}) s WHERE k IN (4, 5)",
    ("fx_points", "fx_grid"),
)
def f9(t: Tables) -> DataFrame:
    checked = classes.validate_points(t.view("fx_points"), t.grid, GRID)
    high = checked.where(F.col("susceptibility_label").isin(SCORE_SCHEME.labels[3:]))
    return high.select("sample_id", F.col("susceptibility_label").alias("label"))


@query(
    "a10_mean_score_at_points",
    f"SELECT round(avg(score), 6) AS mean_score FROM ({SCORED_POINTS}) s WHERE k <> 0",
    ("fx_points", "fx_grid"),
)
def a10(t: Tables) -> DataFrame:
    checked = classes.validate_points(t.view("fx_points"), t.grid, GRID)
    return tidy(checked.agg(F.avg("susceptibility_probability").alias("mean_score")))


D2 = "sqrt(power(s.longitude - p.x, 2) + power(s.latitude - p.y, 2))"
CENTRES = "SELECT row_id * 100 + col_id AS pixel_id, 85.0::DOUBLE + (col_id + 0.5::DOUBLE) * 0.001::DOUBLE AS x, 28.5::DOUBLE + (row_id + 0.5::DOUBLE) * -0.001::DOUBLE AS y FROM fx_grid"


def _centres(t: Tables) -> DataFrame:
    return t.grid.selectExpr(
        "row_id * 100 + col_id AS pixel_id",
        "85.0D + (col_id + 0.5D) * 0.001D AS x",
        "28.5D + (row_id + 0.5D) * -0.001D AS y",
    )


@query(
    "j3_nearest_neighbour",
    f"SELECT pixel_id, min(site_id) AS site_id, round(min(d), 6) AS distance FROM (SELECT p.pixel_id, s.site_id, {D2} AS d, min({D2}) OVER (PARTITION BY p.pixel_id) AS best FROM ({CENTRES}) p, fx_sites s) j WHERE d = best GROUP BY pixel_id",
    ("fx_grid", "fx_sites"),
)
def j3(t: Tables) -> DataFrame:
    found = nearest.nearest_neighbour(_centres(t), t.view("fx_sites"), "pixel_id", "site_id", query_xy=("x", "y"))
    return tidy(found)


@query(
    "j4_distance_anti_join",
    f"SELECT pixel_id FROM ({CENTRES}) p WHERE NOT EXISTS (SELECT 1 FROM fx_sites s WHERE {D2} <= 0.0009::DOUBLE)",
    ("fx_grid", "fx_sites"),
)
def j4(t: Tables) -> DataFrame:
    free = nearest.distance_anti_join(_centres(t), t.view("fx_sites"), "pixel_id", "site_id", 0.0009, query_xy=("x", "y"))
    return free.select("pixel_id")


@query(
    "u4_dedupe_full",
    f"SELECT DISTINCT {PLACE} FROM fx_points",
    ("fx_points",),
)
def u4(t: Tables) -> DataFrame:
    return tidy(t.view("fx_points").select("longitude", "latitude").distinct())


@query(
    "u5_exclude_seen",
    "SELECT site_id FROM fx_sites WHERE site_id NOT IN (SELECT l_suppkey FROM lineitem)",
    ("fx_sites",),
)
def u5(t: Tables) -> DataFrame:
    seen = t.base("lineitem").select(F.col("l_suppkey").alias("site_id")).distinct()
    return t.view("fx_sites").join(seen, "site_id", "left_anti").select("site_id")


@query(
    "l3_sample_n",
    "SELECT sample_id FROM fx_points ORDER BY md5('42:' || sample_id), sample_id LIMIT 1200",
    ("fx_points",),
)
def l3(t: Tables) -> DataFrame:
    return ranking.sample_n(t.view("fx_points"), 1200, "sample_id").select("sample_id")


@query(
    "l4_shuffle_rows",
    "SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) - 1 AS position FROM fx_points",
    ("fx_points",),
)
def l4(t: Tables) -> DataFrame:
    return ranking.shuffle_position(t.view("fx_points"), "sample_id", "position").select("sample_id", "position")


@query(
    "a15_extent",
    "SELECT round(min(longitude), 6) AS min_x, round(max(longitude), 6) AS max_x, round(min(latitude), 6) AS min_y, round(max(latitude), 6) AS max_y, count(*) AS \"rows\" FROM fx_points",
    ("fx_points",),
)
def a15(t: Tables) -> DataFrame:
    return tidy(polygon.extent(t.view("fx_points"), "longitude", "latitude"))


NEEDED = ["sample_id", "longitude", "latitude"]


@query("s7_require_columns", f"SELECT sample_id, {PLACE} FROM fx_points", ("fx_points",))
def s7(t: Tables) -> DataFrame:
    """The points as they are, once every needed column is there."""
    return tidy(sources.require_columns(t.view("fx_points"), NEEDED).select(*NEEDED))
