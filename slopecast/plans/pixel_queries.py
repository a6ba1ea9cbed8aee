"""Pixel-table queries: scan, stack, classify, resample, distance and burning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    circular_encode,
    class_label,
    clip,
    digitize,
    isclose,
    lonlat_to_fraction,
    lonlat_to_pixel,
    null_sentinels,
    pixel_to_lonlat,
    r6,
    risk_formula,
)
from ..operators import classes, pixels, polygon, proximity, resample
from ..operators.pixels import PIXEL
from ..settings import ACCUMULATION_THRESHOLD, CLASS_NODATA, COARSE_RATIO, RISK_SCHEME, SCORE_NODATA, SCORE_SCHEME
from ..sources import sinks
from .fixtures import COARSE, GRID, MEDIUM, Tables
from .registry import query

LAYERS = ["slope", "elevation", "aspect", "ndvi", "lulc", "rainfall", "river_m", "road_m", "twi"]
CLOSE = "abs({c} - CAST(-9999 AS DOUBLE)) <= CAST(0.00000001 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * 9999"
X = "(85.0::DOUBLE + (col_id + 0.5::DOUBLE) * 0.001::DOUBLE)"
Y = "(28.5::DOUBLE + (row_id + 0.5::DOUBLE) * -0.001::DOUBLE)"
CLASS = "CASE WHEN {v} IS NULL THEN 0 WHEN {v} >= 0.8::DOUBLE THEN 5 WHEN {v} >= 0.6::DOUBLE THEN 4 WHEN {v} >= 0.4::DOUBLE THEN 3 WHEN {v} >= 0.2::DOUBLE THEN 2 ELSE 1 END"
SCORE_LABEL = "CASE {k} WHEN 1 THEN 'Very Low' WHEN 2 THEN 'Low' WHEN 3 THEN 'Moderate' WHEN 4 THEN 'High' WHEN 5 THEN 'Very High' END"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


@query(
    "s1_scan_pixels",
    f"SELECT row_id, col_id, {', '.join(f'CASE WHEN NOT ({CLOSE.format(c=c)}) THEN round({c}::DOUBLE, 6) END AS {c}' for c in LAYERS)} FROM fx_grid",
    ("fx_grid",),
)
def s1(t: Tables) -> DataFrame:
    typed = t.grid.withColumns({c: F.col(c).cast("double") for c in LAYERS})
    return _rounded(pixels.clean_layers(typed, LAYERS).select(*PIXEL, *LAYERS), *LAYERS)


@query(
    "s2_raster_meta",
    f"""SELECT layer, CAST(max(row_id) + 1 AS INTEGER) AS height, CAST(max(col_id) + 1 AS INTEGER) AS width,
  round(avg(CASE WHEN value IS NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS missing_percent, 0.001::DOUBLE AS res_x, 0.001::DOUBLE AS res_y,
  85.0::DOUBLE AS "left", round(28.5::DOUBLE - 0.001::DOUBLE * (max(row_id) + 1), 6) AS bottom,
  round(85.0::DOUBLE + 0.001::DOUBLE * (max(col_id) + 1), 6) AS "right", 28.5::DOUBLE AS top
FROM ({' UNION ALL '.join(f"SELECT '{c}' AS layer, row_id, col_id, CASE WHEN NOT ({CLOSE.format(c=c)}) THEN {c}::DOUBLE END AS value FROM fx_grid" for c in LAYERS)}
  UNION ALL SELECT 'score', row_id, col_id, score FROM fx_grid) l GROUP BY layer""",
    ("fx_grid",),
)
def s2(t: Tables) -> DataFrame:
    typed = t.grid.withColumns({c: F.col(c).cast("double") for c in LAYERS})
    long = pixels.melt_layers(pixels.clean_layers(typed, LAYERS), [*LAYERS, "score"])
    return _rounded(pixels.raster_meta(long, GRID), "missing_percent", "bottom", "right")


@query(
    "p4_circular_encode",
    "SELECT row_id, col_id, round(sin(radians(aspect)), 6) + 0.0 AS aspect_sin, round(cos(radians(aspect)), 6) + 0.0 AS aspect_cos FROM fx_grid",
    ("fx_grid",),
)
def p4(t: Tables) -> DataFrame:
    sin, cos = circular_encode("aspect")
    return t.grid.select(*PIXEL, r6(sin).alias("aspect_sin"), r6(cos).alias("aspect_cos"))


@query(
    "p5_null_sentinels",
    f"""SELECT row_id, col_id, CASE WHEN slope <> -9999 THEN slope END AS slope_exact,
  CASE WHEN NOT ({CLOSE.format(c='slope')}) THEN slope END AS slope_close,
  CASE WHEN NOT ({CLOSE.format(c='near')}) THEN round(near, 6) END AS near_close, round(near, 6) AS near_exact
FROM (SELECT *, CASE WHEN slope < 0 THEN slope + CAST(col_id AS DOUBLE) / 500 ELSE slope END AS near FROM fx_grid) g""",
    ("fx_grid",),
)
def p5(t: Tables) -> DataFrame:
    near = F.when(F.col("slope") < 0, F.col("slope") + F.col("col_id").cast("double") / 500).otherwise(F.col("slope"))
    df = t.grid.withColumn("near", near)
    return df.select(
        *PIXEL,
        null_sentinels("slope", [-9999.0, -32768.0], "exact").alias("slope_exact"),
        null_sentinels("slope").alias("slope_close"),
        r6(null_sentinels("near")).alias("near_close"),
        r6("near").alias("near_exact"),
    )


@query(
    "p6_isclose",
    """SELECT row_id, col_id, abs(river_m - road_m) <= 0.00000001::DOUBLE + 0.00001::DOUBLE * abs(road_m) AS same_distance,
  abs(slope + 9999) <= 0.00000001::DOUBLE + 0.00001::DOUBLE * 9999 AS is_nodata, coalesce(abs(score - 0.5::DOUBLE) <= 0.1::DOUBLE, false) AS near_half FROM fx_grid""",
    ("fx_grid",),
)
def p6(t: Tables) -> DataFrame:
    return t.grid.select(
        *PIXEL,
        isclose("river_m", F.col("road_m")).alias("same_distance"),
        isclose("slope", -9999.0).alias("is_nodata"),
        isclose("score", 0.5, rtol=0.0, atol=0.1).alias("near_half"),
    )


@query("p7_pixel_to_lonlat", f"SELECT row_id, col_id, round({X}, 6) AS x, round({Y}, 6) AS y FROM fx_grid", ("fx_grid",))
def p7(t: Tables) -> DataFrame:
    x, y = pixel_to_lonlat("row_id", "col_id", GRID)
    return t.grid.select(*PIXEL, r6(x).alias("x"), r6(y).alias("y"))


@query(
    "p8_lonlat_to_pixel",
    """SELECT sample_id, CAST(floor((latitude - 28.5::DOUBLE) / -0.001::DOUBLE) AS INTEGER) AS row_id, CAST(floor((longitude - 85.0::DOUBLE) / 0.001::DOUBLE) AS INTEGER) AS col_id,
  round((28.5::DOUBLE - latitude) / 0.001::DOUBLE, 6) AS row_at, round((longitude - 85.0::DOUBLE) / 0.001::DOUBLE, 6) AS col_at FROM fx_points""",
    ("fx_points",),
)
def p8(t: Tables) -> DataFrame:
    row, col = lonlat_to_pixel("longitude", "latitude", GRID)
    row_at, col_at = lonlat_to_fraction("longitude", "latitude", GRID)
    return t.view("fx_points").select(
        "sample_id", row.alias("row_id"), col.alias("col_id"), r6(row_at).alias("row_at"), r6(col_at).alias("col_at")
    )


@query("p9_digitize", f"SELECT row_id, col_id, {CLASS.format(v='score')} AS class_value FROM fx_grid", ("fx_grid",))
def p9(t: Tables) -> DataFrame:
    return t.grid.select(*PIXEL, digitize("score").alias("class_value"))


@query(
    "p10_label_map",
    f"SELECT row_id, col_id, {SCORE_LABEL.format(k='(' + CLASS.format(v='score') + ')')} AS label FROM fx_grid",
    ("fx_grid",),
)
def p10(t: Tables) -> DataFrame:
    return t.grid.select(*PIXEL, class_label(digitize("score"), SCORE_SCHEME).alias("label"))


@query(
    "p11_clip",
    "SELECT row_id, col_id, CASE WHEN score IS NOT NULL THEN round(greatest(0, least(1, score * 2 - 0.5::DOUBLE)), 6) + 0.0 END AS clipped FROM fx_grid",
    ("fx_grid",),
)
def p11(t: Tables) -> DataFrame:
    return t.grid.select(*PIXEL, r6(clip(F.col("score") * 2 - F.lit(0.5))).alias("clipped"))


@query(
    "p13_risk_formula",
    "SELECT row_id, col_id, CASE WHEN score IS NOT NULL THEN round(least(1, 0.65::DOUBLE * score + 0.35::DOUBLE * r + 0.25::DOUBLE * score * r), 6) END AS risk FROM (SELECT *, CAST(col_id AS DOUBLE) / 100 AS r FROM fx_grid) g",
    ("fx_grid",),
)
def p13(t: Tables) -> DataFrame:
    return t.grid.select(*PIXEL, r6(risk_formula("score", F.col("col_id").cast("double") / 100)).alias("risk"))


@query(
    "p25_cast_types",
    "SELECT row_id, col_id, CAST(lulc AS DOUBLE) AS lulc, CAST(score AS FLOAT) AS score, CAST(CASE WHEN score > 0.5::DOUBLE THEN 1 ELSE 0 END AS INTEGER) AS landslide FROM fx_grid",
    ("fx_grid",),
)
def p25(t: Tables) -> DataFrame:
    label = F.when(F.col("score") > 0.5, 1).otherwise(0).cast("int")
    return t.grid.select(*PIXEL, F.col("lulc").cast("double"), F.col("score").cast("float"), label.alias("landslide"))


VALID = "slope >= 0 AND slope <= 90 AND elevation >= 0 AND elevation <= 9000 AND aspect >= 0 AND aspect <= 360 AND ndvi >= -1 AND ndvi <= 1 AND rainfall >= 0 AND river_m >= 0 AND road_m >= 0 AND twi >= 0"


@query("f4_pixel_valid_mask", f"SELECT row_id, col_id FROM fx_grid WHERE {VALID}", ("fx_grid",))
def f4(t: Tables) -> DataFrame:
    return pixels.valid_mask(t.grid, LAYERS).select(*PIXEL)


@query(
    "f12_accumulation_threshold",
    "SELECT row_id, col_id, elevation >= 1000 AS is_river FROM fx_grid",
    ("fx_grid",),
)
def f12(t: Tables) -> DataFrame:
    return pixels.at_least(t.grid, "elevation", ACCUMULATION_THRESHOLD, "is_river").select(*PIXEL, "is_river")


@query(
    "j2_stack_layers",
    f"SELECT row_id, col_id, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in [*LAYERS, 'score'])} FROM fx_grid",
    ("fx_grid",),
)
def j2(t: Tables) -> DataFrame:
    columns = [*LAYERS, "score"]
    long = pixels.melt_layers(t.grid, columns)
    return _rounded(pixels.stack_layers(long, columns), *columns)


@query(
    "a21_score_distribution",
    "SELECT count(score) AS valid_pixels, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM fx_grid",
    ("fx_grid",),
)
def a21(t: Tables) -> DataFrame:
    return _rounded(classes.score_distribution(t.grid), "min_score", "max_score", "mean_score")


@query("r12_classify_map", f"SELECT row_id, col_id, round(score, 6) AS score, {CLASS.format(v='score')} AS class_value FROM fx_grid", ("fx_grid",))
def r12(t: Tables) -> DataFrame:
    return _rounded(pixels.classify_map(t.grid.select(*PIXEL, "score")), "score")


@query(
    "k7_color_pixels",
    f"""SELECT row_id, col_id, class_value,
  CASE class_value WHEN 1 THEN 44 WHEN 2 THEN 171 WHEN 3 THEN 255 WHEN 4 THEN 253 WHEN 5 THEN 215 ELSE 0 END AS red,
  CASE class_value WHEN 1 THEN 123 WHEN 2 THEN 217 WHEN 3 THEN 255 WHEN 4 THEN 174 WHEN 5 THEN 25 ELSE 0 END AS green,
  CASE class_value WHEN 1 THEN 182 WHEN 2 THEN 233 WHEN 3 THEN 191 WHEN 4 THEN 97 WHEN 5 THEN 28 ELSE 0 END AS blue,
  CASE WHEN class_value = 0 THEN 0 ELSE 220 END AS alpha
FROM (SELECT row_id, col_id, {CLASS.format(v='score')} AS class_value FROM fx_grid) c""",
    ("fx_grid",),
)
def k7(t: Tables) -> DataFrame:
    classed = pixels.classify_map(t.grid).select(*PIXEL, "class_value")
    return classes.color_pixels(classed, RISK_SCHEME)


@query(
    "k2_write_pixels",
    "SELECT row_id, col_id, CAST(coalesce(score, -9999) AS FLOAT) AS score FROM fx_grid",
    ("fx_grid",),
)
def k2(t: Tables) -> DataFrame:
    path = sinks.write_pixels(t.grid.select(*PIXEL, "score"), t.spark, "score", SCORE_NODATA)
    return t.spark.read.parquet(path).select(*PIXEL, "score")


@query("k2_write_classes", f"SELECT row_id, col_id, CAST({CLASS.format(v='score')} AS TINYINT) AS class_value FROM fx_grid", ("fx_grid",))
def k2_classes(t: Tables) -> DataFrame:
    """The class raster: one byte, 0 where there is no score."""
    classed = pixels.classify_map(t.grid.select(*PIXEL, "score"))
    path = sinks.write_pixels(classed.select(*PIXEL, "class_value"), t.spark, "class_value", CLASS_NODATA, kind="byte")
    return t.spark.read.parquet(path).select(*PIXEL, "class_value")


@query(
    "k2_read_region",
    "SELECT row_id, col_id, CAST(coalesce(score, -9999) AS FLOAT) AS score FROM fx_grid WHERE row_id BETWEEN (SELECT (max(row_id) + 1) // 4 FROM fx_grid) AND (SELECT (max(row_id) + 1) // 2 FROM fx_grid) AND col_id BETWEEN 25 AND 70",
    ("fx_grid",),
)
def k2_region(t: Tables) -> DataFrame:
    """A window over the written scores: tiles outside it are not opened."""
    path = sinks.write_pixels(t.grid.select(*PIXEL, "score"), t.spark, "score", SCORE_NODATA, side=16)
    height = t.shape[0]
    return sinks.read_region(t.spark, path, (height // 4, height // 2), (25, 70), 16).select(*PIXEL, "score")


@query(
    "r1_resample_rule",
    """SELECT layer, CASE WHEN layer = 'lulc' THEN 'nearest' WHEN (0.001::DOUBLE * 100 / n_cols) >= 0.001::DOUBLE * 10 THEN 'cubic_spline' ELSE 'bilinear' END AS kernel, round(0.1::DOUBLE / n_cols, 6) AS a
FROM (SELECT 'rainfall' AS layer, max(col_id) + 1 AS n_cols FROM fx_coarse UNION ALL SELECT 'lulc', max(col_id) + 1 FROM fx_medium UNION ALL SELECT 'slope', max(col_id) + 1 FROM fx_medium) m""",
    ("fx_coarse", "fx_medium"),
)
def r1(t: Tables) -> DataFrame:
    def layer(name: str, view: str) -> DataFrame:
        size = F.lit(0.1) / (F.max("col_id") + 1)
        return t.view(view).agg(size.alias("a")).select(F.lit(name).alias("layer"), "a", (-F.col("a")).alias("e"))

    meta = layer("rainfall", "fx_coarse").unionByName(layer("lulc", "fx_medium")).unionByName(layer("slope", "fx_medium"))
    return pixels.resample_rule(meta, GRID, COARSE_RATIO).select("layer", "kernel", r6("a").alias("a"))


@query(
    "r2_resample_nearest",
    f"""SELECT g.row_id, g.col_id, m.land AS land FROM fx_grid g LEFT JOIN fx_medium m
  ON CAST(floor(({Y.replace('row_id', 'g.row_id')} - 28.5::DOUBLE) / -0.002::DOUBLE) AS INTEGER) = m.row_id AND CAST(floor(({X.replace('col_id', 'g.col_id')} - 85.0::DOUBLE) / 0.002::DOUBLE) AS INTEGER) = m.col_id""",
    ("fx_grid", "fx_medium"),
)
def r2(t: Tables) -> DataFrame:
    return resample.resample(t.grid, GRID, t.view("fx_medium"), MEDIUM, "nearest", "land")


def _smooth_sql(view: str, size: str, steps: str, weight: str) -> str:
    return f"""SELECT row_id, col_id, CASE WHEN mass > 0 THEN round(total / mass, 6) + 0.0 END AS value FROM (
SELECT d.row_id, d.col_id, sum(CASE WHEN s.value IS NOT NULL THEN wr * wc * s.value END) AS total, sum(CASE WHEN s.value IS NOT NULL THEN wr * wc END) AS mass
FROM (SELECT *, {weight.format(t='(v - floor(v))', k='dr')} AS wr, {weight.format(t='(u - floor(u))', k='dc')} AS wc, CAST(floor(v) AS INTEGER) + dr AS sr, CAST(floor(u) AS INTEGER) + dc AS sc
  FROM (SELECT row_id, col_id, ({X} - 85.0::DOUBLE) / {size}::DOUBLE - 0.5::DOUBLE AS u, ({Y} - 28.5::DOUBLE) / -{size}::DOUBLE - 0.5::DOUBLE AS v FROM fx_grid) p,
  (SELECT unnest({steps}) AS dr) a, (SELECT unnest({steps}) AS dc) b) d
LEFT JOIN {view} s ON s.row_id = d.sr AND s.col_id = d.sc GROUP BY d.row_id, d.col_id) w"""


LINEAR_WEIGHT = "(CASE WHEN {k} = 0 THEN 1 - {t} ELSE {t} END)"
SPLINE_WEIGHT = "(CASE WHEN abs({t} - {k}) < 1 THEN (4 - 6 * power(abs({t} - {k}), 2) + 3 * power(abs({t} - {k}), 3)) / 6 WHEN abs({t} - {k}) < 2 THEN power(2 - abs({t} - {k}), 3) / 6 ELSE 0 END)"


@query("r3_resample_bilinear", _smooth_sql("fx_medium", "0.002", "[0, 1]", LINEAR_WEIGHT), ("fx_grid", "fx_medium"))
def r3(t: Tables) -> DataFrame:
    return _rounded(resample.resample(t.grid, GRID, t.view("fx_medium"), MEDIUM, "bilinear"), "value")


@query("r4_resample_cubic_spline", _smooth_sql("fx_coarse", "0.01", "[-1, 0, 1, 2]", SPLINE_WEIGHT), ("fx_grid", "fx_coarse"))
def r4(t: Tables) -> DataFrame:
    return _rounded(resample.resample(t.grid, GRID, t.view("fx_coarse"), COARSE, "cubic_spline"), "value")


@query(
    "w6_nearest_marked_cell",
    """SELECT p.row_id, p.col_id, CAST(min(abs(p.row_id - m.row_id)) AS INTEGER) AS gap
FROM fx_grid p LEFT JOIN fx_grid m ON p.col_id = m.col_id AND m.elevation >= 4400 GROUP BY p.row_id, p.col_id""",
    ("fx_grid",),
)
def w6(t: Tables) -> DataFrame:
    marked = pixels.at_least(t.grid, "elevation", 4400.0, "is_river").select(*PIXEL, "is_river")
    return proximity.nearest_marked_gap(marked, "is_river").select(*PIXEL, "gap")


@query(
    "r6_proximity",
    """SELECT p.row_id, p.col_id, round(30 * sqrt(min(d2)), 6) AS distance FROM
 (SELECT p.row_id, p.col_id, CAST((p.row_id - m.row_id) * (p.row_id - m.row_id) + (p.col_id - m.col_id) * (p.col_id - m.col_id) AS DOUBLE) AS d2
  FROM fx_grid p LEFT JOIN fx_grid m ON m.elevation >= 4450) p GROUP BY p.row_id, p.col_id""",
    ("fx_grid",),
)
def r6_proximity(t: Tables) -> DataFrame:
    marked = pixels.at_least(t.grid, "elevation", 4450.0, "is_river")
    return _rounded(proximity.proximity(marked, "is_river"), "distance")


# Every pixel of a road's box whose corners do not all lie on one side of the road.
ROAD_PIXELS = """SELECT DISTINCT row_id, col_id FROM (
SELECT row_id, col_id, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS c1, (x2 - x1) * (py - y1) - (y2 - y1) * (px + 0.001::DOUBLE - x1) AS c2,
  (x2 - x1) * (py - 0.001::DOUBLE - y1) - (y2 - y1) * (px - x1) AS c3, (x2 - x1) * (py - 0.001::DOUBLE - y1) - (y2 - y1) * (px + 0.001::DOUBLE - x1) AS c4
FROM (SELECT *, 85.0::DOUBLE + col_id * 0.001::DOUBLE AS px, 28.5::DOUBLE - row_id * 0.001::DOUBLE AS py FROM (
  SELECT *, CAST(unnest(range(CAST(floor((least(x1, x2) - 85.0::DOUBLE) / 0.001::DOUBLE) AS INTEGER), CAST(floor((greatest(x1, x2) - 85.0::DOUBLE) / 0.001::DOUBLE) AS INTEGER) + 1)) AS INTEGER) AS col_id FROM (
    SELECT *, CAST(unnest(range(CAST(floor((28.5::DOUBLE - greatest(y1, y2)) / 0.001::DOUBLE) AS INTEGER), CAST(floor((28.5::DOUBLE - least(y1, y2)) / 0.001::DOUBLE) AS INTEGER) + 1)) AS INTEGER) AS row_id FROM fx_roads) a) b) c) d
WHERE least(c1, c2, c3, c4) <= 0 AND greatest(c1, c2, c3, c4) >= 0"""


@query(
    "r7_rasterize_lines",
    f"SELECT g.row_id, g.col_id, CASE WHEN b.row_id IS NULL THEN 0 ELSE 1 END AS burned FROM fx_grid g LEFT JOIN ({ROAD_PIXELS}) b ON g.row_id = b.row_id AND g.col_id = b.col_id",
    ("fx_grid", "fx_roads"),
)
def r7(t: Tables) -> DataFrame:
    return polygon.rasterize_lines(t.grid, t.view("fx_roads"), GRID)


@query(
    "r7_road_distance",
    f"""SELECT p.row_id, p.col_id, round(30 * sqrt(min(CAST((p.row_id - m.row_id) * (p.row_id - m.row_id) + (p.col_id - m.col_id) * (p.col_id - m.col_id) AS DOUBLE))), 6) AS distance
FROM fx_grid p LEFT JOIN (SELECT g.row_id, g.col_id FROM fx_grid g JOIN ({ROAD_PIXELS}) b ON g.row_id = b.row_id AND g.col_id = b.col_id) m ON true GROUP BY p.row_id, p.col_id""",
    ("fx_grid", "fx_roads"),
)
def r7_distance(t: Tables) -> DataFrame:
    """Road proximity as one chain: lines burned into the grid, then the distance to what was burned."""
    roads = polygon.rasterize_lines(t.grid, t.view("fx_roads"), GRID)
    return _rounded(proximity.proximity(roads.withColumn("is_road", F.col("burned") == 1), "is_road"), "distance")
