"""Triangulation, interpolation, fused risk and class-summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classes, pixels, rain, surface
from ..operators.pixels import PIXEL
from ..session import shared_dir
from ..settings import RISK_LABELS, RISK_SCHEME, SCORE_LABELS, SCORE_NODATA
from ..sources import sinks
from ..streaming import readings as streaming
from .cleaning_queries import tidy
from .fixtures import GRID, RUN_TIME, Tables
from .pixel_queries import CLASS
from .point_queries import SCORED_POINTS
from .rain_queries import FILES, now, stations
from .registry import query

TRIGGER = "rainfall_trigger_score"
LAYERS = {"combined": TRIGGER, "1h": "trigger_1h", "3h": "trigger_3h", "24h": "trigger_24h", "72h": "trigger_72h"}
SQL_LAYERS = {"combined": "combined", "1h": "t1", "3h": "t3", "24h": "t24", "72h": "t72"}
EDGES = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]


def class_rows(labels: list[str]) -> str:
    rows = [f"({n}, '{label}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, (label, (lo, hi)) in enumerate(zip(labels, EDGES), start=1)]
    return f"(VALUES {', '.join(rows)}) c(class_value, label, lo, hi)"


@query("r9_triangulate", "SELECT i, j, k FROM sq_triangles", ("sq_triangles",))
def r9(t: Tables) -> DataFrame:
    return surface.triangulate(t.view("fx_gauges"))


@query("j7_interpolation_join", "SELECT row_id, col_id, i, j, k FROM sq_hits", ("sq_hits",))
def j7(t: Tables) -> DataFrame:
    return surface.containing_triangle(t.grid, t.view("fx_gauges"), GRID, t.shape)


@query(
    "r8_interpolate_linear",
    "SELECT g.row_id, g.col_id, round(combined, 6) AS rainfall_trigger_score FROM fx_grid g LEFT JOIN sq_linear l ON l.row_id = g.row_id AND l.col_id = g.col_id",
    ("fx_grid", "sq_linear"),
)
def r8(t: Tables) -> DataFrame:
    fitted = surface.interpolate(t.grid.select(*PIXEL), stations(t), [TRIGGER], GRID, t.shape, nearest=False)
    return tidy(fitted.drop("in_hull"))


@query(
    "r10_nearest_fallback",
    "SELECT row_id, col_id, round(combined, 6) AS rainfall_trigger_score FROM sq_nearest",
    ("sq_nearest",),
)
def r10(t: Tables) -> DataFrame:
    fitted = surface.interpolate(t.grid.select(*PIXEL), stations(t), [TRIGGER], GRID, t.shape)
    return tidy(fitted.where("not in_hull").drop("in_hull"))


@query(
    "r11_window_risk_layers",
    " UNION ALL ".join(
        f"SELECT row_id, col_id, '{name}' AS layer, round(risk_{v}, 6) AS risk, {CLASS.format(v='risk_' + v)} AS class_value FROM sq_risk"
        for name, v in SQL_LAYERS.items()
    ),
    ("sq_risk",),
)
def r11(t: Tables) -> DataFrame:
    layers = surface.risk_layers(t.grid, stations(t), LAYERS, GRID, shape=t.shape)
    return tidy(pixels.classify_map(layers, "risk"))


def risk(t: Tables, points: DataFrame | None = None) -> DataFrame:
    return surface.risk_map(t.grid, stations(t) if points is None else points, GRID, TRIGGER, shape=t.shape)


@query(
    "r13_dynamic_risk_map",
    "SELECT row_id, col_id, round(score, 6) AS score, round(combined, 6) AS rainfall_trigger_score, in_hull, round(risk_combined, 6) AS risk FROM sq_risk",
    ("sq_risk",),
)
def r13(t: Tables) -> DataFrame:
    return tidy(risk(t))


@query("k2_write_risk", "SELECT g.row_id, g.col_id, round(coalesce(risk_combined, -9999::DOUBLE), 6) AS risk FROM fx_grid g LEFT JOIN sq_risk r ON g.row_id = r.row_id AND g.col_id = r.col_id", ("fx_grid", "sq_risk"))
def k2_risk(t: Tables) -> DataFrame:
    """The risk raster over the whole grid, with the sentinel where there is no score."""
    whole = t.grid.select(*PIXEL).join(risk(t).select(*PIXEL, "risk"), PIXEL, "left")
    path = sinks.write_pixels(whole, t.spark, "risk", SCORE_NODATA, kind="double")
    return tidy(t.spark.read.parquet(path).select(*PIXEL, "risk"))


MAXIMA = "max(rain_1h_mm) AS m1, max(rain_3h_mm) AS m3, max(rain_24h_mm) AS m24, max(rain_72h_mm) AS m72, max(rainfall_trigger_score) AS mt"
RISK_AREA = f"""SELECT c.class_value, c.label, c.lo, c.hi, count(r.row_id) AS pixel_count, 100.0::DOUBLE * count(r.row_id) / (SELECT count(*) FROM sq_risk) AS area_percent
FROM {class_rows(RISK_LABELS)} LEFT JOIN (SELECT row_id, {CLASS.format(v='risk_combined')} AS k FROM sq_risk) r ON r.k = c.class_value GROUP BY c.class_value, c.label, c.lo, c.hi"""


SUMMARY_OF_RISK = f"""SELECT label AS risk_label, lo AS risk_min, hi AS risk_max, pixel_count, round(area_percent, 6) AS area_percent, '{RUN_TIME}' AS generated_at,
  round(m1, 6) AS max_rain_1h_mm, round(m3, 6) AS max_rain_3h_mm, round(m24, 6) AS max_rain_24h_mm, round(m72, 6) AS max_rain_72h_mm, round(mt, 6) AS max_trigger_score
FROM ({RISK_AREA}) a, (SELECT {MAXIMA} FROM fx_stations) m"""


@query("a7_risk_summary", SUMMARY_OF_RISK, ("sq_risk", "fx_stations"))
def a7(t: Tables) -> DataFrame:
    return tidy(risk_table(t))


@query(
    "p27_generated_at",
    f"SELECT label AS risk_label, '{RUN_TIME}' AS generated_at, count(g.row_id) AS pixel_count FROM {class_rows(RISK_LABELS)} LEFT JOIN fx_grid g ON g.score IS NOT NULL AND {CLASS.format(v='g.score')} = c.class_value GROUP BY label",
    ("fx_grid",),
)
def p27(t: Tables) -> DataFrame:
    """The run time that is given, on every row of a summary."""
    table = classes.risk_summary(t.grid, rain.rain_maxima(stations(t)), RISK_SCHEME, RUN_TIME, "score")
    return table.select("risk_label", "generated_at", "pixel_count")


@query("t2_stream_risk_refresh", SUMMARY_OF_RISK, ("sq_risk", "fx_stations"))
def t2(t: Tables) -> DataFrame:
    """Readings arrive in several files; after each the totals, surface, risk and summary are made anew.

    The last summary is that of all readings, whatever batch they came in.
    """
    feed, target, state = (shared_dir(t.spark, f"refresh-{part}") for part in ("feed", "tables", "state"))
    t.view("fx_area_readings").repartition(FILES).write.parquet(feed)
    stream = streaming.reading_stream(t.spark, feed, "station_id int, ts timestamp_ntz, mm double", max_files=1)

    def refresh(recent: DataFrame, _) -> DataFrame:
        points = stations(t, t.spark.read.parquet(*recent.inputFiles()))
        return tidy(classes.risk_summary(risk(t, points), rain.rain_maxima(points), RISK_SCHEME, RUN_TIME))

    streaming.stream_refresh(stream, refresh, now(), target, state, "station_id").awaitTermination()
    return streaming.latest_summary(t.spark, target)


def risk_table(t: Tables) -> DataFrame:
    return classes.risk_summary(risk(t), rain.rain_maxima(stations(t)), RISK_SCHEME, RUN_TIME)


SUMMARY = f"""SELECT c.class_value, c.label AS class_label, c.lo AS probability_min, c.hi AS probability_max, coalesce(a.n, 0) AS pixel_count, round(100.0::DOUBLE * coalesce(a.n, 0) / (SELECT count(score) FROM fx_grid), 6) AS area_percent,
  coalesce(p.n, 0) AS landslide_count, round(100.0::DOUBLE * coalesce(p.n, 0) / (SELECT count(*) FROM ({SCORED_POINTS}) s WHERE k <> 0), 6) AS landslide_percent
FROM {class_rows(SCORE_LABELS)} LEFT JOIN (SELECT {CLASS.format(v='score')} AS k, count(*) AS n FROM fx_grid GROUP BY 1) a ON a.k = c.class_value LEFT JOIN (SELECT k, count(*) AS n FROM ({SCORED_POINTS}) s GROUP BY k) p ON p.k = c.class_value"""


def score_table(t: Tables) -> DataFrame:
    classified = pixels.classify_map(t.grid.select(*PIXEL, "score"))
    checked = classes.validate_points(t.view("fx_points"), t.grid, GRID)
    return classes.class_summary(classified, checked)


@query("a6_class_summary", SUMMARY, ("fx_grid", "fx_points"))
def a6(t: Tables) -> DataFrame:
    return tidy(score_table(t))


@query(
    "j11_class_lookup",
    f"SELECT g.row_id, g.col_id, c.label, c.lo, c.hi FROM (SELECT row_id, col_id, {CLASS.format(v='score')} AS k FROM fx_grid) g JOIN {class_rows(SCORE_LABELS)} ON g.k = c.class_value",
    ("fx_grid",),
)
def j11(t: Tables) -> DataFrame:
    table = classes.class_table(t.grid, classes.SCORE_SCHEME).drop("color")
    classified = pixels.classify_map(t.grid.select(*PIXEL, "score")).drop("score")
    return classified.join(F.broadcast(table), "class_value").drop("class_value")


@query(
    "a9_capture_share",
    f"""SELECT round(sum(CASE WHEN class_value IN (4, 5) THEN area_percent ELSE 0 END), 5) AS area_high, round(sum(CASE WHEN class_value = 5 THEN area_percent ELSE 0 END), 5) AS area_top,
  round(sum(CASE WHEN class_value IN (4, 5) THEN landslide_percent ELSE 0 END), 5) AS points_high, round(sum(CASE WHEN class_value = 5 THEN landslide_percent ELSE 0 END), 5) AS points_top FROM ({SUMMARY}) s""",
    ("fx_grid", "fx_points"),
)
def a9(t: Tables) -> DataFrame:
    shares = classes.capture_share(
        score_table(t), "class_label", SCORE_LABELS[3:], {"area_percent": "area", "landslide_percent": "points"}
    )
    return shares.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in shares.columns])
