"""Report, address, GeoJSON, Markdown and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alert_level, first_present, format_percent, place_document, place_fields
from ..operators import classes, lookups, rain, workflow
from ..session import materialise
from ..settings import FEATURES, RISK_LABELS
from ..sources import sinks
from .cleaning_queries import tidy
from .fixtures import ANCHOR, GRID, RUN_TIME, RULES, Tables
from .rain_queries import MAXIMA, stations
from .registry import query
from .surface_queries import RISK_AREA, SUMMARY, class_rows, risk_table, score_table

# A geocoder answer per customer; keys come and go with the customer number.
ADDRESS = """'{"address":{' || CASE WHEN c_custkey % 3 = 0 THEN '"village":"' || c_name || '",' ELSE '"village":"",' END
  || CASE WHEN c_custkey % 4 = 0 THEN '"town":"' || c_mktsegment || '",' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '"county":"County ' || c_nationkey || '",' ELSE '' END
  || '"state":"State ' || c_nationkey || '"}' || CASE WHEN c_custkey % 7 = 0 THEN ',"name":"Named ' || c_custkey || '"' ELSE '' END
  || CASE WHEN c_custkey % 2 = 0 THEN ',"display_name":"Shown ' || c_custkey || '"' ELSE '' END || '}' AS payload"""
PARTS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS local_name,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN 'County ' || c_nationkey END AS municipality,
  CASE WHEN c_custkey % 5 = 0 THEN 'County ' || c_nationkey END AS district, 'State ' || c_nationkey AS province,
  CASE WHEN c_custkey % 7 = 0 THEN 'Named ' || c_custkey WHEN c_custkey % 2 = 0 THEN 'Shown ' || c_custkey END AS fallback,
  CASE WHEN c_custkey % 2 = 0 THEN 'Shown ' || c_custkey END AS shown FROM customer"""
DEFAULT_PLACE = "Unnamed place"


@query("p18_first_present", f"SELECT c_custkey, coalesce(local_name, municipality) AS found FROM ({PARTS}) p")
def p18(t: Tables) -> DataFrame:
    address = F.from_json("payload", "address map<string,string>")["address"]
    return t.base("customer").selectExpr("c_custkey", ADDRESS).select("c_custkey", first_present(address, ["village", "town", "county"]).alias("found"))


@query(
    "p19_place_fields",
    f"SELECT c_custkey, coalesce(local_name, fallback, municipality, '{DEFAULT_PLACE}') AS place, local_name, municipality, district, province, coalesce(shown, local_name, fallback, municipality, '{DEFAULT_PLACE}') AS display_name FROM ({PARTS}) p",
)
def p19(t: Tables) -> DataFrame:
    fields = place_fields("doc", DEFAULT_PLACE, parsed=True)
    parsed = t.base("customer").selectExpr("c_custkey", ADDRESS).select("c_custkey", place_document("payload").alias("doc"))
    return parsed.select("c_custkey", *[c.alias(name) for name, c in fields.items()])


# Every second site has a saved answer; where sites share a key the later one stands.
ANSWERS = f"""(SELECT * FROM (SELECT round_even(latitude, 4) AS lat_key, round_even(longitude, 4) AS lon_key, coalesce(local_name, fallback, municipality, '{DEFAULT_PLACE}') AS place, province,
  row_number() OVER (PARTITION BY round_even(latitude, 4), round_even(longitude, 4) ORDER BY site_id DESC) AS n FROM fx_sites JOIN ({PARTS}) p ON site_id = c_custkey WHERE site_id % 2 = 1) s WHERE n = 1)"""
KEYED = "(SELECT sample_id, round_even(latitude, 4) AS lat_key, round_even(longitude, 4) AS lon_key FROM fx_points)"


def _lookups(t: Tables) -> tuple[DataFrame, DataFrame]:
    answered = t.base("customer").selectExpr("c_custkey AS site_id", ADDRESS).where("site_id % 2 = 1")
    saved = lookups.keyed(t.view("fx_sites")).join(answered, "site_id")
    return lookups.keyed(t.view("fx_points")), lookups.last_answers(saved, "site_id", F.col("payload"))


@query(
    "p20_saved_answers",
    f"SELECT sample_id, p.lat_key, p.lon_key, place, province, n IS NOT NULL AS answered FROM {KEYED} p LEFT JOIN {ANSWERS} a ON p.lat_key = a.lat_key AND p.lon_key = a.lon_key",
    ("fx_points", "fx_sites"),
)
def p20_saved(t: Tables) -> DataFrame:
    points, answers = _lookups(t)
    answers = answers.withColumn("answer", place_document("answer"))
    fields = place_fields("answer", DEFAULT_PLACE, parsed=True)
    found = lookups.with_answers(points, answers, {name: fields[name] for name in ("place", "province")})
    return found.select("sample_id", *lookups.KEY, "place", "province", "answered")


@query(
    "p20_keys_to_ask",
    f"SELECT lat_key, lon_key, count(*) AS lookups FROM {KEYED} p WHERE NOT EXISTS (SELECT 1 FROM {ANSWERS} a WHERE a.lat_key = p.lat_key AND a.lon_key = p.lon_key) GROUP BY lat_key, lon_key",
    ("fx_points", "fx_sites"),
)
def p20_ask(t: Tables) -> DataFrame:
    return lookups.keys_to_ask(*_lookups(t))


@query(
    "p23_format_percent",
    """SELECT o_orderkey, CASE WHEN v > 0 AND v < 1 THEN printf('%.2f', v) ELSE printf('%.1f', v) END || '%' AS shown FROM (SELECT o_orderkey, CAST((o_orderkey * 7919) % 4000 AS DOUBLE) / 97 AS v FROM orders) x""",
)
def p23(t: Tables) -> DataFrame:
    value = F.expr("CAST((o_orderkey * 7919) % 4000 AS DOUBLE) / 97")
    return t.base("orders").select("o_orderkey", format_percent(value).alias("shown"))


ALERT = f""", shares AS (SELECT sum(CASE WHEN class_value IN (4, 5) THEN area_percent ELSE 0 END) AS high, sum(CASE WHEN class_value = 5 THEN area_percent ELSE 0 END) AS severe FROM ({RISK_AREA}) a),
m AS (SELECT {MAXIMA.removeprefix('SELECT ').removesuffix(' FROM fx_stations')}, max(rainfall_trigger_score) AS mt FROM fx_stations)"""


def cards(t: Tables, risk: DataFrame) -> DataFrame:
    """One row of headline numbers from the risk summary."""
    shares = classes.capture_share(risk, "risk_label", RISK_LABELS[3:], {"area_percent": "area"})
    top = rain.rain_maxima(stations(t))
    row = top.select(F.struct(*top.columns)).scalar()
    named = shares.withColumn("_m", row).select("_m.*", F.col("area_high").alias("highSevereArea"), F.col("area_top").alias("severeArea"))
    names = {f"max_rain_{h}h_mm": f"maxRain{h}h" for h in (1, 3, 24, 72)} | {"max_trigger_score": "maxTrigger"}
    return named.withColumnsRenamed(names)


@query(
    "p21_alert_level",
    ALERT
    + """
SELECT CASE WHEN severe >= 1 OR high >= 12 OR mt >= 0.6::DOUBLE THEN 'Elevated' WHEN high >= 5 OR mt >= 0.3::DOUBLE OR m72 >= 60 THEN 'Watch' ELSE 'Normal' END AS label,
  CASE WHEN severe >= 1 OR high >= 12 OR mt >= 0.6::DOUBLE THEN '#d7191c' WHEN high >= 5 OR mt >= 0.3::DOUBLE OR m72 >= 60 THEN '#f97316' ELSE '#0f766e' END AS color, round(high, 5) AS high, round(severe, 5) AS severe FROM shares, m""",
    ("sq_risk", "fx_stations"),
)
def p21(t: Tables) -> DataFrame:
    level = alert_level("highSevereArea", "severeArea", "maxTrigger", "maxRain72h")
    found = cards(t, risk_table(t)).withColumn("a", level)
    return found.select(
        "a.label", "a.color", F.round("highSevereArea", 5).alias("high"), F.round("severeArea", 5).alias("severe")
    )


@query(
    "k3_to_geojson",
    """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || round(longitude, 6) || ',' || round(latitude, 6) || ']},"properties":{"sample_id":' || sample_id || ',"longitude":' || round(longitude, 6) || ',"latitude":' || round(latitude, 6) || '}}' AS feature FROM fx_points""",
    ("fx_points",),
)
def k3(t: Tables) -> DataFrame:
    points = t.view("fx_points").select("sample_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))
    return sinks.feature_lines(points, "longitude", "latitude", ["sample_id", "longitude", "latitude"])


@query(
    "k3_feature_collection",
    """SELECT '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']},"properties":{"station_id":' || station_id || ',"longitude":' || longitude || ',"latitude":' || latitude || '}}', ',' ORDER BY station_id) || ']}' AS geojson
FROM (SELECT station_id, round(x, 6) AS longitude, round(y, 6) AS latitude FROM fx_gauges) g""",
    ("fx_gauges",),
)
def k3_collection(t: Tables) -> DataFrame:
    """The gauges, one for each nation, as one document."""
    gauges = t.view("fx_gauges").select("station_id", F.round("x", 6).alias("longitude"), F.round("y", 6).alias("latitude"))
    return sinks.feature_collection(gauges, "longitude", "latitude", ["station_id", "longitude", "latitude"], "station_id")


@query(
    "k4_app_state",
    ALERT
    + f"""
SELECT '{RUN_TIME}' AS generated_at, '2024-01-15T09:15:00' AS latest_time, round(m72, 6) AS max_rain_72h, round(mt, 6) AS max_trigger, round(high, 5) AS high_area,
  (SELECT count(*) FROM fx_stations) AS stations, (SELECT CAST(sum(pixel_count) AS BIGINT) FROM ({RISK_AREA}) a) AS risk_pixels, (SELECT CAST(sum(landslide_count) AS BIGINT) FROM ({SUMMARY}) s) AS events FROM shares, m""",
    ("sq_risk", "fx_stations", "fx_points"),
)
def k4(t: Tables) -> DataFrame:
    risk = materialise(risk_table(t), "risk")  # the cards and the tables both read it
    tables = {"risk": risk, "susceptibility": score_table(t), "rainfall": stations(t)}
    order = {"risk": "risk_min", "susceptibility": "class_value", "rainfall": "station_id"}
    height, width = t.shape
    bounds = [[28.5 - height * 0.001, 85.0], [28.5, 85.0 + width * 0.001]]
    overlays = {"susceptibility": "assets/susceptibility.png", "risk": "assets/risk.png"}
    latest = ANCHOR.replace(" ", "T")
    state = sinks.app_state(cards(t, risk), tables, order, bounds, overlays, RUN_TIME, latest)
    doc = F.from_json(
        "app_state",
        "generatedAt string, rainfallLatestTime string, cards struct<maxRain72h: double, maxTrigger: double, highSevereArea: double>, "
        "summaries struct<risk: array<struct<pixel_count: long>>, susceptibility: array<struct<landslide_count: long>>, rainfall: array<struct<station_id: int>>>",
    )

    def total(items, name: str):
        return F.aggregate(items, F.lit(0).cast("long"), lambda acc, r: acc + r[name])

    return state.select(doc.alias("d")).select(
        F.col("d.generatedAt").alias("generated_at"),
        F.col("d.rainfallLatestTime").alias("latest_time"),
        F.round("d.cards.maxRain72h", 6).alias("max_rain_72h"),
        F.round("d.cards.maxTrigger", 6).alias("max_trigger"),
        F.round("d.cards.highSevereArea", 5).alias("high_area"),
        F.size("d.summaries.rainfall").cast("long").alias("stations"),
        total(F.col("d.summaries.risk"), "pixel_count").alias("risk_pixels"),
        total(F.col("d.summaries.susceptibility"), "landslide_count").alias("events"),
    )


@query(
    "k5_summary_markdown",
    f"""SELECT 0::BIGINT AS line_no, '| class_value | class_label | probability_min | probability_max | pixel_count | area_percent | landslide_count | landslide_percent |' AS line UNION ALL SELECT 1, '| --- | --- | --- | --- | --- | --- | --- | --- |'
UNION ALL SELECT class_value + 1, '| ' || class_value || ' | ' || class_label || ' | ' || printf('%.3f', probability_min) || ' | ' || printf('%.3f', probability_max) || ' | ' || pixel_count || ' | ' || printf('%.3f', area_percent) || ' | ' || landslide_count || ' | ' || printf('%.3f', landslide_percent) || ' |' FROM ({SUMMARY}) s""",
    ("fx_grid", "fx_points"),
)
def k5(t: Tables) -> DataFrame:
    return sinks.markdown_rows(tidy(score_table(t)), "class_value")


VALID = f"SELECT count(*) FROM fx_grid WHERE {' AND '.join(RULES[c] for c in FEATURES if c in RULES)}"


@query(
    "m9_composed_run",
    f"SELECT class_value AS place, label AS risk_label, '{RUN_TIME}' AS generated_at, ({VALID}) AS scored_pixels, ({VALID}) AS classed_pixels, 3::BIGINT AS models, true AS best_chosen FROM {class_rows(RISK_LABELS)}",
    ("fx_grid",),
)
def m9_run(t: Tables) -> DataFrame:
    """The whole run from raw points: three fitted models, the best one's scores, classes and risk.

    Each of the three is fitted once; ``m7`` covers cross-validation.
    """
    done = workflow.run(t.view("fx_points"), t.grid, stations(t), GRID, t.shape, RUN_TIME, folds=0)
    areas = {r.model: r.test_roc_auc for r in done.metrics.collect()}  # one row per model
    summary = materialise(done.risk_summary, "risk-summary")
    scored = summary.agg(F.sum("pixel_count").alias("n")).scalar()
    classed = done.class_summary.agg(F.sum("pixel_count").alias("n")).scalar()
    place = F.array_position(F.array(*[F.lit(label) for label in RISK_LABELS]), F.col("risk_label")).cast("int")
    return summary.select(
        place.alias("place"),
        "risk_label",
        "generated_at",
        scored.cast("long").alias("scored_pixels"),
        classed.cast("long").alias("classed_pixels"),
        F.lit(len(areas)).cast("long").alias("models"),
        F.lit(areas[done.best.name] == max(areas.values())).alias("best_chosen"),
    )
