"""Rainfall queries: payloads, trailing totals, triggers, alerts and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trigger_score
from ..operators import rain
from ..session import materialise, shared_dir
from ..settings import RAIN_WINDOWS
from ..sources import payload
from ..streaming import readings as streaming
from .cleaning_queries import tidy
from .fixtures import ANCHOR, RUN_TIME, Tables
from .registry import query

FILES = 4
NOW = f"TIMESTAMP '{ANCHOR}'"


def now() -> Column:
    return F.lit(ANCHOR).cast("timestamp_ntz")


def stations(t: Tables, readings: DataFrame | None = None) -> DataFrame:
    """Gauges with trailing totals and every trigger; totals scale with the nation's customers."""
    gauges = t.view("fx_gauges")
    totals = rain.trailing_totals(t.view("fx_area_readings") if readings is None else readings, now(), "station_id", gauges)
    scaled = totals.withColumns({c: F.col(c) * 60 / F.col("customers") for c in rain.RAIN_COLUMNS}).drop("customers")
    return rain.with_window_triggers(scaled)


SUMS = ", ".join(
    f"round(sum(CASE WHEN ts > {NOW} - INTERVAL {h} HOUR THEN mm ELSE 0 END), 6) AS rain_{h}h_mm" for h in RAIN_WINDOWS
)
TOTALS = f"SELECT loc_id, {SUMS} FROM fx_readings WHERE ts <= {NOW} GROUP BY loc_id"


@query("w1_trailing_totals", TOTALS, ("fx_readings",))
def w1(t: Tables) -> DataFrame:
    return tidy(rain.trailing_totals(t.view("fx_readings"), now()))


ROLLING = ", ".join(
    f"round(sum(CASE WHEN b.ts > a.ts - INTERVAL {h} HOUR THEN b.mm ELSE 0 END), 6) AS rain_{h}h_mm" for h in RAIN_WINDOWS
)


@query(
    "w1_rolling_totals",
    f"SELECT a.loc_id, a.ts, {ROLLING} FROM (SELECT DISTINCT loc_id, ts FROM fx_readings) a JOIN fx_readings b ON a.loc_id = b.loc_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 72 HOUR GROUP BY a.loc_id, a.ts",
    ("fx_readings",),
)
def w1_rolling(t: Tables) -> DataFrame:
    return tidy(rain.rolling_totals(t.view("fx_readings")).drop("readings"))


@query(
    "f7_up_to_current",
    f"SELECT loc_id, ts, round(mm, 6) AS mm FROM fx_readings WHERE mm IS NOT NULL AND ts <= {NOW}",
    ("fx_readings",),
)
def f7(t: Tables) -> DataFrame:
    return tidy(rain.up_to(t.view("fx_readings"), now()).select("loc_id", "ts", "mm"))


@query(
    "f7_locations_without_readings",
    "SELECT c_custkey AS loc_id FROM customer WHERE c_custkey NOT IN (SELECT loc_id FROM fx_readings WHERE ts <= TIMESTAMP '2024-01-03 00:00:00')",
    ("fx_readings",),
)
def f7_silent(t: Tables) -> DataFrame:
    places = t.base("customer").select(F.col("c_custkey").alias("loc_id"))
    return rain.locations_without_readings(places, t.view("fx_readings"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))


@query(
    "w2_current_fields",
    f"SELECT loc_id, max(ts) AS latest_time, round(arg_max(mm, ts), 6) AS current_precipitation_mm FROM fx_readings WHERE ts <= {NOW} GROUP BY loc_id",
    ("fx_readings",),
)
def w2(t: Tables) -> DataFrame:
    return tidy(rain.latest_reading(t.view("fx_readings"), now()))


SCORE = "greatest(least(rain_1h_mm / 20, 1), least(rain_3h_mm / 40, 1), least(rain_24h_mm / 100, 1), least(rain_72h_mm / 180, 1))"


@query("p12_trigger_score", f"SELECT loc_id, round({SCORE}, 6) AS rainfall_trigger_score FROM ({TOTALS}) s", ("fx_readings",))
def p12(t: Tables) -> DataFrame:
    totals = tidy(rain.trailing_totals(t.view("fx_readings"), now()))
    score = trigger_score({h: rain.rain_column(h) for h in RAIN_WINDOWS})
    return tidy(totals.select("loc_id", score.alias("rainfall_trigger_score")))


@query("j12_threshold_lookup", f"SELECT loc_id, round({SCORE}, 6) AS rainfall_trigger_score FROM ({TOTALS}) s", ("fx_readings",))
def j12(t: Tables) -> DataFrame:
    return tidy(rain.trigger_by_lookup(tidy(rain.trailing_totals(t.view("fx_readings"), now())), "loc_id"))


@query(
    "a8_rain_maxima",
    "SELECT round(max(rain_1h_mm), 6) AS max_rain_1h_mm, round(max(rain_3h_mm), 6) AS max_rain_3h_mm, round(max(rain_24h_mm), 6) AS max_rain_24h_mm, round(max(rain_72h_mm), 6) AS max_rain_72h_mm, round(max(rainfall_trigger_score), 6) AS max_trigger_score FROM fx_stations",
    ("fx_stations",),
)
def a8(t: Tables) -> DataFrame:
    return tidy(rain.rain_maxima(stations(t)))


@query(
    "j5_attach_readings",
    f"SELECT s.site_id AS loc_id, round(s.longitude, 7) AS longitude, t.rain_72h_mm FROM fx_sites s JOIN ({TOTALS}) t ON s.site_id = t.loc_id",
    ("fx_sites", "fx_readings"),
)
def j5(t: Tables) -> DataFrame:
    places = t.view("fx_sites").withColumnRenamed("site_id", "loc_id")
    attached, _ = rain.attach_totals(places, rain.trailing_totals(t.view("fx_readings"), now()), "loc_id")
    return tidy(attached.select("loc_id", "longitude", "rain_72h_mm"))


@query(
    "j5_unmatched_readings",
    f"SELECT s.site_id AS loc_id, 'point without readings' AS problem FROM fx_sites s WHERE s.site_id NOT IN (SELECT loc_id FROM ({TOTALS}) t)",
    ("fx_sites", "fx_readings"),
)
def j5_audit(t: Tables) -> DataFrame:
    places = t.view("fx_sites").withColumnRenamed("site_id", "loc_id")
    return rain.attach_totals(places, rain.trailing_totals(t.view("fx_readings"), now()), "loc_id")[1]


@query(
    "w3_hotspot_rank",
    f"SELECT loc_id, rainfall_trigger_score, CAST(row_number() OVER (ORDER BY rainfall_trigger_score DESC, loc_id) AS INTEGER) AS \"rank\" FROM (SELECT loc_id, round({SCORE}, 6) AS rainfall_trigger_score FROM ({TOTALS}) s) x ORDER BY rainfall_trigger_score DESC, loc_id LIMIT 4",
    ("fx_readings",),
)
def w3(t: Tables) -> DataFrame:
    scored = tidy(rain.with_trigger(rain.trailing_totals(t.view("fx_readings"), now())))
    return rain.hotspots(scored, "loc_id").select("loc_id", "rainfall_trigger_score", "rank")


MAXIMA = "SELECT max(rain_1h_mm) AS m1, max(rain_3h_mm) AS m3, max(rain_24h_mm) AS m24, max(rain_72h_mm) AS m72 FROM fx_stations"


@query(
    "p22_window_utilisation",
    f""", m AS ({MAXIMA}) SELECT '1h' AS "window", round(m1, 6) AS mm, round(least(100, m1 / 20 * 100), 6) AS percent FROM m UNION ALL SELECT '3h', round(m3, 6), round(least(100, m3 / 40 * 100), 6) FROM m
UNION ALL SELECT '24h', round(m24, 6), round(least(100, m24 / 100 * 100), 6) FROM m UNION ALL SELECT '72h', round(m72, 6), round(least(100, m72 / 180 * 100), 6) FROM m""",
    ("fx_stations",),
)
def p22(t: Tables) -> DataFrame:
    return tidy(rain.window_utilisation(rain.rain_maxima(stations(t))))


# One payload per event: an hour before, a missing entry, an hour ahead of the current time.
PAYLOAD = """'{"hourly":{"time":["' || {t0} || '","' || {t1} || '","' || {t2} || '"],"precipitation":[' || CAST(CAST(value * 100 AS INT) AS STRING) || ',null,7]},"current":{"time":"' || {t1} || '+05:45","precipitation":' || CASE WHEN event_id % 2 = 0 THEN '3' ELSE 'null' END || '}}' AS payload"""


def _payloads(t: Tables, text: str = PAYLOAD, key: str = "event_id") -> DataFrame:
    for name, time in (("{t0}", "ts - INTERVAL 1 HOUR"), ("{t1}", "ts"), ("{t2}", "ts + INTERVAL 1 HOUR")):
        text = text.replace(name, f"date_format({time}, \"yyyy-MM-dd'T'HH:mm:ss\")")
    return t.base("events").selectExpr(key, text)


@query(
    "s5_parse_forecast_json",
    """SELECT event_id, 0 AS item, date_trunc('second', ts - INTERVAL 1 HOUR) AS ts, CAST(CAST(trunc(value * 100) AS INTEGER) AS DOUBLE) AS mm, date_trunc('second', ts) AS current_time FROM events
UNION ALL SELECT event_id, 0, date_trunc('second', ts), NULL, date_trunc('second', ts) FROM events
UNION ALL SELECT event_id, 0, date_trunc('second', ts + INTERVAL 1 HOUR), 7, date_trunc('second', ts) FROM events""",
)
def s5(t: Tables) -> DataFrame:
    items = payload.parse_payloads(_payloads(t), "payload", "event_id")
    return payload.payload_readings(items, "event_id")


@query(
    "w1_payload_totals",
    f"""SELECT user_id, {SUMS} FROM (SELECT user_id, date_trunc('second', ts - INTERVAL 1 HOUR) AS ts, CAST(CAST(trunc(value * 100) AS INTEGER) AS DOUBLE) AS mm FROM events
UNION ALL SELECT user_id, date_trunc('second', ts + INTERVAL 1 HOUR), 7 FROM events) r WHERE ts <= {NOW} GROUP BY user_id""",
)
def w1_payloads(t: Tables) -> DataFrame:
    """Forecast payloads of a location, read and summed up as one chain; entries without an amount and hours to come count for nothing."""
    items = payload.parse_payloads(_payloads(t, key="user_id"), "payload", "user_id")
    return tidy(rain.trailing_totals(payload.payload_readings(items, "user_id"), now(), "user_id"))


UNTIMED = PAYLOAD.replace("\"time\":\"' || {t1} || '+05:45\"", "\"time\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"' || {t1} || '+05:45\"' END || '")


@query(
    "p26_time_normalise",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-15 15:08:00' ELSE date_trunc('second', ts) END AS latest_time, 0::DOUBLE AS current_rain_mm,
  CASE WHEN event_id % 2 = 0 THEN 3::DOUBLE ELSE 0::DOUBLE END AS current_precipitation_mm FROM events""",
)
def p26(t: Tables) -> DataFrame:
    """A third of the payloads have no current time and take the run's, in their own zone."""
    items = payload.parse_payloads(_payloads(t, UNTIMED), "payload", "event_id")
    run_time = F.lit(RUN_TIME[:19].replace("T", " ")).cast("timestamp_ntz")
    return payload.payload_current(items, "event_id", run_time).drop("item")


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(t: Tables) -> DataFrame:
    raw = streaming.reading_stream(t.spark, t.sf_dir, EVENTS, "events.parquet")
    return raw.select(F.col("user_id").alias("loc_id"), "ts", (F.col("value") / 10).alias("mm"), "event_id")


@query("s8_scan_readings_stream", "SELECT loc_id, ts, round(mm, 6) AS mm FROM fx_readings", ("fx_readings",))
def s8(t: Tables) -> DataFrame:
    return tidy(streaming.run_to_table(_event_stream(t).drop("event_id"), "readings"))


ENDS = "SELECT time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour_end, loc_id, mm FROM fx_readings"
CLOSED = f"""SELECT loc_id, hour_end + INTERVAL 1 HOUR * k AS window_end, round(sum(CASE WHEN k < 1 THEN mm ELSE 0 END), 6) AS rain_1h_mm, round(sum(CASE WHEN k < 3 THEN mm ELSE 0 END), 6) AS rain_3h_mm,
  round(sum(CASE WHEN k < 24 THEN mm ELSE 0 END), 6) AS rain_24h_mm, round(sum(mm), 6) AS rain_72h_mm
FROM ({ENDS}) e, (SELECT unnest(range(0, 72)) AS k) s GROUP BY loc_id, hour_end + INTERVAL 1 HOUR * k HAVING hour_end + INTERVAL 1 HOUR * k <= (SELECT max(ts) - INTERVAL 1 MICROSECOND - INTERVAL 1 HOUR FROM fx_readings)"""


@query("t1_stream_trailing_totals", CLOSED, ("fx_readings",))
def t1(t: Tables) -> DataFrame:
    return tidy(streaming.run_to_table(streaming.stream_trailing_totals(_event_stream(t)), "totals"))


LAST = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM fx_readings)"


@query(
    "t3_late_reading_policy",
    f"""SELECT loc_id, ts, CASE WHEN ts <= {LAST} THEN 2 ELSE 3 END AS pull, round(max(mm) + CASE WHEN ts <= {LAST} THEN 1 ELSE 2 END, 6) AS mm,
  (SELECT count(*) FROM (SELECT DISTINCT loc_id, ts FROM fx_readings WHERE ts <= {LAST}) d) AS too_late FROM fx_readings GROUP BY loc_id, ts""",
    ("fx_readings",),
)
def t3(t: Tables) -> DataFrame:
    """The history is pulled three times, one batch each, with other amounts: the last pull replaces what was known.

    What lies behind the watermark, which holds for late rows from the third batch on, is dropped and counted.
    """
    feed = shared_dir(t.spark, "late-feed")
    for pull in (1, 2, 3):
        given = t.view("fx_readings").select("loc_id", "ts", (F.col("mm") + (pull - 1)).alias("mm"), F.lit(pull).alias("pull"))
        given.repartition(FILES).write.mode("append").parquet(feed)
    stream = streaming.reading_stream(t.spark, feed, "loc_id long, ts timestamp_ntz, mm double, pull int", max_files=FILES)
    kept, late = streaming.run_upserts(streaming.last_pulls(stream, ["loc_id"]), ["loc_id", "ts"], "pulls")
    return tidy(kept.withColumn("too_late", F.lit(late).cast("long")))


WEEKS = "date_trunc('week', ts)"
LATEST = "(SELECT max(ts) AS latest FROM fx_readings)"
CLOCK_SUMS = ", ".join(f"round(sum(CASE WHEN ts > latest - INTERVAL {h} HOUR THEN mm ELSE 0 END), 6) AS rain_{h}h_mm" for h in RAIN_WINDOWS)


@query(
    "t2_stream_clock",
    f"SELECT loc_id, {CLOCK_SUMS}, max(latest) AS clock, (SELECT count(DISTINCT {WEEKS}) FROM fx_readings) AS refreshes FROM fx_readings, {LATEST} l WHERE ts > latest - INTERVAL 72 HOUR GROUP BY loc_id",
    ("fx_readings",),
)
def t2_clock(t: Tables) -> DataFrame:
    """Readings arrive week by week, then the first week's again: the clock follows them, and what is old by then refreshes nothing."""
    feed, target, state = (shared_dir(t.spark, f"clock-{part}") for part in ("feed", "tables", "state"))
    rows = materialise(t.view("fx_readings").select("loc_id", "ts", "mm", F.date_trunc("week", "ts").alias("week")), "clock-rows")
    weeks = [r.week for r in rows.select("week").distinct().orderBy("week").collect()]  # one row a week, each a batch
    for week in [*weeks, *weeks[:1]]:
        rows.where(F.col("week") == F.lit(week)).drop("week").coalesce(1).write.mode("append").parquet(feed)
    stream = streaming.reading_stream(t.spark, feed, "loc_id long, ts timestamp_ntz, mm double", max_files=1)

    def refresh(recent: DataFrame, clock: Column) -> DataFrame:
        return rain.trailing_totals(recent, clock).withColumn("clock", clock)

    streaming.stream_refresh(stream, refresh, None, target, state).awaitTermination()
    stored = t.spark.read.option("basePath", f"{target}/summary").parquet(f"{target}/summary")
    refreshes = stored.agg(F.countDistinct("batch")).first()[0]
    return tidy(streaming.latest_summary(t.spark, target).withColumn("refreshes", F.lit(refreshes).cast("long")))
