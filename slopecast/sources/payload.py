"""Rainfall forecast payloads (JSON) to readings and current fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rain import current_fields, normalise_time, wall_clock
from ..settings import PAYLOAD_ZONE

PAYLOAD = (
    "array<struct<hourly: struct<time: array<string>, precipitation: array<double>>, "
    "current: struct<time: string, rain: double, precipitation: double>>>"
)


def utc_now() -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def parse_payloads(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, item, hourly, current): one row per location; a single object counts as a list of one."""
    items = df.select(key, F.posexplode(F.from_json(text, PAYLOAD)).alias("item", "p"))
    return items.select(key, "item", "p.hourly", "p.current")


def payload_readings(items: DataFrame, key: str, run_time: Column | None = None, zone: str = PAYLOAD_ZONE) -> DataFrame:
    """(key, item, ts, mm, current_time) with one row per hourly entry, future hours included.

    Times are the payload's wall clock; a payload without a current time takes ``run_time`` (UTC,
    now by default) in its ``zone``.
    """
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.precipitation").alias("mm"))
    hours = items.select(key, "item", F.col("current.time").alias("now"), F.explode(zipped).alias("h"))
    return hours.select(
        key,
        "item",
        normalise_time("h.time", F.lit(None).cast("timestamp_ntz")).alias("ts"),
        F.col("h.mm").alias("mm"),
        normalise_time("now", wall_clock(utc_now() if run_time is None else run_time, zone)).alias("current_time"),
    )


def payload_current(items: DataFrame, key: str, run_time: Column | None = None, zone: str = PAYLOAD_ZONE) -> DataFrame:
    """(key, item, latest_time, current_rain_mm, current_precipitation_mm); see ``payload_readings`` for a missing time."""
    rain, precipitation = current_fields("current.rain", "current.precipitation")
    return items.select(
        key,
        "item",
        normalise_time("current.time", wall_clock(utc_now() if run_time is None else run_time, zone)).alias("latest_time"),
        rain.alias("current_rain_mm"),
        precipitation.alias("current_precipitation_mm"),
    )
