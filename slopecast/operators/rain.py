"""Trailing rainfall totals, triggers and their summaries (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import as_col, trigger_score, window_trigger
from ..settings import RAIN_THRESHOLDS, RAIN_WINDOWS

HOUR_US = 3600 * 10**6


def rain_column(hours: int) -> str:
    return f"rain_{hours}h_mm"


RAIN_COLUMNS = [rain_column(h) for h in RAIN_WINDOWS]


def normalise_time(text: Column | str, default: Column | None = None) -> Column:
    """ISO time as wall clock without zone; ``default`` (or the session's now) where it is missing."""
    wall = F.regexp_replace(as_col(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(F.to_timestamp_ntz(wall), default if default is not None else F.localtimestamp())


def wall_clock(run_time: Column, zone: str) -> Column:
    """An instant given in UTC (without zone) as the wall clock of a zone, to compare with a payload's times."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), run_time.cast("timestamp_ntz"))


def up_to(readings: DataFrame, current: Column, time: str = "ts", amount: str = "mm") -> DataFrame:
    """Present readings that are not in the future."""
    return readings.where(F.col(amount).isNotNull() & ~F.isnan(amount) & (F.col(time) <= current))


def locations_without_readings(locations: DataFrame, readings: DataFrame, current: Column, loc: str = "loc_id") -> DataFrame:
    """Locations whose totals cannot be computed."""
    return locations.join(up_to(readings, current).select(loc).distinct(), loc, "left_anti")


def _since(current: Column, hours: int) -> Column:
    return current - F.make_dt_interval(hours=F.lit(hours))


def trailing_totals(
    readings: DataFrame,
    current: Column,
    loc: str = "loc_id",
    locations: DataFrame | None = None,
    time: str = "ts",
    amount: str = "mm",
) -> DataFrame:
    """Sum over (current - h, current] for each window, one row per location.

    With ``locations`` only the longest window is scanned and silent locations get 0;
    without it every location that has any reading up to ``current`` is returned.
    """
    past = up_to(readings, current, time, amount)
    if locations is not None:
        past = past.where(F.col(time) > _since(current, max(RAIN_WINDOWS)))
    sums = [
        F.sum(F.when(F.col(time) > _since(current, h), F.col(amount)).otherwise(F.lit(0.0))).alias(rain_column(h))
        for h in RAIN_WINDOWS
    ]
    totals = past.groupBy(loc).agg(*sums)
    if locations is None:
        return totals
    return locations.join(totals, loc, "left").fillna(0.0, RAIN_COLUMNS)


def rolling_totals(
    readings: DataFrame, loc: str = "loc_id", time: str = "ts", amount: str = "mm", chunk_hours: int = 24 * 7
) -> DataFrame:
    """Trailing totals at every reading time of every location.

    Each location is cut into time chunks that also receive the preceding 72 hours,
    so a location with a long history is spread over many windows. Readings at the
    same instant are summed before the shuffle.
    """
    longest = max(RAIN_WINDOWS)
    chunk, halo = chunk_hours * HOUR_US, longest * HOUR_US
    instants = (
        readings.where(F.col(amount).isNotNull())
        .groupBy(loc, time)
        .agg(F.sum(amount).alias("_mm"), F.count(F.lit(1)).alias("readings"))
        .withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
        .withColumn("_own", F.floor(F.col("_us") / chunk))
    )
    spread = instants.withColumn("_chunk", F.explode(F.sequence("_own", F.floor((F.col("_us") + halo) / chunk))))
    order = W.partitionBy(loc, "_chunk").orderBy("_us")
    totals = [
        F.sum("_mm").over(order.rangeBetween(-(h * HOUR_US - 1), 0)).alias(rain_column(h)) for h in RAIN_WINDOWS
    ]
    return (
        spread.select(loc, time, "readings", "_own", "_chunk", *totals)
        .where("_own = _chunk")
        .drop("_own", "_chunk")
    )


def current_fields(rain: Column | str, precipitation: Column | str) -> tuple[Column, Column]:
    """Current rain and precipitation; precipitation falls back to rain, then 0."""
    r, p = as_col(rain).cast("double"), as_col(precipitation).cast("double")
    return F.coalesce(r, F.lit(0.0)), F.coalesce(p, r, F.lit(0.0))


def latest_reading(readings: DataFrame, current: Column, loc: str = "loc_id") -> DataFrame:
    """Time and amount of the last reading up to ``current`` per location."""
    return up_to(readings, current).groupBy(loc).agg(
        F.max("ts").alias("latest_time"), F.max_by("mm", F.struct("ts", "mm")).alias("current_precipitation_mm")
    )


def with_trigger(totals: DataFrame, name: str = "rainfall_trigger_score") -> DataFrame:
    return totals.withColumn(name, trigger_score({h: rain_column(h) for h in RAIN_WINDOWS}))


def with_window_triggers(totals: DataFrame) -> DataFrame:
    """Add one clipped trigger per window next to the combined one."""
    singles = {f"trigger_{h}h": window_trigger(rain_column(h), h) for h in RAIN_WINDOWS}
    return with_trigger(totals).withColumns(singles)


def trigger_by_lookup(totals: DataFrame, loc: str) -> DataFrame:
    """The combined trigger in long form: one row per location and window joined to its threshold."""
    spark = totals.sparkSession
    limits = spark.createDataFrame([(rain_column(h), t) for h, t in RAIN_THRESHOLDS.items()], "window string, threshold double")
    long = totals.unpivot([loc], RAIN_COLUMNS, "window", "mm")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mm") / F.col("threshold")))
    scored = long.join(F.broadcast(limits), "window")
    return scored.groupBy(loc).agg(F.max(share).alias("rainfall_trigger_score"))


def rain_maxima(points: DataFrame) -> DataFrame:
    """One row: the largest total of each window and the largest trigger."""
    return points.agg(
        *[F.max(c).alias(f"max_{c}") for c in RAIN_COLUMNS], F.max("rainfall_trigger_score").alias("max_trigger_score")
    )


def attach_totals(points: DataFrame, totals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Points with their totals, and the points or totals that have no counterpart."""
    missing = points.select(key).join(totals, key, "left_anti").withColumn("problem", F.lit("point without readings"))
    extra = totals.select(key).join(points, key, "left_anti").withColumn("problem", F.lit("readings without point"))
    return points.join(totals, key), missing.unionByName(extra)


def hotspots(points: DataFrame, order_id: str, n: int = 4) -> DataFrame:
    """The n highest triggers with their rank; equal triggers keep input order."""
    top = points.orderBy(F.coalesce("rainfall_trigger_score", F.lit(0.0)).desc(), F.col(order_id)).limit(n)
    by_trigger = W.orderBy(F.coalesce("rainfall_trigger_score", F.lit(0.0)).desc(), F.col(order_id))
    return top.withColumn("rank", F.row_number().over(by_trigger))  # n rows


def window_utilisation(maxima: DataFrame) -> DataFrame:
    """Per window the share of its threshold in percent, at most 100."""
    rows = [
        F.struct(
            F.lit(f"{h}h").alias("window"),
            F.col(f"max_{rain_column(h)}").alias("mm"),
            F.least(F.lit(100.0), F.coalesce(f"max_{rain_column(h)}", F.lit(0.0)) / F.lit(t) * 100).alias("percent"),
        )
        for h, t in RAIN_THRESHOLDS.items()
    ]
    return maxima.select(F.inline(F.array(*rows)))
