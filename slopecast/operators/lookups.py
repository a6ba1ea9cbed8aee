"""Place look-ups: points share a look-up by rounded position, and saved answers are used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo_cache_key

KEY = ["lat_key", "lon_key"]


def keyed(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Points with the key of their look-up; without a position both parts are NULL."""
    return points.withColumns(dict(zip(KEY, geo_cache_key(lat, lon))))


def last_answers(saved: DataFrame, order: str, answer: Column) -> DataFrame:
    """(lat_key, lon_key, answer): the answer saved last for each key, the largest of those saved at one time."""
    whole = saved.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY))
    return whole.groupBy(*KEY).agg(F.max(F.struct(F.col(order).alias("o"), answer.alias("answer"))).alias("_last")).select(*KEY, F.col("_last.answer").alias("answer"))


def with_answers(points: DataFrame, answers: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Keyed points with ``fields`` of their saved answer and whether there is one; each point keeps its one row."""
    found = answers.select(*KEY, *[c.alias(name) for name, c in fields.items()], F.lit(True).alias("answered"))
    return points.join(found, KEY, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def keys_to_ask(points: DataFrame, answers: DataFrame) -> DataFrame:
    """(lat_key, lon_key, lookups): each key of the points that no saved answer covers, and how many points wait for it."""
    waiting = points.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("lookups"))
    return waiting.join(answers, KEY, "left_anti")
