"""Pulled histories: a later pull replaces an earlier one, and totals follow it."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slopecast.operators import rain
from slopecast.session import shared_dir
from slopecast.streaming import readings as streaming

SCHEMA = "loc_id long, ts timestamp_ntz, mm double, pull int"
START = datetime(2024, 5, 1)


def at(hour):
    return START + timedelta(hours=hour)


def fed(spark, *batches):
    """Each list of rows as one file, read in this order, one a batch."""
    feed = shared_dir(spark, "pulls-feed")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    stream = streaming.reading_stream(spark, feed, SCHEMA, max_files=1)
    kept, late = streaming.run_upserts(streaming.last_pulls(stream, ["loc_id"]), ["loc_id", "ts"], "pulls")
    return {(r.loc_id, r.ts): (r.pull, r.mm) for r in kept.collect()}, late, kept


def test_last_pull_stands_and_totals_follow(spark):
    first = [(1, at(h), 1.0, 1) for h in range(4)] + [(2, at(3), 5.0, 1)]
    second = [(1, at(2), 4.0, 2), (1, at(3), 0.0, 2), (2, at(3), 5.0, 2), (None, at(3), 2.0, 2)]
    known, late, kept = fed(spark, first, second)
    assert late == 0
    assert known == {(1, at(0)): (1, 1.0), (1, at(1)): (1, 1.0), (1, at(2)): (2, 4.0), (1, at(3)): (2, 0.0), (2, at(3)): (2, 5.0), (None, at(3)): (2, 2.0)}
    totals = rain.trailing_totals(kept, F.lit(at(3)), "loc_id").where("loc_id = 1").first()
    assert (totals.rain_1h_mm, totals.rain_3h_mm, totals.rain_72h_mm) == (0.0, 5.0, 6.0)


def test_older_pull_and_repeats_change_nothing(spark):
    known, late, _ = fed(spark, [(1, at(5), 2.0, 2)], [(1, at(5), 9.0, 1), (1, at(5), 2.0, 2)])
    assert known == {(1, at(5)): (2, 2.0)} and late == 0


def test_rows_behind_the_watermark_are_counted(spark):
    known, late, _ = fed(spark, [(1, at(9), 1.0, 1), (1, at(0), 1.0, 1)], [(1, at(9), 2.0, 2)], [(1, at(0), 7.0, 3), (1, at(1), 7.0, 3), (1, at(9), 3.0, 3)])
    assert late == 2
    assert known == {(1, at(0)): (1, 1.0), (1, at(9)): (3, 3.0)}


def test_empty_feed(spark):
    feed = shared_dir(spark, "pulls-feed")
    spark.createDataFrame([], SCHEMA).write.parquet(feed)
    kept, late = streaming.run_upserts(streaming.last_pulls(streaming.reading_stream(spark, feed, SCHEMA), ["loc_id"]), ["loc_id", "ts"], "pulls")
    assert kept.count() == 0 and late == 0 and kept.columns == ["loc_id", "ts", "pull", "mm"]
