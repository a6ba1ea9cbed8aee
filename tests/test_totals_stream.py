"""Trailing totals of a stream: one state row per location, ends closed by data and by timers."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from slopecast.session import shared_dir
from slopecast.streaming import readings as streaming

SCHEMA = "loc_id long, ts timestamp_ntz, mm double"
START = datetime(2024, 5, 1)


def at(hour):
    return START + timedelta(hours=hour)


def fed(spark, *batches):
    feed = shared_dir(spark, "totals-feed")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    stream = streaming.reading_stream(spark, feed, SCHEMA, max_files=1)
    return streaming.run_counted(streaming.stream_trailing_totals(stream), "totals")


def expected(rows, closed):
    """Every hourly end up to the watermark whose 72 hours hold a reading, by looking at all readings."""
    want = {}
    for loc in {r[0] for r in rows}:
        own = [(t, mm) for place, t, mm in rows if place == loc and mm is not None]
        end = START
        while end <= closed:
            spans = [[mm for t, mm in own if end - timedelta(hours=h) < t <= end] for h in (1, 3, 24, 72)]
            if spans[-1]:
                want[loc, end] = tuple(round(sum(s), 6) for s in spans)
            end += timedelta(hours=1)
    return want


def test_totals_equal_all_readings_over_many_batches(spark):
    rng = np.random.default_rng(5)
    batches = []
    for b in range(4):  # three days a batch; location 2 falls silent, 3 returns after more than a window
        rows = [(1, at(72 * b + float(h)), float(rng.integers(0, 50)) / 10) for h in rng.uniform(0, 72, 40)]
        rows += [(2, at(float(h)), 1.5) for h in rng.uniform(0, 20, 5)] if b == 0 else []
        rows += [(3, at(72 * b + 7), 2.0), (3, at(72 * b + 7.5), None), (None, at(72 * b + 9), 0.0)] if b in (0, 3) else []
        batches.append([*rows, (9, at(72 * b + 72), 0.1)])
    found, late = fed(spark, *batches)
    got = {(r[0], r[1]): tuple(round(v, 6) for v in r[2:]) for r in found.collect()}
    assert late == 0
    assert got == expected([r for rows in batches for r in rows], at(72 * 4 - 1) - timedelta(milliseconds=1))


def test_hours_behind_the_watermark_are_counted(spark):
    found, late = fed(spark, [(1, at(5), 1.0)], [(1, at(50), 1.0)], [(1, at(51), 1.0)], [(1, at(6), 7.0), (2, at(7), 7.0), (1, at(60), 1.0)])
    assert late == 2
    assert found.where(F.col("loc_id") == 2).count() == 0
    assert found.agg(F.max("rain_1h_mm")).first()[0] == 1.0


def test_one_state_row_for_a_location(spark):
    feed = shared_dir(spark, "totals-feed")
    rows = [(loc, at(h), 1.0) for loc in (1, 2, 3) for h in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(feed)
    stream = streaming.stream_trailing_totals(streaming.reading_stream(spark, feed, SCHEMA))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "totals-state"))
        .trigger(availableNow=True).start(shared_dir(spark, "totals-out"))
    )
    query.awaitTermination()
    kept = [op for op in query.lastProgress["stateOperators"] if op["operatorName"] == "applyInPandasWithState"]
    assert [op["numRowsTotal"] for op in kept] == [3]


def test_no_readings(spark):
    found, late = fed(spark, [])
    assert found.count() == 0 and late == 0


def test_window_totals_skip_what_no_reading_reaches():
    found = streaming.window_totals(np.array([10, 500]), np.array([1.0, 2.0]), None, 501)
    assert found["end"].tolist() == [*range(10, 82), 500, 501]
    assert found["rain_3h_mm"].tolist() == [1.0] * 3 + [0.0] * 69 + [2.0] * 2
    assert streaming.window_totals(np.array([10]), np.array([1.0]), 81, 600).empty


def test_ends_leave_the_state_function_in_few_rows():
    class State:
        exists, hasTimedOut, get = True, True, ([10], [1.5], None)

        def getCurrentWatermarkMs(self):
            return 600 * streaming.HOUR

        def remove(self):
            self.exists = False

    state = State()
    (rows,) = streaming._close_windows((7,), iter([]), state)
    assert rows["_loc"].tolist() == [7] * 3 and not state.exists
    assert np.concatenate(rows["end"].tolist()).tolist() == [*range(10, 82)]
    assert np.concatenate(rows["rain_3h_mm"].tolist()).tolist() == [1.5] * 3 + [0.0] * 69
