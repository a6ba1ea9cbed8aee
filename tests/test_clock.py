"""A refresh that follows the latest reading: each step equals the batch result, and idle batches rewrite nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slopecast.operators import rain
from slopecast.session import shared_dir
from slopecast.streaming import readings as streaming

SCHEMA = "loc_id long, ts timestamp_ntz, mm double"
START = datetime(2024, 5, 1)


def at(hour):
    return START + timedelta(hours=hour)


def fed(spark, *files, current=None):
    feed, target, state = (shared_dir(spark, f"clock-{part}") for part in ("feed", "tables", "state"))
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    clocks = []

    def refresh(recent, clock):
        clocks.append(spark.range(1).select(clock).first()[0])
        return rain.trailing_totals(recent, clock)

    streaming.stream_refresh(streaming.reading_stream(spark, feed, SCHEMA, max_files=1), refresh, current, target, state).awaitTermination()
    stored = spark.read.option("basePath", f"{target}/summary").parquet(f"{target}/summary")
    steps = {}
    for r in stored.collect():
        steps.setdefault(r.batch, {})[r.loc_id] = tuple(r[c] for c in rain.RAIN_COLUMNS)
    return steps, clocks


def expected(rows, clock):
    sums = {}
    for loc, ts, mm in rows:
        if mm is not None and clock - timedelta(hours=72) < ts <= clock:
            own = sums.setdefault(loc, [0.0] * 4)
            for k, h in enumerate((1, 3, 24, 72)):
                own[k] += mm if ts > clock - timedelta(hours=h) else 0.0
    return {loc: tuple(own) for loc, own in sums.items()}


FILES = [
    [(1, at(0), 1.0), (2, at(1), 2.0), (1, at(1), None)],
    [(1, at(30), 4.0), (1, at(29), 3.0), (1, at(29), 3.0), (None, at(30), 1.0)],
    [(2, at(20), 8.0)],  # older than the clock, yet within its window
    [(2, at(90), 16.0)],  # the first readings fall out
    [(1, at(2), 32.0), (1, at(95), None)],  # too old, and nothing measured
]


def test_each_step_equals_the_batch_result(spark):
    steps, clocks = fed(spark, *FILES)
    assert clocks == [at(1), at(30), at(30), at(90)]
    assert sorted(steps) == [0, 1, 2, 3]
    for n, clock in enumerate(clocks):
        assert steps[n] == expected([r for f in FILES[: n + 1] for r in f], clock)


def test_a_given_clock_stands(spark):
    steps, clocks = fed(spark, *FILES, current=F.lit(at(30)).cast("timestamp_ntz"))
    assert clocks == [at(30)] * 4  # what lies ahead of the clock refreshes nothing
    assert steps[4] == expected([r for f in FILES for r in f], at(30))


def test_no_readings(spark):
    steps, clocks = fed(spark, [(1, at(0), None)])
    assert steps == {} and clocks == [None]
