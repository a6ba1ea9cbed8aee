"""Reading streams, their trailing totals and the per-batch warning refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.rain import RAIN_COLUMNS, rain_column, up_to
from ..session import exists, release, shared_dir
from ..settings import RAIN_WINDOWS


def reading_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Readings that land as Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def last_pulls(readings: DataFrame, keys: list[str], pull: str = "pull", time: str = "ts", amount: str = "mm", delay: str = "1 hour") -> DataFrame:
    """(keys, time, pull, amount) of the last pull of each reading, for update mode: a later pull replaces an earlier one.

    A pull that comes again, or an older one that comes late, changes nothing; of several amounts in one
    pull the largest stands. A reading behind the watermark is dropped, which the state operator counts.
    """
    timed = readings.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    last = timed.groupBy(*keys, time).agg(F.max(F.struct(pull, amount)).alias("_last"))
    return last.select(*keys, F.col(time).cast("timestamp_ntz").alias(time), f"_last.{pull}", f"_last.{amount}")


def run_upserts(stream: DataFrame, keys: list[str], purpose: str) -> tuple[DataFrame, int]:
    """Drain the available input in update mode; the row of the last batch for each key, and the rows dropped as too late.

    Every batch writes its changed rows under its own number, so one that is replayed rewrites its own.
    """
    spark = stream.sparkSession
    out, state = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if not exists(spark, out):  # nothing to read, so no batch
        return spark.createDataFrame([], stream.schema), late
    rest = [c for c in stream.columns if c not in keys]
    changes = spark.read.option("basePath", out).parquet(out)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, "_last.*"), late


HOUR = 3_600_000  # milliseconds
#: Window ends in one row of lists, which Spark takes apart: the way from Python to Spark costs by the row.
ENDS_A_ROW = 24
#: What is kept of a location: its hours (by their ends) and sums that open windows need, and the last end emitted.
KEPT = "hours array<long>, amounts array<double>, emitted long"


def window_totals(hours: np.ndarray, amounts: np.ndarray, after: int | None, until: int) -> pd.DataFrame:
    """Totals at each window end in (after, until] whose longest window holds a reading; hours are counted by their ends.

    Hours far apart are not bridged: the ends between them, which no reading reaches, are skipped.
    """
    longest = max(RAIN_WINDOWS)
    order = np.argsort(hours, kind="stable")
    hours, amounts = hours[order], amounts[order]
    ends, totals = [np.empty(0, np.int64)], [[np.empty(0)] for _ in RAIN_WINDOWS]
    bounds = [0, *(np.flatnonzero(np.diff(hours) >= longest) + 1).tolist(), len(hours)]
    for start, stop in zip(bounds, bounds[1:]) if len(hours) else ():
        run, summed = hours[start:stop], amounts[start:stop]
        first = int(run[0])
        low = first if after is None else max(first, after + 1)
        high = min(int(run[-1]) + longest - 1, until)
        if low > high:
            continue
        dense = np.zeros(high - first + longest)
        inside = run <= high
        np.add.at(dense, run[inside] - first + longest - 1, summed[inside])
        views = np.lib.stride_tricks.sliding_window_view(dense, longest)[low - first :]
        ends.append(np.arange(low, high + 1))
        for found, h in zip(totals, RAIN_WINDOWS):
            found.append(views[:, longest - h :].sum(1))
    return pd.DataFrame({"end": np.concatenate(ends)} | {c: np.concatenate(found) for c, found in zip(RAIN_COLUMNS, totals)})


def _by_hour(hours: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, place = np.unique(hours, return_inverse=True)
    return each, np.bincount(place, amounts, len(each))


def _hourly_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per location and hour of a batch: the time of its last reading and the sum."""
    for batch in batches:
        folded = pa.table(batch).group_by(["_loc", "_end"]).aggregate([("_at", "max"), ("_mm", "sum")])
        yield from folded.rename_columns(["_loc", "_end", "_at", "_mm"]).combine_chunks().to_batches()


def _close_windows(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    hours, amounts, emitted = state.get if state.exists else ([], [], None)
    hours, amounts = np.array(hours, np.int64), np.array(amounts, float)
    for part in () if state.hasTimedOut else batches:  # folded as they come, so a busy location fits
        hours, amounts = _by_hour(np.concatenate([hours, part["_end"].to_numpy()]), np.concatenate([amounts, part["_mm"].to_numpy()]))
    until = state.getCurrentWatermarkMs() // HOUR
    found = window_totals(hours, amounts, emitted, until)
    needed = hours + max(RAIN_WINDOWS) - 1 > until
    if needed.any():
        state.update((hours[needed].tolist(), amounts[needed].tolist(), int(until)))
        # A timer fires once the watermark is beyond it, an end is closed once it is reached.
        state.setTimeoutTimestamp(int(max(until + 1, hours[needed].min())) * HOUR - 1)
    elif state.exists:
        state.remove()
    if len(found):
        cuts = range(ENDS_A_ROW, len(found), ENDS_A_ROW)
        lists = {c: pd.Series(np.split(found[c].to_numpy(), cuts), dtype=object) for c in found.columns}
        yield pd.DataFrame({"_loc": [key[0]] * (len(cuts) + 1)} | lists)


def stream_trailing_totals(
    readings: DataFrame, loc: str = "loc_id", time: str = "ts", amount: str = "mm", delay: str = "1 hour"
) -> DataFrame:
    """(loc, window_end, totals) for every closed hourly window end that a reading reaches, in append mode.

    Tasks fold their readings into hourly sums before the shuffle, so a busy location is not sent row by row.
    A location is one state row: the sums of the hours that open windows still need, and the last end emitted.
    A timer in event time closes the ends after its last reading; without open windows it leaves the state. A
    reading without a time or an amount counts for nothing; a task's sum of an hour whose last reading is behind
    the watermark is dropped and counted. Shifting time back by a microsecond turns [start, end) into (start, end].
    """
    kind = dict(readings.dtypes)[loc]
    at = F.col(time).cast("timestamp") - F.expr("INTERVAL 0.000001 SECOND")
    present = readings.where(F.col(amount).isNotNull() & ~F.isnan(amount) & F.col(time).isNotNull()).select(
        F.col(loc).alias("_loc"), F.floor(F.unix_millis(at) / HOUR + 1).alias("_end"), at.alias("_at"), F.col(amount).cast("double").alias("_mm")
    )
    hourly = present.mapInArrow(_hourly_sums, f"_loc {kind}, _end long, _at timestamp, _mm double").withWatermark("_at", delay)
    totals = hourly.groupBy("_loc").applyInPandasWithState(
        _close_windows,
        f"_loc {kind}, end array<long>, {', '.join(f'{c} array<double>' for c in RAIN_COLUMNS)}",
        KEPT,
        "append",
        "EventTimeTimeout",
    )
    each = totals.select(F.col("_loc").alias(loc), F.explode(F.arrays_zip("end", *RAIN_COLUMNS)).alias("_at"))
    end = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, CAST(_at.end AS INT))")
    return each.select(loc, end.alias("window_end"), *[f"_at.{c}" for c in RAIN_COLUMNS])


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a Parquet table and return that table."""
    return run_counted(stream, purpose, mode)[0]


def run_counted(stream: DataFrame, purpose: str, mode: str = "append") -> tuple[DataFrame, int]:
    """Drain the available input into a Parquet table; that table, and the rows dropped as too late."""
    spark = stream.sparkSession
    out, state = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-state")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), late


def fold_recent(
    batch: DataFrame, folder: str, batch_id: int, current: Column | None = None, loc: str = "loc_id", time: str = "ts", amount: str = "mm"
) -> tuple[DataFrame, Column, bool]:
    """Readings of the longest window up to ``current``, of this batch and all before: one row per location and instant.

    Without ``current`` the clock is the latest reading so far. Returned besides are the clock, and whether the
    batch moved it or brought a reading that still counts. The table of each batch is written under its number
    from that of the batch before, so a batch that is replayed after a failure rewrites its own. Tables two
    batches back are released.
    """
    spark = batch.sparkSession
    given = batch.where(F.col(amount).isNotNull() & ~F.isnan(amount)).select(loc, time, amount)
    before = f"{folder}/batch={batch_id - 1}"
    known = spark.read.parquet(before) if exists(spark, before) else given.limit(0)
    moved = False
    if current is None:
        then, now = (rows.agg(F.max(time)).first()[0] for rows in (known, given))
        moved = now is not None and (then is None or now > then)
        current = F.lit(now if moved else then).cast(batch.schema[time].dataType)
    counts = (F.col(time) <= current) & (F.col(time) > current - F.make_dt_interval(hours=F.lit(max(RAIN_WINDOWS))))
    target = f"{folder}/batch={batch_id}"
    recent = given.unionByName(known).where(counts)
    recent.groupBy(loc, time).agg(F.sum(amount).alias(amount)).write.mode("overwrite").parquet(target)
    release(spark, f"{folder}/batch={batch_id - 2}")
    return spark.read.parquet(target), current, moved or not given.where(counts).isEmpty()


def stream_refresh(
    readings: DataFrame,
    refresh: Callable[[DataFrame, Column], DataFrame],
    current: Column | None,
    target: str,
    state: str,
    loc: str = "loc_id",
    time: str = "ts",
    amount: str = "mm",
    available_now: bool = True,
) -> StreamingQuery:
    """Recompute a summary after each micro-batch from all readings of the longest window, and store it under the batch's number.

    ``refresh`` gets those readings and the clock. Without ``current`` the clock follows the latest reading. A batch
    that changes neither leaves the last summary as it is; the first one always stores one.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        recent, clock, changed = fold_recent(batch, f"{target}/recent", batch_id, current, loc, time, amount)
        if changed or not exists(batch.sparkSession, f"{target}/summary"):
            refresh(recent, clock).write.mode("overwrite").parquet(f"{target}/summary/batch={batch_id}")

    writer = readings.writeStream.foreachBatch(store).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_summary(spark: SparkSession, target: str) -> DataFrame:
    """The summary of the last batch."""
    batches = spark.read.option("basePath", f"{target}/summary").parquet(f"{target}/summary")
    last = batches.agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{target}/summary/batch={last}")
