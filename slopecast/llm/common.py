"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.session import release, shared_dir, tune

#: Rows in one Arrow batch of whole texts; bounds what a Python worker holds at once.
TEXTS_PER_BATCH = 128
#: Rows up to which a counted table may be broadcast (at some tens of bytes a row).
BROADCAST_ROWS = 400_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus queries: adaptive plans and small batches of texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a landed table of at most ``rows`` rows; a larger one joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_limit(share: float) -> int:
    """The largest of the lowest share of all signed 64-bit hashes."""
    return min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))


def hash_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``rows`` rows by the order of a hash of some columns, the same on every layout.

    Only a share of the hash range that holds about twice as many competes, so that what the tasks
    send does not grow with their number.
    """
    share = min(1.0, 2 * (rows + 50) / max(df.count(), 1))
    drawn = F.xxhash64(*by)
    return df.where(drawn <= hash_limit(share)).orderBy(drawn, *by).limit(rows)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``landed`` writes inside are deleted at the end.

    What a lazy result still reads must be written by ``materialise`` instead.
    """
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            release(spark, path)


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """Written below the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts; null counts as empty."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, whatever else the table holds."""
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))


def id_field() -> pa.Field:
    return pa.field("doc_id", pa.int64())
