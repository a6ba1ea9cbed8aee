"""Exact global positions without a single-task window.

Rows fall into ordered buckets. A row's position is the number of rows in the
earlier buckets (a small aggregate) plus its place inside its own bucket, so the
window runs over many buckets instead of one global partition.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import as_col, hash_key
from ..settings import SEED


HASH_PREFIX = 4  # hex digits: 65,536 even buckets, a million rows each for 65 billion rows
LEAST_BUCKETS, BUCKET_ROWS = 1024, 1_000_000


def range_bucket(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add an ordered bucket number with about equally many rows of ``key`` per bucket, at most about ``BUCKET_ROWS``.

    Equal keys share a bucket, so the key should be unique or already grouped.
    """
    buckets = max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    numeric = df.withColumn(name, F.col(key).cast("double"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(numeric.approxQuantile(name, shares, 0.25 / buckets)))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=name, outputCol=f"{name}_no").transform(numeric)
    return placed.drop(name).withColumnRenamed(f"{name}_no", name)


def with_position(
    df: DataFrame,
    bucket: str,
    order: list[Column | str],
    name: str,
    within: list[str] | None = None,
    total: str | None = None,
    first: int | None = None,
) -> DataFrame:
    """Add the 0-based position over (bucket, order), per ``within`` group.

    ``total`` also adds the group's row count. ``first`` keeps only the first rows
    and drops later buckets before the window runs.
    """
    groups = within or []
    sizes = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    over = W.partitionBy(*groups)
    before = over.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_rows").over(over))
    offsets = offsets.drop("_rows")
    if first is not None:
        offsets = offsets.where(F.col("_offset") < first)
    inner = W.partitionBy(*groups, bucket).orderBy(*order)
    placed = (
        df.join(offsets, [*groups, bucket])
        .withColumn(name, F.col("_offset") + F.row_number().over(inner) - 1)
        .drop("_offset", bucket)
    )
    return placed if first is None else placed.where(F.col(name) < first)


def surrogate_id(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense ids 0..n-1 in the order of a unique numeric key."""
    return with_position(range_bucket(df, key, "_bucket"), "_bucket", [key], name)


def _hash_buckets(df: DataFrame, key: Column | str, seed: int) -> DataFrame:
    hashed = df.withColumn("_hash", hash_key(key, seed))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, HASH_PREFIX))


def shuffle_position(
    df: DataFrame, key: str, name: str, seed: int = SEED, within: list[str] | None = None, total: str | None = None
) -> DataFrame:
    """Position in a seeded permutation, optionally inside groups of any size."""
    placed = with_position(_hash_buckets(df, key, seed), "_bucket", ["_hash", key], name, within, total)
    return placed.drop("_hash")


def sample_n(df: DataFrame, n: int, key: str, name: str | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every layout; ``name`` keeps the draw number."""
    placed = with_position(_hash_buckets(df, key, seed), "_bucket", ["_hash", key], name or "_draw", first=n)
    return placed.drop("_hash") if name else placed.drop("_hash", "_draw")


def shuffle_rows(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Rows in a seeded random order, by a range shuffle on the hash."""
    return df.orderBy(hash_key(key, seed), as_col(key))
