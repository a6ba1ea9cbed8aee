"""Whitening of embeddings: decorrelated leading components of unit variance, exact where integers allow it.

Entries become integers, ``x = floor(64 * c) + 1000000``, so counts, sums and deviations are exact. The estimates
come from the fit list, each distinct vector once: vectors are packed into the narrowest integers that
hold them and folded by an aggregate, in which copies collapse before the shuffle.

The covariance is centred before multiplying: every task adds the products of its centred rows, and one
sum per pair of dimensions is shuffled. What comes to the driver is one matrix of dimensions by
dimensions. It is brought to tridiagonal form by Householder reflections; Sturm counts bisect
the leading eigenvalues; inverse iteration finds their vectors, each made orthogonal to the others of
its cluster of close eigenvalues. The projection is broadcast and applied to all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed, scratch

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows of vectors that a task works on at once.
ROWS_AT_ONCE = 4096
#: Entries from here on, times ``SCALE``, do not fit the exact arithmetic.
TOO_LARGE = float(1 << 62)
LONG_LIMIT = (1 << 63) - 1
#: Eigenvalues closer than this share of the norm form a cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Fit:
    """Count and sums of ``x - OFFSET`` over the fit list, and its leading components."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    """The vector has no null, non-finite or immense entry."""
    entries = vector.cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= TOO_LARGE / SCALE))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def entries(column: pa.Array, size: int) -> np.ndarray:
    """``floor(64 * c)`` of every row as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(flat * SCALE).astype(np.int64)


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes of the narrowest signed integers that hold it, after one byte with their width."""
    most = np.maximum(rows.max(axis=1), ~rows.min(axis=1))  # of -128 as of 127
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        head = bytes([w])
        for i, row in zip(at, rows[at].astype(f"<i{w}")):
            out[i] = head + row.tobytes()
    return out


def unpack(packed: list[bytes], size: int) -> np.ndarray:
    rows = np.empty((len(packed), size), np.int64)
    width = np.array([p[0] for p in packed])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        rows[at] = np.frombuffer(b"".join(packed[i][1:] for i in at), f"<i{w}").reshape(-1, size)
    return rows


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` as doubles, from the exact ``n * x - S`` where that fits a long."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    if 2 * n * (most + 1) + max(map(abs, sums), default=0) <= LONG_LIMIT:
        return (rows * n - np.array(sums, np.int64)) / n
    exact = rows.astype(object) * n - np.array(sums, object)
    return (exact / n).astype(float)


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S) ** 2``, exact; None beyond a long."""
    most = n * (max(int(rows.max(initial=0)), -int(rows.min(initial=0))) + 1) + max(map(abs, sums), default=0)
    if rows.shape[1] * most**2 <= LONG_LIMIT:
        return ((rows * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in (rows.astype(object) * n - np.array(sums, object)).tolist()]
    return [v if v <= LONG_LIMIT else None for v in exact]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield unpack(batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist(), size)


def product_sums(fit_list: DataFrame, size: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of the outer products of ``rows_of`` the vectors, as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for rows in _blocks(batches, size):
            own = rows_of(rows)
            total += own.T @ own
            seen = True
        if seen:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    sums = fit_list.select("packed").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for row in sums.collect():  # one row for each pair of dimensions
        out[row.i, row.j] = out[row.j, row.i] = row.v
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, off, q`` with ``matrix = q @ T @ q.T``, by Householder reflections."""
    a = matrix.copy()
    size = len(a)
    q = np.eye(size)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if np.abs(v[1:]).max() <= EPS * EPS * scale or scale == 0:
            continue
        v /= scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = column
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of the shifted matrix."""
    least = max(float(np.max(off**2, initial=0.0)), float(np.max(np.abs(diagonal), initial=0.0)) ** 2, 1e-300) * EPS**2
    least = max(least**0.5, 1e-150)
    count = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for n, d in enumerate(diagonal):
        pivot = d - at - (off[n - 1] ** 2 / pivot if n else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket is as narrow as doubles allow."""
    size = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    room = EPS * max(abs(low[0]), abs(high[0]), 1e-300)
    low, high = low - room * size, high + room * size
    rank = size - 1 - np.arange(k)  # so many are smaller
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any() or (high - low).max() <= room / 4:
            return middle
        above = sturm_counts(diagonal, off, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def shifted_solve(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solves ``(T - value) x = right`` by elimination with row exchanges; tiny pivots count as ``least``."""
    size = len(diagonal)
    u0, u1, u2 = diagonal - value, np.append(off, 0.0), np.zeros(size)
    x = right.copy()
    for n in range(size - 1):
        below = off[n]
        if abs(below) > abs(u0[n]):
            share = u0[n] / below
            u0[n], u1[n], u2[n], u0[n + 1], u1[n + 1] = below, u0[n + 1], u1[n + 1], u1[n] - share * u0[n + 1], -share * u1[n + 1]
            x[n], x[n + 1] = x[n + 1], x[n] - share * x[n + 1]
        else:
            pivot = u0[n] if abs(u0[n]) > least else least
            u0[n] = pivot
            share = below / pivot
            u0[n + 1] -= share * u1[n]
            x[n + 1] -= share * x[n]
    if abs(u0[-1]) <= least:
        u0[-1] = least
    for n in range(size - 1, -1, -1):
        rest = x[n]
        if n + 1 < size:
            rest -= u1[n] * x[n + 1]
        if n + 2 < size:
            rest -= u2[n] * x[n + 2]
        x[n] = rest / u0[n]
        if abs(x[n]) > 1e200:
            x /= 1e200
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, by inverse iteration."""
    size = len(diagonal)
    norm = max(float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)), 1e-300)
    least = EPS * norm
    random = np.random.default_rng(0)
    out = np.zeros((size, len(values)))
    start, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        # Shifts of equal eigenvalues are drawn apart, or their solutions would be the same.
        shift = min(value, shift - 2 * least) if k > start else value
        own = out[:, start:k]
        x = random.normal(size=size)
        for _ in range(6):
            x -= own @ (own.T @ x)
            x /= np.linalg.norm(x)
            x = shifted_solve(diagonal, off, shift, x, least)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= own @ (own.T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, and unit eigenvectors as columns; those that are zero are left out."""
    k = min(k, len(matrix))
    scale = float(np.abs(matrix).max(initial=0.0))
    if k == 0 or scale == 0:
        return np.empty(0), np.empty((len(matrix), 0))
    diagonal, off, q = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    values = values[values > len(matrix) * EPS * np.abs(diagonal).sum()]
    vectors = q @ vectors_of(diagonal, off, values)
    return values * scale, vectors


def vector_size(rows: DataFrame) -> int:
    """The most frequent length of a vector, of equally frequent ones the largest; 0 without rows."""
    top = rows.groupBy(F.size("vector").alias("size")).count().where("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Fit | None:
    """The estimates from the distinct vectors of ``rows`` (``vector``, usable and of one size)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(entries(batch.column(0), size)) if batch.num_rows else [], pa.binary())], ["packed"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for block in _blocks(batches, size):
            count += len(block)
            high += (block >> 31).sum(axis=0)
            low += (block & ((1 << 31) - 1)).sum(axis=0)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, count)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    with scratch(rows.sparkSession):
        fit_list = landed(rows.select("vector").mapInArrow(packed, "packed binary").distinct(), "whitening-fit-list")
        parts = fit_list.mapInArrow(summed, "i int, n long, high long, low long").groupBy("i")
        totals = parts.agg(F.sum("n").alias("n"), F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low")).orderBy("i").collect()
        if not totals:
            return None
        n, sums = totals[0].n, [(int(r.high) << 31) + int(r.low) for r in totals]
        covariance = product_sums(fit_list, size, lambda x: centred(x, n, sums), size) / n
        values, vectors = leading(covariance, components)
        own = Fit(n, sums, vectors, values, float(np.trace(covariance)))
        whitened = product_sums(fit_list, size, lambda x: project(x, own), len(values)) / n
        error = float(np.abs(whitened - np.eye(len(values))).max(initial=0.0))
    return Fit(n, sums, vectors, values, own.trace, error)


def project(rows: np.ndarray, model: Fit) -> np.ndarray:
    return centred(rows, model.n, model.sums) @ (model.vectors / np.sqrt(model.values))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    Rows whose vector is null, or holds a null, a non-finite entry or one of 2**56 or more, are dropped, and
    so are vectors of another length than the most frequent one. Repeated rows and null ids are
    rows like others; they count once in the fit list. Components of zero variance are left out, so one
    distinct vector, like an empty table, gives no rows. ``deviation`` is null where it exceeds a
    long. Equal eigenvalues have components in any directions that span theirs.
    """
    spark = vectors.sparkSession
    vector = vectors[vector_column]
    rows = vectors.where(usable(vector)).select(vectors[id_column].cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    size = vector_size(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.where(F.size("vector") == size)
    model = fit(rows, size, components) if size else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # dimensions x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                own = entries(part.column(1), size)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(own)), k)))
                deviation = pa.array(deviations(own, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k)))
                rest = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(own)), np.full(len(own) * k, model.n)]
                columns = [ids, *map(pa.array, rest), deviation, pa.array(project(own, model).ravel()), pa.array(np.tile(explained, len(own))), pa.array(np.full(len(own) * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
