"""Whitening against exact integers and a plain eigenvalue solver."""

import numpy as np
import pytest

from slopecast.llm import queries, whitening


def plain(vectors, k=16):
    x = np.array(sorted({tuple(int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    z = ((x * n - sums) / n).astype(float)
    v = z.T @ z / n
    values, vectors_ = np.linalg.eigh(v)
    return n, sums, values[::-1][:k], vectors_[:, ::-1][:, :k], np.trace(v)


def compared(rows, given, k=16):
    n, sums, values, vectors, trace = plain(given.values(), k)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(given)
    signs = {}
    for i, own in by.items():
        x = np.array([int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in given[i]], dtype=object)
        assert sorted(own) == list(range(1, len(own) + 1))
        for c, r in own.items():
            assert r.n == n and r.deviation == sum(int(d) ** 2 for d in x * n - sums)
            assert abs(r.explained - values[c - 1] / trace) <= 1e-9 * r.explained and r.identity_error < 1e-6
            want = float(((x * n - sums) / n).astype(float) @ vectors[:, c - 1] / np.sqrt(values[c - 1]))
            sign = signs.setdefault(c, 1.0 if abs(r.whitened - want) <= abs(r.whitened + want) else -1.0)
            assert abs(r.whitened - sign * want) < 1e-6 * max(1, abs(want))


def test_query_equals_a_plain_solver(spark, sf_dir):
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    compared(queries.QUERIES["op13_whitening"](spark, sf_dir).collect(), given)


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "split", "rank", "graded", "wilkinson"])
def test_solver(kind):
    random = np.random.default_rng(3)
    size = 40
    q = np.linalg.qr(random.normal(size=(size, size)))[0]
    spectrum = {
        "random": random.uniform(1, 9, size), "equal": np.ones(size), "clusters": np.repeat([5.0, 5.0 + 1e-13, 2.0, 1.0], 10),
        "split": np.arange(1.0, size + 1), "rank": np.r_[[3.0, 2.0, 1.0], np.zeros(size - 3)], "graded": 10.0 ** -np.arange(size),
    }
    if kind == "wilkinson":
        m = np.diag(np.abs(np.arange(size) - 20.0) + 1) + np.diag(np.ones(size - 1), 1) + np.diag(np.ones(size - 1), -1)
    else:
        m = np.diag(spectrum[kind]) if kind in ("equal", "split") else (q * spectrum[kind]) @ q.T
    m = (m + m.T) / 2
    values, vectors = whitening.leading(m, 16)
    want = np.linalg.eigvalsh(m)[::-1][:16]
    assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0] * size) and (len(values) == 16 or kind in ("rank", "graded"))
    assert len(values) >= 3
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * want[0] * size


def test_counts_of_smaller_eigenvalues():
    random = np.random.default_rng(1)
    d, e = random.normal(size=30), random.normal(size=29)
    want = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 50)
    assert whitening.sturm_counts(d, e, at).tolist() == [int((want < x).sum()) for x in at]


def test_packing_returns_all_widths():
    rows = np.array([[0, -128], [127, 5], [128, 0], [-129, 7], [40_000, 1], [-(1 << 31), 2], [1 << 40, 3]], np.int64)
    packed = whitening.pack(rows)
    assert [p[0] for p in packed] == [1, 1, 2, 2, 4, 4, 8] and (whitening.unpack(packed, 2) == rows).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -3.0]), (2, None), (3, [nan, 1.0, 1.0]), (4, [1.0, None, 2.0]), (5, [inf, 0.0, 0.0]), (6, []), (7, [1.0]), (8, [0.25, 0.5, 9.0])]
    rows += [(9, [0.5, 1.0, -3.0]), (10, [7.0, -1.0, 0.0]), (11, [0.0, 0.0, 1e37]), (12, [3.0, 3.0, 3.5])]
    schema = "vec_id long, embedding array<float>, component string, n string, vector string, packed string, size string"
    df = spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], schema)
    kept = {1, 8, 9, 10, 12}
    compared(whitening.whiten(df).collect(), {i: v for i, v in rows if i in kept})
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id IN (1, 9)")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(None, [0.0]), (None, [1.0])], "vec_id long, embedding array<float>")).count() == 2


def test_large_numbers_stay_exact(spark):
    given = {i: [float(np.float32(c)) for c in v] for i, v in enumerate([[1e9, 1.0], [-1e9, 2.0], [0.0, 5.0]])}
    rows = whitening.whiten(spark.createDataFrame(list(given.items()), "vec_id long, embedding array<float>")).where("component = 1").collect()
    n, sums, *_ = plain(given.values())
    for r in rows:
        x = [int(np.floor(64 * c)) + 1000000 for c in given[r.vec_id]]
        want = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r.deviation == (want if want < 1 << 63 else None)
