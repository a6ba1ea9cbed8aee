"""Support vector machines against the bound that their dual gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopecast.operators import models, svm


def rows(spark, n=600):
    random = np.random.default_rng(3)
    x = random.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + random.normal(0, 0.5, n) > 0).astype(int)
    w = np.where(y == 1, 1.5, 0.7)
    given = [(i % 3, int(b), float(c), a.tolist()) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return x, y, w, spark.createDataFrame(given, "fold int, y int, w double, x array<double>").repartition(3)


def test_fits_reach_the_least_loss(spark):
    x, y, w, df = rows(spark)
    kernel = svm.Kernel(4, 0.25, size=24)
    lifted, sign = kernel.lift(x), np.where(y == 1, 1.0, -1.0)
    got = svm.fit(df, kernel, [0, -1], 2.0, 1e-3, 500)
    for without, at in zip((0, -1), got):
        on = np.arange(len(y)) % 3 != without

        def loss(v):
            return 2.0 * (w * np.maximum(1 - sign * (lifted @ v), 0))[on].sum() + v[:-1] @ v[:-1] / 2

        least, random = loss(at), np.random.default_rng(1)
        for k in range(4000):  # no way leads further down than the tolerance
            other = at + random.normal(size=25) * 0.5 ** (k % 16) * (random.uniform(size=25) < 0.3)
            least = min(least, loss(other))
        assert loss(at) <= least * (1 + 2e-3)
        plain = np.zeros(25)
        for k in range(1, 6001):  # subgradient steps from elsewhere
            short = on & (sign * (lifted @ plain) < 1)
            slope = np.append(plain[:-1], 0.0) - 2.0 * lifted[short].T @ (w * sign)[short]
            plain = plain - slope / (k + 100)
        assert loss(at) <= loss(plain) * (1 + 2e-3)
    with pytest.raises(RuntimeError):
        svm.fit(df, kernel, [-1], 2.0, 1e-3, 2)


def test_margins_by_fold(spark):
    x, y, w, df = rows(spark, 40)
    kernel = svm.Kernel(4, 0.25, size=8)
    weights = np.random.default_rng(2).normal(size=(3, 9))
    for r in df.withColumn("m", kernel.margin(weights, F.col("x"), F.col("fold"))).collect():
        assert r.m == pytest.approx(float(kernel.lift(np.array([r.x]))[0] @ weights[r.fold]))


def test_no_feature_is_stored(spark, monkeypatch):
    x, y, w, df = rows(spark, 300)
    names = [*models.MODEL_NUMERIC, "lulc"]
    random = np.random.default_rng(4)
    table = [(i, int(i % 2), *(float(v) for v in random.normal(i % 2, 1, len(names) - 1)), "10.0") for i in range(300)]
    train = spark.createDataFrame(table, f"sample_id long, {models.LABEL} int, {', '.join(f'{c} double' for c in names[:-1])}, lulc string")
    landed, write = [], models.materialise
    monkeypatch.setattr(models, "materialise", lambda df, purpose: landed.append((purpose, df.columns)) or write(df, purpose))
    scored = models.fit_svm(train).transform(train)
    assert scored.where("score between 0 and 1").count() == 300
    assert dict(landed)["svm"] == ["sample_id", "fold", "y", "w", "x"]


def test_the_first_steps_know_the_curvature(spark, monkeypatch):
    """From a margin of zero the intercept, which costs nothing, once took steps of many millions, and passes to take them back."""
    random = np.random.default_rng(8)
    x = random.normal(size=(4000, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + random.normal(0, 0.2, 4000) > 0.1).astype(int)
    given = [(i % 3, int(b), float(4000 / (2 * (y == b).sum())), a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(given, "fold int, y int, w double, x array<double>")
    steps, move = [], svm.Fit.move

    def watched(self, *args):
        move(self, *args)
        steps.append(float(np.abs(self.step).max()))

    monkeypatch.setattr(svm.Fit, "move", watched)
    got = svm.fit(df, svm.Kernel(4, 0.25, size=64), [0, 1, 2, -1], 2.0, 1e-3, 40)
    assert len(got) == 4 and max(steps) < 1e4
