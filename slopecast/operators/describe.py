"""Numbers behind the exploratory figures."""

from __future__ import annotations

from itertools import combinations
from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalar import all_of, missing_flag, significance
from ..settings import TREND_PAIRS
from .quantiles import exact_quantiles


def layer_stats(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max, mean, population deviation, missing share and skewness per layer, in one pass."""
    parts = {
        "min": F.min,
        "max": F.max,
        "mean": F.avg,
        "std": F.stddev_pop,
        "skewness": F.skewness,
        "missing_percent": lambda c: F.avg(F.col(c).isNull().cast("double")) * 100,
    }
    wide = pixels.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = wide.agg(*[F.struct(*[fn(c).alias(k) for k, fn in parts.items()]).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}.{k}").alias(k) for k in parts]) for c in columns]
    return row.select(F.inline(F.array(*rows))).withColumn("flag", missing_flag("missing_percent"))


def correlation_matrix(sets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Pearson r of every feature pair over complete rows, per named set."""
    pairs = list(combinations(columns, 2))
    result = None
    for name, df in sets.items():
        complete = df.where(all_of(F.col(c).isNotNull() for c in columns))
        row = complete.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}_{b}") for a, b in pairs])
        rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs]
        part = row.select(F.inline(F.array(*rows))).withColumn("set", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


def percentile_trim(long: DataFrame, limits: dict[str, dict[float, float]]) -> DataFrame:
    """Rows of (layer, ..., value) whose value lies between the already known percentiles of its layer."""
    low = high = F.lit(None).cast("double")
    for layer, q in limits.items():
        low = F.when(F.col("layer") == layer, F.lit(q[min(q)])).otherwise(low)
        high = F.when(F.col("layer") == layer, F.lit(q[max(q)])).otherwise(high)
    return long.where(F.col("value").between(low, high))


def histogram(sets: dict[str, DataFrame], reference: str, columns: list[str], bins: int = 60) -> DataFrame:
    """Equal-width density histogram per feature and set.

    All sets are trimmed to the 1st..99th percentile of the reference set first; bin
    limits then follow each set's own range.
    """
    limits = exact_quantiles(sets[reference], {c: F.col(c) for c in columns}, [0.01, 0.99])
    long = None
    for name, df in sets.items():
        pairs = [
            F.struct(F.lit(c).alias("feature"), F.when(F.col(c).between(q[0.01], q[0.99]), F.col(c).cast("double")).alias("v"))
            for c, q in limits.items()
        ]
        part = df.select(F.inline(F.array(*pairs))).where("v is not null").withColumn("set", F.lit(name))
        long = part if long is None else long.unionByName(part)
    key = ["set", "feature"]
    range_of = long.groupBy(*key).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("set_mean")
    )  # one row per set and feature
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    number = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    binned = (
        long.join(F.broadcast(range_of), key)
        .withColumn("bin", F.coalesce(number, F.lit(0)).cast("int"))
        .groupBy(*key, "bin", "lo", "hi", "n", "set_mean")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    density = F.try_divide(F.col("count").cast("double"), F.col("n") * width)
    return binned.select(*key, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_left"), "count", density.alias("density"), "set_mean")


def boxplot_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, moments, whiskers (furthest value within 1.5*IQR) and flier count."""
    quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    aggregates, rows = [], []
    for c, q in quartiles.items():
        q1, median, q3 = q[0.25], q[0.5], q[0.75]
        iqr = q3 - q1
        v = F.col(c).cast("double")
        inside = v.between(F.lit(q1 - 1.5 * iqr), F.lit(q3 + 1.5 * iqr))
        aggregates.append(
            F.struct(
                F.avg(v).alias("mean"),
                F.stddev_pop(v).alias("std"),
                F.min(F.when(inside, v)).alias("whisker_low"),
                F.max(F.when(inside, v)).alias("whisker_high"),
                F.count_if(~inside).alias("fliers"),
            ).alias(c)
        )
        rows.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(q1).alias("q1"),
                F.lit(median).alias("median"),
                F.lit(q3).alias("q3"),
                F.lit(iqr).alias("iqr"),
                *[F.col(f"{c}.{k}").alias(k) for k in ("mean", "std", "whisker_low", "whisker_high", "fliers")],
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1.0 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of Pearson r under no correlation, n rows."""
    if n <= 2 or r != r:
        return float("nan")
    return _beta_tail(1.0 - min(r * r, 1.0), (n - 2) / 2.0, 0.5)


@F.pandas_udf(DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(a, b) for a, b in zip(r, n)])


def linear_trend(df: DataFrame, pairs: list[tuple[str, str]] = TREND_PAIRS) -> DataFrame:
    """Least-squares line, r, p and significance per feature pair, one pass over the data.

    The p-value is the only Python step and sees one row per pair.
    """
    aggregates, rows = [], []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        aggregates.append(
            F.struct(
                F.count(x).alias("n"),
                F.regr_slope(y, x).alias("slope"),
                F.regr_intercept(y, x).alias("intercept"),
                F.corr(x, y).alias("r"),
                F.min(x).alias("x_min"),
                F.max(x).alias("x_max"),
            ).alias(f"p{i}")
        )
        rows.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"p{i}").alias("s")))
    fitted = df.agg(*aggregates).select(F.inline(F.array(*rows))).select("x", "y", "s.*")
    return fitted.withColumn("p_value", _p_value("r", "n")).withColumn("significance", significance("p_value"))


def trend_line(trend: DataFrame, points: int = 200) -> DataFrame:
    """Evenly spaced points on each fitted line from x-min to x-max."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    at = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    line = trend.withColumn("i", i).withColumn("x_at", at)
    return line.select("x", "y", "i", "x_at", (F.col("intercept") + F.col("slope") * F.col("x_at")).alias("y_at"))


def pct_difference(points: DataFrame, area: DataFrame, columns: list[str]) -> DataFrame:
    """How far the mean at points lies above or below the mean of the whole area."""

    def means(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
        rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in columns]
        return row.select(F.inline(F.array(*rows)))

    both = means(points, "point_mean").join(means(area, "area_mean"), "feature").where("area_mean != 0")
    share = (F.col("point_mean") - F.col("area_mean")) / F.abs("area_mean") * 100
    return both.withColumn("pct", share).withColumn("direction", F.when(F.col("pct") > 0, "HIGHER").otherwise("LOWER"))
