"""Exact linear-interpolation quantiles by histogram refinement.

``percentile`` keeps every distinct value of a group in one task. Here each pass
is a map-side combined histogram: the bin that holds a wanted rank becomes the
next interval, until it is small enough to list its distinct values.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024
LIST_ROWS = 200_000

Quantiles = dict[str, dict[float, float]]


def _long(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("_c"), c.cast("double").alias("_v")) for n, c in columns.items()]
    return df.select(F.inline(F.array(*pairs))).where("_v is not null")


def _spans(active: list[dict]) -> list[tuple]:
    """Distinct (column, lo, hi); ranks of one column mostly share an interval."""
    return sorted({(a["c"], a["lo"], a["hi"]) for a in active})


def _inside(long: DataFrame, active: list[dict]) -> DataFrame:
    spans = long.sparkSession.createDataFrame(_spans(active), "_c string, _lo double, _hi double")
    return long.join(F.broadcast(spans), "_c").where("_v between _lo and _hi")


def _refine(long: DataFrame, active: list[dict]) -> None:
    width = (F.col("_hi") - F.col("_lo")) / F.lit(BINS)
    number = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1))
    found = (
        _inside(long, active)
        .withColumn("_bin", number)
        .groupBy("_c", "_lo", "_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        .collect()  # at most BINS rows for each interval
    )
    bins: dict[tuple, list] = {}
    for b in sorted(found, key=lambda b: b["_bin"]):
        bins.setdefault((b["_c"], b["_lo"]), []).append(b)
    for a in active:
        for b in bins[a["c"], a["lo"]]:
            if a["below"] + b["n"] > a["rank"]:
                a.update(lo=b["lo"], hi=b["hi"], n=b["n"])
                break
            a["below"] += b["n"]


def _pick(long: DataFrame, active: list[dict]) -> dict[tuple[str, int], float]:
    counts = _inside(long, active).groupBy("_c", "_lo", "_v").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(W.partitionBy("_c", "_lo").orderBy("_v"))
    rows = [(a["c"], a["lo"], a["rank"], a["rank"] - a["below"]) for a in active]
    ranks = long.sparkSession.createDataFrame(rows, "_c string, _lo double, _rank long, _at long")
    found = (
        counts.withColumn("_upto", running)
        .join(F.broadcast(ranks), ["_c", "_lo"])
        .where(F.col("_upto") > F.col("_at"))
        .groupBy("_c", "_rank")
        .agg(F.min("_v").alias("v"))
    )
    return {(r["_c"], r["_rank"]): r["v"] for r in found.collect()}  # one row per wanted rank


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], list_rows: int = LIST_ROWS) -> Quantiles:
    """Quantiles of each named column over its non-missing values; empty columns are left out."""
    long = _long(df, columns)
    facts = [
        F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(c)
        for c, v in ((c, v.cast("double")) for c, v in columns.items())
    ]
    extent = df.agg(*facts).first()
    wanted: dict[tuple[str, int], dict] = {}
    positions: dict[tuple[str, float], float] = {}
    for c in columns:
        r = extent[c]
        if not r["n"]:
            continue
        for p in probs:
            position = p * (r["n"] - 1)
            positions[c, p] = position
            for rank in {floor(position), min(floor(position) + 1, r["n"] - 1)}:
                wanted[c, rank] = dict(c=c, rank=rank, lo=r["lo"], hi=r["hi"], n=r["n"], below=0)
    while wide := [a for a in wanted.values() if a["n"] > list_rows and a["lo"] < a["hi"]]:
        _refine(long, wide)
    values = {(a["c"], a["rank"]): a["lo"] for a in wanted.values() if a["lo"] == a["hi"]}
    open_spans = [a for key, a in wanted.items() if key not in values]
    if open_spans:
        values |= _pick(long, open_spans)
    result: Quantiles = {}
    for (c, p), position in positions.items():
        rank = floor(position)
        low = values[c, rank]
        high = values.get((c, rank + 1), low)
        result.setdefault(c, {})[p] = low + (high - low) * (position - rank)
    return result


def approx_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], accuracy: int = 10_000) -> Quantiles:
    """One-pass sketch for layers where a rank error of 1/accuracy is acceptable."""
    points = F.array(*[F.lit(p) for p in probs])
    row = df.agg(*[F.percentile_approx(c.cast("double"), points, accuracy).alias(n) for n, c in columns.items()]).first()
    return {n: dict(zip(probs, row[n])) for n in columns if row[n] is not None}
