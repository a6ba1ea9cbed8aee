"""Quality rules: base statistics of a text, and robust multivariate outliers among its peers.

Peers are the documents of one language and source. Their location and scatter are minimum
covariance determinant estimates: concentration steps over all rows, each keeping the share
``SUBSET`` of a group with the smallest distances and re-estimating from it, until the
determinants no longer fall. Documents beyond a chi-square bound of the Mahalanobis distance are
rejected.

Every step is a map-side combined aggregate over the landed statistics. Quantiles of a group come
from a histogram of fixed, narrow bins, so a group of any size is one short list of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.session import materialise

from .common import BROADCAST_ROWS, landed, scratch, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Share of a group that the estimates rest on.
SUBSET = 0.75
#: Groups of fewer usable rows use the estimates of their language, and those in turn of the corpus.
MIN_GROUP = 50
#: Chance that a document of a normal group lies beyond the bound.
REJECT_P = 1e-5
MAX_STEPS = 20
#: Added to each variance, in squared units of the transformed statistics. A statistic that most
#: documents of a group share exactly (no symbols, no repeats) would otherwise have none.
VARIANCE_FLOOR = np.array([0.04, 0.04, 0.25, 0.25, 0.5])
DIMENSIONS = len(VARIANCE_FLOOR)
#: Bins of a doubling of the distance, for the quantiles of a group.
BINS = 64

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys) + 1, bool)
    twice[1:-1] = same
    marked = np.zeros(n, bool)
    starts = order[twice[1:] | twice[:-1]]
    for offset in range(3):
        marked[starts + offset] = True
    return int(marked.sum())


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group_columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the group columns as strings and the base statistics of every row; a null text has no words."""
    groups = [docs[c].cast("string").alias(f"group_{n}") for n, c in enumerate(group_columns)]
    given = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"), *groups)
    names = [c.split()[0] for c in STATISTICS.split(", ")]
    labels = [f"group_{n}" for n in range(len(groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            counted = np.array([text_statistics(t) for t in values], np.int64).reshape(-1, len(names))
            columns = [pa.array(counted[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(2 + i) for i in range(len(labels))), *columns], ["doc_id", *labels, *names]
            )

    schema = "doc_id long, " + "".join(f"{c} string, " for c in labels) + STATISTICS
    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """Statistics on scales where documents of one group are roughly normal."""
    share = lambda part, whole: F.log1p(100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return [
        F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")),
        F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_words"),
        share("n_repeat_words", "n_words"),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the regularised incomplete gamma function."""
    term = total = 1.0 / (k / 2)
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / 2 / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 500.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return low


def cut_bins(rows: DataFrame, value: Column, share: float, by: tuple[str, ...] = ("level", "key")) -> DataFrame:
    """For each group: the bin in which the given share of its rows is reached."""
    binned = rows.groupBy(*by, value.alias("bin")).count()
    own = Window.partitionBy(*by)
    running = F.sum("count").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = binned.withColumn("up_to", running).withColumn("n", F.sum("count").over(own))
    return ranked.where(F.col("up_to") >= share * F.col("n")).groupBy(*by).agg(F.min("bin").alias("cut"))


def distance_bin() -> Column:
    return F.floor(F.log2(F.greatest(F.col("distance"), F.lit(1e-12))) * BINS).cast("int")


def moments(rows: DataFrame) -> DataFrame:
    """Count, sums and products of the features of each group."""
    x = [F.col(f"x{i}") for i in range(DIMENSIONS)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
    return rows.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def estimates(summed: DataFrame) -> DataFrame:
    """Location, inverse scatter (row by row) and log determinant from the moments."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                mean = np.array([getattr(row, f"s{i}") for i in range(DIMENSIONS)]) / row.n
                second = np.zeros((DIMENSIONS, DIMENSIONS))
                for i in range(DIMENSIONS):
                    for j in range(i + 1):
                        second[i, j] = second[j, i] = getattr(row, f"p{i}_{j}") / row.n
                scatter = second - np.outer(mean, mean) + np.diag(VARIANCE_FLOOR)
                sign, size = np.linalg.slogdet(scatter)
                if sign <= 0:  # rounding of a group without any spread
                    scatter, size = np.diag(np.maximum(np.diag(scatter), VARIANCE_FLOOR)), 0.0
                out.append((row.level, row.key, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(size)))
            yield pd.DataFrame(out, columns=["level", "key", "mean", "inverse", "size"])

    return summed.mapInPandas(solve, "level int, key string, mean array<double>, inverse array<double>, size double")


def mahalanobis() -> Column:
    off = [F.col(f"x{i}") - F.get("mean", F.lit(i)) for i in range(DIMENSIONS)]
    terms = [off[i] * off[j] * F.get("inverse", F.lit(i * DIMENSIONS + j)) * (1.0 if i == j else 2.0) for i in range(DIMENSIONS) for j in range(i + 1)]
    return sum(terms[1:], terms[0])


class Groups:
    """Usable rows by ``level, key`` with features ``x0..``; tables of one row a group are broadcast up to a checked number."""

    def __init__(self, rows: DataFrame, groups: int):
        self.rows = rows
        self.small = F.broadcast if groups <= BROADCAST_ROWS else lambda df: df

    def join(self, rows: DataFrame, per_group: DataFrame) -> DataFrame:
        return rows.join(self.small(per_group), ["level", "key"])

    def distances(self, fitted: DataFrame) -> DataFrame:
        """Squared Mahalanobis distance of each row from its group's estimates."""
        joined = self.join(self.rows, fitted.select("level", "key", "mean", "inverse"))
        return joined.withColumn("distance", mahalanobis()).drop("mean", "inverse")

    def medians(self, kind: str, rows: DataFrame, values: list[Column]) -> DataFrame:
        grid = 1 / 64
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), v.alias("value")) for i, v in enumerate(values)]))
        long = rows.select("level", "key", each.alias("v")).select("level", "key", "v.dim", "v.value")
        cut = cut_bins(long, F.floor(F.col("value") / grid).cast("long"), 0.5, ("level", "key", "dim"))
        middle = (F.col("cut") + 0.5) * grid
        wide = [F.max(F.when(F.col("dim") == i, middle)).alias(f"{kind}{i}") for i in range(DIMENSIONS)]
        return landed(cut.groupBy("level", "key").agg(*wide), "quality-start")

    def fit(self, near: DataFrame, share: float) -> DataFrame:
        """Estimates from the given share of each group with the smallest distances."""
        inner = self.join(near, cut_bins(near, distance_bin(), share)).where(distance_bin() <= F.col("cut"))
        return landed(estimates(moments(inner)), "quality-fit")

    def start(self) -> DataFrame:
        """From the half of each group nearest to its medians, in units of the median deviations."""
        x = [F.col(f"x{i}") for i in range(DIMENSIONS)]
        m, d = [F.col(f"m{i}") for i in range(DIMENSIONS)], [F.col(f"d{i}") for i in range(DIMENSIONS)]
        center = self.medians("m", self.rows, x)
        off = self.join(self.rows, center)
        spread = self.medians("d", off, [F.abs(a - b) for a, b in zip(x, m)])
        scaled = [F.pow(a - b, 2) / (F.pow(1.4826 * c, 2) + float(v)) for a, b, c, v in zip(x, m, d, VARIANCE_FLOOR)]
        near = self.join(off, spread).withColumn("distance", sum(scaled[1:], scaled[0]))
        return self.fit(near.select(*self.rows.columns, "distance"), 0.5)

    def concentrate(self) -> DataFrame:
        """Steps until the determinants no longer fall; then the scatter is made consistent for a normal group."""
        fitted, size = self.start(), math.inf
        for _ in range(MAX_STEPS):
            fitted = self.fit(self.distances(fitted), SUBSET)
            now = fitted.agg(F.sum("size")).first()[0]
            if size - now < 1e-4 * max(1.0, abs(now)):
                break
            size = now
        scale = SUBSET / chi2_cdf(chi2_quantile(SUBSET, DIMENSIONS), DIMENSIONS + 2)
        return materialise(fitted.select("level", "key", "mean", F.transform("inverse", lambda v: v / scale).alias("inverse")), "quality-final")


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group_columns: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``doc_id``, statistics, ``base_failed``, ``distance`` (from the group's estimates) and ``kept`` of every row.

    Documents that fail the base rules are rejected and take no part in the estimates. Rows with
    the same id, ties and repeats are judged each for itself. A null language or source is a
    group of its own. Groups too small for estimates use those of their language, then of the
    whole corpus; with fewer usable documents than that in the whole corpus nothing is an outlier
    and ``distance`` is null. An empty table gives no rows.
    """
    measured = materialise(statistics(docs, id_column, text_column, group_columns), "quality-statistics")
    named = F.to_json(F.struct("group_0", "group_1"), {"ignoreNullFields": "false"})
    language = F.to_json(F.struct("group_0"), {"ignoreNullFields": "false"})
    usable = measured.where(~base_failed()).withColumns({"k0": named, "k1": language, "k2": F.lit("all")})
    # Which level speaks for a group: its own, its language's or the corpus'.
    sizes = usable.groupBy("k0", "k1", "k2").agg(F.count(F.lit(1)).alias("n0"))
    sizes = sizes.withColumn("n1", F.sum("n0").over(Window.partitionBy("k1"))).withColumn("n2", F.sum("n0").over(Window.partitionBy("k2")))
    level = F.when(F.col("n0") >= MIN_GROUP, 0).when(F.col("n1") >= MIN_GROUP, 1).when(F.col("n2") >= MIN_GROUP, 2)
    levels = materialise(sizes.select("k0", level.alias("level")).where("level is not null"), "quality-levels")
    x = {f"x{i}": c for i, c in enumerate(features())}
    each = usable.withColumns(x).select("doc_id", "k0", "k1", "k2", *x)
    used = [r.level for r in levels.select("level").distinct().collect()]
    parts = [each.select("doc_id", F.lit(n).alias("level"), F.col(f"k{n}").alias("key"), *x) for n in sorted(used)]
    if not parts:
        return measured.select("doc_id", *(c.split()[0] for c in STATISTICS.split(", ")), base_failed().alias("base_failed"), F.lit(None).cast("double").alias("distance"), (~base_failed()).alias("kept"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    with scratch(docs.sparkSession):
        groups = Groups(landed(rows, "quality-features"), levels.count())
        fitted = groups.concentrate()
    keyed = measured.withColumns({"k0": named, "k1": language, "k2": F.lit("all")} | x)
    keyed = keyed.join(groups.small(levels), "k0", "left")
    key = F.when(F.col("level") == 0, F.col("k0")).when(F.col("level") == 1, F.col("k1")).when(F.col("level") == 2, F.col("k2"))
    keyed = keyed.withColumn("key", key).join(groups.small(fitted), ["level", "key"], "left")
    outlier = F.coalesce(F.col("distance") > chi2_quantile(1 - REJECT_P, DIMENSIONS), F.lit(False))
    return keyed.withColumn("distance", mahalanobis()).select(
        "doc_id", *(c.split()[0] for c in STATISTICS.split(", ")), base_failed().alias("base_failed"), "distance", (~base_failed() & ~outlier).alias("kept")
    )
