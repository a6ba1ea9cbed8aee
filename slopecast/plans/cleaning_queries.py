"""Cleaning, training-table and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import all_of, domain_conditions, missing_flag, null_sentinels, r6, reason_string
from ..operators import background, clean, describe
from ..operators.clean import XY
from ..operators.pixels import PIXEL, clean_layers, melt_layers, sample_pixels
from ..session import materialise
from ..settings import FEATURES, FOLDS, TREND_PAIRS
from .fixtures import ANY_BAD, ANY_MISSING, FEATURE_LIST, FENCED, GRID, RULES, Tables
from .registry import query

ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_LIST.split(", ") if c != "lulc") + ", CAST(lulc AS DOUBLE) AS lulc"
PLACE = "round(longitude, 7) AS longitude, round(latitude, 7) AS latitude"


def landed_sample(t: Tables) -> DataFrame:
    """The sampled points, written once for steps that read them several times."""
    return materialise(sampled(t), "sampled")


def sampled(t: Tables) -> DataFrame:
    """Distinct points with every layer's value."""
    drawn = sample_pixels(clean.dedupe_points(t.view("fx_points")), t.grid, GRID, [*FEATURES, "score"])
    return drawn.withColumns({c: null_sentinels(c) for c in FEATURES})


def tagged(t: Tables) -> DataFrame:
    return clean.clean_inventory(t.view("fx_points"), t.grid, GRID)


def positives(t: Tables) -> DataFrame:
    """The cleaned inventory, written once because several steps read it."""
    return materialise(clean.kept_rows(tagged(t)), "clean")


def training(t: Tables) -> DataFrame:
    known = positives(t)
    drawn = background.sample_background(t.grid, known, GRID, known.count())
    return background.training_table(known, drawn)


def tidy(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles: seven places for coordinates, six elsewhere."""
    doubles = [c for c, kind in df.dtypes if kind == "double" and c not in skip]
    return df.withColumns({c: F.round(c, 7 if c in XY else 6) + F.lit(0.0) for c in doubles})


@query("f1_drop_missing", f"SELECT sample_id FROM sq_sampled WHERE NOT ({ANY_MISSING})", ("sq_sampled",))
def f1(t: Tables) -> DataFrame:
    return clean.drop_missing(sampled(t), [*XY, *FEATURES]).select("sample_id")


LOOSE = " AND ".join(f"({c} IS NULL OR {r})" for c, r in RULES.items())


@query("f2_domain_rules", f"SELECT sample_id FROM sq_sampled WHERE {LOOSE}", ("sq_sampled",))
def f2(t: Tables) -> DataFrame:
    return clean.domain_rules(sampled(t)).select("sample_id")


@query("f3_domain_rules_strict", f"SELECT sample_id FROM sq_sampled WHERE {' AND '.join(RULES.values())}", ("sq_sampled",))
def f3(t: Tables) -> DataFrame:
    return clean.domain_rules(sampled(t), strict=True).select("sample_id")


REASONS = ", ".join(f"CASE WHEN NOT ({r}) THEN '{c}_outside_domain' END" for c, r in RULES.items())


@query("p14_reason_string", f"SELECT sample_id, concat_ws(';', {REASONS}) AS reason FROM sq_sampled", ("sq_sampled",))
def p14(t: Tables) -> DataFrame:
    points = sampled(t)
    failures = {c: ~F.coalesce(ok, F.lit(True)) for c, ok in domain_conditions(points.columns).items()}
    return points.select("sample_id", reason_string(failures, "outside_domain").alias("reason"))


def _in_domain(t: Tables) -> DataFrame:
    return clean.domain_rules(clean.drop_missing(landed_sample(t), [*XY, *FEATURES]))


IN_DOMAIN = f"SELECT * FROM sq_sampled WHERE NOT ({ANY_MISSING}) AND NOT ({ANY_BAD})"
A2_ROW = """SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
  round(max({c}_lo), 6) + 0.0 AS lower_bound, round(max({c}_hi), 6) AS upper_bound, count(CASE WHEN NOT ({c} BETWEEN {c}_lo AND {c}_hi) THEN 1 END) AS outliers FROM ({d}) d, sq_fences"""


@query("a2_iqr_bounds", " UNION ALL ".join(A2_ROW.format(c=c, d=IN_DOMAIN) for c in FENCED), ("sq_sampled", "sq_fences"))
def a2(t: Tables) -> DataFrame:
    rows = _in_domain(t)
    return tidy(clean.iqr_bounds_table(rows, clean.iqr_bounds(rows)))


@query("f5_iqr_filter", "SELECT sample_id FROM sq_clean", ("sq_clean",))
def f5(t: Tables) -> DataFrame:
    rows = _in_domain(t)
    return clean.iqr_filter(rows, clean.iqr_bounds(rows)).select("sample_id")


@query(
    "j8_bounds_cross_join",
    f"SELECT sample_id, {', '.join(f'{c} BETWEEN {c}_lo AND {c}_hi AS {c}_inside' for c in FENCED)} FROM ({IN_DOMAIN}) d, sq_fences",
    ("sq_sampled", "sq_fences"),
)
def j8(t: Tables) -> DataFrame:
    """One-row statistics meet every row as literals, so no join is left in the plan."""
    rows = _in_domain(t)
    inside = clean.iqr_conditions(clean.iqr_bounds(rows))
    return rows.select("sample_id", *[ok.alias(f"{c}_inside") for c, ok in inside.items()])


A3_SQL = """SELECT 'duplicate_coordinate_removal' AS step, CAST(sum(copies) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(copies) - count(*) AS BIGINT) AS rows_removed, 'Dropped exact duplicate longitude/latitude pairs.' AS detail FROM sq_tagged
UNION ALL SELECT 'missing_value_removal', count(*), count(*) - count(CASE WHEN stage = 'missing_value_removal' THEN 1 END), count(CASE WHEN stage = 'missing_value_removal' THEN 1 END), 'Dropped rows with missing/NoData values in any required feature.' FROM sq_tagged
UNION ALL SELECT 'domain_rule_filtering', count(*), count(*) - count(CASE WHEN stage = 'domain_rule_filtering' THEN 1 END), count(CASE WHEN stage = 'domain_rule_filtering' THEN 1 END), 'Applied physical bounds for coordinates and raster feature values.' FROM sq_tagged WHERE stage IS DISTINCT FROM 'missing_value_removal'
UNION ALL SELECT 'eda_iqr_outlier_removal', count(*), count(*) - count(stage), count(stage), 'Removed 1.5*IQR outliers for continuous non-circular EDA features only.' FROM sq_tagged WHERE stage IS NULL OR stage = 'eda_iqr_outlier_removal'"""


@query("a3_audit_report", A3_SQL, ("sq_tagged",))
def a3(t: Tables) -> DataFrame:
    return clean.audit_report(tagged(t))


@query(
    "a4_removed_rows_audit",
    f"SELECT sample_id, {PLACE}, {ROUNDED}, removal_reason FROM sq_tagged WHERE stage IS NOT NULL",
    ("sq_tagged",),
)
def a4(t: Tables) -> DataFrame:
    return tidy(clean.removed_rows(tagged(t)))


@query(
    "u1_union_by_name",
    "SELECT sample_id, removal_reason, CASE WHEN stage <> 'missing_value_removal' THEN round(slope, 6) END AS slope FROM sq_tagged WHERE stage IS NOT NULL",
    ("sq_tagged",),
)
def u1(t: Tables) -> DataFrame:
    rows = tagged(t)
    missing = rows.where(F.col("stage") == clean.MISSING).select("sample_id", "removal_reason")
    other = rows.where(F.col("stage").isin(clean.DOMAIN, clean.OUTLIERS)).select("sample_id", "removal_reason", "slope")
    return tidy(missing.unionByName(other, allowMissingColumns=True))


@query("u3_dedupe_subset", f"SELECT sample_id, {PLACE}, copies FROM sq_unique", ("sq_unique",))
def u3(t: Tables) -> DataFrame:
    return tidy(clean.dedupe_points(t.view("fx_points")))


@query(
    "l5_sample_background",
    f"SELECT sample_id, {PLACE}, {ROUNDED}, 0 AS landslide FROM sq_background",
    ("sq_background",),
)
def l5(t: Tables) -> DataFrame:
    known = positives(t)
    n = known.count()
    drawn = background.sample_background(t.grid, known, GRID, n)
    return tidy(drawn.withColumn("lulc", F.col("lulc").cast("double")))


@query(
    "f14_min_distance_filter",
    "SELECT row_id, col_id FROM sq_eligible",
    ("sq_eligible",),
)
def f14(t: Tables) -> DataFrame:
    return background.eligible_background(t.grid, positives(t), GRID).select(*PIXEL)


@query(
    "u2_union_classes",
    f"SELECT sample_id, {PLACE}, {ROUNDED}, landslide FROM sq_training",
    ("sq_training",),
)
def u2(t: Tables) -> DataFrame:
    return tidy(training(t).withColumn("lulc", F.col("lulc").cast("double")))


@query(
    "a5_build_report",
    """SELECT 'clean_landslide_samples' AS metric, CAST(sum(landslide) AS DOUBLE) AS value FROM sq_training
UNION ALL SELECT 'background_samples', CAST(sum(1 - landslide) AS DOUBLE) FROM sq_training
UNION ALL SELECT 'total_training_rows', CAST(count(*) AS DOUBLE) FROM sq_training
UNION ALL SELECT 'min_background_distance_degrees', 0.0009::DOUBLE UNION ALL SELECT 'random_seed', 42::DOUBLE""",
    ("sq_training",),
)
def a5(t: Tables) -> DataFrame:
    return background.build_report(training(t))


SPLIT = """SELECT sample_id, landslide, CASE WHEN row_number() OVER (PARTITION BY landslide ORDER BY md5('42:' || sample_id), sample_id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY landslide)) THEN 'test' ELSE 'train' END AS split FROM fx_train"""


@query("w4_stratified_split", SPLIT, ("fx_train",))
def w4(t: Tables) -> DataFrame:
    rows = t.view("fx_train").select("sample_id", "landslide")
    return background.stratified_split(rows, "sample_id", "landslide").select("sample_id", "landslide", "split")


@query(
    "w5_stratified_folds",
    "SELECT sample_id, landslide, CAST((row_number() OVER (PARTITION BY landslide ORDER BY md5('42:' || sample_id), sample_id) - 1) % 5 AS INTEGER) AS fold FROM fx_train",
    ("fx_train",),
)
def w5(t: Tables) -> DataFrame:
    rows = t.view("fx_train").select("sample_id", "landslide")
    return background.stratified_folds(rows, "sample_id", "landslide", FOLDS).select("sample_id", "landslide", "fold")


@query(
    "j9_split_membership",
    f"SELECT t.sample_id, round(t.slope, 6) AS slope, t.landslide FROM fx_train t WHERE t.sample_id IN (SELECT sample_id FROM ({SPLIT}) s WHERE split = 'test')",
    ("fx_train",),
)
def j9(t: Tables) -> DataFrame:
    rows = t.view("fx_train")
    split = background.stratified_split(rows.select("sample_id", "landslide"), "sample_id", "landslide")
    test = background.split_members(rows, split.where(F.col("split") == "test"), "sample_id")
    return tidy(test.select("sample_id", "slope", "landslide"))


MOMENTS = """SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
  round(avg(power({c} - m, 3)) / power(stddev_pop({c}), 3), 6) + 0.0 AS skewness, round(100.0::DOUBLE * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*), 6) AS missing_percent,
  CASE WHEN 100.0::DOUBLE * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*) > 40 THEN 'RED' WHEN 100.0::DOUBLE * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*) > 20 THEN 'ORANGE' ELSE 'GREEN' END AS flag
FROM (SELECT CASE WHEN {c} > -9998 THEN CAST({c} AS DOUBLE) END AS {c}, avg(CASE WHEN {c} > -9998 THEN CAST({c} AS DOUBLE) END) OVER () AS m FROM fx_grid) g"""


@query("a1_layer_stats", " UNION ALL ".join(MOMENTS.format(c=c) for c in FEATURES), ("fx_grid",))
def a1(t: Tables) -> DataFrame:
    return tidy(describe.layer_stats(clean_layers(t.grid, FEATURES), FEATURES))


@query(
    "p16_missing_flag",
    """SELECT lulc, round(100.0::DOUBLE * sum(bad) / count(*), 6) AS missing_percent, CASE WHEN 100.0::DOUBLE * sum(bad) / count(*) > 40 THEN 'RED' WHEN 100.0::DOUBLE * sum(bad) / count(*) > 20 THEN 'ORANGE' ELSE 'GREEN' END AS flag
FROM (SELECT lulc, CASE WHEN score IS NULL OR score < CAST(lulc AS DOUBLE) / 200 THEN 1 ELSE 0 END AS bad FROM fx_grid) g GROUP BY lulc""",
    ("fx_grid",),
)
def p16(t: Tables) -> DataFrame:
    bad = F.coalesce(F.col("score") < F.col("lulc").cast("double") / 200, F.lit(True))
    share = t.grid.groupBy("lulc").agg((F.avg(bad.cast("double")) * 100).alias("missing_percent"))
    return tidy(share.withColumn("flag", missing_flag(F.round("missing_percent", 9))))


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


COMPLETE_GRID = "SELECT * FROM fx_grid WHERE slope > -9998"
COMPLETE_POINTS = f"SELECT * FROM sq_sampled WHERE NOT ({ANY_MISSING})"
CORR = "SELECT '{s}' AS \"set\", '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 AS r FROM {d} d"


@query(
    "a11_correlation_matrix",
    f", cg AS ({COMPLETE_GRID}), cp AS ({COMPLETE_POINTS})\n"
    + " UNION ALL ".join(CORR.format(s=s, a=a, b=b, d=d) for s, d in (("background", "cg"), ("points", "cp")) for a, b in _pairs(FEATURES)),
    ("fx_grid", "sq_sampled"),
)
def a11(t: Tables) -> DataFrame:
    sets = {"background": clean_layers(t.grid, FEATURES), "points": landed_sample(t)}
    return tidy(describe.correlation_matrix(sets, FEATURES))


@query(
    "j10_pairwise_complete",
    "SELECT count(*) AS n, round(corr(slope, score), 6) + 0.0 AS r FROM sq_sampled WHERE slope IS NOT NULL AND score IS NOT NULL",
    ("sq_sampled",),
)
def j10(t: Tables) -> DataFrame:
    both = sampled(t).where(all_of([F.col("slope").isNotNull(), F.col("score").isNotNull()]))
    return tidy(both.agg(F.count(F.lit(1)).alias("n"), F.corr("slope", "score").alias("r")))


TRIM = "SELECT '{c}' AS layer, row_id, col_id, round({c}::DOUBLE, 6) AS value FROM fx_grid WHERE {c} BETWEEN (SELECT quantile_cont({c}::DOUBLE, 0.01) FROM fx_grid) AND (SELECT quantile_cont({c}::DOUBLE, 0.99) FROM fx_grid)"


@query("f6_percentile_trim", " UNION ALL ".join(TRIM.format(c=c) for c in FEATURES), ("fx_grid",))
def f6(t: Tables) -> DataFrame:
    """Every layer inside its own limits; one pass finds the limits of all."""
    layers = t.grid.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    limits = describe.exact_quantiles(layers, {c: F.col(c) for c in FEATURES}, [0.01, 0.99])
    return tidy(describe.percentile_trim(melt_layers(layers, FEATURES), limits))


HIST = FEATURES
VALUES = " UNION ALL ".join(
    f"SELECT '{s}' AS \"set\", '{c}' AS feature, {c} AS v FROM {d} d WHERE {c} BETWEEN (SELECT quantile_cont({c}, 0.01) FROM cg) AND (SELECT quantile_cont({c}, 0.99) FROM cg)"
    for c in HIST
    for s, d in (("raster", "cg"), ("points", "sq_sampled"))
)


@query(
    "a12_histogram",
    f""", cg AS (SELECT CASE WHEN slope > -9998 THEN slope END AS slope, {', '.join(c for c in HIST if c != 'slope')} FROM fx_grid), vals AS ({VALUES}),
lim AS (SELECT "set", feature, min(v) AS lo, max(v) AS hi, count(*) AS n, avg(v) AS set_mean FROM vals GROUP BY "set", feature)
SELECT v."set", v.feature, CAST(least(floor((v.v - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) AS INTEGER) AS bin, round(max(lo) + least(floor((v.v - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) * max((hi - lo) / 60.0::DOUBLE), 6) AS bin_left,
  count(*) AS "count", round(count(*) / (max(n) * max((hi - lo) / 60.0::DOUBLE)), 6) AS density, round(max(set_mean), 6) AS set_mean
FROM vals v JOIN lim USING ("set", feature) GROUP BY v."set", v.feature, least(floor((v.v - lo) / ((hi - lo) / 60.0::DOUBLE)), 59)""",
    ("fx_grid", "sq_sampled"),
)
def a12(t: Tables) -> DataFrame:
    sets = {"raster": clean_layers(t.grid, HIST).select(*HIST), "points": landed_sample(t).select(*HIST)}
    return tidy(describe.histogram(sets, "raster", HIST))


BOX = """SELECT '{c}' AS feature, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_low, round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_high,
  count(CASE WHEN NOT (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS fliers
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM sq_sampled), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM sq_sampled) q GROUP BY q1, q2, q3"""


@query("a13_boxplot_stats", " UNION ALL ".join(BOX.format(c=c) for c in FEATURES), ("sq_sampled",))
def a13(t: Tables) -> DataFrame:
    return tidy(describe.boxplot_stats(landed_sample(t), FEATURES))


TREND = "SELECT '{a}' AS x, '{b}' AS y, regr_slope({b}, {a}) AS slope, regr_intercept({b}, {a}) AS intercept, corr({a}, {b}) AS r, min({a}) AS x_min, max({a}) AS x_max, count(*) AS n FROM sq_sampled WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
TRENDS = " UNION ALL ".join(TREND.format(a=a, b=b) for a, b in TREND_PAIRS)


@query(
    "a14_linear_trend",
    f"""SELECT x, y, CAST(i AS INTEGER) AS i, n, round(slope, 6) + 0.0 AS slope, round(r, 6) + 0.0 AS r, round(x_min + i * (x_max - x_min) / 199.0::DOUBLE, 6) + 0.0 AS x_at, round(intercept + slope * (x_min + i * (x_max - x_min) / 199.0::DOUBLE), 6) + 0.0 AS y_at
FROM ({TRENDS}) f, (SELECT unnest(range(0, 200)) AS i) k""",
    ("sq_sampled",),
)
def a14(t: Tables) -> DataFrame:
    trend = describe.linear_trend(sampled(t))
    line = describe.trend_line(trend).select("x", "y", "i", "x_at", "y_at")
    return tidy(line.join(F.broadcast(trend.select("x", "y", "n", "slope", "r")), ["x", "y"]))


# Density of r under no correlation, integrated beyond |r| by Simpson's rule.
P_VALUE = f"""SELECT x, y, n, r, CASE WHEN n > 4 THEN sum(w * power(1 - u * u, (n - 4) / 2.0::DOUBLE)) * (least(1.0::DOUBLE, abs(r) + 40 / sqrt(n)) - abs(r)) / 2000
  * 2 * exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE) - lgamma(0.5::DOUBLE)) END AS p FROM (
  SELECT x, y, n, r, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3.0::DOUBLE AS w, abs(r) + i * (least(1.0::DOUBLE, abs(r) + 40 / sqrt(n)) - abs(r)) / 2000 AS u
  FROM ({TRENDS}) f, (SELECT unnest(range(0, 2001)) AS i) k) s GROUP BY x, y, n, r"""


@query(
    "p15_significance",
    f"SELECT x, y, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance FROM ({P_VALUE}) q",
    ("sq_sampled",),
)
def p15(t: Tables) -> DataFrame:
    return tidy(describe.linear_trend(sampled(t)).select("x", "y", "n", "r", "p_value", "significance"))


DIFF = "SELECT '{c}' AS feature, (SELECT avg(CAST({c} AS DOUBLE)) FROM sq_sampled) AS point_mean, (SELECT avg(CASE WHEN {c} > -9998 THEN CAST({c} AS DOUBLE) END) FROM fx_grid) AS area_mean"


@query(
    "p17_pct_difference",
    f"""SELECT feature, round(point_mean, 6) AS point_mean, round(area_mean, 6) AS area_mean, round((point_mean - area_mean) / abs(area_mean) * 100, 6) + 0.0 AS pct, CASE WHEN point_mean > area_mean THEN 'HIGHER' ELSE 'LOWER' END AS direction
FROM ({' UNION ALL '.join(DIFF.format(c=c) for c in FEATURES)}) d WHERE area_mean <> 0""",
    ("sq_sampled", "fx_grid"),
)
def p17(t: Tables) -> DataFrame:
    return tidy(describe.pct_difference(sampled(t), clean_layers(t.grid, FEATURES), FEATURES))
