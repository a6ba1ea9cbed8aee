"""Audited cleaning of a sampled point inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import all_of, any_of, domain_conditions, null_sentinels, reason_string
from ..session import materialise
from ..settings import DOMAIN_RULES, FEATURES, OUTLIER_FEATURES, Grid
from .pixels import sample_pixels
from .quantiles import exact_quantiles

XY = ["longitude", "latitude"]

# --- fixed values: stage names, removal reason and audit texts ---------------
DUPLICATES = "duplicate_coordinate_removal"
MISSING = "missing_value_removal"
DOMAIN = "domain_rule_filtering"
OUTLIERS = "eda_iqr_outlier_removal"
MISSING_REASON = "missing_or_nodata_raster_value"
DETAILS = {
    DUPLICATES: "Dropped exact duplicate longitude/latitude pairs.",
    MISSING: "Dropped rows with missing/NoData values in any required feature.",
    DOMAIN: "Applied physical bounds for coordinates and raster feature values.",
    OUTLIERS: "Removed 1.5*IQR outliers for continuous non-circular EDA features only.",
}

Bounds = dict[str, dict[str, float]]


def dedupe_points(points: DataFrame, key: str = "sample_id", on: list[str] = XY) -> DataFrame:
    """First row (lowest key) of every coordinate pair, with its number of copies.

    An aggregate instead of a ranking, so copies collapse before the shuffle.
    """
    rest = [c for c in points.columns if c not in [key, *on]]
    first = F.min(F.struct(key, *rest)).alias("_first")
    return points.groupBy(*on).agg(first, F.count(F.lit(1)).alias("copies")).select("_first.*", *on, "copies")


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def domain_rules(df: DataFrame, strict: bool = False, rules=DOMAIN_RULES) -> DataFrame:
    """Rows inside all bounds; a missing value passes unless ``strict``."""
    conditions = domain_conditions(df.columns, rules).values()
    return df.where(all_of(F.coalesce(c, F.lit(not strict)) for c in conditions))


def iqr_bounds(df: DataFrame, columns: list[str] = OUTLIER_FEATURES, list_rows: int = 200_000) -> Bounds:
    """Quartiles and 1.5*IQR fences of each column."""
    quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75], list_rows)
    bounds: Bounds = {}
    for name, q in quartiles.items():
        q1, q3 = q[0.25], q[0.75]
        iqr = q3 - q1
        bounds[name] = {"q1": q1, "q3": q3, "iqr": iqr, "lower_bound": q1 - 1.5 * iqr, "upper_bound": q3 + 1.5 * iqr}
    return bounds


def iqr_conditions(bounds: Bounds) -> dict[str, Column]:
    """Column -> inside its fences; a missing value is outside."""
    return {
        c: F.coalesce(F.col(c).between(F.lit(b["lower_bound"]), F.lit(b["upper_bound"])), F.lit(False))
        for c, b in bounds.items()
    }


def iqr_bounds_table(df: DataFrame, bounds: Bounds) -> DataFrame:
    """One row per feature with its fences and how many rows of ``df`` fall outside."""
    inside = iqr_conditions(bounds)
    counted = df.agg(*[F.count_if(~inside[c]).alias(c) for c in bounds])
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            *[F.lit(b[k]).alias(k) for k in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
            F.col(c).alias("outliers"),
        )
        for c, b in bounds.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


def iqr_filter(df: DataFrame, bounds: Bounds) -> DataFrame:
    return df.where(all_of(iqr_conditions(bounds).values()))


def tag_removals(sampled: DataFrame, features: list[str] = FEATURES, outlier_features: list[str] = OUTLIER_FEATURES) -> DataFrame:
    """Add ``stage`` (first failed stage, NULL when clean) and ``removal_reason``."""
    missing = any_of(F.col(c).isNull() for c in [*XY, *features])
    bad_domain = {c: ~F.coalesce(ok, F.lit(True)) for c, ok in domain_conditions(sampled.columns).items()}
    checked = sampled.withColumn("_missing", missing).withColumn("_domain", reason_string(bad_domain, "outside_domain"))
    bounds = iqr_bounds(checked.where("not _missing and _domain = ''"), outlier_features)
    bad_iqr = {c: ~ok for c, ok in iqr_conditions(bounds).items()}
    checked = checked.withColumn("_iqr", reason_string(bad_iqr, "iqr_outlier"))
    stage = F.when(F.col("_missing"), MISSING).when(F.col("_domain") != "", DOMAIN).when(F.col("_iqr") != "", OUTLIERS)
    reason = (
        F.when(F.col("_missing"), F.lit(MISSING_REASON))
        .when(F.col("_domain") != "", F.col("_domain"))
        .when(F.col("_iqr") != "", F.col("_iqr"))
    )
    return checked.withColumns({"stage": stage, "removal_reason": reason}).drop("_missing", "_domain", "_iqr")


def clean_inventory(points: DataFrame, pixels: DataFrame, grid: Grid, features: list[str] = FEATURES) -> DataFrame:
    """Dedupe, sample every layer and tag each remaining point with its removal stage.

    The sampled points are written once, so that the fences and the tags do not join
    the pixel table again.
    """
    sampled = sample_pixels(dedupe_points(points), pixels, grid, features)
    landed = materialise(sampled.withColumns({c: null_sentinels(c) for c in features}), "sampled")
    return tag_removals(landed, features)


def kept_rows(tagged: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    clean = tagged.where(F.col("stage").isNull()).select("sample_id", *XY, *features)
    return clean.withColumn("landslide", F.lit(1))


def removed_rows(tagged: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return tagged.where(F.col("stage").isNotNull()).select("sample_id", *XY, *features, "removal_reason")


def audit_report(tagged: DataFrame) -> DataFrame:
    """Rows before, after and removed for each stage, in one pass."""
    counts = tagged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(F.col("stage") == MISSING).alias("missing"),
        F.count_if(F.col("stage") == DOMAIN).alias("domain"),
        F.count_if(F.col("stage") == OUTLIERS).alias("outliers"),
    )
    after_missing = F.col("unique_rows") - F.col("missing")
    after_domain = after_missing - F.col("domain")
    spans = [
        (DUPLICATES, F.col("raw"), F.col("unique_rows")),
        (MISSING, F.col("unique_rows"), after_missing),
        (DOMAIN, after_missing, after_domain),
        (OUTLIERS, after_domain, after_domain - F.col("outliers")),
    ]
    rows = [
        F.struct(
            F.lit(step).alias("step"),
            before.alias("rows_before"),
            after.alias("rows_after"),
            (before - after).alias("rows_removed"),
            F.lit(DETAILS[step]).alias("detail"),
        )
        for step, before, after in spans
    ]
    return counts.select(F.inline(F.array(*rows)))
