"""Training table: known positives and distance-excluded random background pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pixel_to_lonlat
from ..session import materialise
from ..settings import DOMAIN_RULES, FEATURES, MIN_BACKGROUND_DISTANCE, SEED, TEST_SHARE, Grid
from .clean import XY, domain_rules
from .nearest import pixels_near_points
from .pixels import PIXEL, valid_mask
from .ranking import sample_n, shuffle_position

# --- fixed values: metric names of the build report --------------------------
REPORT_METRICS = [
    "clean_landslide_samples",
    "background_samples",
    "total_training_rows",
    "min_background_distance_degrees",
    "random_seed",
]


def eligible_background(
    pixels: DataFrame, positives: DataFrame, grid: Grid, distance: float = MIN_BACKGROUND_DISTANCE, features: list[str] = FEATURES
) -> DataFrame:
    """Complete in-domain pixels with no positive within ``distance``, at their centres."""
    x, y = pixel_to_lonlat("row_id", "col_id", grid)
    near = pixels_near_points(positives, grid, distance, ("longitude", "latitude"))
    free = valid_mask(pixels.select(*PIXEL, *features), features).join(near, PIXEL, "left_anti")
    placed = free.withColumn("longitude", x).withColumn("latitude", y)
    return domain_rules(placed, strict=True, rules={c: DOMAIN_RULES[c] for c in XY})


def sample_background(
    pixels: DataFrame,
    positives: DataFrame,
    grid: Grid,
    n: int,
    distance: float = MIN_BACKGROUND_DISTANCE,
    seed: int = SEED,
    features: list[str] = FEATURES,
) -> DataFrame:
    """Exactly n random eligible pixels with ids bg_0..bg_{n-1} and label 0; an error if there are fewer.

    The eligible pixels are written once, since the count and the draw both read them.
    """
    eligible = materialise(eligible_background(pixels, positives, grid, distance, features), "eligible")
    keyed = require_rows(eligible, n).withColumn("_pixel", F.concat_ws(":", *PIXEL))
    drawn = sample_n(keyed, n, "_pixel", "_draw", seed)
    return drawn.select(
        F.concat(F.lit("bg_"), F.col("_draw").cast("string")).alias("sample_id"),
        *XY,
        *features,
        F.lit(0).alias("landslide"),
    )


def require_rows(eligible: DataFrame, n: int) -> DataFrame:
    """The rows themselves; raises when there are fewer than asked for."""
    found = eligible.count()
    if found < n:
        raise RuntimeError(f"{n} background pixels are asked for, but only {found} are eligible")
    return eligible


def training_table(positives: DataFrame, background: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Positives and background stacked by name, ids as text."""
    columns = ["sample_id", *XY, *features, "landslide"]
    known = positives.withColumn("sample_id", F.col("sample_id").cast("string")).withColumn("landslide", F.lit(1))
    return known.select(*columns).unionByName(background.select(*columns))


def build_report(training: DataFrame, distance: float = MIN_BACKGROUND_DISTANCE, seed: int = SEED) -> DataFrame:
    counts = training.agg(
        F.count_if(F.col("landslide") == 1).alias("positives"),
        F.count_if(F.col("landslide") == 0).alias("background"),
        F.count(F.lit(1)).alias("total"),
    )
    values = [F.col("positives"), F.col("background"), F.col("total"), F.lit(distance), F.lit(seed)]
    rows = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in zip(REPORT_METRICS, values)]
    return counts.select(F.inline(F.array(*rows)))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split``: the first ceil(share*n) rows of each label in hash order are the test part."""
    placed = shuffle_position(df, key, "_position", seed, [label], "_total")
    is_test = F.col("_position") < F.ceil(F.lit(test_share) * F.col("_total"))
    return placed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_position", "_total")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Add a fold number that deals each label's rows out evenly in hash order."""
    placed = shuffle_position(df, key, "_position", seed, [label])
    return placed.withColumn(name, (F.col("_position") % folds).cast("int")).drop("_position")


def split_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Full rows of the given member keys."""
    return df.join(members.select(key), key, "left_semi")
