"""Fixed values shared by the operators."""

from __future__ import annotations

from math import inf
from typing import NamedTuple

# --- fixed values: layers, in contract order --------------------------------
FEATURES = ["slope", "elevation", "aspect", "ndvi", "lulc", "rainfall", "river_m", "road_m", "twi"]
CATEGORICAL = ["lulc"]
CIRCULAR = ["aspect"]
OUTLIER_FEATURES = [c for c in FEATURES if c not in CATEGORICAL + CIRCULAR]
MODEL_NUMERIC = ["slope", "elevation", "aspect_sin", "aspect_cos", "ndvi", "rainfall", "river_m", "road_m", "twi"]

# --- fixed values: inclusive physical bounds --------------------------------
DOMAIN_RULES = {
    "longitude": (80.0, 90.0),
    "latitude": (25.0, 31.0),
    "slope": (0.0, 90.0),
    "elevation": (0.0, 9000.0),
    "aspect": (0.0, 360.0),
    "ndvi": (-1.0, 1.0),
    "rainfall": (0.0, inf),
    "river_m": (0.0, inf),
    "road_m": (0.0, inf),
    "twi": (0.0, inf),
}
NODATA_CODES = [-9999.0, -32768.0, 3.4028235e38, -3.4028235e38]

# --- fixed values: class schemes --------------------------------------------
CLASS_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.000001]
SCORE_LABELS = ["Very Low", "Low", "Moderate", "High", "Very High"]
RISK_LABELS = ["Low", "Guarded", "Moderate", "High", "Severe"]
CLASS_COLORS = ["#2c7bb6", "#abd9e9", "#ffffbf", "#fdae61", "#d7191c"]
CLASS_NODATA = 0
SCORE_NODATA = -9999.0
OVERLAY_ALPHA = 220

# --- fixed values: rainfall thresholds in mm by trailing window in hours -----
RAIN_THRESHOLDS = {1: 20.0, 3: 40.0, 24: 100.0, 72: 180.0}
RAIN_WINDOWS = list(RAIN_THRESHOLDS)
PAYLOAD_ZONE = "Asia/Kathmandu"  # zone of the wall clock in payloads

# --- fixed values: distances, sampling and modelling ------------------------
MIN_BACKGROUND_DISTANCE = 0.0009  # planar degrees
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
COARSE_RATIO = 10
ACCUMULATION_THRESHOLD = 1000
METRES_PER_PIXEL = 30.0
TREND_PAIRS = [
    ("slope", "elevation"),
    ("slope", "ndvi"),
    ("elevation", "rainfall"),
    ("river_m", "slope"),
    ("twi", "slope"),
    ("ndvi", "rainfall"),
]


class Grid(NamedTuple):
    """North-up affine of one pixel grid: x = c + col*a, y = f + row*e (e < 0)."""

    c: float
    a: float
    f: float
    e: float


class ClassScheme(NamedTuple):
    labels: list[str]
    edges: list[float] = CLASS_EDGES
    colors: list[str] = CLASS_COLORS


SCORE_SCHEME = ClassScheme(SCORE_LABELS)
RISK_SCHEME = ClassScheme(RISK_LABELS)
