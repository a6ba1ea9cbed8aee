"""Published results, retyped as literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopecast.functions import alert_level, trigger_score
from slopecast.operators import classes, clean, metrics, rain, surface
from slopecast.settings import RAIN_WINDOWS, RISK_LABELS, RISK_SCHEME, SCORE_LABELS

# --- fixed values: station, longitude, latitude, 1/3/24/72 h totals in mm, trigger ---
STATIONS = [
    (1, 85.7087560762858, 27.695128703143023, 0.1, 0.7, 14.1, 25.8, 0.14333333),
    (2, 85.79779934771437, 27.695128703143023, 0.1, 1.2, 17.6, 40.1, 0.22277778),
    (3, 85.88684261914295, 27.695128703143023, 0.3, 0.5, 14.9, 49.0, 0.27222222),
    (4, 85.61971280485722, 27.779838198285884, 0.1, 0.5, 6.4, 27.8, 0.15444444),
    (5, 85.7087560762858, 27.779838198285884, 0.1, 1.3, 13.9, 33.5, 0.18611111),
    (6, 85.79779934771437, 27.779838198285884, 0.1, 1.3, 13.9, 33.5, 0.18611111),
    (7, 85.88684261914295, 27.779838198285884, 0.1, 0.7, 14.1, 25.8, 0.14333333),
    (8, 85.97588589057153, 27.779838198285884, 0.2, 1.6, 16.0, 23.9, 0.16),
    (9, 85.53066953342864, 27.86454769342874, 0.0, 0.2, 3.3, 33.0, 0.18333333),
    (10, 85.61971280485722, 27.86454769342874, 0.5, 1.6, 15.9, 47.4, 0.26333333),
    (11, 85.7087560762858, 27.86454769342874, 0.3, 2.0, 34.7, 73.7, 0.40944444),
    (12, 85.79779934771437, 27.86454769342874, 0.2, 1.7, 29.7, 36.4, 0.297),
    (13, 85.88684261914295, 27.86454769342874, 0.2, 1.6, 16.0, 23.9, 0.16),
    (14, 85.97588589057153, 27.86454769342874, 1.3, 2.5, 48.7, 72.6, 0.487),
    (15, 85.53066953342864, 27.9492571885716, 0.2, 1.0, 17.4, 32.0, 0.17777778),
    (16, 85.61971280485722, 27.9492571885716, 0.2, 1.4, 31.4, 56.2, 0.314),
    (17, 85.7087560762858, 27.9492571885716, 0.3, 2.0, 34.7, 73.7, 0.40944444),
    (18, 85.79779934771437, 27.9492571885716, 0.3, 2.0, 35.2, 70.0, 0.38888889),
    (19, 85.88684261914295, 27.9492571885716, 0.1, 0.8, 24.4, 39.5, 0.244),
    (20, 85.53066953342864, 28.033966683714457, 0.2, 1.0, 17.4, 32.0, 0.17777778),
    (21, 85.61971280485722, 28.033966683714457, 0.0, 0.7, 7.3, 32.5, 0.18055556),
    (22, 85.7087560762858, 28.033966683714457, 0.2, 0.8, 4.3, 37.5, 0.20833333),
    (23, 85.79779934771437, 28.033966683714457, 0.0, 0.8, 9.0, 39.3, 0.21833333),
    (24, 85.88684261914295, 28.033966683714457, 0.1, 0.6, 4.8, 17.2, 0.09555556),
    (25, 85.53066953342864, 28.118676178857317, 0.5, 1.2, 14.1, 54.0, 0.3),
    (26, 85.61971280485722, 28.118676178857317, 0.2, 0.2, 3.7, 36.9, 0.205),
    (27, 85.7087560762858, 28.118676178857317, 0.5, 0.9, 3.0, 28.5, 0.15833333),
    (28, 85.79779934771437, 28.118676178857317, 0.4, 1.0, 5.3, 26.5, 0.14722222),
    (29, 85.73951107592136, 27.9148969304763, 0.3, 2.0, 34.7, 73.7, 0.40944444),
]


@pytest.fixture(scope="module")
def stations(spark):
    totals = ", ".join(f"rain_{h}h_mm double" for h in RAIN_WINDOWS)
    return spark.createDataFrame(STATIONS, f"station_id int, x double, y double, {totals}, expected double")


def test_trigger_scores(stations):
    score = trigger_score({h: rain.rain_column(h) for h in RAIN_WINDOWS})
    worst = stations.select(F.max(F.abs(score - F.col("expected")))).first()[0]
    assert worst < 1e-8


def test_maxima_and_hotspots(stations):
    scored = rain.with_trigger(stations)
    top = rain.rain_maxima(scored).first()
    assert tuple(top) == pytest.approx((1.3, 2.5, 48.7, 73.7, 0.487))
    ranked = rain.hotspots(scored, "station_id").orderBy("rank").collect()
    assert [r["station_id"] for r in ranked] == [14, 11, 17, 29]


def test_lattice_triangulation_tiles_the_hull(stations):
    triangles = surface.triangulate(stations).toPandas()
    xy = stations.select("station_id", "x", "y").toPandas().set_index("station_id")
    corners = [xy.loc[triangles[c]].to_numpy() for c in "ijk"]
    a, b, c = corners
    area = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (c - a)[:, 0] * (b - a)[:, 1]) / 2
    assert len(triangles) == 42
    assert area.sum() == pytest.approx(0.150856, abs=1e-6)
    assert set(triangles.to_numpy().ravel()) == set(range(1, 30))


def test_iqr_fences():
    q1, q3 = 32.69052505493164, 45.4854850769043
    assert (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) == pytest.approx((13.498085021972656, 64.67792510986328))


def test_audit_counts(spark):
    tagged = spark.range(1434).select(
        F.lit(1).alias("copies"),
        F.when(F.col("id") < 5, clean.MISSING).when(F.col("id") < 325, clean.OUTLIERS).alias("stage"),
    )
    rows = [(r["rows_before"], r["rows_after"], r["rows_removed"]) for r in clean.audit_report(tagged).collect()]
    assert rows == [(1434, 1434, 0), (1434, 1429, 5), (1429, 1429, 0), (1429, 1109, 320)]


@pytest.mark.parametrize(
    "counts, expected",
    [
        ((180, 42, 20, 202), (0.8603603603603603, 0.8278688524590164, 0.9099099099099099, 0.8669527896995708)),
        ((179, 43, 23, 199), (0.8513513513513513, 0.8223140495867769, 0.8963963963963963, 0.8577586206896551)),
        ((174, 48, 43, 179), (0.795045045045045, 0.788546255506608, 0.8063063063063063, 0.7973273942093542)),
    ],
)
def test_binary_metrics(spark, counts, expected):
    names = "true_negative long, false_positive long, false_negative long, true_positive long"
    row = metrics.binary_metrics(spark.createDataFrame([counts], names)).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == pytest.approx(expected)


def test_empty_denominators(spark):
    names = "true_negative long, false_positive long, false_negative long, true_positive long"
    row = metrics.binary_metrics(spark.createDataFrame([(5, 0, 0, 0)], names)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def _expand(spark, counts, name):
    rows = spark.createDataFrame(list(enumerate(counts, start=1)), f"{name} int, n int")
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "_")


def test_class_shares(spark):
    pixels = spark.createDataFrame(
        [(1, 1727469), (2, 629255), (3, 361329), (4, 264985), (5, 137728)], "class_value int, pixel_count long"
    )
    shared = classes._with_share(pixels, "pixel_count", "area_percent", None).orderBy("class_value").collect()
    assert [round(r["area_percent"], 3) for r in shared] == [55.354, 20.163, 11.578, 8.491, 4.413]
    points = _expand(spark, [6, 32, 97, 300, 674], "susceptibility_class")
    area = _expand(spark, [173, 63, 36, 26, 14], "class_value")
    summary = classes.class_summary(area, points)
    assert [r["landslide_count"] for r in summary.orderBy("class_value").collect()] == [6, 32, 97, 300, 674]
    shares = classes.capture_share(summary, "class_label", SCORE_LABELS[3:], {"landslide_percent": "points"}).first()
    assert round(shares["points_high"], 1) == 87.8


def test_risk_capture(spark):
    percent = [43.82723861624028, 28.450372001329022, 16.63616985214465, 10.373520028733543, 0.7126995015525021]
    summary = spark.createDataFrame(list(zip(RISK_LABELS, percent)), "risk_label string, area_percent double")
    row = classes.capture_share(summary, "risk_label", RISK_SCHEME.labels[3:], {"area_percent": "area"}).first()
    assert (round(row["area_high"], 1), round(row["area_top"], 1)) == (11.1, 0.7)


@pytest.mark.parametrize(
    "facts, label",
    [
        ((11.086219530286046, 0.7126995015525021, 0.487, 73.7), "Watch"),
        ((12.0, 0.0, 0.0, 0.0), "Elevated"),
        ((0.0, 1.0, 0.0, 0.0), "Elevated"),
        ((0.0, 0.0, 0.6, 0.0), "Elevated"),
        ((4.99, 0.99, 0.29, 59.9), "Normal"),
        ((0.0, 0.0, 0.0, 60.0), "Watch"),
    ],
)
def test_alert_level(spark, facts, label):
    row = spark.createDataFrame([facts], "high double, severe double, trig double, rain double")
    found = row.select(alert_level("high", "severe", "trig", "rain").alias("a")).first()["a"]
    assert found["label"] == label
    if facts[3] == 73.7:
        assert found["reason"].startswith("The strongest 72h rainfall total is 73.7 mm.")


def test_risk_summary_carries_run_time_and_empty_classes(spark, stations):
    risk = spark.createDataFrame([(0.1,), (0.2,), (0.85,), (None,)], "risk double")
    maxima = rain.rain_maxima(rain.with_trigger(stations))
    rows = classes.risk_summary(risk, maxima, RISK_SCHEME, "2026-07-31T09:23:22+05:45").orderBy("risk_min").collect()
    assert [r["pixel_count"] for r in rows] == [1, 1, 0, 0, 1]
    assert {r["generated_at"] for r in rows} == {"2026-07-31T09:23:22+05:45"}
    assert {round(r["max_trigger_score"], 3) for r in rows} == {0.487}
    assert sum(r["area_percent"] for r in rows) == pytest.approx(100.0)
