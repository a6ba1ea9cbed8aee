"""Brute-force comparisons, invariants, errors and literal payloads."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopecast.functions import first_present, isclose, null_sentinels, place_fields, risk_formula, significance
from slopecast.operators import background, clean, delaunay, describe, lookups, models, nearest, polygon, proximity, quantiles, rain, ranking, resample, surface
from slopecast.settings import Grid
from slopecast.sources import payload, points, polygons, sinks

UNIT = Grid(c=0.0, a=1.0, f=0.0, e=-1.0)


def _grid(spark, height, width, marked=()):
    rows = [(r, c, (r, c) in set(marked)) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, "row_id int, col_id int, marked boolean")


def test_proximity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(proximity, "CHUNK_ROWS", 7)
    monkeypatch.setattr(proximity, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    for marked in ([(int(r), int(c)) for r, c in zip(rng.integers(0, 30, 9), rng.integers(0, 40, 9))], [(29, 0)], []):
        found = proximity.proximity(_grid(spark, 30, 40, marked), "marked", 30.0).toPandas()
        assert len(found) == 1200
        if marked:
            cells = np.array(marked)
            best = np.sqrt(((found[["row_id", "col_id"]].to_numpy()[:, None, :] - cells[None]) ** 2).sum(-1)).min(1)
            np.testing.assert_allclose(found["distance"].to_numpy(float), best * 30.0)
        else:
            assert found["distance"].isna().all()


def test_row_minimum_equals_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        rows, width = rng.integers(1, 6), rng.integers(1, 60)
        costs = np.where(rng.random((rows, width)) < rng.random(), proximity.FAR, rng.integers(0, 400, (rows, width)) ** 2).astype(np.int64)
        places = np.arange(width)
        want = (costs[:, None, :] + (places[:, None] - places[None, :]) ** 2).min(2)
        got = proximity.row_minimum(costs)
        assert ((got == want) | ((got >= proximity.FAR) & (want >= proximity.FAR))).all()


def test_bilinear_reproduces_a_plane(spark):
    source = spark.range(64).selectExpr("CAST(id DIV 8 AS INT) row_id", "CAST(id % 8 AS INT) col_id")
    source = source.withColumn("value", F.col("row_id") * 4.0 + F.col("col_id") * 2.0)
    coarse = Grid(c=0.0, a=4.0, f=0.0, e=-4.0)
    found = resample.resample(_grid(spark, 32, 32), UNIT, source, coarse, "bilinear").where(
        "row_id between 2 and 29 and col_id between 2 and 29"
    )
    expected = ((F.col("row_id") + 0.5) / 4 - 0.5) * 4 + ((F.col("col_id") + 0.5) / 4 - 0.5) * 2
    assert found.agg(F.max(F.abs(F.col("value") - expected))).first()[0] < 1e-9


def test_nearest_neighbour_with_a_dense_cluster(spark):
    rng = np.random.default_rng(5)
    sites = np.vstack([rng.uniform(0, 1, (150, 2)), 0.5 + rng.normal(0, 1e-5, (150, 2)), np.full((50, 2), 0.25)])
    asked = np.vstack([rng.uniform(-0.5, 1.5, (200, 2)), 0.5 + rng.normal(0, 1e-5, (50, 2))])
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "site int, longitude double, latitude double")
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "id int, longitude double, latitude double")
    found = nearest.nearest_neighbour(q, s, "id", "site").toPandas().sort_values("id")
    exact = np.sqrt(((asked[:, None] - sites[None]) ** 2).sum(-1))
    np.testing.assert_allclose(found["distance"], exact.min(1))
    free = nearest.distance_anti_join(q, s, "id", "site", 0.02)
    assert {r["id"] for r in free.collect()} == set(np.flatnonzero(exact.min(1) > 0.02))


def test_pixels_near_points_equals_brute_force(spark):
    grid = Grid(c=85.0, a=0.00027, f=28.0, e=-0.00027)
    rng = np.random.default_rng(6)
    at = np.column_stack([85.0 + rng.uniform(0, 0.01, 8), 28.0 - rng.uniform(0, 0.01, 8)])
    p = spark.createDataFrame([(float(x), float(y)) for x, y in at], "longitude double, latitude double")
    found = nearest.pixels_near_points(p, grid, 0.0009, ("longitude", "latitude"))
    got = {(r["row_id"], r["col_id"]) for r in found.collect()}
    want = set()
    for r in range(-10, 60):
        for c in range(-10, 60):
            x, y = 85.0 + (c + 0.5) * 0.00027, 28.0 + (r + 0.5) * -0.00027
            if np.sqrt(((at - [x, y]) ** 2).sum(1)).min() <= 0.0009:
                want.add((r, c))
    assert got == want


def test_quantiles_after_refinement(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(2000, 1.25), [1e6, -1e6]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    found = quantiles.exact_quantiles(df, {"v": F.col("v")}, probs, list_rows=50)["v"]
    np.testing.assert_allclose([found[p] for p in probs], np.quantile(values, probs))
    rough = quantiles.approx_quantiles(df, {"v": F.col("v")}, [0.5])["v"][0.5]
    assert abs(rough - np.quantile(values, 0.5)) < 0.05


def test_positions_are_dense(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 37) % 1009)
    placed = ranking.surrogate_id(df, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in placed] == list(range(1000))
    drawn = ranking.sample_n(df, 100, "id")
    assert drawn.count() == 100 and drawn.distinct().count() == 100
    assert {r["id"] for r in drawn.collect()} == {r["id"] for r in ranking.sample_n(df.repartition(3), 100, "id").collect()}
    assert ranking.sample_n(df, 5000, "id").count() == 1000


def test_split_and_folds(spark):
    df = spark.range(101).withColumn("landslide", (F.col("id") % 3 == 0).cast("int"))
    split = background.stratified_split(df, "id", "landslide")
    sizes = {(r["landslide"], r["split"]): r["count"] for r in split.groupBy("landslide", "split").count().collect()}
    assert sizes == {(1, "test"): 7, (1, "train"): 27, (0, "test"): 14, (0, "train"): 53}
    folds = background.stratified_folds(df, "id", "landslide", 5)
    spread = folds.groupBy("landslide", "fold").count().groupBy("landslide").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in spread)


def test_removed_and_clean_make_up_the_input(spark, sf_dir):
    from slopecast.plans.cleaning_queries import tagged
    from slopecast.plans.fixtures import Tables

    t = Tables(spark, sf_dir)
    rows = tagged(t)
    kept, removed = clean.kept_rows(rows).count(), clean.removed_rows(rows).count()
    assert kept + removed == t.view("fx_points").select("longitude", "latitude").distinct().count()


def test_shortfall_raises(spark):
    with pytest.raises(RuntimeError, match="10 background pixels .* only 3"):
        background.require_rows(spark.range(3), 10)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="lulc"):
        points.require_columns(spark.range(1), ["id", "lulc"])
    assert points.missing_columns(spark.range(1), ["id", "b", "a"]) == ["b", "a"]


def test_sentinel_modes(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-9999.0,), (-9999.00001,), (3.4028234663852886e38,), (7.0,), (None,)], "v double")
    close = [r[0] for r in df.select(null_sentinels("v")).collect()]
    exact = [r[0] for r in df.select(null_sentinels("v", [-9999.0, -32768.0], "exact")).collect()]
    assert close == [None, None, None, None, None, 7.0, None]
    assert exact == [None, None, None, -9999.00001, 3.4028234663852886e38, 7.0, None]
    assert [r[0] for r in df.select(isclose("v", -9999.0)).collect()] == [False, False, True, True, False, False, False]


def test_risk_is_monotone_and_bounded(spark):
    df = spark.range(121).selectExpr("(id div 11) / 10D AS s", "(id % 11) / 10D AS r").withColumn("v", risk_formula("s", "r"))
    table = df.toPandas().pivot(index="s", columns="r", values="v").to_numpy()
    assert table.min() >= 0 and table.max() <= 1
    assert (np.diff(table, axis=0) >= 0).all() and (np.diff(table, axis=1) >= 0).all()


def test_surface_reproduces_a_plane_and_stations(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform([2, -38], [58, -2], (15, 2))
    rows = [(i, float(x), float(y), float(0.3 + 0.01 * x - 0.02 * y)) for i, (x, y) in enumerate(xy)]
    stations = spark.createDataFrame(rows, "station_id int, x double, y double, v double")
    fitted = surface.interpolate(_grid(spark, 40, 60).select("row_id", "col_id"), stations, ["v"], UNIT)
    expected = 0.3 + 0.01 * (F.col("col_id") + 0.5) + 0.02 * (F.col("row_id") + 0.5)
    inside = fitted.where("in_hull")
    assert inside.count() > 500
    assert inside.agg(F.max(F.abs(F.col("v") - expected))).first()[0] < 1e-9
    outside = fitted.where("not in_hull").toPandas()
    centre = np.column_stack([outside["col_id"] + 0.5, -(outside["row_id"] + 0.5)])
    nearest_id = ((centre[:, None] - xy[None]) ** 2).sum(-1).argmin(1)
    np.testing.assert_allclose(outside["v"], [rows[i][3] for i in nearest_id])


def test_triangulation_equals_empty_circles(spark):
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 1, (40, 2))
    stations = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "station_id int, x double, y double")
    got = {tuple(r) for r in surface.triangulate(stations).toPandas().to_numpy().tolist()}
    z = (xy**2).sum(1)
    want = set()
    for i in range(40):
        for j in range(i + 1, 40):
            for k in range(j + 1, 40):
                m = np.column_stack([xy[[i, j, k]], np.ones(3)])
                plane = np.linalg.solve(m, z[[i, j, k]])
                if ((z - xy @ plane[:2] - plane[2]) > -1e-12).all():
                    want.add((i, j, k))
    assert got == want


def _triangulated(spark, xy, block):
    stations = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "station_id int, x double, y double")
    return np.array([tuple(r) for r in delaunay.triangulate(stations, block).collect()])


@pytest.mark.parametrize("kind", ["cluster of five", "dense cluster", "lattice", "even"])
def test_triangulation_tiles_the_hull_with_empty_circles(spark, kind):
    """Many blocks, stations 11 m apart among distant ones, and equal circles."""
    rng = np.random.default_rng(4)
    far = rng.uniform(0, 1, (24, 2))
    lattice = np.stack(np.meshgrid(np.arange(30) * 0.1, np.arange(20) * 0.07), -1).reshape(-1, 2)
    xy = {
        "cluster of five": np.r_[far, 0.5 + rng.uniform(0, 1e-4, (5, 2))], "dense cluster": np.r_[far, 0.5 + rng.uniform(0, 1e-4, (1000, 2))],
        "lattice": lattice, "even": rng.uniform(0, 1, (1500, 2)),
    }[kind]
    got = _triangulated(spark, xy, 64)
    corners = delaunay.hull(np.arange(len(xy)), *xy.T)
    assert len({tuple(t) for t in got}) == len(got) == (2 * 29 * 19 if kind == "lattice" else 2 * len(xy) - 2 - len(corners))
    a, b, c = (xy[got[:, n]] for n in range(3))
    area = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum()
    hx, hy = xy[corners].T
    assert area == pytest.approx(abs(np.dot(hx, np.roll(hy, -1)) - np.dot(hy, np.roll(hx, -1))), rel=1e-9)
    for t in got[:: max(1, len(got) // 500)]:
        x, y, radius = delaunay.circles(int(t[0]), t[None, 1:], *xy.T)
        away = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        away[t] = np.inf
        assert away.min() >= radius[0] * (1 - 1e-5)


def test_few_or_hidden_or_missing_stations(spark):
    schema = "station_id int, x double, y double"
    for rows in ([], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 1.0, 1.0)], [(n, float(n), 2.0 * n) for n in range(6)]):
        assert delaunay.triangulate(spark.createDataFrame(rows, schema)).count() == 0
    rows = [(3, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (7, 0.0, 0.0), (5, 1.0, 0.0), (8, None, 1.0)]
    stations = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in delaunay.triangulate(stations).collect()] == [(1, 2, 3)]
    assert sorted(tuple(r) for r in delaunay.hidden_stations(stations).collect()) == [(5, 1), (7, 3)]


def test_surface_of_many_stations_in_one_tile(spark, monkeypatch):
    """The same surface whether the nearest search holds the stations or goes through the pyramid."""
    rng = np.random.default_rng(6)
    xy = np.r_[rng.uniform([20, -30], [20.5, -29.5], (300, 2)), rng.uniform([5, -35], [55, -5], (12, 2))]
    rows = [(i, float(x), float(y), float(2 * x - y)) for i, (x, y) in enumerate(xy)]
    stations = spark.createDataFrame(rows, "station_id int, x double, y double, v double")
    grid = _grid(spark, 40, 60).select("row_id", "col_id")
    plain = sorted(tuple(r) for r in surface.interpolate(grid, stations, ["v"], UNIT).collect())
    monkeypatch.setattr(surface, "FEW_STATIONS", 1000)
    assert sorted(tuple(r) for r in surface.interpolate(grid, stations, ["v"], UNIT).collect()) == plain
    for r, c, v, inside in plain:
        x, y = c + 0.5, -(r + 0.5)
        want = 2 * x - y if inside else rows[int(((xy - [x, y]) ** 2).sum(1).argmin())][3]
        assert v == pytest.approx(want, abs=1e-9)
    assert 0 < sum(r[3] for r in plain) < len(plain) == 2400


def test_polygon_strictness_and_multi_parts(spark):
    square = [(0, 0, s, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    island = [(0, 1, s, x, y) for s, (x, y) in enumerate([(6.0, 0.0), (8.0, 0.0), (7.0, 3.0)])]
    vertices = spark.createDataFrame(square + island, "feature_id int, part_id int, seq int, x double, y double")
    edges = polygon.ring_edges(vertices)
    asked = [(1, 2.0, 2.0), (2, 4.0, 2.0), (3, 0.0, 0.0), (4, 7.0, 1.0), (5, 5.0, 1.0), (6, 2.0, 4.0)]
    p = spark.createDataFrame(asked, "id int, longitude double, latitude double")
    inside = polygon.points_in_polygons(p, edges, "id", 1.5)
    assert {r["id"] for r in inside.collect()} == {1, 4}
    text = sinks.polygon_features(vertices)
    again = polygons.parse_features(text, "geojson")
    assert again.select("part_id").distinct().count() == 2
    assert again.count() == 5 + 4
    grid = Grid(c=-1.0, a=1.0, f=5.0, e=-1.0)
    kept = polygon.clip_to_polygon(_grid(spark, 7, 11), edges, grid)
    assert kept.where("col_id between 1 and 4").count() == 16


def test_clip_drops_centres_on_the_boundary(spark):
    ring = [(0, 0, s, x, y) for s, (x, y) in enumerate([(0.5, -0.5), (4.5, -0.5), (4.5, -4.5), (0.5, -4.5)])]
    vertices = spark.createDataFrame(ring, "feature_id int, part_id int, seq int, x double, y double")
    kept = polygon.clip_to_polygon(_grid(spark, 6, 6), polygon.ring_edges(vertices), UNIT)
    assert {(r["row_id"], r["col_id"]) for r in kept.collect()} == {(r, c) for r in range(1, 4) for c in range(1, 4)}


def test_payloads(spark):
    one = '{"hourly":{"time":["2024-01-01T08:00","2024-01-01T09:00","2024-01-01T10:00"],"precipitation":[1.5,null,9]},"current":{"time":"2024-01-01T09:15"}}'
    many = '[{"hourly":{"time":["2024-01-01T09:00"],"precipitation":[2]},"current":{"time":"2024-01-01T09:15:00+05:45","rain":0.4}},{"hourly":{"time":[],"precipitation":[]},"current":{"time":"2024-01-01T09:15","rain":0.1,"precipitation":0.7}}]'
    items = payload.parse_payloads(spark.createDataFrame([(1, one), (2, many)], "k int, j string"), "j", "k")
    readings = payload.payload_readings(items, "k").withColumnRenamed("k", "loc_id")
    assert readings.count() == 4
    now = F.lit("2024-01-01 09:15:00").cast("timestamp_ntz")
    totals = {r["loc_id"]: r["rain_3h_mm"] for r in rain.trailing_totals(readings, now).collect()}
    assert totals == {1: 1.5, 2: 2.0}
    current = payload.payload_current(items, "k").orderBy("k", "item").collect()
    assert [(r["current_rain_mm"], r["current_precipitation_mm"]) for r in current] == [(0.0, 0.0), (0.4, 0.4), (0.1, 0.7)]
    assert {str(r["latest_time"]) for r in current} == {"2024-01-01 09:15:00"}


def test_windows_are_left_open(spark):
    rows = [(1, "2024-01-01 08:00:00", 5.0), (1, "2024-01-01 08:00:01", 2.0), (1, "2024-01-01 09:00:01", 4.0)]
    readings = spark.createDataFrame(rows, "loc_id int, t string, mm double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    row = rain.trailing_totals(readings, F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")).first()
    assert (row["rain_1h_mm"], row["rain_3h_mm"]) == (2.0, 7.0)
    silent = spark.createDataFrame([(1,), (2,)], "loc_id int")
    filled = rain.trailing_totals(readings, F.lit("2024-01-01 09:00:00").cast("timestamp_ntz"), locations=silent)
    assert {r["loc_id"]: r["rain_72h_mm"] for r in filled.collect()} == {1: 7.0, 2: 0.0}


def test_addresses(spark):
    rows = [
        '{"address":{"village":"A","county":"B","state":"C"},"display_name":"A, B"}',
        '{"address":{"town":"T"}}',
        '{"address":{"village":"","road":"R"},"name":"N"}',
        '{"display_name":"Only shown"}',
        "{}",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    got = df.select("i", *[c.alias(n) for n, c in place_fields("j", "Somewhere").items()]).orderBy("i").collect()
    assert [r["place"] for r in got] == ["A", "T", "R", "Only shown", "Somewhere"]
    assert [r["district"] for r in got] == ["B", None, None, None, None]
    assert got[4]["display_name"] == "Somewhere"
    pick = spark.sql("SELECT map('a', '', 'b', 'x') AS m").select(first_present("m", ["a", "b"])).first()[0]
    assert pick == "x"


def test_p_values_and_significance(spark):
    assert describe.correlation_p_value(0.5, 20) == pytest.approx(0.0247696, abs=1e-6)
    assert describe.correlation_p_value(-0.9, 10) == pytest.approx(0.00038716, abs=1e-7)
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.2,)], "p double")
    assert [r[0] for r in df.select(significance("p")).collect()] == ["***", "**", "*", "ns"]


def test_models_learn_and_reload(spark, tmp_path):
    rng = np.random.default_rng(10)
    n = 400
    table = pd.DataFrame({c: rng.uniform(0, 1, n) for c in ("slope", "elevation", "ndvi", "rainfall", "river_m", "road_m", "twi")})
    table["aspect"] = rng.uniform(0, 360, n)
    table["lulc"] = rng.choice([10, 30, 40], n)
    table["sample_id"] = range(n)
    table["landslide"] = (table["slope"] + table["rainfall"] + rng.normal(0, 0.1, n) > 1).astype("int32")
    df = models.engineer(spark.createDataFrame(table))
    for scorer in (models.fit_logistic(df), models.fit_svm(df), models.fit_forest(df, trees=10, depth=5)):
        scored = scorer.transform(df)
        assert models.roc_auc(scored, "landslide", "score").first()["roc_auc"] > 0.93
        metrics = models.confusion_matrix(scored, "landslide", "predicted")
        models.save_model(scorer, str(tmp_path / scorer.name), metrics, {"seed": "42"})
        again = models.load_model(spark, str(tmp_path / scorer.name)).transform(df)
        both = scored.select("sample_id", "score").join(again.select("sample_id", F.col("score").alias("s2")), "sample_id")
        assert both.agg(F.max(F.abs(F.col("score") - F.col("s2")))).first()[0] < 1e-12
    unknown = df.limit(5).withColumn("lulc", F.lit("999.0"))
    assert models.fit_logistic(df).transform(unknown).where("score is null").count() == 0


def test_unknown_category_is_all_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    known = spark.createDataFrame([("10.0",), ("30.0",)], "lulc string")
    fitted = Pipeline(stages=models.one_hot()).fit(known)
    row = fitted.transform(spark.createDataFrame([("77.0",)], "lulc string")).select(vector_to_array("lulc_hot").alias("v")).first()
    assert row["v"] == [0.0, 0.0]


def _clipped(x1, y1, x2, y2, row, col):
    """Whether a segment meets the inside of a pixel of the unit grid, by clipping on its four sides."""
    low, high = 0.0, 1.0
    for start, step, a, b in ((x1, x2 - x1, col, col + 1), (-y1, y1 - y2, row, row + 1)):
        if step == 0:
            if not a <= start < b:
                return False
            continue
        one, two = sorted(((a - start) / step, (b - start) / step))
        low, high = max(low, one), min(high, two)
    return low <= high


def test_line_cells_equal_clipping_and_burn_short_corners(spark):
    rng = np.random.default_rng(11)
    lines = [tuple(float(v) for v in row) for row in np.column_stack([rng.uniform(0, 12, 60), rng.uniform(-12, 0, 60), rng.uniform(0, 12, 60), rng.uniform(-12, 0, 60)])]
    lines += [(0.9, -0.02, 1.05, -0.13), (3.5, -1.5, 3.5, -1.5), (2.25, -9.75, 2.25, -0.25), (0.25, -4.5, 11.75, -4.5)]
    for n, line in enumerate(lines):
        frame = spark.createDataFrame([line], "x1 double, y1 double, x2 double, y2 double") if n < 3 or n >= 60 else None
        if frame is None:
            continue
        got = {tuple(r) for r in polygon.line_cells(frame, UNIT).collect()}
        assert got == {(r, c) for r in range(12) for c in range(12) if _clipped(*line, r, c)}, line
    together = spark.createDataFrame([*lines, (None, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in polygon.line_cells(together, UNIT).collect()}
    assert got == {(r, c) for r in range(12) for c in range(12) if any(_clipped(*line, r, c) for line in lines)}


def test_a_line_through_a_corner_burns_the_corners_owner(spark):
    for line in ((0.5, -0.5, 2.5, -2.5), (2.5, -2.5, 0.5, -0.5)):
        frame = spark.createDataFrame([line], "x1 double, y1 double, x2 double, y2 double")
        assert {tuple(r) for r in polygon.line_cells(frame, UNIT).collect()} == {(0, 0), (1, 1), (2, 2)}
    frame = spark.createDataFrame([(2.5, -0.5, 0.5, -2.5)], "x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in polygon.line_cells(frame, UNIT).collect()} == {(0, 2), (1, 2), (1, 1), (2, 1), (2, 0)}


def test_saved_answers_with_odd_rows(spark):
    schema = "id int, latitude double, longitude double, note string"
    places = lookups.keyed(spark.createDataFrame([(1, 28.00004, 85.0, "a"), (2, 28.00001, 85.00002, "a"), (3, None, 85.0, "b"), (4, 27.5, 85.0, None)], schema))
    saved = lookups.keyed(spark.createDataFrame([(1, 28.0, 85.0, "old"), (2, 28.00002, 85.0, "new"), (2, 28.0, 85.0, "later"), (3, None, 85.0, "lost")], schema))
    answers = lookups.last_answers(saved, "id", F.col("note"))
    assert [tuple(r) for r in answers.collect()] == [(28.0, 85.0, "new")]
    found = lookups.with_answers(places, answers, {"place": F.col("answer")})
    assert {r.id: (r.note, r.place, r.answered) for r in found.collect()} == {1: ("a", "new", True), 2: ("a", "new", True), 3: ("b", None, False), 4: (None, None, False)}
    assert [tuple(r) for r in lookups.keys_to_ask(places, answers).collect()] == [(27.5, 85.0, 1)]
    none = answers.limit(0)
    assert lookups.with_answers(places, none, {"place": F.col("answer")}).where("answered").count() == 0
    assert lookups.keys_to_ask(places.limit(0), answers).count() == 0


def test_nearest_site_of_a_short_list_breaks_ties_and_orders_nan_last():
    sites = [{"x": float("nan"), "y": 0.0}, {"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}]
    place = surface.nearest_site(sites).func
    found = place(pd.Series([1.0, 1.9, 0.0]), pd.Series([0.0, 0.0, 0.0]), pd.Series([True, True, False]))
    assert found[:2].tolist() == [1, 2] and pd.isna(found[2])
