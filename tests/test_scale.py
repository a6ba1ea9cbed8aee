"""Plans of steps that must not grow faster than their input."""

import numpy as np
import pandas as pd
import pytest

from slopecast.operators import nearest, pixels, polygon
from slopecast.settings import Grid


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _points(spark, xy, key):
    return spark.createDataFrame(pd.DataFrame({key: np.arange(len(xy)), "longitude": xy[:, 0], "latitude": xy[:, 1]}))


def _brute(asked, sites):
    d = np.sqrt((asked[:, None, 0] - sites[None, :, 0]) ** 2 + (asked[:, None, 1] - sites[None, :, 1]) ** 2)
    return d.argmin(1), d.min(1)


def test_a_query_is_not_shuffled_at_every_level(spark):
    r = np.random.default_rng(3)
    sites = r.random((3000, 2))
    found = nearest.nearest_neighbour(_points(spark, r.random((500, 2)), "q"), _points(spark, sites, "s"), "q", "s")
    assert "Window" not in plan(found)


@pytest.mark.parametrize("short,long", [(48, 1024), (1, 2)])  # with short lists, every query of a busy cell walks alone
def test_nearest_of_clusters_and_far_points(spark, monkeypatch, short, long):
    monkeypatch.setattr(nearest, "SHORT_LIST", short)
    monkeypatch.setattr(nearest, "LONG_LIST", long)
    r = np.random.default_rng(5)
    sites = np.round(np.vstack([r.random((150, 2)), 0.5 + r.random((150, 2)) / 5000, [[0.5, 0.5]] * 40]), 9)
    asked = np.vstack([r.random((100, 2)), 0.5 + r.random((100, 2)) / 4000, [[0.5, 0.5], [-40.0, 3.0], [1e7, -1e7], [0.2, 900.0]]])
    found = nearest.nearest_neighbour(_points(spark, asked, "q"), _points(spark, sites, "s"), "q", "s").toPandas().sort_values("q")
    site, distance = _brute(asked, sites)
    assert found["q"].tolist() == list(range(len(asked)))
    assert np.array_equal(found["distance"], distance)
    assert found["s"].tolist() == site.tolist()
    near = nearest.nearest_neighbour(_points(spark, asked, "q"), _points(spark, sites, "s"), "q", "s", within=0.01).toPandas()
    assert sorted(near["q"]) == np.flatnonzero(distance <= 0.01).tolist()


def test_a_point_meets_a_grid_once_for_all_its_layers(spark):
    fine, coarse = Grid(0.0, 1.0, 0.0, -1.0), Grid(0.0, 2.0, 0.0, -2.0)
    wide = spark.createDataFrame([(0, 0, 1.0, 2.0, None), (1, 1, 3.0, None, 5.0)], "row_id int, col_id int, a double, b double, c double")
    rain = spark.createDataFrame([("r", 0, 0, 7.0)], "layer string, row_id int, col_id int, value double")
    points = spark.createDataFrame([(1, 0.5, -0.5), (2, 1.5, -1.5), (3, 9.5, -9.5), (4, None, None), (5, 0.4, -0.4)], "id int, longitude double, latitude double")
    grids = {"a": fine, "b": fine, "c": fine, "r": coarse}
    sampled = pixels.sample_layers(points, pixels.melt_layers(wide, ["a", "b", "c"]).unionByName(rain), grids, "id")
    assert [tuple(x)[3:] for x in sampled.orderBy("id").collect()] == [(1.0, 2.0, None, 7.0), (3.0, None, 5.0, 7.0), (None,) * 4, (None,) * 4, (1.0, 2.0, None, 7.0)]
    text = sampled._jdf.queryExecution().analyzed().toString()
    assert text.count("struct(_grid") == 2 * text.count("explode(") == 4


def test_lattice_points_are_dealt_out_and_never_broadcast(spark):
    rings = [(f, 0, n, f + x, y) for f in range(20) for n, (x, y) in enumerate([(0.0, 0.0), (0.9, 0.0), (0.9, 0.9), (0.0, 0.9)])]
    made = polygon.sample_lattice(spark.createDataFrame(rings, "feature_id int, part_id int, seq int, x double, y double"), 4, 0.01)
    text = plan(made)
    assert "REPARTITION_BY_NUM" in text
    assert any("SortMergeJoin" in line and "_band" in line for line in text.splitlines())
    assert made.groupBy("feature_id").count().where("count != 5").isEmpty() and made.count() == 100  # 2 x 2 inside and the centroid
