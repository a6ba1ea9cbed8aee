"""Physical plans: no cross products, no unbounded broadcast, pruned scans."""

import pytest

import __spark_entry__ as entry_points
from slopecast.operators import rain
from slopecast.plans.fixtures import Tables
from slopecast.plans.rain_queries import now

QUERIES = entry_points.queries()
EAGER = {"m4_random_forest", "m5_svm_rbf_calibrated", "m7_evaluate_model", "m7_evaluate_forest", "m7_evaluate_svm", "m8_feature_importance", "l2_rank_importance", "m10_score_pixels", "k6_save_model", "t1_stream_trailing_totals", "t2_stream_risk_refresh", "t2_stream_clock", "t3_late_reading_policy", "s8_scan_readings_stream"}
HEADLINE = ["a3_audit_report", "l5_sample_background", "j3_nearest_neighbour", "j6_point_in_polygon", "f13_clip_to_polygon", "a7_risk_summary", "r11_window_risk_layers", "r4_resample_cubic_spline", "r6_proximity", "a6_class_summary", "w1_rolling_totals"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cross_products(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_recent_totals_prune_rows_and_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    df = rain.trailing_totals(t.view("fx_area_readings"), now(), "station_id", t.view("fx_gauges"))
    text = plan(df)
    assert "GreaterThan(ts" in text and "LessThanOrEqual(ts" in text
    assert "props" not in text


def test_pixels_are_not_shuffled_for_the_risk_map(spark, sf_dir):
    text = plan(QUERIES["r13_dynamic_risk_map"](spark, sf_dir))
    pixel_side = text.split("orders.parquet")[0]
    assert "BroadcastHashJoin" in text
    assert "hashpartitioning(row_id" not in pixel_side and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["a7_risk_summary", "r13_dynamic_risk_map"])
def test_a_pixel_is_located_once(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("filter(_runs") == 1
