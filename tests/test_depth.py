import pytest
from pyspark.sql import functions as F

from utilnet.operators import depth, passages


def plan(spark, length, found, dn=50):
    nodes = spark.createDataFrame([(0, "a", "tie"), (0, "b", "oks")], "dataset_id long, node_id string, node_type string")
    edges = spark.createDataFrame([(0, "e", "a", "b", length, dn)],
                                  "dataset_id long, edge_id string, start_id string, end_id string, length double, dn int")
    p = spark.createDataFrame([(0, "e", *r) for r in found],
                              "dataset_id long, edge_id string, object_id string, rule string, s_from double, s_to double, "
                              "core_from double, core_to double, factor double, length double")
    bands, links, placed = depth.stations(nodes, edges, p)
    solved = depth.solve_depths(bands, links)
    sec = depth.depth_sections(placed, solved, passages.sections(edges, p))
    return edges, p, sec


def crossing(object_id, rule, at, ext, factor, length):
    return (object_id, rule, at - ext, at + ext, at, at, factor, length)


def test_gas_pipe_is_crossed_above_when_that_is_nearer(spark):
    """DN50 under gas at 2.8 m: 2.8 - 0.2 - 0.125 = 2.475 is the least disturbance from 3 m."""
    edges, p, sec = plan(spark, 100.0, [crossing("g", "gas_pipeline", 50.0, 2.0, 1.25, 100.0)])
    row = depth.crossing_report(sec, p, edges).first()
    assert row["position"] == "above" and row["depth"] == pytest.approx(2.475) and row["code"] is None
    rep = depth.profile_report(sec, edges).first()
    assert rep["min_depth"] == pytest.approx(2.475) and rep["max_slope"] <= 0.1 + 1e-8
    total = sec.agg(F.sum(F.col("s_to") - F.col("s_from"))).first()[0]
    assert total == pytest.approx(100.0)


def test_surface_crossing_needs_no_change(spark):
    edges, p, sec = plan(spark, 100.0, [("r", "road", 37.0, 63.0, 40.0, 60.0, 1.6, 100.0)])
    row = depth.crossing_report(sec, p, edges).first()
    assert row["position"] == "under_surface" and row["depth"] == pytest.approx(3.0)
    assert {r["factor"] for r in sec.collect()} == {1.0, 1.6}


def test_plateau_cut_by_the_pipe_end_is_reported(spark):
    edges, p, _ = plan(spark, 100.0, [("r", "road", 0.0, 24.0, 1.0, 21.0, 1.6, 100.0)])
    assert [r["code"] for r in depth.short_plateaus(p, edges).collect()] == ["PLATEAU_TOO_SHORT"]
