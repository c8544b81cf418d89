import math

import pytest
from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.functions.register import register_functions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("flow,dn", [(80.0, 200), (22.3, 100), (22.3001, 125), (0.0, 50), (22501.9, 1400)])
def test_diameter(spark, flow, dn):
    assert value(spark, rules.diameter(F.lit(flow))) == dn


def test_rule_values(spark):
    assert value(spark, rules.diameter(F.lit(30000.0))) is None
    assert value(spark, rules.pipe_width(F.lit(200))) == pytest.approx(0.88)
    assert value(spark, rules.depth_factor(F.lit(5.0))) == pytest.approx(1.2)
    assert value(spark, rules.score(F.lit(50e6), F.lit(200.0))) == pytest.approx(2.0)
    assert value(spark, rules.score4(F.lit(1.00005))) == 1.0001
    assert value(spark, rules.relative_rating(F.lit(2.0), F.lit(1.0))) == 50
    assert value(spark, rules.relative_rating(F.lit(1.0), F.lit(2.0))) is None


def test_projection_golden_point_and_round_trip(spark):
    x, y = geo.to_utm(F.lit(37.6), F.lit(55.75))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(412125.4591875144, abs=1e-4)
    assert row["y"] == pytest.approx(6179143.32361831, abs=1e-4)
    lon, lat = geo.from_utm(F.lit(row["x"]), F.lit(row["y"]))
    back = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert (back["lon"], back["lat"]) == pytest.approx((37.6, 55.75), abs=1e-10)


@pytest.mark.parametrize("degrees,metres", [(0, 0), (90, 25), (45, 50), (135, 75), (2, 35), (92, 35), (47, 60),
                                            (133, 85), (20, 100)])
def test_turn_penalty(spark, degrees, metres):
    assert value(spark, geo.turn_penalty(F.lit(math.radians(degrees)))) == metres


def test_path_functions(spark):
    path = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
                     for x, y in ((0, 0), (10, 0), (10, 10))])
    row = spark.range(1).select(
        geo.path_length(path).alias("len"), geo.point_at(path, F.lit(15.0)).alias("p"),
        geo.project(path, F.lit(12.0), F.lit(4.0)).alias("at"), geo.is_straight(path).alias("s"),
        geo.sub_line(path, F.lit(5.0), F.lit(12.0)).alias("part"), geo.path_wkt(path).alias("wkt")).first()
    assert row["len"] == 20 and tuple(row["p"]) == (10, 5) and row["at"] == 14 and row["s"] is False
    assert [tuple(p) for p in row["part"]] == [(5, 0), (10, 0), (10, 2)]
    assert value(spark, geo.path_length(geo.parse_wkt(F.lit(row["wkt"])))) == 20
    assert value(spark, geo.parse_wkt(F.lit("POINT (1 2)"))) is None


def test_sql_functions(spark):
    assert "tn_diameter" in register_functions(spark)
    row = spark.sql("SELECT tn_diameter(80D) AS dn, tn_score(50e6D, 200D) AS s, tn_chamber_price(600) AS c").first()
    assert (row["dn"], row["s"], row["c"]) == (200, 2.0, 8e6)
