import random

import pytest
from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.operators import evaluate, passages, spatial


def segments(spark, rows):
    df = spark.createDataFrame(rows, "dataset_id long, edge_id long, x0 double, y0 double, x1 double, y1 double")
    path = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")),
                   F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return geo.explode_segments(df.select("dataset_id", "edge_id", path.alias("path")))


def test_bbox_join_finds_every_pair_once_at_all_sizes(spark):
    rnd = random.Random(5)
    def boxes(n, big):
        out = []
        for i in range(n):
            x, y, s = rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice([0, 1, 20, 150, big])
            out.append((0, i, x, y, x + s, y + s * rnd.random()))
        return out
    a, b = boxes(60, 3000), boxes(60, 90000)
    cols = "dataset_id long, id long, minx double, miny double, maxx double, maxy double"
    got = spatial.bbox_join(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 7.0, 16.0).collect()
    pairs = [(r["a_id"], r["b_id"]) for r in got]
    want = {(p[1], q[1]) for p in a for q in b if p[2] - 7 <= q[4] and p[4] + 7 >= q[2] and p[3] - 7 <= q[5] and p[5] + 7 >= q[3]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_road_passage_and_its_price(spark):
    """A road at 40 to 60 m of a 100 m pipe: passage 37 to 63, 74 m plain and 26 m at 1.6."""
    segs = segments(spark, [(0, 1, 0.0, 0.0, 100.0, 0.0)])
    ring = [(40, -5, 60, -5), (60, -5, 60, 5), (60, 5, 40, 5), (40, 5, 40, -5)]
    road = geo.with_box(spark.createDataFrame(
        [(0, 9, "road", i, *map(float, s)) for i, s in enumerate(ring)],
        "dataset_id long, object_id long, rule string, seq int, x0 double, y0 double, x1 double, y1 double"))
    edges = spark.createDataFrame([(0, 1, 100.0, 100)], "dataset_id long, edge_id long, length double, dn int")
    found = passages.passages(edges, segs, road, None)
    row = found.first()
    assert (row["s_from"], row["s_to"]) == pytest.approx((37, 63))
    cost = evaluate.pipe_cost(passages.sections(edges, found), edges).first()["pipe_cost"]
    assert cost == pytest.approx(74 * 89748 + 26 * 89748 * 1.6)


def test_nearest_reaches_far_objects(spark):
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 900.0, 0.0)], "dataset_id long, point_id long, x double, y double")
    obj = spark.createDataFrame([(0, 7, 1000.0, 0.0), (0, 8, 5.0, 0.0)], "dataset_id long, object_id long, x double, y double")
    got = spatial.nearest(spatial.as_points(pts), spatial.as_points(obj), 2, "point_id", "object_id").collect()
    assert {(r["a_point_id"], r["rank"]): (r["b_object_id"], r["distance"]) for r in got} == {
        (1, 1): (8, 5.0), (1, 2): (7, 1000.0), (2, 1): (7, 100.0), (2, 2): (8, 895.0)}
