"""What keeps the work of a query in proportion to its input."""

import random
import re

from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.operators import graph, ordering, spatial, variants
from utilnet.plans import bridge, feature_queries
from utilnet.session import BROADCAST_ROWS, cut

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def last_join(df):
    return re.search(r"\w+Join\b", plan(df)).group()


def test_features_are_parsed_once(spark):
    """a filter on the result does not carry the parsing with it."""
    found = feature_queries.parsed(spark, D).filter("reject IS NOT NULL")
    assert "parse_json" not in plan(found) and found.count() > 0


def test_features_are_parsed_by_all_tasks(spark):
    """a table of one file is dealt over the tasks before it is parsed."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        assert len(feature_queries.parsed(spark, D).inputFiles()) > 2
    finally:
        spark.conf.unset(name)


def test_distance_is_computed_once(spark):
    """the distance of a pair stands in the plan once, not in the join's condition and again in the result."""
    a = geo.with_box(spark.createDataFrame([(0, 1, 0.0, 0.0, 3.0, 4.0)], "dataset_id int, edge_id int, x0 double, y0 double, x1 double, y1 double"))
    b = a.withColumnRenamed("edge_id", "object_id")
    near = spatial.within(a, b, 1.0, "edge_id", "object_id")
    root = plan(near).count("SQRT(")
    assert root == 2 * plan(geo.once(a, "d", geo.segment_distance(*[F.col(c) for c in ("x0", "y0", "x1", "y1")] * 2))).count("SQRT(")
    assert [tuple(r) for r in near.collect()] == [(0, 1, 1, 0.0)]


def test_large_tables_are_not_broadcast(spark):
    """a written or given table of many rows is small as a file, yet not collected on the driver."""
    many = cut(spark.range(BROADCAST_ROWS + 1).select(F.lit(1).alias("k"), F.lit(2).alias("v")))
    few = cut(spark.range(10).select(F.lit(1).alias("k")))
    assert "BroadcastHashJoin" not in plan(many.join(many.withColumnRenamed("v", "w"), "k"))
    assert "BroadcastHashJoin" in plan(few.join(few.withColumn("w", F.lit(3)), "k"))
    assert "BroadcastHashJoin" not in plan(bridge.edges(spark, D))


def test_edges_meet_as_wholes(spark, monkeypatch):
    """edges, not their slices, go through the spatial join; straight and bent edges give the share of a plain count."""
    e = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 100.0, 0.0), (0, 0, 2, 0.0, 50.0, 0.0, 90.0), (0, 1, 1, 0.0, 4.0, 47.0, 9.0)],
                              "dataset_id int, network_id int, edge_id int, x0 double, y0 double, x1 double, y1 double")
    e = e.withColumn("length", geo.distance(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    pairs = spark.createDataFrame([(0, 0, 1)], "dataset_id int, a int, b int")
    seen, join = [], spatial.bbox_join

    def watched(a, b, *args, **kwargs):
        seen.append(a.count())
        return join(a, b, *args, **kwargs)

    monkeypatch.setattr(spatial, "bbox_join", watched)
    segments = geo.with_box(e)
    straight = variants.outside_share(e, segments, pairs).first()["outside"]
    bent = variants.outside_share(bridge.with_path(e).drop("x0", "y0", "x1", "y1"), segments, pairs).first()["outside"]
    assert seen == [2, 2]

    def off(x, y):
        t = max(0.0, min(1.0, (x * 47 + (y - 4) * 5) / (47 ** 2 + 5 ** 2)))
        return ((x - t * 47) ** 2 + (y - 4 - t * 5) ** 2) ** 0.5

    far = sum(100 / 9 for i in range(9) if off((i + 0.5) / 9 * 100, 0) > 6) + sum(10 for i in range(4) if off(0, 50 + (i + 0.5) * 10) > 6)
    assert abs(straight - far / 140) < 1e-9 and abs(bent - far / 140) < 1e-9 and 0 < far < 140


def test_best_score_is_one_of_the_scores(spark):
    """scores that come out a little different when they are computed again leave no network without a rating."""
    drift = F.udf(lambda: 1 + random.random(), "double").asNondeterministic()
    networks = spark.range(40).select((F.col("id") % 4).alias("district"), F.col("id").alias("dataset_id")).withColumn("score", drift())
    rows = ordering.rank_variants(networks, ["district"], ["score", "dataset_id"]).collect()
    assert all(r["rating"] is not None for r in rows)
    assert sorted(r["rank"] for r in rows if r["rating"] == 100) == [1, 1, 1, 1]


def test_loops_broadcast_no_joined_rows(spark):
    """what loops and chains join stays with the executors, at any size between the bounds."""
    assert BROADCAST_ROWS <= 10_000
    n = bridge.nodes(spark, D)
    chains = graph.flow_chains(graph.flows(n, bridge.edges(spark, D)))
    up = chains.select("dataset_id", F.col("edge_id").alias("up_edge"), F.lit(1).alias("seen"))
    few = cut(chains.select("dataset_id", "edge_id", "up_edge"))
    assert last_join(few.join(up, ["dataset_id", "up_edge"], "left")) == "SortMergeJoin"
    flowed = graph.flows(n, bridge.edges(spark, D)).select("dataset_id", F.col("edge_id").alias("up_edge"), "flow")
    assert last_join(few.join(flowed, ["dataset_id", "up_edge"], "left")) == "SortMergeJoin"


def test_points_stay_on_their_level(spark):
    """boxes whose largest size is known are laid on no level that the other side lacks; the pairs stay the same."""
    rng = random.Random(3)
    rows = [(0, i, float(rng.randrange(400)), float(rng.randrange(400))) for i in range(300)]
    pts = spatial.as_points(spark.createDataFrame(rows, "dataset_id int, id int, x double, y double"))
    boxes = geo.with_box(spark.createDataFrame(
        [(0, i, x, y, x + 3.0 ** (i % 7), y + 1.0) for _, i, x, y in rows], "dataset_id int, id int, x0 double, y0 double, x1 double, y1 double"))
    for b, r, cell, sizes, joins in ((pts, 5.0, 11.0, (0.0, 0.0), 1), (pts, 5.5, 11.0, (0.0, 0.0), 2), (boxes, 5.0, 16.0, (0.0, None), 1), (boxes, 5.0, 16.0, (None, None), 2)):
        out = spatial.bbox_join(pts, b, r, cell, sizes=sizes)
        assert plan(out).count("SortMergeJoin") == joins and "Broadcast" not in plan(out)
        got = sorted((x["a_id"], x["b_id"]) for x in out.collect())
        wide = {i: 3.0 ** (i % 7) if b is boxes else 0.0 for _, i, _, _ in rows}
        tall = 1.0 if b is boxes else 0.0
        assert got == sorted((i, j) for _, i, x, y in rows for _, j, u, v in rows
                             if x - r <= u + wide[j] and x + r >= u and y - r <= v + tall and y + r >= v)


def test_nearest_at_every_distance(spark):
    """rows that need several rounds find what a plain search finds."""
    rng = random.Random(4)
    a = [(0, i, float(rng.randrange(5000)), float(rng.randrange(5000))) for i in range(60)]
    b = [(0, i, float(rng.randrange(5000)), float(rng.randrange(5000))) for i in range(40)]
    sides = [spatial.as_points(spark.createDataFrame(rows, f"dataset_id int, {n} int, x double, y double")) for rows, n in ((a, "p"), (b, "q"))]
    got = sorted((x["a_p"], x["rank"], x["b_q"]) for x in spatial.nearest(*sides, 3, "p", "q").collect())
    want = [sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for _, j, u, v in b)[:3] for _, _, x, y in a]
    assert got == sorted((i, n + 1, j) for i, found in enumerate(want) for n, (_, j) in enumerate(found))


def test_contacts_are_compiled(spark):
    """The arithmetic of contacts is in no lambda, which Spark would interpret for every pair."""
    a = geo.with_box(spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 10.0, 0.0, 0.0, 10.0), (0, 2, 0, 4.0, -5.0, 4.0, 5.0, 0.0, 10.0), (0, 3, 0, 20.0, 0.0, 30.0, 0.0, 0.0, 10.0)],
                                            "dataset_id int, edge_id int, seq int, x0 double, y0 double, x1 double, y1 double, at0 double, at1 double"))
    hits = spatial.line_hits(a, a.withColumnRenamed("edge_id", "object_id")).filter("edge_id < object_id")
    assert "lambdafunction" not in plan(hits)
    assert [(r["edge_id"], r["object_id"], r["at"], r["x"], r["y"]) for r in hits.collect()] == [(1, 2, 4.0, 4.0, 0.0)]
    ends = [("n1", 0.0, 0.0), ("n2", 10.0, 0.0), ("n3", 4.0, -5.0), ("n4", 4.0, 5.0), ("n5", 20.0, 0.0), ("n6", 30.0, 0.0)]
    nodes = spark.createDataFrame([(0, n, x, y, "chamber") for n, x, y in ends], "dataset_id int, node_id string, x double, y double, node_type string")
    edges = spark.createDataFrame([(0, i + 1, i + 1, f"n{2 * i + 1}", f"n{2 * i + 2}") for i in range(3)], "dataset_id int, edge_id int, edge_ord int, start_id string, end_id string")
    found = spatial.crossing_violations(edges, a, nodes)
    assert "lambdafunction" not in plan(found)
    assert [(r["edge_id"], r["other_id"], r["code"]) for r in found.collect()] == [(1, 2, "CROSSING")]
