"""Audits, entries, routes and candidates on cases made by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import audit, candidates, entries, evaluate, existing, routes, ties
from utilnet.sources import networks

PATH = "array<struct<x:double,y:double>>"


def ring(spark, boxes, extra=""):
    """Sides of boxes (dataset_id, object_id, minx, miny, maxx, maxy)."""
    rows = []
    for ds, name, a, b, c, d in boxes:
        spots = [(a, b), (c, b), (c, d), (a, d), (a, b)]
        rows += [(ds, name, 0, k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(spots, spots[1:]))]
    return geo.with_box(spark.createDataFrame(rows, "dataset_id long, object_id string, ring int, seq int, x0 double, y0 double, x1 double, y1 double"))


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_exports_are_read_without_trust(spark):
    def line(props, geometry=None):
        return json.dumps({"type": "Feature", "geometry": geometry, "properties": props})

    rows = [line({"id": 5, "object_type": "heat_network", "variant_id": "v1", "start_node_id": "#a", "end_node_id": 7, "diameter": 50, "cost": "dear"},
                 {"type": "LineString", "coordinates": [[1, 2], [3, 4, -3]]}),
            line({"id": "5", "object_type": "variant_summary", "unconnected_oks_ids": [1, "1", None], "score": 2.5}), "no json", "[]", ""]
    got = networks.read_export(spark.createDataFrame([(1, r) for r in rows], "dataset_id long, value string")).collect()
    assert [r.id for r in got] == ["#5", "5", None, None, None]
    pipe, summary = got[0], got[1]
    assert (pipe.start_id, pipe.end_id, pipe.dn, pipe.cost) == ("##a", "#7", 50, None)
    assert [tuple(v) for v in pipe.path] == [(1, 2), (3, 4)]
    assert summary.summary.score == 2.5 and summary.summary.unconnected == ["#1", "1", None] and summary.summary.connected is None


def test_graph_of_ids(spark):
    rows = [("a", "r", "n1", 10.0, 100, "heat_chamber"), ("b", "n1", "n2", 6.0, 100, None), ("c", "n1", "n3", 4.0, 80, None),
            ("d", "n2", "n3", 6.0, 125, None), ("e", "z1", "z2", 1.0, 50, None), ("f", "z2", "z1", 1.0, 50, None), ("g", "dry", "n4", 1.0, 50, "technical_node")]
    links = spark.createDataFrame([(1, "v", *r[:3], 90.0, *r[3:5], r[5]) for r in rows],
                                  "dataset_id long, variant_id string, id string, start_id string, end_id string, length double, flow double, dn int, kind string")
    links = links.withColumn("start", F.struct(F.lit("new").alias("origin"), "kind"))
    found = pairs(audit.graph_findings(links), "code", "object_id")
    assert found == {("SEVERAL_PARENTS", "n3"), ("CYCLE", "z1"), ("CYCLE", "z2"), ("ROOT_WITHOUT_CHAMBER", "dry"), ("DIAMETER_GROWS", "d")}
    longer = pairs(audit.graph_findings(links.withColumn("length", F.lit(230.0))), "code", "object_id")
    assert {o for c, o in longer if c == "RUN_TOO_LONG"} == {"b", "g"}  # 460 m of DN100, 230 m of DN50; nothing on the cycle


@pytest.mark.parametrize("kind,codes", [(0, {"DIAMETER_GROWS", "BELOW_PRICE"}), (1, {"UNKNOWN_TYPE"}), (2, {"DUPLICATE_ID"}), (3, {"ID_OF_THE_MAP"})])
def test_seeded_exports(spark, data, kind, codes):
    from utilnet.plans import load_all
    from utilnet.plans.registry import QUERIES
    load_all()
    if not hasattr(test_seeded_exports, "found"):
        test_seeded_exports.found = QUERIES["export_audit"](spark, data).collect()
    natural = {"RUN_TOO_LONG", "UNKNOWN_END"}
    assert {r.code for r in test_seeded_exports.found if r.dataset_id == kind} - natural == codes


def test_a_price_that_is_missing_is_no_zero(spark):
    objects = spark.createDataFrame(
        [(1, 0, "source", None, 50, 1.0, 1.0, True), (1, 1, "heat_network", 0, 50, 1.0, 10.0, True), (1, 2, "heat_network", 1, 50, None, 10.0, True),
         (2, 0, "source", None, 50, 1.0, 1.0, True), (2, 1, "heat_network", 0, 50, 1.0, 10.0, True)],
        "dataset_id long, object_id long, object_type string, upstream_id long, dn int, flow double, length double, start_near boolean")
    tied = spark.createDataFrame([(1, 9, 2, 5.0, 4.0), (2, 9, 1, 5.0, 40000.0)], "dataset_id long, root_id long, existing_id long, at double, flow double")
    pieces = existing.reconstruction(objects, tied)
    assert pairs(pieces, "dataset_id", "object_id", "required_dn", "code") == {(1, 1, 65, None), (1, 2, None, "UNKNOWN_FLOW"), (2, 1, None, "CAPACITY_EXCEEDED")}
    totals = {r.dataset_id: r for r in existing.reconstruction_totals(pieces).collect()}
    assert totals[1].recon_cost is None and totals[2].recon_cost is None and totals[1].recon_length == 15
    chambers = spark.createDataFrame([(1, 7, 50), (1, 8, 50)], "dataset_id long, object_id long, dn int")
    branch = spark.createDataFrame([(1, 7, 100), (1, 7, None), (1, 8, 100)], "dataset_id long, object_id long, dn int")
    none = spark.createDataFrame([], "dataset_id long, object_id long, dn int")
    grown = existing.chamber_reconstruction(chambers, branch, none)
    assert pairs(grown, "object_id", "required_dn", "cost") == {(7, None, None), (8, 100, 3e6)}
    assert existing.reconstruction_totals(pieces.filter("code IS NULL"), grown).first().chamber_recon_cost is None

    nodes = spark.createDataFrame([(n, k, t, None, None) for n in (1, 2, 3) for k, t in ((0, "tie"), (1, "oks"))],
                                  "dataset_id long, node_id long, node_type string, existing_type string, entry_id long")
    edges = spark.createDataFrame([(n, 1, 0, 1, 10.0, 50) for n in (1, 2, 3)], "dataset_id long, edge_id long, start_id long, end_id long, length double, dn int")
    plain = edges.select("dataset_id", "edge_id", F.lit(0.0).alias("s_from"), F.col("length").alias("s_to"), F.lit(1.0).alias("factor"))
    wanted = spark.createDataFrame([], "dataset_id long, demand_id long, flow double")
    recon = spark.createDataFrame([(1, None, 5.0, 0.0), (2, 7.0, 5.0, 0.0)], "dataset_id long, recon_cost double, recon_length double, chamber_recon_cost double")
    for profile in ("contest", "appendix", "protocol"):
        out = {r.dataset_id: r for r in evaluate.network_summary(nodes, edges, plain, wanted, recon=recon, profile=profile).collect()}
        assert out[1].engineering_cost is None and (out[1].score_raw is None) == (profile != "contest")
        assert out[2].engineering_cost - out[3].engineering_cost == 7 and out[3].recon_cost == 0


def entry_case(spark):
    """A 10 m square with its consumer 3 m above the lower wall, and pipes that come in four ways."""
    rows = [(1, "up", [(5, -20), (5, 3)]), (1, "side", [(-20, 3), (5, 3)]), (1, "bent", [(5, -20), (7, 2), (5, 3)]), (1, "round", [(30, -9), (8, -9), (5, 3)]),
            (1, "past", [(-20, 8), (30, 8)]), (1, "away", [(-20, 30), (30, 30)])]
    edges = spark.createDataFrame([(d, e, [tuple(map(float, v)) for v in p], 50) for d, e, p in rows], f"dataset_id long, edge_id string, path {PATH}, dn int")
    return edges.withColumn("length", geo.path_length(F.col("path"))), ring(spark, [(1, "B", 0, 0, 10, 10)])


def test_entries(spark):
    edges, rings = entry_case(spark)
    owners = edges.filter("edge_id NOT IN ('past', 'away')").select("dataset_id", "edge_id", F.lit("B").alias("building_id"))
    doors = entries.entry_portals(edges, owners, rings)
    got = {r.edge_id: r for r in doors.collect()}
    assert got["up"].indoor == pytest.approx(3) and (got["up"].portal_x, got["up"].portal_y) == (5, pytest.approx(0))
    assert got["side"].indoor is None and got["bent"].indoor is None and got["round"].indoor == pytest.approx(3 * math.hypot(12, 3) / 12)
    segments = geo.explode_segments(edges.select("dataset_id", "edge_id", "path"))
    walls = spark.createDataFrame([(1, "up", 0.0, 0.0, 10.0, 0.0), (1, "round", 10.0, 0.0, 10.0, 10.0)],
                                  "dataset_id long, edge_id string, wall_x0 double, wall_y0 double, wall_x1 double, wall_y1 double")
    found = pairs(entries.entry_violations(edges, segments, rings, doors, walls), "edge_id", "code")
    assert found == {("side", "BUILDING_INTERSECTION"), ("side", "BUILDING_ENTRY_INVALID"), ("bent", "BUILDING_INTERSECTION"), ("bent", "BUILDING_ENTRY_INVALID"),
                     ("past", "BUILDING_INTERSECTION"), ("round", "BUILDING_ENTRY_WALL")}
    report = {r.edge_id: r for r in entries.entry_report(doors).collect()}
    assert report["up"].reference == pytest.approx(3) and report["up"].wall_metres == 0 and set(report) == {"up", "round"}
    assert entries.entry_portals(edges, owners.limit(0), rings).count() == 0
    kinds = spark.createDataFrame([("oks_future", None), ("restriction", "oks"), ("restriction", "park"), (None, None)], "t string, r string")
    assert [r[0] for r in kinds.select(entries.is_building(F.col("t"), F.col("r"))).collect()] == [True, True, False, False]


def test_routes_tell_why(spark):
    edges, rings = entry_case(spark)
    edges = edges.withColumn("start_id", F.concat(F.lit("s"), "edge_id")).withColumn("end_id", F.col("edge_id"))
    detour = spark.createDataFrame([(1, "detour", [(0.0, -30.0), (9.0, -40.0), (20.0, -30.0)], 50)], f"dataset_id long, edge_id string, path {PATH}, dn int")
    edges = edges.unionByName(detour.withColumn("length", geo.path_length(F.col("path"))).withColumn("start_id", F.lit("a")).withColumn("end_id", F.lit("b")))
    owners = edges.filter("edge_id IN ('up', 'side', 'bent', 'round')").select("dataset_id", "edge_id", F.lit("B").alias("building_id"))
    why = routes.chord_reasons(edges, rings.withColumn("rule", F.lit("oks")), None, owners)
    out = {r.edge_id: r for r in routes.explain_routes(edges, why).collect()}
    assert out["detour"].first_reason == "NOT_PROVEN" and out["detour"].detour == pytest.approx(math.hypot(9, 10) + math.hypot(11, 10) - 20)
    assert out["side"].first_reason == "BUILDING_INTERSECTION" and out["away"].first_reason is None and out["past"].reasons >= 1
    assert out["detour"].bends == 1 and out["up"].detour == 0


def test_spread_places_like_one_after_the_other(spark):
    rng = random.Random(5)
    rows = [(ds, f"P{k % 4}", f"{k}", rng.random() * 120, rng.random() * 40, rng.choice([0.0, math.pi / 4, 0.4, 0.4001]), round(rng.random() * 9, 1))
            for ds in (1, 2) for k in range(60)]
    places = spark.createDataFrame(rows, "dataset_id long, existing_id string, place string, x double, y double, axis double, distance double")
    want = set()
    for ds in (1, 2):
        taken = []
        for r in sorted((r for r in rows if r[0] == ds), key=lambda r: (math.floor(r[6] * 1e6 + 0.5), r[1], r[2])):
            turn = lambda a, b: min(abs(math.remainder(a - b, math.pi / 4)), math.pi / 4 - abs(math.remainder(a - b, math.pi / 4)))
            if len(taken) < 7 and not any(math.dist(r[3:5], t[3:5]) < 20 and turn(r[5], t[5]) < math.radians(.5) for t in taken):
                taken.append(r)
                want.add((ds, len(taken), r[2]))
    assert pairs(ties.spread_places(places, 7), "dataset_id", "rank", "place") == want
    assert ties.spread_places(places.limit(0), 7).count() == 0


def test_ties_near_chambers(spark):
    entry = spark.createDataFrame([(1, "e", 50.0, 30.0, 50), (1, "odd", 0.0, 0.0, 51)], "dataset_id long, entry_id string, x double, y double, dn int")
    lines = spark.createDataFrame([(1, "P", [(0.0, 0.0), (100.0, 0.0)])], f"dataset_id long, object_id string, path {PATH}")
    chambers = spark.createDataFrame([(1, "C", 67.0, 3.0, 1), (1, "full", 35.0, 0.1, 0)], "dataset_id long, object_id string, x double, y double, spare int")
    got = ties.tie_candidates(entry, lines, chambers, 9).collect()
    assert {(r.existing_id, r.x, r.y) for r in got} == {("P", 50, 0), ("P", 0, 0), ("P", 100, 0), ("C", 67, 3)}  # 65 m is the chamber's, 35 m nobody's
    assert [r.rank for r in sorted(got, key=lambda r: r.distance)] == [1, 2, 3, 4]


def test_groups_are_sets(spark):
    edges = spark.createDataFrame([(1, k, s, e) for k, s, e in ((1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 1, 5), (6, 0, 6), (7, 0, 7))],
                                  "dataset_id long, edge_id long, start_id long, end_id long")
    users = [(1, "a", 3, 0.0, 0.0), (1, "b", 4, 1.0, 0.0), (1, "c", 5, 5.0, 0.0), (1, "d", 6, 100.0, 0.0), (1, "e", 7, 101.0, 0.0)]
    frame = spark.createDataFrame(users, "dataset_id long, demand_id string, end_id long, x double, y double")
    got = {tuple(r.members) for r in ties.demand_groups(edges, frame.select("dataset_id", "demand_id", "end_id"), frame).collect()}
    near = {("a", "b"), ("a", "b", "c"), ("a", "b", "c", "d"), ("b", "c"), ("d", "e"), ("c", "d", "e"), ("b", "c", "d", "e")}
    assert got == near
    wide = pairs(candidates.context_features(
        spark.createDataFrame([(1, 0, 1, "a", 0.0, 0.0, 10.0, 0.0, 3.0)], "dataset_id long, state_id long, cand_id long, demand_id string, x double, y double, tx double, ty double, score double"),
        frame.withColumn("flow", F.lit(2.0)), spark.createDataFrame([(1, 0, "e")], "dataset_id long, state_id long, demand_id string")).withColumn(
        "c", F.array_join(F.transform("context", lambda v: F.round(v, 4)).cast("array<string>"), " ")), "c")
    assert wide == {("0.2 0.2 0.05 0.1156 1.0 0.6667 0.06 0.6 0.01 0.25",)}


def test_catalogue_of_reasons():
    assert routes.PRECEDENCE.index("BUILDING_INTERSECTION") == 0 and len(candidates.NAMES) == 22 and len(candidates.CONTEXT) == 10
    assert len(rules.DN) == 18
