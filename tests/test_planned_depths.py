"""Depths planned under the passages that the map gives, against a step-by-step planner."""

import pytest
from pyspark.sql import functions as F
from test_depth import crossing, plan

from utilnet.functions import rules
from utilnet.operators import depth
from utilnet.plans import depth_queries
from utilnet.plans.passage_queries import fx_passages

KEYS = range(480, 520)  # the nodes of map 12


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("map")
    spark.createDataFrame([(k,) for k in KEYS], "c_custkey long").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(k, 7 * k % 50) for k in KEYS], "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    return str(at)


@pytest.fixture(scope="module")
def planned(spark, folder):
    """Both queries plan the same; once is enough here."""
    return depth_queries.planned(spark, folder)


def step_by_step(nodes, pipes, found):
    """Depth in the middle of every passage, None where no depth fits: domains, lower bounds and return to 3 m, one by one."""
    rule = {r[0]: r for r in rules.RESTRICTIONS}
    parent, spots = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def name(e, x):
        return ("n", e["start_id"]) if x == 0 else ("n", e["end_id"]) if x == round(e["length"], 7) else ("e", e["edge_id"], x)

    mine = {e["edge_id"]: [p for p in found if p["edge_id"] == e["edge_id"]] for e in pipes}
    for e in pipes:
        cuts = {0.0, round(e["length"], 7)} | {round(p[c], 7) for p in mine[e["edge_id"]] for c in ("s_from", "s_to")}
        spots[e["edge_id"]] = at = sorted(cuts)
        for a, b in zip(at, at[1:]):
            if any(p["s_from"] - 1e-8 <= (a + b) / 2 <= p["s_to"] + 1e-8 for p in mine[e["edge_id"]]):
                parent[root(name(e, a))] = root(name(e, b))
    domain, links = {}, []

    def meet(x, bands):
        old = domain.get(x, [(0.7, 12.0)])
        domain[x] = sorted((max(a, c), min(b, f)) for a, b in old for c, f in bands if max(a, c) <= min(b, f) + 1e-8)

    for n in nodes:
        meet(root(("n", n["node_id"])), [(3.0, 3.0)] if n["node_type"] != "chamber" else [(0.7, 12.0)])
    for e in pipes:
        for x in spots[e["edge_id"]]:
            meet(root(name(e, x)), [(0.7, 12.0)])
            for p in mine[e["edge_id"]]:
                if p["s_from"] - 1e-6 <= x <= p["s_to"] + 1e-6:
                    _, _, area, _, _, _, _, gap, old, top = rule[p["rule"]]
                    old = rules.HEIGHT[rules.DN.index(p["object_dn"])] if p["rule"] == "heat_network" else old
                    meet(root(name(e, x)), [(gap, 12.0)] if area else [(0.7, top - gap - rules.HEIGHT[0]), (top + old + gap, 12.0)])
        for a, b in zip(spots[e["edge_id"]], spots[e["edge_id"]][1:]):
            a, b, far = root(name(e, a)), root(name(e, b)), 0.1 * (b - a)
            if a != b:
                links += [(a, b, far), (b, a, far)]
    low = {x: d[0][0] for x, d in domain.items() if d}
    links = [k for k in links if k[0] in low and k[1] in low]
    while any(low[a] - far > low[b] + 1e-8 for a, b, far in links):
        for a, b, far in links:
            if low[a] - far > low[b] + 1e-8:
                band = next(d for d in domain[b] if low[a] - far <= d[1] + 1e-8)
                low[b] = max(band[0], min(low[a] - far, band[1]))
    high = {x: min(3.0, next(b for a, b in domain[x] if a - 1e-8 <= v <= b + 1e-8)) if v < 3 - 1e-8 else v for x, v in low.items()}
    while any(high[a] + far < high[b] - 1e-8 and high[b] > low[b] for a, b, far in links):
        for a, b, far in links:
            high[b] = max(low[b], min(high[b], high[a] + far))
    of = {e["edge_id"]: e for e in pipes}
    return {(p["edge_id"], p["object_id"], round(p["s_from"], 5)): high.get(root(name(of[p["edge_id"]], round(p["s_from"], 7)))) for p in found}


def test_every_passage_of_the_map_is_reported(spark, folder, planned, monkeypatch):
    """the passages are those of the map, at the depths of the step-by-step planner."""
    monkeypatch.setattr(depth_queries, "planned", lambda *_: planned)
    real = fx_passages(spark, folder)
    want = {(r["edge_id"], r["object_id"], round(r["s_from"], 5)) for r in real.collect()}
    got = depth_queries.crossing_report(spark, folder).collect()
    assert {(r["edge_id"], r["object_id"], round(r["s_from"], 5)) for r in got} == want and len(got) == len(want)
    assert {r["rule"] for r in got} >= {"gas_pipeline", "power_cable", "heat_network"}
    nodes, pipes = depth_queries.bridge.nodes(spark, folder).collect(), depth_queries._sized(spark, folder).collect()
    right = step_by_step(nodes, pipes, planned[1].collect())
    for r in got:
        depth_ = right[r["edge_id"], r["object_id"], round(r["s_from"], 5)]
        assert r["depth"] == (None if depth_ is None else pytest.approx(depth_, abs=1e-6))
        assert (r["code"] == "DEPTH_DOMAIN_EMPTY") == (r["depth"] is None) and r["code"] != "VERTICAL_CLEARANCE"


def test_profiles_cover_all_pipes(spark, folder, planned, monkeypatch):
    """sections under the passages of the map make up the whole length; their range is that of the crossings."""
    monkeypatch.setattr(depth_queries, "planned", lambda *_: planned)
    sections, _, pipes = planned
    size = F.sum(F.col("s_to") - F.col("s_from"))
    assert sections.agg(size).first()[0] == pytest.approx(pipes.agg(F.sum("length")).first()[0], abs=1e-4)
    one = depth_queries.depth_profiles(spark, folder).first()
    lowest = depth_queries.crossing_report(spark, folder).agg(F.min("depth")).first()[0]
    assert one["min_depth"] == pytest.approx(lowest) and one["max_slope"] <= 0.1 + 1e-8
    assert one["unplanned"] == pytest.approx(sections.filter("code IS NOT NULL").agg(F.coalesce(size, F.lit(0.0))).first()[0])


def test_a_passage_that_no_depth_fits_is_told(spark):
    """A gas pipe within two metres of a node that is fixed at 3 m: nothing vanishes, and nothing is invented."""
    edges, p, sec = plan(spark, 100.0, [crossing("g", "gas_pipeline", 50.0, 2.0, 1.25, 100.0), ("h", "gas_pipeline", 97.0, 100.0, 99.0, 99.0, 1.25, 100.0)])
    got = {r["object_id"]: r for r in depth.crossing_report(sec, p, edges).collect()}
    assert got["h"]["depth"] is None and got["h"]["position"] is None and got["h"]["code"] == "DEPTH_DOMAIN_EMPTY"
    assert got["g"]["depth"] == pytest.approx(2.475) and got["g"]["code"] is None
    assert depth.profile_report(sec, edges).first()["unplanned"] == pytest.approx(48.0)


def test_passages_that_begin_together_are_reported_once(spark):
    edges, p, sec = plan(spark, 100.0, [("r", "road", 0.0, 24.0, 1.0, 21.0, 1.6, 100.0), ("r", "road", 0.0, 40.0, 2.0, 37.0, 1.6, 100.0)])
    assert depth.crossing_report(sec, p, edges).count() == 2


def test_pipes_that_come_twice_have_a_profile(spark):
    """their stations coincide, and a step without a length would have no slope."""
    nodes = spark.createDataFrame([(0, "a", "tie"), (0, "b", "oks")], "dataset_id long, node_id string, node_type string")
    pipes = spark.createDataFrame([(0, "e", "a", "b", 100.0, 50)] * 2, "dataset_id long, edge_id string, start_id string, end_id string, length double, dn int")
    p = spark.createDataFrame([(0, "e", *crossing("g", "gas_pipeline", 50.0, 2.0, 1.25, 100.0))] * 2,
                              "dataset_id long, edge_id string, object_id string, rule string, s_from double, s_to double, "
                              "core_from double, core_to double, factor double, length double")
    bands, links, placed = depth.stations(nodes, pipes, p)
    sections = depth.depth_sections(placed, depth.solve_depths(bands, links), depth.planned_sections(pipes, p))
    assert depth.profile_report(sections, pipes).first()["min_depth"] == pytest.approx(2.475)
    assert sections.agg(F.sum(F.col("s_to") - F.col("s_from"))).first()[0] == pytest.approx(100.0)
