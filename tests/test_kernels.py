import random

from pyspark.sql import functions as F

from utilnet.operators import evaluate, graph, ordering
from utilnet.operators.kernels import climb, components, fold_subtrees, running
from utilnet.functions import rules


def test_running_equals_a_plain_loop_with_one_hot_group(spark):
    rnd = random.Random(1)
    rows = [(1 if i % 3 else rnd.randrange(5), i, float(rnd.randrange(50))) for i in range(600)]
    out = running(spark.createDataFrame(rows, "g int, o int, v double"), ["g"], ["o"], sums={"s": "v"}, mins={"m": "v"},
                  lasts={"l": "v"}, row_number="n").collect()
    got = {(r["g"], r["o"]): (r["s"], r["m"], r["l"], r["n"]) for r in out}
    seen = {}
    for g, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        prior = seen.setdefault(g, [])
        want = (sum(prior), min(prior), prior[-1], len(prior) + 1) if prior else (None, None, None, 1)
        assert got[(g, o)] == want
        prior.append(v)


def test_climb_reports_cycles_and_missing_ids(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (10, 11), (11, 12), (12, 10), (20, 99), (21, 20)]
    df = spark.createDataFrame([(0, a, b, 1.0) for a, b in rows], "k int, v int, u int, w double")
    got = {r["v"]: r for r in climb(df, ["k"], "v", "u", sums=["w"]).collect()}
    assert (got[5]["top"], got[5]["hops"], got[5]["w"], got[5]["status"]) == (1, 4, 4.0, "ok")
    assert {got[v]["status"] for v in (10, 11, 12)} == {"cycle"}
    assert (got[21]["top"], got[21]["status"]) == (99, "dangling")


def test_folds_on_a_path_and_a_star(spark):
    path = [(0, i, i - 1 if i else None, 1.0, i) for i in range(40)]
    star = [(1, i, 0 if i else None, 1.0, i) for i in range(40)]
    df = spark.createDataFrame(path + star, "k int, v int, u int, s double, m int")
    got = {(r["k"], r["v"]): (r["s"], r["m"]) for r in fold_subtrees(df, ["k"], "v", "u", ["s"], ["m"]).collect()}
    assert all(got[(0, i)] == (40 - i, 39) for i in range(40))
    assert got[(1, 0)] == (40, 39) and got[(1, 7)] == (1, 7)


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(3).shuffle(ids)
    nodes = spark.createDataFrame([(0, i) for i in range(61)], "k int, node_id int")
    pairs = spark.createDataFrame([(0, a, b) for a, b in zip(ids, ids[1:])], "k int, a int, b int")
    got = {r["node_id"]: r["label"] for r in components(nodes, pairs, ["k"]).collect()}
    assert {got[i] for i in range(60)} == {0} and got[60] == 60


def _faults(tree, size):
    """What is wrong with a choice of row numbers per edge: flow, shrinking, runs of one size."""
    found = []
    run = {}
    for v in sorted(tree):
        e, i = tree[v], size[v]
        above = tree.get(e["up"])
        run[v] = e["length"] + (run[e["up"]] if above and size[e["up"]] == i else 0.0)
        if e["flow"] > rules.CAPACITY[i] + 1e-9:
            found.append(("flow", v))
        if above and size[e["up"]] < i:
            found.append(("shrinks", v))
        if run[v] > rules.RUN_LIMIT[i] + 1e-3:
            found.append(("run", v))
    return found


def test_repaired_sizes_are_sound_and_tight(spark):
    """Every rule holds, and no chain above its own least size could be one size smaller."""
    rnd = random.Random(7)
    nodes, edges, trees = [], [], {}
    for ds in range(25):
        n = rnd.randrange(4, 16)
        up = {v: rnd.randrange(max(0, v - 3), v) for v in range(1, n)}
        demand = {v: float(rnd.choice([0, 0.5, 1, 2, 5])) for v in range(n)}
        flow = dict(demand)
        for v in range(n - 1, 0, -1):
            flow[up[v]] += flow[v]
        trees[ds] = {v: {"up": up[v], "length": float(rnd.randrange(20, 180)), "flow": flow[v]} for v in up}
        nodes += [(ds, v, "chamber" if v else "tie", demand[v]) for v in range(n)]
        edges += [(ds, v, e["up"], v, e["length"]) for v, e in trees[ds].items()]
    n = spark.createDataFrame(nodes, "dataset_id long, node_id long, node_type string, demand double")
    e = spark.createDataFrame(edges, "dataset_id long, edge_id long, start_id long, end_id long, length double")
    got = {}
    for r in graph.repair_dn(graph.flow_chains(graph.flows(n, e))).collect():
        got.setdefault(r["dataset_id"], {})[r["edge_id"]] = (rules.DN.index(r["dn"]), r["chain_id"])
    for ds, tree in trees.items():
        size = {v: i for v, (i, _) in got[ds].items()}
        assert not _faults(tree, size)
        chains = {}
        for v, (_, chain) in got[ds].items():
            chains.setdefault(chain, []).append(v)
        for members in chains.values():
            lower = {**size, **{v: size[v] - 1 for v in members}}
            assert size[members[0]] == 0 or _faults(tree, lower)


def test_flows_and_runs_beyond_the_table(spark):
    """30,000 t/h and 12 km fit no diameter: violations, no price, no score; a sound network keeps its own."""
    n = spark.createDataFrame([(0, 0, "tie", 0.0), (0, 1, "oks", 30000.0), (1, 0, "tie", 0.0), (1, 1, "oks", 1.0),
                               (2, 0, "tie", 0.0), (2, 1, "oks", 1.0)],
                              "dataset_id long, node_id long, node_type string, demand double")
    e = spark.createDataFrame([(0, 1, 0, 1, 50.0), (1, 1, 0, 1, 12000.0), (2, 1, 0, 1, 50.0)],
                              "dataset_id long, edge_id long, start_id long, end_id long, length double")
    sized = graph.repair_dn(graph.flow_chains(graph.flows(n, e)))
    assert {(r["dataset_id"], r["object_id"], r["code"]) for r in graph.size_violations(sized).collect()} == {
        (0, 1, "CAPACITY_EXCEEDED"), (1, 1, "RUN_TOO_LONG")}
    wanted = n.filter("demand > 0").selectExpr("dataset_id", "node_id AS demand_id", "demand AS flow")
    tied = n.selectExpr("*", "'heat_network' AS existing_type", "IF(demand > 0, node_id, NULL) AS entry_id")
    priced = evaluate.price_networks(tied, e, wanted)
    got = {r["dataset_id"]: (r["pipe_cost"], r["chamber_cost"], r["score"]) for r in priced.collect()}
    assert got[0] == (None, None, None) and got[1] == (None, None, None)
    assert None not in got[2]
    ranked = ordering.rank_variants(priced.selectExpr("0 AS g", "dataset_id", "score"), ["g"], ["score", "dataset_id"])
    assert {r["dataset_id"]: r["rank"] for r in ranked.collect()} == {0: None, 1: None, 2: 1}


def test_long_branches_get_larger_pipes(spark):
    """800 m at 1 t/h needs DN200; a 110 + 100 m stem is DN65 where its branches stay DN50."""
    n = spark.createDataFrame([(0, 0, "tie", 0.0), (0, 1, "oks", 1.0), (1, 0, "tie", 0.0), (1, 1, "chamber", 0.0),
                               (1, 2, "oks", 1.0), (1, 3, "oks", 1.0)],
                              "dataset_id long, node_id long, node_type string, demand double")
    e = spark.createDataFrame([(0, 1, 0, 1, 800.0), (1, 1, 0, 1, 110.0), (1, 2, 1, 2, 100.0), (1, 3, 1, 3, 100.0)],
                              "dataset_id long, edge_id long, start_id long, end_id long, length double")
    got = {(r["dataset_id"], r["edge_id"]): r["dn"] for r in graph.repair_dn(graph.flow_chains(graph.flows(n, e))).collect()}
    assert got == {(0, 1): 200, (1, 1): 65, (1, 2): 50, (1, 3): 50}
