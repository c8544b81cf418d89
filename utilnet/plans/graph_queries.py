"""Graph operators on the tree views."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators import graph
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.registry import query


def _flowed(spark, d):
    return graph.flows(bridge.nodes(spark, d), bridge.edges(spark, d))


@query("flows", sql(f"""SELECT dataset_id, edge_id, flow, ({rules.DN})[dn_idx + 1]::BIGINT AS dn
  FROM fx_flows""", "fx_flows"))
def flows(spark, d):
    return _flowed(spark, d).select("dataset_id", "edge_id", "flow",
                                    F.col("dn").cast("long").alias("dn"))


@query("node_roots", sql("""SELECT dataset_id, node_id, count(*) - 1 AS hops, min(anc) AS root_id,
  'ok' AS status FROM fx_anc GROUP BY 1, 2""", "fx_anc"))
def node_roots(spark, d):
    return graph.root_of(bridge.nodes(spark, d), bridge.edges(spark, d)).select(
        "dataset_id", "node_id", "hops", "root_id", "status")


# Damage the tree in a regular way so that every kind of violation occurs.
_BROKEN = {
    "bn": "SELECT dataset_id, node_id, node_type FROM fx_nodes WHERE src % 211 <> 5",
    "be": """SELECT dataset_id, edge_id, start_id, end_id FROM fx_edges UNION ALL
      SELECT dataset_id, edge_id + 1000, end_id, start_id FROM fx_edges WHERE edge_id = 5
        AND dataset_id % 7 = 2 UNION ALL
      SELECT dataset_id, edge_id + 2000, end_id, 0 FROM fx_edges WHERE edge_id = 2
        AND dataset_id % 7 = 4 UNION ALL
      SELECT dataset_id, edge_id + 3000, 7, end_id FROM fx_edges WHERE edge_id = 30
        AND dataset_id % 7 = 5""",
    "inc": "SELECT dataset_id, end_id AS node_id, count(*) AS n, min(start_id) AS up FROM be GROUP BY 1, 2",
    "pl": """SELECT bn.dataset_id, bn.node_id, node_type, n, up FROM bn
      LEFT JOIN inc USING (dataset_id, node_id)""",
    "walk": """SELECT dataset_id, node_id, node_id AS cur, 0 AS steps FROM pl UNION ALL
      SELECT w.dataset_id, w.node_id, p.up, steps + 1 FROM walk w JOIN pl p
      ON p.dataset_id = w.dataset_id AND p.node_id = w.cur WHERE p.up IS NOT NULL AND steps < 60""",
    "fin": """SELECT dataset_id, node_id, max(steps) AS steps, arg_max(cur, steps) AS top
      FROM walk GROUP BY 1, 2""",
}


@query("forest_violations", sql("""
  SELECT DISTINCT dataset_id, edge_id AS object_id, 'MISSING_NODE' AS code FROM be e
    WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.dataset_id = e.dataset_id AND bn.node_id = e.start_id)
       OR NOT EXISTS (SELECT 1 FROM bn WHERE bn.dataset_id = e.dataset_id AND bn.node_id = e.end_id)
  UNION ALL SELECT dataset_id, node_id, 'SEVERAL_PARENTS' FROM inc WHERE n > 1
  UNION ALL SELECT dataset_id, node_id, 'ROOT_WITH_PARENT' FROM pl
    WHERE node_type = 'tie' AND n IS NOT NULL
  UNION ALL SELECT dataset_id, node_id, 'CYCLE' FROM fin WHERE steps >= 60
  UNION ALL SELECT f.dataset_id, f.node_id, 'NO_ROOT' FROM fin f WHERE steps < 60 AND NOT EXISTS
    (SELECT 1 FROM bn WHERE bn.dataset_id = f.dataset_id AND bn.node_id = f.top
      AND bn.node_type = 'tie')""", "fx_edges", extra=_BROKEN))
def forest_violations(spark, d):
    n = bridge.nodes(spark, d).filter("src % 211 <> 5")
    e = bridge.edges(spark, d).select("dataset_id", "edge_id", "start_id", "end_id")
    ds = F.col("dataset_id")
    turned = e.filter((F.col("edge_id") == 5) & (ds % 7 == 2)).select(
        ds, (F.col("edge_id") + 1000).alias("edge_id"), F.col("end_id").alias("start_id"),
        F.col("start_id").alias("end_id"))
    fed = e.filter((F.col("edge_id") == 2) & (ds % 7 == 4)).select(
        ds, (F.col("edge_id") + 2000).alias("edge_id"), F.col("end_id").alias("start_id"),
        F.lit(0).cast("long").alias("end_id"))
    second = e.filter((F.col("edge_id") == 30) & (ds % 7 == 5)).select(
        ds, (F.col("edge_id") + 3000).alias("edge_id"), F.lit(7).cast("long").alias("start_id"),
        "end_id")
    return graph.forest_violations(n, e.union(turned).union(fed).union(second))


_BELOW = {
    "below": """SELECT e.dataset_id, e.edge_id, n.node_id AS terminal_id FROM fx_edges e
      JOIN fx_anc a ON a.dataset_id = e.dataset_id AND a.anc = e.end_id
      JOIN fx_nodes n ON n.dataset_id = a.dataset_id AND n.node_id = a.node_id AND n.demand > 0""",
    "sets": """SELECT b.dataset_id, b.edge_id, count(*) AS n, max(terminal_id) AS last_id,
      sum(('0x' || substr(md5(terminal_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest_a,
      sum(('0x' || substr(md5(terminal_id::VARCHAR), 9, 8))::BIGINT)::BIGINT AS digest_b
      FROM below b GROUP BY 1, 2""",
    "tot": "SELECT dataset_id, count(*) AS total FROM fx_nodes WHERE demand > 0 GROUP BY 1",
}


@query("branch_groups", sql("""SELECT DISTINCT s.dataset_id, n, last_id, digest_a, digest_b
  FROM sets s JOIN tot USING (dataset_id) WHERE n > 1 AND n < total""",
                            "fx_edges", "fx_anc", extra=_BELOW))
def branch_groups(spark, d):
    return graph.branch_groups(bridge.nodes(spark, d), bridge.edges(spark, d))


@query("branch_members", sql("""SELECT b.dataset_id, b.edge_id, terminal_id FROM below b
  JOIN sets s ON s.dataset_id = b.dataset_id AND s.edge_id = b.edge_id
  JOIN tot ON tot.dataset_id = b.dataset_id WHERE n > 1 AND n < total""",
                             "fx_edges", "fx_anc", extra=_BELOW))
def branch_members(spark, d):
    return graph.branch_members(bridge.nodes(spark, d), bridge.edges(spark, d)).select(
        "dataset_id", "edge_id", "terminal_id")


# Chains in SQL: walk up while the flow stays the same.
CHAINS = {
    "ch": """SELECT dataset_id, edge_id, edge_id AS head, flow FROM fx_flows UNION ALL
      SELECT c.dataset_id, c.edge_id, p.edge_id, c.flow FROM ch c
      JOIN fx_flows h ON h.dataset_id = c.dataset_id AND h.edge_id = c.head
      JOIN fx_flows p ON p.dataset_id = c.dataset_id AND p.end_id = h.start_id
      WHERE abs(p.flow - c.flow) < 1e-8""",
    "hd": "SELECT dataset_id, edge_id, min(head) AS chain_id FROM ch GROUP BY 1, 2",
    "chl": """SELECT h.dataset_id, h.chain_id, sum(f.length) AS chain_length, min(f.dn_idx) AS fi
      FROM hd h JOIN fx_flows f USING (dataset_id, edge_id) GROUP BY 1, 2""",
    "own": f"""SELECT dataset_id, chain_id, chain_length, greatest(fi,
      len(list_filter({rules.RUN_LIMIT}, lambda l: chain_length > l + 0.001))) AS own_idx FROM chl""",
    "cidx": """SELECT t.dataset_id, t.chain_id, max(o.own_idx) AS chain_idx
      FROM own t JOIN fx_anc a ON a.dataset_id = t.dataset_id AND a.anc = t.chain_id
      JOIN own o ON o.dataset_id = t.dataset_id AND o.chain_id = a.node_id GROUP BY 1, 2""",
}


@query("flow_chains", sql("""SELECT hd.dataset_id, hd.edge_id, hd.chain_id,
  round(chain_length, 6) AS chain_length FROM hd JOIN chl USING (dataset_id, chain_id)""",
                          "fx_flows", extra={k: CHAINS[k] for k in ("ch", "hd", "chl")}))
def flow_chains(spark, d):
    return graph.flow_chains(_flowed(spark, d)).select(
        "dataset_id", "edge_id", "chain_id", F.round("chain_length", 6).alias("chain_length"))


@query("chain_diameters", sql(f"""SELECT dataset_id, chain_id,
  ({rules.DN})[own_idx + 1]::BIGINT AS own_dn, ({rules.DN})[chain_idx + 1]::BIGINT AS dn
  FROM own JOIN cidx USING (dataset_id, chain_id)""", "fx_flows", extra=CHAINS))
def chain_diameters(spark, d):
    chains = graph.chain_dn(graph.flow_chains(_flowed(spark, d)))
    return chains.select("dataset_id", "chain_id",
                         rules.dn_of(F.col("own_idx")).cast("long").alias("own_dn"),
                         rules.dn_of(F.col("chain_idx")).cast("long").alias("dn"))


RUNS = {
    "sz": """SELECT f.dataset_id, f.edge_id, f.start_id, f.end_id, f.length, c.chain_idx AS i
      FROM fx_flows f JOIN hd USING (dataset_id, edge_id) JOIN cidx c USING (dataset_id, chain_id)""",
    "run": """SELECT s.dataset_id, s.edge_id, s.length AS run_length, s.i FROM sz s
      LEFT JOIN sz p ON p.dataset_id = s.dataset_id AND p.end_id = s.start_id
      WHERE p.edge_id IS NULL OR p.i <> s.i UNION ALL
      SELECT s.dataset_id, s.edge_id, r.run_length + s.length, s.i FROM run r
      JOIN sz s ON s.dataset_id = r.dataset_id AND s.start_id = r.edge_id AND s.i = r.i""",
}


# Demands so large that part of the pipes need more than the largest diameter.
LARGE = 400.0
LARGE_CHAINS = {"big": f"""SELECT * EXCLUDE (flow, dn_idx), flow * {LARGE} AS flow,
  len(list_filter({rules.CAPACITY}, lambda c: flow * {LARGE} > c + 1e-9)) AS dn_idx FROM fx_flows""",
                **{k: v.replace("fx_flows", "big") for k, v in CHAINS.items()}}


def large_nodes(nodes):
    return nodes.withColumn("demand", F.col("demand") * LARGE)


@query("oversized_chains", sql(f"""SELECT dataset_id, chain_id, ({rules.DN})[chain_idx + 1]::BIGINT AS dn,
  chain_idx >= {len(rules.DN)} AS oversized FROM cidx""", "fx_flows", extra=LARGE_CHAINS))
def oversized_chains(spark, d):
    flowed = graph.flows(large_nodes(bridge.nodes(spark, d)), bridge.edges(spark, d))
    return graph.chain_dn(graph.flow_chains(flowed)).select(
        "dataset_id", "chain_id", rules.dn_of(F.col("chain_idx")).cast("long").alias("dn"),
        (F.col("chain_idx") == rules.OVERSIZE).alias("oversized"))


@query("size_violations", sql("""SELECT dataset_id, edge_id AS object_id, 'CAPACITY_EXCEEDED' AS code
  FROM big WHERE dn_idx >= 18""", "fx_flows", extra={"big": LARGE_CHAINS["big"]}))
def size_violations(spark, d):
    flowed = graph.flows(large_nodes(bridge.nodes(spark, d)), bridge.edges(spark, d))
    return graph.size_violations(graph.repair_dn(graph.flow_chains(flowed)))


@query("diameter_runs", sql(f"""SELECT dataset_id, edge_id, round(run_length, 6) AS run_length,
  run_length > ({rules.RUN_LIMIT})[i + 1] + 0.001 AS overlong FROM run""",
                            "fx_flows", extra={**CHAINS, **RUNS}))
def diameter_runs(spark, d):
    chains = graph.flow_chains(_flowed(spark, d))
    sizes = graph.chain_dn(chains).select("dataset_id", "chain_id",
                                          F.col("chain_idx").alias("dn_idx"))
    runs = graph.path_runs(chains.drop("dn_idx", "dn").join(
        sizes, ["dataset_id", "chain_id"]))
    return runs.select("dataset_id", "edge_id", F.round("run_length", 6).alias("run_length"),
                       (F.col("run_length") > F.col("run_limit") + 0.001).alias("overlong"))


def repaired(spark, d):
    return graph.repair_dn(graph.flow_chains(_flowed(spark, d)))


@query("node_degrees", sql("""SELECT n.dataset_id, n.node_id, count(e.edge_id) AS degree,
  count(e.edge_id) > 4 AS over_limit FROM fx_nodes n LEFT JOIN fx_edges e
  ON e.dataset_id = n.dataset_id AND (e.start_id = n.node_id OR e.end_id = n.node_id)
  GROUP BY 1, 2""", "fx_edges"))
def node_degrees(spark, d):
    return graph.degrees(bridge.nodes(spark, d), bridge.edges(spark, d))
