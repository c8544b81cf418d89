"""Operators of the existing network on its tree and line views."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators import existing as ops
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.registry import query

_WALK = {
    "w": """SELECT dataset_id, object_id, object_id AS cur, 0 AS steps FROM fx_existing UNION ALL
      SELECT w.dataset_id, w.object_id, o.upstream_id, steps + 1 FROM w JOIN fx_existing o
      ON o.dataset_id = w.dataset_id AND o.object_id = w.cur WHERE o.upstream_id IS NOT NULL AND steps < 60""",
    "fin": "SELECT dataset_id, object_id, max(steps) AS steps, arg_max(cur, steps) AS top FROM w GROUP BY 1, 2",
}


@query("dangling_refs", sql("""SELECT dataset_id, object_id, upstream_id, 'UNKNOWN_UPSTREAM' AS code FROM fx_existing o
  WHERE upstream_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_existing p WHERE p.dataset_id = o.dataset_id
  AND p.object_id = o.upstream_id)""", "fx_existing"))
def dangling_refs(spark, d):
    return ops.dangling_refs(bridge.existing(spark, d))


@query("upstream_violations", sql("""SELECT f.dataset_id, f.object_id, CASE WHEN steps >= 60 THEN 'CYCLE'
  WHEN t.object_id IS NULL THEN 'MISSING_TARGET' ELSE 'NO_UPSTREAM' END AS code FROM fin f LEFT JOIN fx_existing t
  ON t.dataset_id = f.dataset_id AND t.object_id = f.top WHERE steps >= 60 OR t.object_id IS NULL
  OR t.object_type <> 'source'""", "fx_existing", extra=_WALK))
def upstream_violations(spark, d):
    return ops.upstream_violations(bridge.existing(spark, d))


_EFF = {
    "ew": """SELECT dataset_id, object_id, upstream_id AS cur, 0 AS steps FROM fx_existing WHERE object_type <> 'source'
      UNION ALL SELECT e.dataset_id, e.object_id, o.upstream_id, steps + 1 FROM ew e JOIN fx_existing o
      ON o.dataset_id = e.dataset_id AND o.object_id = e.cur AND o.object_type = 'heat_chamber' WHERE steps < 60""",
    "eff": """SELECT e.dataset_id, e.object_id, max(CASE WHEN o.object_type = 'heat_network' THEN e.cur END) AS pipe_id
      FROM ew e LEFT JOIN fx_existing o ON o.dataset_id = e.dataset_id AND o.object_id = e.cur GROUP BY 1, 2""",
}


@query("effective_pipes", sql("SELECT dataset_id, object_id, pipe_id FROM eff", "fx_existing", extra=_EFF))
def effective_pipes(spark, d):
    return ops.effective_pipe(bridge.existing(spark, d))


@query("dn_monotone", sql("""SELECT o.dataset_id, o.object_id, pipe_id, 'DN_SHRINKS' AS code FROM fx_existing o
  JOIN eff USING (dataset_id, object_id) JOIN fx_existing p ON p.dataset_id = o.dataset_id AND p.object_id = pipe_id
  WHERE o.object_type = 'heat_network' AND p.dn < o.dn""", "fx_existing", extra=_EFF))
def dn_monotone(spark, d):
    return ops.dn_monotone(bridge.existing(spark, d))


@query("inference_notes", sql("""SELECT o.dataset_id, count(*) AS inferred, count(*) FILTER (p.object_type =
  'heat_network' AND p.dn < o.dn) AS transitions FROM fx_existing o JOIN fx_existing p ON p.dataset_id = o.dataset_id
  AND p.object_id = o.upstream_id WHERE o.object_type = 'heat_network' GROUP BY 1""", "fx_existing"))
def inference_notes(spark, d):
    return ops.inference_notes(bridge.existing(spark, d))


def _ends(spark, d):
    """Points on a decimetre lattice, dense enough for some to fall together."""
    k = F.col("o_orderkey")
    return bridge.table(spark, d, "orders").select(
        bridge.div(k, 400).alias("dataset_id"), k.alias("end_id"),
        ((k * 17) % 53 / 10.0).alias("x"), ((k * 29) % 61 / 10.0).alias("y"))


_CL = {
    "pt": """SELECT o_orderkey // 400 AS dataset_id, o_orderkey AS end_id, (o_orderkey * 17 % 53)::INT AS ix,
      (o_orderkey * 29 % 61)::INT AS iy FROM orders""",
    "lk": """SELECT a.dataset_id, a.end_id AS a, b.end_id AS b FROM pt a JOIN pt b ON a.dataset_id = b.dataset_id
      AND (a.ix - b.ix)**2 + (a.iy - b.iy)**2 <= 6""",
    "cc": """SELECT dataset_id, end_id, end_id AS label FROM pt UNION SELECT c.dataset_id, l.b, c.label FROM cc c
      JOIN lk l ON l.dataset_id = c.dataset_id AND l.a = c.end_id""",
    "lb": "SELECT dataset_id, end_id, min(label) AS vertex_id FROM cc GROUP BY 1, 2",
}


@query("endpoint_clusters", sql("SELECT dataset_id, end_id, vertex_id FROM lb", extra=_CL))
def endpoint_clusters(spark, d):
    return ops.cluster_endpoints(_ends(spark, d)).select("dataset_id", "end_id", "vertex_id")


@query("ambiguous_clusters", sql("""SELECT DISTINCT a.dataset_id, a.vertex_id, 'AMBIGUOUS_CLUSTER' AS code
  FROM lb a JOIN pt p USING (dataset_id, end_id) JOIN lb b ON b.dataset_id = a.dataset_id AND b.vertex_id = a.vertex_id
  JOIN pt q ON q.dataset_id = b.dataset_id AND q.end_id = b.end_id WHERE (p.ix - q.ix)**2 + (p.iy - q.iy)**2 > 6""",
                                 extra=_CL))
def ambiguous_clusters(spark, d):
    return ops.ambiguous_clusters(ops.cluster_endpoints(_ends(spark, d)))


def _lines(spark, d):
    """The tree as undirected pipes with one extra pipe per fifth dataset that closes a ring."""
    e = bridge.edges(spark, d)
    base = e.select("dataset_id", F.col("edge_id").alias("object_id"), F.col("start_id").alias("va"),
                    F.col("end_id").alias("vb"),
                    rules.dn_of((F.col("edge_id") % 18).cast("int")).cast("long").alias("dn"))
    base = base.filter(~((F.col("dataset_id") % 6 == 1) & (F.col("object_id") == 3)))
    ring = e.filter((F.col("dataset_id") % 5 == 2) & (F.col("edge_id") == 6)).select(
        "dataset_id", F.lit(900).cast("long").alias("object_id"), F.lit(5).cast("long").alias("va"),
        F.lit(6).cast("long").alias("vb"), F.lit(50).cast("long").alias("dn"))
    return base.unionByName(ring)


def _node_objects(spark, d):
    n = bridge.nodes(spark, d).filter("node_id % 4 = 0")
    return n.select("dataset_id", (F.col("node_id") + 100).alias("object_id"), F.when(
        F.col("node_id") == 0, "source").otherwise("heat_chamber").alias("object_type"),
        F.col("node_id").alias("vertex_id"))


_ORI = {
    "ln": f"""SELECT dataset_id, edge_id AS object_id, start_id AS va, end_id AS vb, ({rules.DN})[edge_id % 18 + 1] AS dn
      FROM fx_edges WHERE NOT (dataset_id % 6 = 1 AND edge_id = 3)""",
    "rc": """SELECT dataset_id, node_id FROM fx_nodes WHERE node_id = 0 UNION ALL SELECT r.dataset_id, l.vb FROM rc r
      JOIN ln l ON l.dataset_id = r.dataset_id AND l.va = r.node_id""",
}


@query("inferred_upstream", sql("""SELECT l.dataset_id, l.object_id, CASE WHEN va % 4 = 0 THEN va + 100 ELSE va END
  AS upstream_id FROM ln l JOIN rc ON rc.dataset_id = l.dataset_id AND rc.node_id = l.va""", "fx_edges", extra=_ORI))
def inferred_upstream(spark, d):
    found, _ = ops.infer_upstream(_lines(spark, d), _node_objects(spark, d))
    return found.filter("object_type = 'heat_network'").select("dataset_id", "object_id", "upstream_id")


@query("orientation_violations", sql("""SELECT dataset_id, 900 AS object_id, 'RING' AS code FROM fx_edges
  WHERE dataset_id % 5 = 2 AND edge_id = 6 UNION ALL
  SELECT l.dataset_id, l.object_id, 'UNREACHABLE_PIPE' FROM ln l WHERE NOT EXISTS (SELECT 1 FROM rc
    WHERE rc.dataset_id = l.dataset_id AND rc.node_id = l.va) UNION ALL
  SELECT n.dataset_id, node_id + 100, 'UNREACHABLE_CHAMBER' FROM fx_nodes n WHERE node_id % 4 = 0 AND node_id > 0
    AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.dataset_id = n.dataset_id AND rc.node_id = n.node_id)""",
                                     "fx_edges", extra=_ORI))
def orientation_violations(spark, d):
    return ops.infer_upstream(_lines(spark, d), _node_objects(spark, d))[1]


def _tree_objects(spark, d):
    """Sound tree: node 0 is the source, every other node a pipe of length 10 + id."""
    n = bridge.nodes(spark, d)
    return n.select(
        "dataset_id", F.col("node_id").alias("object_id"),
        F.when(F.col("node_id") == 0, "source").otherwise("heat_network").alias("object_type"),
        F.col("parent_id").alias("upstream_id"), F.lit(50).alias("dn"),
        (F.col("src") % 5).cast("double").alias("flow"),
        (10 + F.col("node_id")).cast("double").alias("length"),
        (F.col("node_id") % 2 == 0).alias("start_near"))


def _ties(spark, d):
    n = bridge.nodes(spark, d).filter("demand > 0")
    return n.select("dataset_id", F.col("src").alias("root_id"), F.col("node_id").alias("existing_id"),
                    (F.col("node_id") % 7 + 1).cast("double").alias("at"), F.col("demand").alias("flow"))


_REC = {
    "sp": """SELECT a.dataset_id, a.anc AS object_id, 0.0::DOUBLE AS a, (10 + a.anc)::DOUBLE AS b, sum(demand) AS f
      FROM fx_anc a JOIN fx_nodes n ON n.dataset_id = a.dataset_id AND n.node_id = a.node_id
      WHERE a.anc > 0 AND a.anc <> a.node_id AND demand > 0 GROUP BY 1, 2 UNION ALL
      SELECT dataset_id, node_id, CASE WHEN node_id % 2 = 0 THEN 0 ELSE node_id % 7 + 1 END,
      CASE WHEN node_id % 2 = 0 THEN node_id % 7 + 1 ELSE 10 + node_id END, demand FROM fx_nodes WHERE demand > 0""",
    "pc3": "SELECT sp.*, src % 5 + f AS fl FROM sp JOIN fx_nodes n ON n.dataset_id = sp.dataset_id AND n.node_id = sp.object_id",
    "ix": f"SELECT *, len(list_filter({rules.CAPACITY}, lambda c: fl > c + 1e-9)) AS i FROM pc3",
}


@query("reconstruction", sql(f"""SELECT dataset_id, object_id, a AS s_from, b AS s_to, f AS added,
  ({rules.DN})[i + 1]::BIGINT AS required_dn, round((b - a) * ({rules.PRICE_RECON})[i + 1], 3) AS cost FROM ix WHERE i > 0""",
                             "fx_anc", extra=_REC))
def reconstruction(spark, d):
    return ops.reconstruction(_tree_objects(spark, d), _ties(spark, d)).select(
        "dataset_id", "object_id", "s_from", "s_to", "added",
        F.col("required_dn").cast("long").alias("required_dn"), F.round("cost", 3).alias("cost"))


@query("chamber_diameters", sql("""SELECT n.dataset_id, n.node_id AS object_id, max(l.dn)::BIGINT AS chamber_dn,
  count(DISTINCT l.object_id) AS degree FROM fx_nodes n LEFT JOIN (SELECT ln.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by
  FROM ln JOIN fx_nodes a ON a.dataset_id = ln.dataset_id AND a.node_id = va JOIN fx_nodes b ON b.dataset_id = ln.dataset_id
  AND b.node_id = vb) l ON l.dataset_id = n.dataset_id AND ((l.ax = n.x AND l.ay = n.y) OR (l.bx = n.x AND l.by = n.y))
  GROUP BY 1, 2""", "fx_edges", extra={"ln": _ORI["ln"]}))
def chamber_diameters(spark, d):
    n = bridge.nodes(spark, d)
    ln = _lines(spark, d).filter("object_id <> 900")
    xy = n.select("dataset_id", F.col("node_id").alias("v"), "x", "y")
    ends = ln.select("dataset_id", "object_id", "dn", F.explode(F.array(
        F.struct(F.lit(0).alias("end"), F.col("va").alias("v")),
        F.struct(F.lit(1).alias("end"), F.col("vb").alias("v")))).alias("_e")).select(
        "dataset_id", "object_id", "dn", "_e.*").join(xy, ["dataset_id", "v"]).drop("v")
    chambers = n.select("dataset_id", F.col("node_id").alias("object_id"), "x", "y")
    return ops.chamber_diameters(chambers, ends)


@query("grown_chambers", sql(f"""SELECT dataset_id, node_id AS object_id, CASE WHEN hole THEN NULL ELSE need END AS required_dn, CASE WHEN NOT hole THEN
  CASE WHEN need <= 200 THEN 3e6 WHEN need <= 500 THEN 5e6 WHEN need <= 1000 THEN 8e6 ELSE 12e6 END END::DOUBLE AS cost FROM (SELECT n.dataset_id, n.node_id,
  max(({rules.DN})[f.dn_idx + 1])::BIGINT AS need, bool_or(f.edge_id % 9 = 4) AS hole FROM fx_nodes n JOIN fx_flows f ON f.dataset_id = n.dataset_id AND n.node_id IN (f.start_id, f.end_id)
  WHERE n.node_type = 'chamber' GROUP BY 1, 2) WHERE hole OR need > 65""", "fx_flows"))
def grown_chambers(spark, d):
    """Old chambers of DN65 that their new branches and the pieces touching them make larger; some pieces have no size."""
    from utilnet.operators import graph
    n = bridge.nodes(spark, d)
    e = graph.flows(n, bridge.edges(spark, d)).withColumn("dn", F.when(F.col("edge_id") % 9 != 4, F.col("dn")))
    chambers = n.filter("node_type = 'chamber'").select("dataset_id", F.col("node_id").alias("object_id"), F.lit(65).alias("dn"))
    out, up = (e.select("dataset_id", F.col(f"{side}_id").alias("object_id"), "dn") for side in ("start", "end"))
    return ops.chamber_reconstruction(chambers, out, up).select(
        "dataset_id", "object_id", F.col("required_dn").cast("long").alias("required_dn"), "cost")
