"""Windows over maps and comparison of three layouts per dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.operators import graph, variants, windows
from utilnet.plans import bridge
from utilnet.plans.bridge import sql, table
from utilnet.plans.registry import query


def layouts(spark, d):
    """Edges of three layouts: the tree, a mildly shifted one and a strongly shifted one."""
    n = bridge.nodes(spark, d).withColumn("network_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    shift = F.when(F.col("network_id") == 1, (F.col("node_id") % 3) * 15).when(
        F.col("network_id") == 2, 40 * (F.col("node_id") % 2)).otherwise(0)
    n = n.withColumn("x", F.col("x") + shift)
    up = n.select("dataset_id", "network_id", F.col("node_id").alias("parent_id"), F.col("x").alias("x0"),
                  F.col("y").alias("y0"))
    return n.join(up, ["dataset_id", "network_id", "parent_id"]).select(
        "dataset_id", "network_id", F.col("node_id").alias("edge_id"), "x0", "y0", F.col("x").alias("x1"),
        F.col("y").alias("y1"), geo.distance(F.col("x0"), F.col("y0"), F.col("x"), F.col("y")).alias("length"))


def pairs(spark, d):
    return bridge.nodes(spark, d).select("dataset_id").distinct().select("dataset_id", F.explode(F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, 2), (1, 2))])).alias(
        "p")).select("dataset_id", "p.*")


def differences(spark, d):
    e = layouts(spark, d)
    return variants.route_difference(e, geo.with_box(e), pairs(spark, d))


_LAY = {
    "ly": """SELECT n.dataset_id, w.id AS network_id, n.node_id, n.parent_id, n.y, n.x + CASE w.id WHEN 1 THEN (n.node_id % 3) * 15
      WHEN 2 THEN 40 * (n.node_id % 2) ELSE 0 END AS x FROM fx_nodes n, (VALUES (0), (1), (2)) w(id)""",
    "le": """SELECT c.dataset_id, c.network_id, c.node_id AS edge_id, p.x AS x0, p.y AS y0, c.x AS x1, c.y AS y1,
      sqrt((c.x-p.x)**2+(c.y-p.y)**2) AS len FROM ly c JOIN ly p ON p.dataset_id = c.dataset_id AND p.network_id = c.network_id
      AND p.node_id = c.parent_id""",
    "sl": """SELECT *, greatest(1, ceil(len / 12))::INT AS n FROM le""",
    "mp": """SELECT dataset_id, network_id, len / n AS piece, x0 + (i + 0.5) / n * (x1 - x0) AS mx,
      y0 + (i + 0.5) / n * (y1 - y0) AS my FROM (SELECT *, unnest(range(n)) AS i FROM sl)""",
    "nr": """SELECT m.dataset_id, m.network_id AS a, o.id AS b, m.piece, EXISTS (SELECT 1 FROM le e WHERE e.dataset_id = m.dataset_id
      AND e.network_id = o.id AND (mx - x0 - greatest(0, least(1, ((mx-x0)*(x1-x0)+(my-y0)*(y1-y0))/(len*len)))*(x1-x0))**2 +
      (my - y0 - greatest(0, least(1, ((mx-x0)*(x1-x0)+(my-y0)*(y1-y0))/(len*len)))*(y1-y0))**2 <= 36) AS near
      FROM mp m, (VALUES (0), (1), (2)) o(id) WHERE o.id <> m.network_id""",
    "ou": "SELECT dataset_id, a, b, sum(CASE WHEN near THEN 0 ELSE piece END) / sum(piece) AS outside FROM nr GROUP BY 1, 2, 3",
}


@query("route_difference", sql("""SELECT dataset_id, least(a, b) AS a, greatest(a, b) AS b, round(max(outside), 6) AS difference
  FROM ou GROUP BY 1, 2, 3""", "fx_nodes", extra=_LAY))
def route_difference(spark, d):
    return differences(spark, d).select("dataset_id", "a", "b", F.round("difference", 6).alias("difference"))


def _sets(spark, d):
    """Customers as members of layouts: layout 2 drops every seventh member."""
    return bridge.nodes(spark, d).filter("demand > 0").select(
        "dataset_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("network_id"),
        F.col("src").alias("existing_id")).filter("NOT (network_id = 2 AND existing_id % 107 = 3)")


@query("equal_sets", sql("""SELECT d.dataset_id, p.a, p.b, NOT (p.b = 2 AND bool_or(src % 107 = 3 AND demand > 0)) AS equal
  FROM fx_nodes d, (VALUES (0, 1), (0, 2), (1, 2)) p(a, b) GROUP BY 1, 2, 3""", "fx_nodes"))
def equal_sets(spark, d):
    return variants.same_sets(_sets(spark, d), pairs(spark, d), ["existing_id"])


@query("structural_difference", sql("""SELECT d.dataset_id, p.a, p.b, p.b = 2 AND bool_or(src % 107 = 3 AND demand > 0) AS structural
  FROM fx_nodes d, (VALUES (0, 1), (0, 2), (1, 2)) p(a, b) GROUP BY 1, 2, 3""", "fx_nodes"))
def structural_difference(spark, d):
    n, e = bridge.nodes(spark, d), bridge.edges(spark, d)
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("network_id")
    groups = graph.branch_groups(n, e).select("*", three)
    return variants.structural_difference(_sets(spark, d), groups, pairs(spark, d))


def _metrics(spark, d):
    """Index values of the orders' networks; pairs of neighbouring keys of a customer are compared."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), k.alias("network_id"), (F.col("o_totalprice") / 1000).alias("score"),
        (100 + (k * 31) % 997).cast("double").alias("earthwork_index"),
        (50 + (k * 57) % 991).cast("double").alias("installation_index"))


def _pool(spark, d):
    return _metrics(spark, d)


def _metric_pairs(spark, d):
    m = _pool(spark, d).select("dataset_id", F.col("network_id").alias("a"))
    return m.join(m.withColumnRenamed("a", "b"), "dataset_id").filter("a < b").select(
        "dataset_id", "a", "b", ((F.col("a") + F.col("b")) % 100 / 500.0).alias("difference"),
        (F.col("a") % 2 == 0).alias("structural"))


_CH = {
    "m": """SELECT o_custkey AS ds, o_orderkey AS id, o_totalprice / 1000 AS score, (100 + (o_orderkey * 31) % 997)::DOUBLE AS e,
      (50 + (o_orderkey * 57) % 991)::DOUBLE AS i FROM orders
""",
    "ap": """SELECT x.ds, x.id AS a, y.id AS b FROM m x JOIN m y ON x.ds = y.ds AND x.id <> y.id WHERE (x.id + y.id) % 100 / 500.0 >= 0.06
      OR ((x.id + y.id) % 100 / 500.0 >= 0.03 AND least(x.id, y.id) % 2 = 0)""",
    "bal": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY score, id) AS n FROM m) WHERE n = 1",
    "fr": "SELECT m.*, bal.e AS be, bal.i AS bi FROM m JOIN bal USING (ds) JOIN ap ON ap.ds = m.ds AND ap.a = m.id AND ap.b = bal.id",
    "er": "SELECT * FROM fr WHERE e < be - greatest(0.001, be * 0.005)",
    "ins": "SELECT * FROM fr WHERE i < bi - greatest(0.001, bi * 0.005)",
    "tri": """SELECT er.ds, er.id AS eid, ins.id AS iid, row_number() OVER (PARTITION BY er.ds ORDER BY
      CASE WHEN er.e < ins.e - greatest(0.001, ins.e * 0.005) THEN 0 ELSE 1 END, er.e, er.score, er.id, ins.i, ins.score, ins.id) AS n
      FROM er JOIN ap ON ap.ds = er.ds AND ap.a = er.id JOIN ins ON ins.ds = er.ds AND ins.id = ap.b
      WHERE ins.i < er.i - greatest(0.001, er.i * 0.005)""",
    "one": "SELECT ds, id FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY e, score, id) AS k FROM er) WHERE k = 1",
}


@query("chosen_variants", sql("""SELECT ds AS dataset_id, id AS network_id, 'balanced' AS role FROM bal UNION ALL
  SELECT ds, eid, 'earthworks' FROM tri WHERE n = 1 UNION ALL SELECT ds, iid, 'installation' FROM tri WHERE n = 1 UNION ALL
  SELECT ds, id, 'earthworks' FROM one WHERE ds NOT IN (SELECT ds FROM tri)""", extra=_CH))
def chosen_variants(spark, d):
    return variants.choose_variants(_pool(spark, d), _metric_pairs(spark, d))


# The audit judges a careless choice, which takes the best network of each metric whatever the others are.
_CARELESS = {"balanced": ("score", "score"), "earthworks": ("earthwork_index", "e"), "installation": ("installation_index", "i")}


@query("variant_audit", sql("""SELECT x.ds AS dataset_id, least(x.id, y.id) || '-' || greatest(x.id, y.id) AS object_id, 'TOO_CLOSE' AS code
  FROM r x JOIN r y ON x.ds = y.ds AND x.id < y.id WHERE (x.id + y.id) % 100 / 500.0 < 0.06 UNION ALL
  SELECT r.ds, role, 'NOT_BETTER' FROM r JOIN m USING (ds, id) JOIN (SELECT m.ds, m.e AS be, m.i AS bi FROM r JOIN m USING (ds, id)
    WHERE role = 'balanced') b ON b.ds = r.ds
  WHERE role = 'earthworks' AND NOT m.e < be * 0.995 OR role = 'installation' AND NOT m.i < bi * 0.995""", extra={
    "m": _CH["m"], "r": " UNION ALL ".join(f"""SELECT ds, id, '{role}' AS role FROM m
      QUALIFY row_number() OVER (PARTITION BY ds ORDER BY {col}, id) = 1"""
      for role, (_, col) in _CARELESS.items())}))
def variant_audit(spark, d):
    pool = _pool(spark, d)
    roles = None
    for role, (metric, _) in _CARELESS.items():
        best = pool.groupBy("dataset_id").agg(F.min_by("network_id", F.struct(metric, "network_id")).alias("network_id"))
        best = best.withColumn("role", F.lit(role))
        roles = best if roles is None else roles.unionByName(best)
    return variants.audit_variants(pool.drop("score"), roles, _metric_pairs(spark, d))


@query("run_comparison", """SELECT o_custkey AS dataset_id, count(*) FILTER (presence = 'both') AS matched, count(*) FILTER (presence <> 'both')
  AS unmatched, round(sum(dl), 4) AS delta FROM (SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'only_before' WHEN o_orderkey % 13 = 0
  THEN 'only_after' ELSE 'both' END AS presence, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN (o_orderkey % 17)::DOUBLE END AS dl
  FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)) GROUP BY 1""")
def run_comparison(spark, d):
    m = _metrics(spark, d)
    before = m.filter(F.col("network_id") % 13 != 0)
    after = m.filter(F.col("network_id") % 11 != 0).withColumn("score", F.col("score") + F.col("network_id") % 17)
    out = variants.compare_runs(before, after, ["dataset_id", "network_id"], ["score"])
    return out.groupBy("dataset_id").agg(
        F.count(F.when(F.col("presence") == "both", 1)).alias("matched"),
        F.count(F.when(F.col("presence") != "both", 1)).alias("unmatched"),
        F.round(F.sum("delta_score"), 4).alias("delta"))


@query("rechecked_networks", """SELECT o_orderkey AS network_id, (o_orderkey % 3)::DOUBLE AS delta FROM orders WHERE o_orderkey % 3 > 0""")
def rechecked_networks(spark, d):
    m = _metrics(spark, d)
    now = m.withColumn("score", F.col("score") + F.col("network_id") % 3)
    return variants.recheck(now, m, ["network_id"]).select("network_id", F.round("delta", 6).alias("delta"))


@query("tree_signatures", sql("""SELECT dataset_id, count(*) AS parts, sum(('0x' || substr(md5(p), 1, 8))::BIGINT)::BIGINT AS digest_a,
  sum(('0x' || substr(md5(p), 9, 8))::BIGINT)::BIGINT AS digest_b FROM (SELECT dataset_id, start_id || '>' || end_id AS p FROM fx_edges
  UNION ALL SELECT dataset_id, 'oks:' || src FROM fx_nodes WHERE demand > 0) GROUP BY 1""", "fx_edges"))
def tree_signatures(spark, d):
    e = bridge.edges(spark, d).select("dataset_id", F.concat_ws(">", "start_id", "end_id").alias("part"))
    t = bridge.nodes(spark, d).filter("demand > 0").select("dataset_id", F.concat(
        F.lit("oks:"), F.col("src").cast("string")).alias("part"))
    return variants.tree_signature(e, t, ["dataset_id"])


# ---- windows over maps ----

@query("map_window", sql("""SELECT dataset_id, object_id FROM fx_boxes WHERE maxx >= 200 AND maxy >= 300 AND minx <= 700 AND miny <= 800""",
                         "fx_boxes"))
def map_window(spark, d):
    return windows.in_window(bridge.boxes(spark, d), 200, 300, 700, 800).select("dataset_id", "object_id")


@query("window_density", sql("""SELECT n.dataset_id, n.node_id AS window_id, count(object_id) AS objects, coalesce(sum(5 * (93 + object_id % 40)
  + 4 * (20 + object_id % 9)), 0)::BIGINT AS estimate, count(object_id) > 3 AS too_dense FROM fx_nodes n LEFT JOIN fx_boxes b
  ON b.dataset_id = n.dataset_id AND maxx >= x - 60 AND minx <= x + 60 AND maxy >= y - 60 AND miny <= y + 60 GROUP BY 1, 2""",
                             "fx_nodes", "fx_boxes"))
def window_density(spark, d):
    k = F.col("object_id")
    boxes = bridge.boxes(spark, d).withColumn("geometry_bytes", 93 + k % 40).withColumn("property_bytes", 20 + k % 9)
    wins = bridge.nodes(spark, d).select(
        "dataset_id", F.col("node_id").alias("window_id"), (F.col("x") - 60).alias("minx"), (F.col("y") - 60).alias("miny"),
        (F.col("x") + 60).alias("maxx"), (F.col("y") + 60).alias("maxy"))
    return windows.window_density(boxes, wins, max_objects=3, max_estimate=128 * 1024 * 1024)


@query("type_page", sql("""SELECT dataset_id, object_id FROM fx_boxes WHERE rule = 'road' AND object_id > 100 ORDER BY object_id LIMIT 1000""",
                        "fx_boxes"))
def type_page(spark, d):
    b = bridge.boxes(spark, d).withColumnRenamed("rule", "object_type").withColumnRenamed("object_id", "id")
    return windows.page_by_type(b, "road", 1000, after=100).select("dataset_id", F.col("id").alias("object_id"))


@query("viewport", sql("""SELECT dataset_id, object_id, n AS rank, c > 15 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
  ORDER BY CASE object_type WHEN 'source' THEN 2 WHEN 'heat_network' THEN 3 ELSE 4 END, object_id) AS n,
  count(*) OVER (PARTITION BY dataset_id) AS c FROM fx_existing) WHERE n <= 15""", "fx_existing"))
def viewport(spark, d):
    o = bridge.existing(spark, d).withColumnRenamed("object_id", "id")
    return windows.viewport(o, size=15).select(
        "dataset_id", F.col("id").alias("object_id"), F.col("rank").cast("long").alias("rank"), "truncated")


@query("variant_page", """SELECT dataset_id, variant_id, id, c > 8 AS truncated FROM (SELECT o_custkey AS dataset_id, o_orderkey % 2 AS variant_id,
  o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey,
  o_orderkey % 2) AS c FROM orders WHERE o_orderstatus <> 'P') WHERE n <= 8""")
def variant_page(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), (F.col("o_orderkey") % 2).alias("variant_id"), F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") != "P").alias("has_geometry"))
    return windows.variant_features(rows, size=8).select("dataset_id", "variant_id", "id", "truncated")


@query("dataset_extent", sql("""SELECT dataset_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM fx_boxes GROUP BY 1""",
                             "fx_boxes"))
def dataset_extent(spark, d):
    return windows.extent(bridge.boxes(spark, d))


@query("latest_per_owner", """SELECT o_custkey, o_orderkey, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
  o_orderkey DESC) AS n FROM orders) WHERE n <= 5""")
def latest_per_owner(spark, d):
    return windows.latest_per_owner(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 5).select(
        "o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("job_status", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(event_type, (ts, event_id)) IN ('click', 'view') AS interrupted FROM events GROUP BY 1""")
def job_status(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), "event_id",
                                         F.struct("ts", "event_id").alias("updated"))
    return windows.latest_status(e, "user_id", "updated", ["status", "event_id"], ["click", "view"])
