"""Descriptors of candidate connections over the trees, their buildings and obstacles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import candidates, graph, spatial
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.entry_queries import HALF, SERVED, served
from utilnet.plans.passage_queries import _HARD, named_lines, named_rings
from utilnet.plans.registry import query
from utilnet.session import cut

SOFT_AREAS = ("road", "tram_tracks")


def proposals(spark, d, rings):
    """One candidate a consumer: to the node its pipe comes from, which is old for the first level."""
    e = graph.flows(bridge.nodes(spark, d), bridge.edges(spark, d))
    above = bridge.edges(spark, d).select("dataset_id", F.col("end_id").alias("start_id"), geo.bearing(
        F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("axis"))
    n = bridge.nodes(spark, d).filter("demand > 0").select("dataset_id", F.col("node_id").alias("edge_id"), "demand", "src")
    points = n.join(e, ["dataset_id", "edge_id"]).select("dataset_id", F.col("edge_id").alias("point_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    own = spatial.resolve_building(points, rings).select("dataset_id", F.col("point_id").alias("edge_id"), F.col("building_id"))
    return (e.join(n, ["dataset_id", "edge_id"]).join(above, ["dataset_id", "start_id"], "left").join(own, ["dataset_id", "edge_id"])
            .select("dataset_id", F.col("edge_id").alias("cand_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x0").alias("tx"),
                    F.col("y0").alias("ty"), "axis", "dn", "flow", (F.col("start_id") < 5).alias("existing"), (F.col("start_id") >= 5).alias("edge_target"),
                    (F.col("demand") / 10).alias("lower_score"), (F.col("edge_id") % 10).alias("connected"),
                    (1 + F.col("dataset_id") % 3).alias("roots"), "building_id"))


_W = "({0})[dn_idx + 1] + CASE WHEN ({1})[dn_idx + 1] <= 150 THEN 0.075 ELSE 0.125 END".format(rules.HEIGHT, rules.DN)
_CLIP = """greatest(0, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN minx AND maxx THEN 0 ELSE 2 END ELSE least((minx - x0) / (x1 - x0), (maxx - x0) / (x1 - x0)) END,
   CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN miny AND maxy THEN 0 ELSE 2 END ELSE least((miny - y0) / (y1 - y0), (maxy - y0) / (y1 - y0)) END) AS ta,
   least(1, CASE WHEN x1 = x0 THEN 1 ELSE greatest((minx - x0) / (x1 - x0), (maxx - x0) / (x1 - x0)) END,
   CASE WHEN y1 = y0 THEN 1 ELSE greatest((miny - y0) / (y1 - y0), (maxy - y0) / (y1 - y0)) END) AS tb"""
_CORNER = "sqrt(pow(c[1] - x0 - greatest(0, least(1, ((c[1]-x0)*(x1-x0)+(c[2]-y0)*(y1-y0))/(length*length)))*(x1-x0), 2) + " \
          "pow(c[2] - y0 - greatest(0, least(1, ((c[1]-x0)*(x1-x0)+(c[2]-y0)*(y1-y0))/(length*length)))*(y1-y0), 2))"
PROPOSED = {
    "pipe": SERVED["pipe"], "house": SERVED["house"], "bent": "SELECT *, x0 AS tx, y0 AS ty FROM pipe", "own": SERVED["own"],
    "cand": f"""SELECT f.dataset_id, f.edge_id, e.x1 AS px, e.y1 AS py, e.x0 AS qx, e.y0 AS qy, f.length, f.flow, f.dn_idx, {_W} AS hw, f.start_id,
      atan2(u.y1 - u.y0, u.x1 - u.x0) AS axis, n.demand, n.src, o.house FROM fx_flows f JOIN fx_edges e USING (dataset_id, edge_id)
      JOIN fx_nodes n ON n.dataset_id = f.dataset_id AND n.node_id = f.edge_id AND n.demand > 0
      LEFT JOIN fx_edges u ON u.dataset_id = f.dataset_id AND u.end_id = f.start_id LEFT JOIN own o ON o.dataset_id = f.dataset_id AND o.edge_id = f.edge_id""",
    "solid": f"""SELECT dataset_id, 'H' || house AS object_id, house, minx, maxx, miny, maxy FROM house UNION ALL
      SELECT dataset_id, 'A' || object_id, NULL, minx, maxx, miny, maxy FROM fx_areas WHERE rule IN {_HARD}""",
    "near": """SELECT *, CASE WHEN ta <= tb THEN 0 ELSE least(ends, corners) END AS apart FROM (SELECT c.dataset_id, c.edge_id, dn_idx, hw, length, x0, y0, x1, y1, s.*
      EXCLUDE (dataset_id), """ + _CLIP + """, least(sqrt(pow(greatest(minx - x0, 0, x0 - maxx), 2) + pow(greatest(miny - y0, 0, y0 - maxy), 2)),
        sqrt(pow(greatest(minx - x1, 0, x1 - maxx), 2) + pow(greatest(miny - y1, 0, y1 - maxy), 2))) AS ends,
      list_min(list_transform([[minx, miny], [maxx, miny], [minx, maxy], [maxx, maxy]], lambda c: """ + _CORNER + """)) AS corners
      FROM (SELECT *, px AS x0, py AS y0, qx AS x1, qy AS y1, house AS home FROM cand) c JOIN solid s ON s.dataset_id = c.dataset_id
      AND (c.home IS NULL OR s.house IS NULL OR s.house <> c.home)
      AND minx - 20 <= greatest(x0, x1) AND maxx + 20 >= least(x0, x1) AND miny - 20 <= greatest(y0, y1) AND maxy + 20 >= least(y0, y1))""",
    "hitn": f"""SELECT *, apart <= CASE WHEN ({rules.DN})[dn_idx + 1] < 500 THEN 5 WHEN ({rules.DN})[dn_idx + 1] <= 800 THEN 7 ELSE 9 END + hw AS hit,
      list_transform([[minx, miny], [maxx, miny], [minx, maxy], [maxx, maxy]], lambda c: (-(c[1] - x0) * (y1 - y0) + (c[2] - y0) * (x1 - x0)) / length) AS off FROM near""",
    "obst": """SELECT dataset_id, edge_id, count(*) AS nearby, count(*) FILTER (hit) AS hits, coalesce(sum((tb - ta) * length) FILTER ((tb - ta) * length > 1e-5), 0) AS inlen,
      coalesce(max(least(-list_min(off), list_max(off))) FILTER (hit AND list_min(off) <= 0 AND list_max(off) >= 0), 0) AS bypass FROM hitn GROUP BY 1, 2""",
    "occ": """SELECT c.dataset_id, c.edge_id, count(*) AS n FROM cand c JOIN fx_edges e ON e.dataset_id = c.dataset_id AND e.edge_id < 13,
      LATERAL (SELECT (qx-px)*(e.y1-e.y0)-(qy-py)*(e.x1-e.x0) AS den, (e.x0-px)*(e.y1-e.y0)-(e.y0-py)*(e.x1-e.x0) AS tn, (e.x0-px)*(qy-py)-(e.y0-py)*(qx-px) AS un,
        ((e.x0-px)*(qx-px)+(e.y0-py)*(qy-py)) / (c.length*c.length) AS p, ((e.x1-px)*(qx-px)+(e.y1-py)*(qy-py)) / (c.length*c.length) AS q) w
      WHERE CASE WHEN den <> 0 THEN tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1 WHEN un = 0 THEN least(1, greatest(p, q)) >= greatest(0, least(p, q)) ELSE false END GROUP BY 1, 2""",
    "sft": """SELECT dataset_id, edge_id, count(*) AS n FROM (SELECT c.dataset_id, c.edge_id FROM cand c JOIN fx_ulines e ON e.dataset_id = c.dataset_id,
      LATERAL (SELECT (qx-px)*(e.y1-e.y0)-(qy-py)*(e.x1-e.x0) AS den, (e.x0-px)*(e.y1-e.y0)-(e.y0-py)*(e.x1-e.x0) AS tn, (e.x0-px)*(qy-py)-(e.y0-py)*(qx-px) AS un,
        ((e.x0-px)*(qx-px)+(e.y0-py)*(qy-py)) / (c.length*c.length) AS p, ((e.x1-px)*(qx-px)+(e.y1-py)*(qy-py)) / (c.length*c.length) AS q) w
      WHERE CASE WHEN den <> 0 THEN tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1 WHEN un = 0 THEN least(1, greatest(p, q)) >= greatest(0, least(p, q)) ELSE false END
      UNION ALL SELECT dataset_id, edge_id FROM (SELECT c.dataset_id, c.edge_id, """ + _CLIP + f""" FROM (SELECT *, px AS x0, py AS y0, qx AS x1, qy AS y1 FROM cand) c
      JOIN fx_areas s ON s.dataset_id = c.dataset_id AND rule IN {SOFT_AREAS}) WHERE ta <= tb) GROUP BY 1, 2""",
    "gray": f"""SELECT *, least(CASE WHEN ux > 0 THEN (maxx - px) / ux WHEN ux < 0 THEN (minx - px) / ux ELSE 1e9 END,
      CASE WHEN uy > 0 THEN (maxy - py) / uy WHEN uy < 0 THEN (miny - py) / uy ELSE 1e9 END) AS t, least(px - minx, maxx - px, py - miny, maxy - py) AS m FROM (
      SELECT c.*, minx, maxx, miny, maxy, way, CASE WHEN way < 8 THEN cos(coalesce(axis, 0) + way * {math.pi} / 4) ELSE (qx - px) / length END AS ux,
      CASE WHEN way < 8 THEN sin(coalesce(axis, 0) + way * {math.pi} / 4) ELSE (qy - py) / length END AS uy FROM cand c JOIN house h ON h.dataset_id = c.dataset_id AND h.house = c.house,
      (SELECT unnest(range(9)) AS way) w)""",
    "gwin": f"""SELECT r.*, sqrt(pow(qx - greatest(w0, least(w1, qx)), 2) + pow(qy - greatest(z0, least(z1, qy)), 2)) AS far,
      sqrt(pow(px + t * ux - greatest(w0, least(w1, px + t * ux)), 2) + pow(py + t * uy - greatest(z0, least(z1, py + t * uy)), 2)) <= 1e-6 AS open FROM gray r, LATERAL (
      SELECT minx + hw AS w0, miny AS z0, maxx - hw AS w1, miny AS z1, py - miny AS d UNION ALL SELECT minx + hw, maxy, maxx - hw, maxy, maxy - py
      UNION ALL SELECT minx, miny + hw, minx, maxy - hw, px - minx UNION ALL SELECT maxx, miny + hw, maxx, maxy - hw, maxx - px) s WHERE s.d <= m + 1e-6 AND {2 * HALF} > 2 * hw + 2e-6""",
    "gfeat": f"""SELECT dataset_id, edge_id, min(far) AS wd, {2 * HALF} - 2 * any_value(hw) AS wl, count(DISTINCT way) FILTER (open AND way < 8) AS open8,
      count(DISTINCT way) FILTER (open AND way = 8) AS vis FROM gwin GROUP BY 1, 2""",
}


@query("candidate_features", sql(f"""SELECT c.dataset_id, c.edge_id AS cand_id, pos - 1 AS pos, round([length / 100, length * (abs(cos(dl)) + abs(sin(dl))) / 100, abs(sin(2 * dl)),
  ({rules.DN})[dn_idx + 1] / 300, flow / ({rules.CAPACITY})[dn_idx + 1], (start_id < 5)::INT, (start_id >= 5)::INT, demand / 10 / (c.edge_id % 10 + 1), c.edge_id % 10 / 20,
  (1 + c.dataset_id % 3) / 8, coalesce(wd, 0) / 20, coalesce(wl, 0) / 50, coalesce(open8, 8) / 8, coalesce(vis, 1), CASE WHEN wd IS NULL THEN 0 ELSE 5 / 50 END,
  coalesce(hits, 0) / 10, coalesce(inlen, 0) / 100, coalesce(bypass, 0) / 100, coalesce(nearby, 0) / 20, coalesce(occ.n, 0) / 5, coalesce(sft.n, 0) / 10,
  length / ({rules.RUN_LIMIT})[least(18, dn_idx + 2)]][pos], 5)::DOUBLE + 0.0::DOUBLE AS value
  FROM (SELECT *, CASE WHEN axis IS NULL THEN 0 ELSE atan2(qy - py, qx - px) - axis END AS dl FROM cand) c LEFT JOIN gfeat USING (dataset_id, edge_id)
  LEFT JOIN obst USING (dataset_id, edge_id) LEFT JOIN occ USING (dataset_id, edge_id) LEFT JOIN sft USING (dataset_id, edge_id), (SELECT unnest(range(1, 23)) AS pos) w""",
                                 "fx_flows", "fx_areas", "fx_ulines", extra=PROPOSED))
def candidate_features(spark, d):
    """The whole descriptor of every consumer's candidate, one row a component."""
    _, rings = served(spark, d)
    cands = cut(proposals(spark, d, rings))
    houses = rings.withColumn("object_id", F.concat(F.lit("H"), F.col("object_id").cast("string")))
    cands = cands.withColumn("building_id", F.concat(F.lit("H"), F.col("building_id").cast("string")))
    areas = named_rings(spark, d).withColumn("object_id", F.concat(F.lit("A"), F.col("object_id").cast("string")))
    shape = ["dataset_id", "object_id", "x0", "y0", "x1", "y1", *spatial.BOX]
    hard = cut(houses.select(*shape).unionByName(areas.filter(f"rule IN {_HARD}").select(*shape)))
    pipes = cut(geo.with_box(bridge.edges(spark, d).filter("edge_id < 13").select("dataset_id", F.col("edge_id").alias("object_id"), "x0", "y0", "x1", "y1")))
    lines = cut(named_lines(spark, d).select(*shape))
    soft = cut(areas.filter(f"rule IN {SOFT_AREAS}").select(*shape))
    lines = lines.withColumn("object_id", F.col("object_id").cast("string"))
    found = candidates.candidate_features(cands, hard, houses, pipes, lines, soft)
    return found.select("dataset_id", "cand_id", F.posexplode("features").alias("pos", "value")).select(
        "dataset_id", "cand_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query("context_features", sql("""SELECT c.dataset_id, c.state::BIGINT AS state_id, c.node_id AS cand_id, pos - 1 AS pos, round([done / required, c.demand / total,
  coalesce(least, 0) / 100, coalesce(mean, 0) / 300, coalesce(near, 0), coalesce(corr, 0), coalesce(f, 0) / 100, c.state / required, coalesce(nb, 0) / 100, required / 20][pos], 5)::DOUBLE AS value
  FROM (SELECT n.*, p.x AS tx, p.y AS ty, state FROM fx_nodes n JOIN fx_nodes p ON p.dataset_id = n.dataset_id AND p.node_id = n.parent_id, (VALUES (3), (5)) s(state) WHERE n.demand > 0) c
  JOIN (SELECT dataset_id, count(*) AS required, sum(demand) AS total FROM fx_nodes WHERE demand > 0 GROUP BY 1) t USING (dataset_id)
  JOIN (SELECT dataset_id, state, count(*) FILTER (src % state = 1) AS done FROM fx_nodes, (VALUES (3), (5)) s(state) WHERE demand > 0 GROUP BY 1, 2) k
    ON k.dataset_id = c.dataset_id AND k.state = c.state LEFT JOIN LATERAL (SELECT min(d) AS least, avg(d) AS mean, avg((d <= 100)::INT) AS near, avg((b <= 60)::INT) AS corr,
    sum(demand) AS f, min(e) AS nb FROM (SELECT o.demand, sqrt(pow(o.x - c.tx, 2) + pow(o.y - c.ty, 2)) AS d, sqrt(pow(o.x - c.x, 2) + pow(o.y - c.y, 2)) AS e,
      sqrt(pow(o.x - c.x - g * (c.tx - c.x), 2) + pow(o.y - c.y - g * (c.ty - c.y), 2)) AS b FROM fx_nodes o,
      LATERAL (SELECT greatest(0, least(1, ((o.x - c.x) * (c.tx - c.x) + (o.y - c.y) * (c.ty - c.y)) / (pow(c.tx - c.x, 2) + pow(c.ty - c.y, 2)))) AS g) z
      WHERE o.dataset_id = c.dataset_id AND o.demand > 0 AND o.src % c.state <> 1 AND o.src <> c.src)) r ON true, (SELECT unnest(range(1, 11)) AS pos) w""", "fx_nodes"))
def context_features(spark, d):
    """The map's remaining consumers around every candidate, in two states of each network."""
    n = bridge.nodes(spark, d)
    users = n.filter("demand > 0").select("dataset_id", F.col("src").alias("demand_id"), "x", "y", F.col("demand").alias("flow"))
    states = F.explode(F.array(F.lit(3), F.lit(5))).alias("state_id")
    up = n.select("dataset_id", F.col("node_id").alias("parent_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    cands = n.filter("demand > 0").join(up, ["dataset_id", "parent_id"]).select(
        "dataset_id", states, F.col("node_id").alias("cand_id"), F.col("src").alias("demand_id"), "x", "y", "tx", "ty").withColumn(
        "score", F.col("state_id").cast("double"))
    done = users.select("dataset_id", states, "demand_id").filter("demand_id % state_id = 1")
    found = candidates.context_features(cands, users, done)
    return found.select("dataset_id", F.col("state_id").cast("long").alias("state_id"), "cand_id", F.posexplode("context").alias("pos", "value")).select(
        "dataset_id", "state_id", "cand_id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value"))
