"""Entries into buildings and the integrity of stored layouts, with seeded defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import entries, graph, spatial
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.registry import query
from utilnet.session import cut

HALF, SHIFT, BEND = 6.413, 2.371, (2.3, 3.1)  # half a building, its shift towards the pipe, the bend of a pipe inside
ROUND = (20.0, 15.0)  # where a pipe turns that goes round the building to the wall behind


def served(spark, d):
    """(edges with path and size, rings of the consumers' buildings): of seven, one building is off the middle, one pipe bends
    inside and one goes round to the wall behind."""
    n = bridge.nodes(spark, d)
    e = graph.flows(n, bridge.edges(spark, d)).join(n.select("dataset_id", F.col("node_id").alias("edge_id"), "demand", "src"),
                                                   ["dataset_id", "edge_id"])
    kind = F.when(F.col("demand") > 0, F.col("src") % 7)
    ends = [F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]
    bend = F.struct((F.col("x1") + BEND[0]).alias("x"), (F.col("y1") + BEND[1]).alias("y"))
    dx, dy = F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")
    along, shift = F.abs(dx) >= F.abs(dy), F.when(kind == 3, SHIFT).otherwise(0.0)
    behind = F.struct((F.col("x1") + F.when(along, -ROUND[0] * F.signum(dx)).otherwise(ROUND[1])).alias("x"),
                      (F.col("y1") + F.when(along, ROUND[1]).otherwise(-ROUND[0] * F.signum(dy))).alias("y"))
    e = e.withColumn("path", F.when(kind == 5, F.array(ends[0], bend, ends[1])).when(
        kind == 4, F.array(ends[0], behind, ends[1])).otherwise(F.array(*ends)))
    cx = F.col("x1") + F.when(along, F.signum(dx) * shift).otherwise(0.0)
    cy = F.col("y1") + F.when(along, 0.0).otherwise(F.signum(dy) * shift)
    houses = e.filter("demand > 0").select("dataset_id", F.col("src").alias("object_id"), (cx - HALF).alias("minx"), (cy - HALF).alias("miny"),
                                           (cx + HALF).alias("maxx"), (cy + HALF).alias("maxy"))
    return cut(e.select("dataset_id", "edge_id", "path", "dn", "demand", "src", "x0", "y0", "x1", "y1")), cut(bridge.box_ring(houses))


def portals(e, rings):
    points = e.filter("demand > 0").select("dataset_id", F.col("edge_id").alias("point_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    own = spatial.resolve_building(points, rings).filter("building_id IS NOT NULL").select(
        "dataset_id", F.col("point_id").alias("edge_id"), "building_id")
    return cut(entries.entry_portals(e, own, rings))


SERVED = {
    "pipe": f"""SELECT e.dataset_id, e.edge_id, e.x0, e.y0, e.x1, e.y1, e.length, CASE WHEN n.demand > 0 THEN n.src % 7 END AS kind, n.src,
      ({rules.HEIGHT})[dn_idx + 1] + CASE WHEN ({rules.DN})[dn_idx + 1] <= 150 THEN 0.075 ELSE 0.125 END AS hw
      FROM fx_edges e JOIN fx_flows f USING (dataset_id, edge_id) JOIN fx_nodes n ON n.dataset_id = e.dataset_id AND n.node_id = e.edge_id""",
    "bent": f"""SELECT *, CASE kind WHEN 5 THEN x1 + {BEND[0]} WHEN 4 THEN x1 + CASE WHEN abs(x0 - x1) >= abs(y0 - y1) THEN -{ROUND[0]} * sign(x0 - x1) ELSE {ROUND[1]} END
      ELSE x0 END AS tx, CASE kind WHEN 5 THEN y1 + {BEND[1]} WHEN 4 THEN y1 + CASE WHEN abs(x0 - x1) >= abs(y0 - y1) THEN {ROUND[1]} ELSE -{ROUND[0]} * sign(y0 - y1) END
      ELSE y0 END AS ty FROM pipe""",
    "legs": """SELECT *, 0.0::DOUBLE AS at0, sqrt(pow(u1 - u0, 2) + pow(v1 - v0, 2)) AS l FROM (SELECT dataset_id, edge_id, x0 AS u0, y0 AS v0,
      CASE WHEN kind IN (4, 5) THEN tx ELSE x1 END AS u1, CASE WHEN kind IN (4, 5) THEN ty ELSE y1 END AS v1 FROM bent) UNION ALL
      SELECT dataset_id, edge_id, tx, ty, x1, y1, sqrt(pow(tx - x0, 2) + pow(ty - y0, 2)), sqrt(pow(tx - x1, 2) + pow(ty - y1, 2)) FROM bent WHERE kind IN (4, 5)""",
    "size": "SELECT dataset_id, edge_id, sum(l) AS len FROM legs GROUP BY 1, 2",
    "house": f"""SELECT dataset_id, src AS house, cx - {HALF} AS minx, cx + {HALF} AS maxx, cy - {HALF} AS miny, cy + {HALF} AS maxy FROM (SELECT dataset_id, src,
      x1 + CASE WHEN kind = 3 AND abs(x0 - x1) >= abs(y0 - y1) THEN sign(x0 - x1) * {SHIFT} ELSE 0 END AS cx,
      y1 + CASE WHEN kind = 3 AND abs(x0 - x1) < abs(y0 - y1) THEN sign(y0 - y1) * {SHIFT} ELSE 0 END AS cy FROM pipe WHERE kind IS NOT NULL)""",
    "own": """SELECT b.dataset_id, edge_id, min(house) AS house FROM bent b JOIN house h ON h.dataset_id = b.dataset_id
      AND x1 BETWEEN minx AND maxx AND y1 BETWEEN miny AND maxy WHERE kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1""",
    "ray": """SELECT *, least(CASE WHEN ux > 0 THEN (maxx - x1) / ux WHEN ux < 0 THEN (minx - x1) / ux ELSE 1e9 END,
      CASE WHEN uy > 0 THEN (maxy - y1) / uy WHEN uy < 0 THEN (miny - y1) / uy ELSE 1e9 END) AS t, least(x1 - minx, maxx - x1, y1 - miny, maxy - y1) AS m
      FROM (SELECT b.*, own.house, minx, maxx, miny, maxy, dd, (tx - x1) / dd AS ux, (ty - y1) / dd AS uy FROM (SELECT *, sqrt(pow(tx - x1, 2) + pow(ty - y1, 2)) AS dd FROM bent) b
      JOIN own USING (dataset_id, edge_id) JOIN house h ON h.dataset_id = own.dataset_id AND h.house = own.house)""",
    "win": f"""SELECT r.*, w0, z0, w1, z1, x1 + t * ux AS px, y1 + t * uy AS py FROM ray r, LATERAL (
      SELECT minx + hw AS w0, miny AS z0, maxx - hw AS w1, miny AS z1, y1 - miny AS far UNION ALL SELECT minx + hw, maxy, maxx - hw, maxy, maxy - y1
      UNION ALL SELECT minx, miny + hw, minx, maxy - hw, x1 - minx UNION ALL SELECT maxx, miny + hw, maxx, maxy - hw, maxx - x1) s
      WHERE s.far <= m + 1e-6 AND {2 * HALF} > 2 * hw + 2e-6""",
    "gate": """SELECT *, sqrt(pow(x0 - greatest(w0, least(w1, x0)), 2) + pow(y0 - greatest(z0, least(z1, y0)), 2)) AS net,
      t <= dd + 1e-6 AND sqrt(pow(px - greatest(w0, least(w1, px)), 2) + pow(py - greatest(z0, least(z1, py)), 2)) <= 1e-6 AS open FROM win""",
    "door": """SELECT dataset_id, edge_id, house, src, kind, px, py, t, m, min(net) AS nearest, min(net) FILTER (open) AS chosen FROM gate
      GROUP BY ALL HAVING bool_or(open)""",
    "span": """SELECT dataset_id, edge_id, house, at0 + greatest(0, ax, ay) * l AS a, at0 + least(1, bx, by_) * l AS b FROM (SELECT g.*, house,
      CASE WHEN u1 = u0 THEN CASE WHEN u0 BETWEEN minx AND maxx THEN 0 ELSE 2 END ELSE least((minx - u0) / (u1 - u0), (maxx - u0) / (u1 - u0)) END AS ax,
      CASE WHEN u1 = u0 THEN 1 ELSE greatest((minx - u0) / (u1 - u0), (maxx - u0) / (u1 - u0)) END AS bx,
      CASE WHEN v1 = v0 THEN CASE WHEN v0 BETWEEN miny AND maxy THEN 0 ELSE 2 END ELSE least((miny - v0) / (v1 - v0), (maxy - v0) / (v1 - v0)) END AS ay,
      CASE WHEN v1 = v0 THEN 1 ELSE greatest((miny - v0) / (v1 - v0), (maxy - v0) / (v1 - v0)) END AS by_
      FROM legs g JOIN house h ON h.dataset_id = g.dataset_id) WHERE (least(1, bx, by_) - greatest(0, ax, ay)) * l > 1e-5""",
    "over": """SELECT s.dataset_id, s.edge_id, s.house, max(CASE WHEN d.t IS NULL THEN b - a ELSE greatest(0, least(b, len - t) - a) END) AS rest, any_value(d.kind) AS kind
      FROM span s JOIN size USING (dataset_id, edge_id) LEFT JOIN door d ON d.dataset_id = s.dataset_id AND d.edge_id = s.edge_id AND d.house = s.house GROUP BY 1, 2, 3""",
}


@query("entry_violations", sql("""SELECT dataset_id, edge_id, house AS object_id, 'BUILDING_INTERSECTION' AS code FROM over WHERE rest > 2e-6
  UNION ALL SELECT dataset_id, edge_id, house, 'BUILDING_ENTRY_INVALID' FROM own ANTI JOIN door USING (dataset_id, edge_id)
  UNION ALL SELECT dataset_id, edge_id, house, 'BUILDING_ENTRY_WALL' FROM over WHERE rest <= 2e-6 AND kind = 2""", "fx_flows", extra=SERVED))
def entry_violations(spark, d):
    """All pipes against all buildings; every seventh entry is assigned a wall it does not use."""
    e, rings = served(spark, d)
    found = portals(e, rings)
    segments = cut(geo.explode_segments(e.select("dataset_id", "edge_id", "path")))
    far = e.filter("demand > 0 AND src % 7 = 2").select(
        "dataset_id", "edge_id", (F.col("x1") + 100).alias("wall_x0"), F.col("y1").alias("wall_y0"),
        (F.col("x1") + 101).alias("wall_x1"), F.col("y1").alias("wall_y1"))
    own = found.join(e.filter("src % 7 <> 2").select("dataset_id", "edge_id"), ["dataset_id", "edge_id"]).select(
        "dataset_id", "edge_id", *[F.col(f"window_{c}").alias(f"wall_{c}") for c in ("x0", "y0", "x1", "y1")])
    return entries.entry_violations(e, segments, rings, found, far.unionByName(own))


@query("entry_report", sql("""SELECT dataset_id, edge_id, house AS building_id, round(px, 5) AS portal_x, round(py, 5) AS portal_y, round(t, 5) AS indoor,
  round(m, 5) AS reference, round(chosen, 5) AS wall_to_network, round(nearest, 5) AS nearest_to_network, chosen - nearest <= 1e-4 AS faces_network,
  round(8 * greatest(0, chosen - nearest), 4) AS wall_metres FROM door""", "fx_flows", extra=SERVED))
def entry_report(spark, d):
    e, rings = served(spark, d)
    return entries.entry_report(portals(e, rings)).select(
        "dataset_id", "edge_id", "building_id", *[F.round(c, 5).alias(c) for c in (
            "portal_x", "portal_y", "indoor", "reference", "wall_to_network", "nearest_to_network")], "faces_network",
        F.round("wall_metres", 4).alias("wall_metres"))


@query("wall_penalties", sql("""SELECT dataset_id, round(sum(t), 4) AS indoor_length, round(sum(8 * greatest(0, chosen - nearest)), 3) AS wall_metres
  FROM door GROUP BY 1""", "fx_flows", extra=SERVED))
def wall_penalties(spark, d):
    e, rings = served(spark, d)
    return entries.wall_penalty(entries.entry_report(portals(e, rings))).select(
        "dataset_id", F.round("indoor_length", 4).alias("indoor_length"), F.round("wall_metres", 3).alias("wall_metres"))


# ---- stored layouts against the map ----
KINDS = 13  # each map has the defect of its number modulo this


def stored(spark, d):
    """(nodes, edges, entries, sources): the trees as stored layouts, with one defect a map."""
    n = bridge.nodes(spark, d).withColumn("k", F.col("dataset_id") % KINDS)
    node, kind = F.col("node_id"), F.col("k")

    def at(number, place):
        return (kind == number) & (node == place)

    pipe = F.concat(F.lit("P"), F.col("dataset_id").cast("string"))
    entry = F.when(at(1, 14), 999999).when(at(2, 14), F.col("src") + 1).when((F.col("node_type") == "oks") & (F.col("src") % 29 != 3), F.col("src"))
    nodes = n.select("dataset_id", "node_id", F.when(at(5, 5), "valve").otherwise(F.col("node_type")).alias("node_type"),
                     (F.col("x") + F.when(at(4, 14), 0.01).otherwise(0.0)).alias("x"), "y",
                     F.when(at(6, 0), "Z").when(at(12, 0), F.concat(F.lit("R"), F.col("dataset_id").cast("string"))).when(
                         (node == 0) | at(8, 5), pipe).alias("existing_id"), entry.cast("long").alias("entry_id"))
    e = bridge.with_path(bridge.edges(spark, d)).withColumn("k", F.col("dataset_id") % KINDS)
    point = lambda p, by=0.0: F.struct((F.col(f"x{p}") + by).alias("x"), F.col(f"y{p}").alias("y"))
    leaf = F.col("edge_id") == 14
    path = (F.when((F.col("k") == 9) & leaf, F.array(point(0, 0.002), point(1))).when((F.col("k") == 11) & leaf, F.array(point(1), point(1)))
            .otherwise(F.col("path")))
    end = F.when((F.col("k") == 10) & leaf, 777).otherwise(F.col("end_id")).cast("long")
    edges = e.withColumn("path", path).withColumn("end_id", end).select("dataset_id", "edge_id", "start_id", "end_id", "path")
    pair = bridge.nodes(spark, d).filter(f"dataset_id % {KINDS} = 3 AND node_id IN (14, 15)").groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct("node_id", "x", "y"))).alias("p")).filter("size(p) = 2")
    more = pair.select("dataset_id", F.lit(900).cast("long").alias("edge_id"), F.lit(14).cast("long").alias("start_id"),
                       F.lit(15).cast("long").alias("end_id"), F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("path"))
    edges = edges.unionByName(more).withColumn("length", geo.path_length(F.col("path")))
    wanted = bridge.nodes(spark, d).filter("demand > 0").select("dataset_id", F.col("src").alias("entry_id"), "x", "y")
    tie = n.filter("node_id = 0")
    y = F.col("y") + F.when(kind == 7, 0.02).otherwise(0.0)
    shape = F.array(F.struct((F.col("x") - 10).alias("x"), y.alias("y")), F.struct((F.col("x") + 30).alias("x"), y.alias("y")))
    lines = [tie.select("dataset_id", F.concat(F.lit(mark), F.col("dataset_id").cast("string")).alias("object_id"),
                        F.lit(name).alias("object_type"), shape.alias("path")) for mark, name in (("P", "heat_network"), ("R", "restriction"))]
    return cut(nodes), cut(edges), wanted, cut(geo.explode_segments(lines[0].unionByName(lines[1])))


STORED = {
    "nd": f"""SELECT *, CASE WHEN k = 1 AND node_id = 14 THEN 999999 WHEN k = 2 AND node_id = 14 THEN src + 1 WHEN node_id >= 13 AND src % 29 <> 3 THEN src END AS entry,
      k = 4 AND node_id = 14 AS moved FROM (SELECT *, dataset_id % {KINDS} AS k FROM fx_nodes)""",
    "ed": f"""SELECT dataset_id, edge_id, start_id, CASE WHEN dataset_id % {KINDS} = 10 AND edge_id = 14 THEN 777 ELSE end_id END AS end_id FROM fx_edges
      UNION ALL SELECT dataset_id, 900, 14, 15 FROM nd WHERE k = 3 AND node_id IN (14, 15) GROUP BY 1 HAVING count(*) = 2""",
    "ends": "SELECT dataset_id, start_id AS node_id, 1 AS out FROM ed UNION ALL SELECT dataset_id, end_id, 0 FROM ed",
}


@query("layout_audit", sql(f"""SELECT n.dataset_id, n.node_id::VARCHAR AS object_id, CASE WHEN u.src IS NULL THEN 'UNKNOWN_ENTRY' ELSE 'ENTRY_MOVED' END AS code
  FROM nd n LEFT JOIN fx_nodes u ON u.dataset_id = n.dataset_id AND u.src = n.entry AND u.demand > 0 WHERE n.node_type = 'oks' AND (u.src IS NULL OR n.moved OR u.src <> n.src)
  UNION ALL SELECT n.dataset_id, node_id::VARCHAR, 'REPEATED_ENTRY' FROM nd n JOIN (SELECT dataset_id, entry FROM nd WHERE node_type = 'oks' AND entry IS NOT NULL
    GROUP BY 1, 2 HAVING count(*) > 1) USING (dataset_id, entry) WHERE node_type = 'oks'
  UNION ALL SELECT n.dataset_id, n.node_id::VARCHAR, 'NOT_A_LEAF' FROM nd n LEFT JOIN ends USING (dataset_id, node_id) WHERE node_type = 'oks'
    GROUP BY 1, 2 HAVING count(out) <> 1 OR coalesce(sum(out), 0) > 0
  UNION ALL SELECT dataset_id, src::VARCHAR, 'ENTRY_MISSING' FROM fx_nodes u WHERE demand > 0 AND NOT EXISTS (FROM nd WHERE nd.dataset_id = u.dataset_id AND nd.entry = u.src AND node_type = 'oks')
  UNION ALL SELECT dataset_id, '0', CASE WHEN k = 7 THEN 'TIE_OFF_SOURCE' ELSE 'UNKNOWN_SOURCE' END FROM nd WHERE node_id = 0 AND k IN (6, 7, 12)
  UNION ALL SELECT dataset_id, '5', CASE k WHEN 5 THEN 'UNKNOWN_NODE_TYPE' ELSE 'FOREIGN_TIE' END FROM nd WHERE node_id = 5 AND k IN (5, 8)
  UNION ALL SELECT dataset_id, edge_id::VARCHAR, 'EDGE_NODE_MISSING' FROM ed WHERE end_id = 777
  UNION ALL SELECT e.dataset_id, '14', c FROM fx_edges e, (VALUES (4, 'EDGE_OFF_END'), (9, 'EDGE_OFF_START'), (11, 'EDGE_EMPTY'), (11, 'EDGE_OFF_START')) v(k, c)
    WHERE edge_id = 14 AND e.dataset_id % {KINDS} = v.k""", "fx_edges", extra=STORED))
def layout_audit(spark, d):
    """Stored layouts against the map and their own geometry, one seeded defect a map."""
    return entries.layout_violations(*stored(spark, d))


@query("tie_places", sql(f"""SELECT dataset_id, 0::BIGINT AS node_id, 10.0::DOUBLE AS at FROM nd WHERE node_id = 0 AND k NOT IN (6, 7)""", "fx_nodes", extra={"nd": STORED["nd"]}))
def tie_places(spark, d):
    """Where on their old object the ties of stored layouts lie."""
    nodes, _, _, sources = stored(spark, d)
    return entries.ties_on_sources(nodes, sources).select("dataset_id", "node_id", F.round("at", 6).alias("at"))
