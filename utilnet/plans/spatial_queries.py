"""Spatial joins on the box, point and line views."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.operators import spatial
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.registry import query

# Exact distance from a point to a filled box, and to its outline.
_DX = "greatest(minx - x, 0, x - maxx)"
_DY = "greatest(miny - y, 0, y - maxy)"


def edge_segments(spark, d):
    lines = bridge.with_path(bridge.edges(spark, d)).select("dataset_id", "edge_id", "path")
    return geo.explode_segments(lines)


def rings(spark, d):
    return bridge.box_ring(bridge.areas(spark, d).select(
        "dataset_id", "object_id", *spatial.BOX))


def utility_segments(spark, d):
    return geo.with_box(bridge.utility_lines(spark, d).select(
        "dataset_id", "object_id", F.lit(0).alias("seq"), "x0", "y0", "x1", "y1"))


@query("bbox_pairs", sql("""SELECT p.dataset_id, point_id, object_id FROM fx_points p JOIN fx_boxes b
  ON p.dataset_id = b.dataset_id AND x >= minx - 12 AND x <= maxx + 12 AND y >= miny - 12
  AND y <= maxy + 12""", "fx_points", "fx_boxes"))
def bbox_pairs(spark, d):
    pts = spatial.as_points(bridge.points(spark, d).select("dataset_id", "point_id", "x", "y"))
    return spatial.bbox_join(pts, bridge.boxes(spark, d), 12.0).select(
        "dataset_id", F.col("a_point_id").alias("point_id"),
        F.col("b_object_id").alias("object_id"))


@query("within_distance", sql("""SELECT p.dataset_id, p.point_id, l.edge_id, round(sqrt((l.x - x0 - t * (x1 - x0))**2
  + (l.y - y0 - t * (y1 - y0))**2), 6) AS distance FROM (SELECT p.*, e.*, greatest(0, least(1,
  ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (length * length))) AS t FROM fx_points p
  JOIN fx_edges e ON e.dataset_id = p.dataset_id) l JOIN fx_points p ON p.point_id = l.point_id
  WHERE sqrt((l.x - x0 - t * (x1 - x0))**2 + (l.y - y0 - t * (y1 - y0))**2) <= 30""",
                              "fx_points", "fx_edges"))
def within_distance(spark, d):
    pts = spatial.as_points(bridge.points(spark, d).select("dataset_id", "point_id", "x", "y"))
    out = spatial.within(pts, edge_segments(spark, d), 30.0, "point_id", "edge_id")
    return out.select("dataset_id", F.col("a_point_id").alias("point_id"),
                      F.col("b_edge_id").alias("edge_id"), F.round("distance", 6).alias("distance"))


@query("nearest_objects", sql("""SELECT dataset_id, point_id, object_id, round(dist, 6) AS distance, rank FROM (
  SELECT p.dataset_id, point_id, object_id, dist, row_number() OVER (PARTITION BY point_id
  ORDER BY dist, object_id) AS rank FROM (SELECT p.dataset_id, point_id, object_id,
  sqrt((x - (minx + maxx) / 2)**2 + (y - (miny + maxy) / 2)**2) AS dist
  FROM fx_points p JOIN fx_boxes b ON b.dataset_id = p.dataset_id) p) WHERE rank <= 3""",
                              "fx_points", "fx_boxes"))
def nearest_objects(spark, d):
    pts = spatial.as_points(bridge.points(spark, d).select("dataset_id", "point_id", "x", "y"))
    centers = spatial.as_points(bridge.boxes(spark, d).select(
        "dataset_id", "object_id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y")))
    out = spatial.nearest(pts, centers, 3, "point_id", "object_id")
    return out.select("dataset_id", F.col("a_point_id").alias("point_id"),
                      F.col("b_object_id").alias("object_id"),
                      F.round("distance", 6).alias("distance"),
                      F.col("rank").cast("long").alias("rank"))


@query("building_of_point", sql("""SELECT p.dataset_id, point_id, count(object_id) AS containing,
  CASE WHEN count(object_id) = 1 THEN min(object_id) WHEN count(object_id) = 0 THEN max(oks_id) END AS building_id,
  CASE WHEN count(object_id) > 1 THEN 'AMBIGUOUS_BUILDING_ENTRY' END AS code FROM (
  SELECT p.*, n.object_id AS oks_id FROM fx_points p LEFT JOIN fx_areas n ON n.dataset_id = p.dataset_id
  AND n.object_id = point_id // 10) p
  LEFT JOIN fx_areas b ON b.dataset_id = p.dataset_id AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy
  GROUP BY 1, 2""", "fx_points", "fx_areas"))
def building_of_point(spark, d):
    pts = bridge.points(spark, d).withColumn("oks_id", bridge.div(F.col("point_id"), 10))
    return spatial.resolve_building(pts, rings(spark, d))


# Slab clipping of a two-point edge against a box: shares where it is inside.
CLIP = {
    "clip": """SELECT e.dataset_id, e.edge_id, b.object_id, b.rule, e.length, x0, y0, x1, y1,
      greatest(0, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN minx AND maxx THEN 0 ELSE 2 END
        ELSE least((minx - x0) / (x1 - x0), (maxx - x0) / (x1 - x0)) END,
        CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN miny AND maxy THEN 0 ELSE 2 END
        ELSE least((miny - y0) / (y1 - y0), (maxy - y0) / (y1 - y0)) END) AS ti,
      least(1, CASE WHEN x1 = x0 THEN 1 ELSE greatest((minx - x0) / (x1 - x0), (maxx - x0) / (x1 - x0)) END,
        CASE WHEN y1 = y0 THEN 1 ELSE greatest((miny - y0) / (y1 - y0), (maxy - y0) / (y1 - y0)) END) AS tout
      FROM fx_edges e JOIN fx_areas b ON b.dataset_id = e.dataset_id""",
    "inside": "SELECT *, ti * length AS a, tout * length AS b FROM clip WHERE (tout - ti) * length > 1e-5",
}


@query("area_passages", sql("""SELECT dataset_id, edge_id, object_id, round(a, 6) AS core_from,
  round(b, 6) AS core_to FROM inside""", "fx_edges", "fx_areas", extra=CLIP))
def area_passages(spark, d):
    out = spatial.polygon_intervals(edge_segments(spark, d), rings(spark, d))
    return out.select("dataset_id", "edge_id", "object_id",
                      F.round("core_from", 6).alias("core_from"), F.round("core_to", 6).alias("core_to"))


HITS = {
    "lh": """SELECT e.dataset_id, e.edge_id, l.object_id, l.rule, l.dn, e.length, e.x0, e.y0, e.x1, e.y1,
      (l.x0-e.x0)*(l.y1-l.y0)-(l.y0-e.y0)*(l.x1-l.x0) AS tn, (l.x0-e.x0)*(e.y1-e.y0)-(l.y0-e.y0)*(e.x1-e.x0) AS un,
      (e.x1-e.x0)*(l.y1-l.y0)-(e.y1-e.y0)*(l.x1-l.x0) AS den
      FROM fx_edges e JOIN fx_ulines l ON l.dataset_id = e.dataset_id""",
    "lx": "SELECT *, tn / den AS t FROM lh WHERE den <> 0 AND tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1",
}


@query("line_crossings", sql("""SELECT DISTINCT dataset_id, edge_id, object_id, round(t * length, 5) AS measure
  FROM lx""", "fx_edges", "fx_ulines", extra=HITS))
def line_crossings(spark, d):
    hits = spatial.line_hits(edge_segments(spark, d), utility_segments(spark, d))
    return hits.filter("NOT parallel").select(
        "dataset_id", "edge_id", "object_id", F.round("at", 5).alias("measure")).distinct()


@query("crossing_violations", sql("""SELECT a.dataset_id, a.edge_id, b.edge_id AS other_id, 'CROSSING' AS code
  FROM fx_edges a JOIN fx_edges b ON a.dataset_id = b.dataset_id AND a.edge_id < b.edge_id,
  LATERAL (SELECT (a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0) AS den,
   (b.x0-a.x0)*(a.y1-a.y0)-(b.y0-a.y0)*(a.x1-a.x0) AS un, (b.x0-a.x0)*(b.y1-b.y0)-(b.y0-a.y0)*(b.x1-b.x0) AS tn,
   ((b.x0-a.x0)*(a.x1-a.x0)+(b.y0-a.y0)*(a.y1-a.y0)) / (a.length**2) AS p,
   ((b.x1-a.x0)*(a.x1-a.x0)+(b.y1-a.y0)*(a.y1-a.y0)) / (a.length**2) AS q,
   a.start_id IN (b.start_id, b.end_id) AS s, a.end_id IN (b.start_id, b.end_id) AS e) w
  WHERE CASE WHEN den <> 0 THEN tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1 AND NOT (
      (s AND tn / den * a.length < 0.01) OR (e AND (1 - tn / den) * a.length < 0.01))
    WHEN un = 0 THEN (least(1, greatest(p, q)) - greatest(0, least(p, q))) * a.length > 0.01
      OR (least(1, greatest(p, q)) >= greatest(0, least(p, q)) AND NOT s AND NOT e)
    ELSE false END""", "fx_edges"))
def crossing_violations(spark, d):
    return spatial.crossing_violations(bridge.edges(spark, d), edge_segments(spark, d),
                                       bridge.nodes(spark, d))


@query("entry_walls", sql("""SELECT dataset_id, point_id, building_id, round(distance, 6) AS distance,
   w AS wall_length, x0, y0, x1, y1 FROM (
  SELECT *, min(distance) OVER (PARTITION BY point_id) AS m FROM (
  SELECT p.dataset_id, point_id, object_id AS building_id, s.*, maxx - minx AS w,
    CASE s.h WHEN 'x' THEN abs(x - s.x0) ELSE abs(y - s.y0) END AS distance
  FROM (SELECT p.*, count(*) OVER (PARTITION BY point_id) AS n, b.object_id, minx, miny, maxx, maxy FROM fx_points p JOIN fx_areas b
    ON b.dataset_id = p.dataset_id AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy) p,
  LATERAL (SELECT 'y' AS h, minx AS x0, miny AS y0, maxx AS x1, miny AS y1 UNION ALL
    SELECT 'x', maxx, miny, maxx, maxy UNION ALL SELECT 'y', minx, maxy, maxx, maxy UNION ALL
    SELECT 'x', minx, miny, minx, maxy) s WHERE n = 1)) WHERE distance <= m + 1e-6""",
                          "fx_points", "fx_areas"))
def entry_walls(spark, d):
    pts = bridge.points(spark, d)
    r = rings(spark, d)
    owners = (spatial.resolve_building(pts, r).filter("building_id IS NOT NULL")
              .join(pts.select("dataset_id", "point_id", "flow"), ["dataset_id", "point_id"]))
    from utilnet.functions.rules import diameter
    owners = owners.select("dataset_id", "point_id", "building_id",
                           diameter(F.col("flow")).alias("dn"))
    return spatial.entry_walls(pts, r, owners).select(
        "dataset_id", "point_id", "building_id", F.round("distance", 6).alias("distance"),
        "wall_length", "x0", "y0", "x1", "y1")


@query("terminal_crossings", sql("""SELECT DISTINCT dataset_id, point_id, round(px, 5) AS exit_x,
  round(py, 5) AS exit_y FROM (
  SELECT *, x + t * ux AS px, y + t * uy AS py FROM (SELECT *,
    least(CASE WHEN ux > 0 THEN (maxx - x) / ux WHEN ux < 0 THEN (minx - x) / ux ELSE 1e9 END,
          CASE WHEN uy > 0 THEN (maxy - y) / uy WHEN uy < 0 THEN (miny - y) / uy ELSE 1e9 END) AS t,
    least(x - minx, maxx - x, y - miny, maxy - y) AS m FROM (
  SELECT p.*, b.*, (500 - x) / dd AS ux, (500 - y) / dd AS uy, CASE WHEN flow <= 3.5 + 1e-9 THEN 0.2
     WHEN flow <= 8.3 + 1e-9 THEN 0.215 WHEN flow <= 13.2 + 1e-9 THEN 0.235 WHEN flow <= 22.3 + 1e-9 THEN 0.255
     WHEN flow <= 40.2 + 1e-9 THEN 0.3 ELSE 0.325 END AS hw
  FROM (SELECT *, count(*) OVER (PARTITION BY point_id) AS n FROM (SELECT p.point_id, p.x, p.y, p.flow, p.dataset_id,
     b.minx, b.maxx, b.miny, b.maxy, sqrt((500 - x)**2 + (500 - y)**2) AS dd FROM fx_points p JOIN fx_areas b
     ON b.dataset_id = p.dataset_id AND x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy)) b,
     LATERAL (SELECT 1) p WHERE n = 1 AND dd >= 1e-6
     AND least(x - minx, maxx - x, y - miny, maxy - y) > 0))
  WHERE t <= dd + 1e-6) WHERE maxx - minx > 2 * hw + 2e-6 AND (
   (abs(px - minx) <= 1e-6 AND x - minx <= m + 1e-6 AND py BETWEEN miny + hw - 1e-6 AND maxy - hw + 1e-6) OR
   (abs(px - maxx) <= 1e-6 AND maxx - x <= m + 1e-6 AND py BETWEEN miny + hw - 1e-6 AND maxy - hw + 1e-6) OR
   (abs(py - miny) <= 1e-6 AND y - miny <= m + 1e-6 AND px BETWEEN minx + hw - 1e-6 AND maxx - hw + 1e-6) OR
   (abs(py - maxy) <= 1e-6 AND maxy - y <= m + 1e-6 AND px BETWEEN minx + hw - 1e-6 AND maxx - hw + 1e-6))""",
                                 "fx_points", "fx_areas"))
def terminal_crossings(spark, d):
    """Straight entries from the map centre: the first wall met must be the nearest one."""
    from utilnet.functions.rules import diameter
    pts, r = bridge.points(spark, d), rings(spark, d)
    inside = spatial.contained(pts, r)
    single = inside.groupBy("dataset_id", "point_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("object_id").alias("building_id"),
        F.min("edge_distance").alias("gap")).filter("n = 1 AND gap > 1e-6")
    owners = single.join(pts, ["dataset_id", "point_id"]).select(
        "dataset_id", "point_id", "building_id", diameter(F.col("flow")).alias("dn"))
    rays = owners.join(pts, ["dataset_id", "point_id"]).select(
        "dataset_id", "point_id", F.col("point_id").alias("ray_id"), "building_id", "x", "y",
        F.lit(500.0).alias("tx"), F.lit(500.0).alias("ty"))
    walls = spatial.entry_walls(pts, r, owners)
    return spatial.terminal_crossing(rays, r, walls, "ray_id").select(
        "dataset_id", "point_id", F.round("exit_x", 5).alias("exit_x"),
        F.round("exit_y", 5).alias("exit_y"))
