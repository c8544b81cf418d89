"""Passages, sections and clearance rules on the edge, box and line views."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import passages as ops
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.registry import query
from utilnet.plans.spatial_queries import CLIP, HITS, edge_segments, utility_segments
from utilnet.session import cut

_SOFT = ", ".join(f"('{r[0]}', {r[4]}::DOUBLE, {r[5]}::DOUBLE, {r[3]}::DOUBLE, {r[8]}::DOUBLE)"
                  for r in rules.RESTRICTIONS if not r[1])


def named_rings(spark, d):
    return bridge.box_ring(bridge.areas(spark, d))


def named_lines(spark, d):
    return geo.with_box(bridge.utility_lines(spark, d).withColumn("seq", F.lit(0)))


def fx_passages(spark, d):
    # Each is read several times over.
    return ops.passages(cut(bridge.edges(spark, d)), cut(edge_segments(spark, d)), cut(named_rings(spark, d)),
                        cut(named_lines(spark, d)))


PASS = {
    **CLIP, **HITS,
    "soft": f"SELECT * FROM (VALUES {_SOFT}) AS t(rule, ext, factor, clearance, own_height)",
    "core": """SELECT dataset_id, edge_id, object_id, rule, length, a AS c0, b AS c1 FROM inside UNION ALL
      SELECT dataset_id, edge_id, object_id, rule, length, t * length, t * length FROM lx""",
    "ps": """SELECT c.*, factor, greatest(0, c0 - ext) AS s0, least(length, c1 + ext) AS s1
      FROM core c JOIN soft USING (rule)""",
}
_V = ("fx_edges", "fx_areas", "fx_ulines")


@query("passages", sql("""SELECT dataset_id, edge_id, object_id, rule, round(s0, 5) AS s_from,
  round(s1, 5) AS s_to, factor FROM ps""", *_V, extra=PASS))
def passages(spark, d):
    return fx_passages(spark, d).select(
        "dataset_id", "edge_id", "object_id", "rule", F.round("s_from", 5).alias("s_from"),
        F.round("s_to", 5).alias("s_to"), "factor")


SECT = {
    **PASS,
    "cuts": """SELECT dataset_id, edge_id, 0.0::DOUBLE AS pos FROM fx_edges UNION SELECT dataset_id, edge_id, length
      FROM fx_edges UNION SELECT dataset_id, edge_id, s0 FROM ps UNION SELECT dataset_id, edge_id, s1 FROM ps""",
    "el": """SELECT dataset_id, edge_id, pos AS f, lead(pos) OVER (PARTITION BY dataset_id, edge_id ORDER BY pos) AS t
      FROM cuts""",
    "sec": """SELECT el.dataset_id, el.edge_id, f, t, coalesce(max(factor), 1) AS factor FROM el LEFT JOIN ps
      ON ps.dataset_id = el.dataset_id AND ps.edge_id = el.edge_id AND (f + t) / 2 BETWEEN s0 AND s1
      WHERE t - f >= 1e-8 GROUP BY 1, 2, 3, 4""",
}


@query("sections", sql("""SELECT dataset_id, edge_id, round(f, 4) AS s_from, round(t, 4) AS s_to, factor
  FROM sec WHERE t - f > 1e-4""", *_V, extra=SECT))
def sections(spark, d):
    return ops.sections(bridge.edges(spark, d), fx_passages(spark, d)).filter(
        "s_to - s_from > 1e-4").select("dataset_id", "edge_id", F.round("s_from", 4).alias("s_from"),
                                       F.round("s_to", 4).alias("s_to"), "factor")


@query("merged_passages", sql("""SELECT dataset_id, edge_id, object_id, round(min(s0), 5) AS s_from,
  round(max(s1), 5) AS s_to FROM (SELECT *, sum(n) OVER (PARTITION BY dataset_id, edge_id, object_id
  ORDER BY s0, s1) AS g FROM (SELECT *, CASE WHEN s0 > max(s1) OVER (PARTITION BY dataset_id, edge_id, object_id
  ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-7 THEN 1 ELSE 0 END AS n FROM ps))
  GROUP BY dataset_id, edge_id, object_id, g""", *_V, extra=PASS))
def merged_passages(spark, d):
    return ops.merge_passages(fx_passages(spark, d)).select(
        "dataset_id", "edge_id", "object_id", F.round("s_from", 5).alias("s_from"),
        F.round("s_to", 5).alias("s_to"))


@query("entry_angles", sql("""SELECT DISTINCT dataset_id, edge_id, object_id, 'ENTRY_ANGLE' AS code FROM (
  SELECT *, x0 + ti * (x1 - x0) AS hx, y0 + ti * (y1 - y0) AS hy FROM inside i JOIN fx_areas b USING (dataset_id, object_id)
  WHERE b.rule IN ('road', 'tram_tracks')) WHERE a < 1e-5 OR a > length - 1e-5 OR
  ((least(abs(hx - minx), abs(hx - maxx)) <= 0.02) AND abs(y1 - y0) / length > sqrt(0.5) + 1e-6) OR
  ((least(abs(hy - miny), abs(hy - maxy)) <= 0.02) AND abs(x1 - x0) / length > sqrt(0.5) + 1e-6)""",
                           "fx_edges", "fx_areas", extra=CLIP))
def entry_angles(spark, d):
    e = bridge.with_path(bridge.edges(spark, d))
    return ops.steep_entries(fx_passages(spark, d), e, named_rings(spark, d))


_SIZED = {"ed": f"""SELECT f.dataset_id, f.edge_id, f.length, e.x0, e.y0, e.x1, e.y1, ({rules.DN})[dn_idx + 1] AS dn,
  ({rules.HEIGHT})[dn_idx + 1] + CASE WHEN ({rules.DN})[dn_idx + 1] <= 150 THEN 0.075 ELSE 0.125 END AS half
  FROM fx_flows f JOIN fx_edges e USING (dataset_id, edge_id)"""}
# Distance from a two-point edge to a box outline or to its inside, by the four corners and the
# two ends: exact for segments against convex boxes that do not meet.
_APART = {
    "pr": """SELECT e.*, b.object_id, b.rule, minx, miny, maxx, maxy FROM ed e JOIN fx_areas b
      ON b.dataset_id = e.dataset_id""",
    "cl2": """SELECT *, greatest(0, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN minx AND maxx THEN 0 ELSE 2 END
        ELSE least((minx - x0) / (x1 - x0), (maxx - x0) / (x1 - x0)) END,
        CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN miny AND maxy THEN 0 ELSE 2 END
        ELSE least((miny - y0) / (y1 - y0), (maxy - y0) / (y1 - y0)) END) <=
      least(1, CASE WHEN x1 = x0 THEN 1 ELSE greatest((minx - x0) / (x1 - x0), (maxx - x0) / (x1 - x0)) END,
        CASE WHEN y1 = y0 THEN 1 ELSE greatest((miny - y0) / (y1 - y0), (maxy - y0) / (y1 - y0)) END) AS meets,
      list_min([sqrt(greatest(minx - x0, 0, x0 - maxx)**2 + greatest(miny - y0, 0, y0 - maxy)**2),
        sqrt(greatest(minx - x1, 0, x1 - maxx)**2 + greatest(miny - y1, 0, y1 - maxy)**2)]) AS ends,
      list_min(list_transform([[minx, miny], [maxx, miny], [minx, maxy], [maxx, maxy]], lambda c:
        sqrt((c[1] - x0 - greatest(0, least(1, ((c[1]-x0)*(x1-x0)+(c[2]-y0)*(y1-y0))/(length*length)))*(x1-x0))**2
           + (c[2] - y0 - greatest(0, least(1, ((c[1]-x0)*(x1-x0)+(c[2]-y0)*(y1-y0))/(length*length)))*(y1-y0))**2)))
        AS corners FROM pr""",
    "ap": "SELECT *, CASE WHEN meets THEN 0 ELSE least(ends, corners) END AS apart FROM cl2",
}
_HARD = "('park','social_area','prohibited_site','water','railway','oks')"


def sized_edges(spark, d):
    from utilnet.plans.graph_queries import _flowed
    return _flowed(spark, d)


@query("hard_clearance", sql(f"""SELECT dataset_id, edge_id, object_id, 'CLEARANCE' AS code FROM ap
  WHERE rule IN {_HARD} AND apart < half + CASE WHEN rule <> 'oks' THEN 1 WHEN dn < 500 THEN 5
  WHEN dn <= 800 THEN 7 ELSE 9 END - 1e-5""", "fx_flows", "fx_areas", extra={**_SIZED, **_APART}))
def hard_clearance(spark, d):
    return ops.hard_clearance(sized_edges(spark, d), edge_segments(spark, d), named_rings(spark, d))


@query("target_clearance", sql(f"""SELECT point_id FROM fx_points p WHERE NOT EXISTS (SELECT 1 FROM fx_areas b
  WHERE b.dataset_id = p.dataset_id AND rule IN {_HARD} AND sqrt(greatest(minx - x, 0, x - maxx)**2 +
  greatest(miny - y, 0, y - maxy)**2) < CASE WHEN rule = 'oks' THEN 5 ELSE 1 END + (2 * 0.18 + 0.15) / 2 - 1e-5)""",
                              "fx_points", "fx_areas"))
def target_clearance(spark, d):
    pts = bridge.points(spark, d).select("dataset_id", "point_id", "x", "y", F.lit(100).alias("dn"))
    return ops.target_clear(pts, named_rings(spark, d)).select("point_id")


# Edges with a kink in the middle, for the rules about turns.
def kinked(spark, d):
    e = bridge.with_path(bridge.edges(spark, d))
    mid = F.struct(((F.col("x0") + F.col("x1")) / 2 + (F.col("edge_id") % 5 - 2) * 60).alias("x"),
                   ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return e.withColumn("path", F.array(F.get("path", F.lit(0)), mid, F.get("path", F.lit(1))))


KINK = {"kk": """SELECT dataset_id, edge_id, start_id, x0, y0, x1, y1, (x0 + x1) / 2 + (edge_id % 5 - 2) * 60 AS mx,
  (y0 + y1) / 2 AS my FROM fx_edges""",
        "kt": """SELECT *, acos(greatest(-1, least(1, cos(atan2(my - y0, mx - x0) - atan2(y1 - my, x1 - mx))))) AS ang
  FROM kk"""}


@query("sharp_turns", sql("""SELECT dataset_id, edge_id, 'TURN_OVER_90' AS code FROM kt
  WHERE ang > pi() / 2 + 1e-6""", "fx_edges", extra=KINK))
def sharp_turns(spark, d):
    segs = geo.explode_segments(kinked(spark, d).select("dataset_id", "edge_id", "path"))
    return ops.sharp_turns(segs).select("dataset_id", "edge_id", "code")


@query("crooked_passages", sql("""SELECT dataset_id, edge_id, 'PASSAGE_NOT_STRAIGHT' AS code FROM (
  SELECT dataset_id, edge_id, l1, l1 + l2 AS len, edge_id % 5 <> 2 AS kinked FROM (SELECT *,
  sqrt((mx-x0)**2+(my-y0)**2) AS l1, sqrt((x1-mx)**2+(y1-my)**2) AS l2 FROM kk))
  WHERE kinked AND l1 > len * 0.3 + 1e-3 AND l1 < len * 0.6 - 1e-3""", "fx_edges", extra=KINK))
def crooked_passages(spark, d):
    e = kinked(spark, d)
    size = geo.path_length(F.col("path"))
    found = e.select("dataset_id", "edge_id", F.col("edge_id").alias("object_id"),
                     (size * 0.3).alias("s_from"), (size * 0.6).alias("s_to"))
    return ops.crooked_passages(found, e).select("dataset_id", "edge_id", "code")


@query("facade_drift", sql("""SELECT dataset_id, edge_id, round(16 * greatest(0, len * sin(off) - 1), 4) AS penalty
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, edge_id ORDER BY round(gap, 6), off) AS n FROM (
  SELECT e.dataset_id, e.edge_id, e.length AS len, b.object_id,
    least(list_min(list_transform([[b.x0,b.y0],[b.x1,b.y1]], lambda c:
        sqrt((c[1]-e.x0-greatest(0,least(1,((c[1]-e.x0)*(e.x1-e.x0)+(c[2]-e.y0)*(e.y1-e.y0))/(e.length**2)))*(e.x1-e.x0))**2
        +(c[2]-e.y0-greatest(0,least(1,((c[1]-e.x0)*(e.x1-e.x0)+(c[2]-e.y0)*(e.y1-e.y0))/(e.length**2)))*(e.y1-e.y0))**2))),
      list_min(list_transform([[e.x0,e.y0],[e.x1,e.y1]], lambda c:
        sqrt((c[1]-b.x0-greatest(0,least(1,((c[1]-b.x0)*(b.x1-b.x0)+(c[2]-b.y0)*(b.y1-b.y0))/b.l2))*(b.x1-b.x0))**2
        +(c[2]-b.y0-greatest(0,least(1,((c[1]-b.x0)*(b.x1-b.x0)+(c[2]-b.y0)*(b.y1-b.y0))/b.l2))*(b.y1-b.y0))**2))),
      CASE WHEN q.den <> 0 AND q.tn / q.den BETWEEN 0 AND 1 AND q.un / q.den BETWEEN 0 AND 1 THEN 0 ELSE 1e9 END) AS gap,
    least(abs(q.dd - (pi()/2) * round_even(q.dd / (pi()/2), 0)), pi()/2 - abs(q.dd - (pi()/2) * round_even(q.dd / (pi()/2), 0))) AS off
  FROM fx_edges e JOIN (SELECT *, (x1-x0)**2 + (y1-y0)**2 AS l2 FROM fx_ulines) b ON b.dataset_id = e.dataset_id AND e.length >= 60,
  LATERAL (SELECT atan2(e.y1-e.y0, e.x1-e.x0) - atan2(b.y1-b.y0, b.x1-b.x0) AS dd,
    (b.x0-e.x0)*(b.y1-b.y0)-(b.y0-e.y0)*(b.x1-b.x0) AS tn, (b.x0-e.x0)*(e.y1-e.y0)-(b.y0-e.y0)*(e.x1-e.x0) AS un,
    (e.x1-e.x0)*(b.y1-b.y0)-(e.y1-e.y0)*(b.x1-b.x0) AS den) q)
  WHERE gap <= 40 AND off <= radians(6)) WHERE n = 1""", "fx_edges", "fx_ulines"))
def facade_drift(spark, d):
    """Long diagonals stand in for walls, so that runs have something to be parallel to."""
    return ops.facade_drift(edge_segments(spark, d), utility_segments(spark, d)).select(
        "dataset_id", "edge_id", F.round("penalty", 4).alias("penalty"))


@query("parallel_clearance")
def parallel_clearance(spark, d):
    e = sized_edges(spark, d)
    merged = cut(ops.merge_passages(fx_passages(spark, d)))
    lines = named_lines(spark, d).select("dataset_id", "object_id", "rule", "dn", "x0", "y0", "x1",
                                         "y1", *ops.spatial.BOX)
    return ops.soft_clearance(e, edge_segments(spark, d), merged, lines)


@query("headings", sql("""SELECT dataset_id, edge_id, share::BIGINT AS share, round(CASE WHEN l1 + 1e-7 >= share * (l1 + l2) / 4 THEN atan2(my - y0, mx - x0) ELSE atan2(y1 - my, x1 - mx) END, 8) AS heading
  FROM (SELECT *, sqrt((mx-x0)**2+(my-y0)**2) AS l1, sqrt((x1-mx)**2+(y1-my)**2) AS l2 FROM kk), (VALUES (0), (1), (3), (4)) v(share) WHERE share <> 2""", "fx_edges", extra=KINK))
def headings(spark, d):
    """The heading with which bent pipes arrive at their start, quarters and end."""
    e = kinked(spark, d).withColumn("share", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(4))))
    at = geo.path_length(F.col("path")) * F.col("share") / 4
    return e.select("dataset_id", "edge_id", F.col("share").cast("long").alias("share"), F.round(geo.heading_at(F.col("path"), at), 8).alias("heading"))


@query("piece_names", sql("""SELECT dataset_id, edge_id, 'tt:v1:' || edge_id || ':' || (edge_id % 3) AS part, 'tt:v1:' || edge_id || ':node:' || (edge_id % 3) AS joint FROM fx_edges""", "fx_edges"))
def piece_names(spark, d):
    """Ids of exported pieces and of the technical nodes between them."""
    from utilnet.functions import text
    name = [F.lit("tt:v1:"), F.col("edge_id"), F.col("edge_id") % 3]
    return bridge.edges(spark, d).select("dataset_id", "edge_id", text.part_id(*name).alias("part"), text.break_id(*name).alias("joint"))
