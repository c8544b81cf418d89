"""Straight chords of bent pipes against every rule, and candidates for new ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators import routes, ties
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.evaluate_queries import _TP
from utilnet.plans.passage_queries import _APART, _HARD, _SIZED, KINK, kinked, named_rings, sized_edges
from utilnet.plans.registry import query
from utilnet.plans.spatial_queries import CLIP
from utilnet.session import cut


def bent(spark, d):
    return cut(kinked(spark, d).join(sized_edges(spark, d).select("dataset_id", "edge_id", "dn"), ["dataset_id", "edge_id"])
               .select("dataset_id", "edge_id", "start_id", "end_id", "path", "dn"))


CHORDS = {
    **_SIZED, **_APART, **CLIP, **KINK,
    "part": """SELECT dataset_id, edge_id, x0, y0, mx AS x1, my AS y1 FROM kk UNION ALL SELECT dataset_id, edge_id, mx, my, x1, y1 FROM kk""",
    "why": f"""SELECT dataset_id, edge_id, object_id, 4 AS r, 'CLEARANCE' AS code FROM ap
      WHERE rule IN {_HARD} AND apart < half + CASE WHEN rule <> 'oks' THEN 1 WHEN dn < 500 THEN 5 WHEN dn <= 800 THEN 7 ELSE 9 END - 1e-5
      UNION SELECT dataset_id, edge_id, object_id, 5, 'ENTRY_ANGLE' FROM (
      SELECT *, x0 + ti * (x1 - x0) AS hx, y0 + ti * (y1 - y0) AS hy FROM inside i JOIN fx_areas b USING (dataset_id, object_id)
      WHERE b.rule IN ('road', 'tram_tracks')) WHERE a < 1e-5 OR a > length - 1e-5 OR
      ((least(abs(hx - minx), abs(hx - maxx)) <= 0.02) AND abs(y1 - y0) / length > sqrt(0.5) + 1e-6) OR
      ((least(abs(hy - miny), abs(hy - maxy)) <= 0.02) AND abs(x1 - x0) / length > sqrt(0.5) + 1e-6)
      UNION SELECT a.dataset_id, a.edge_id, b.edge_id, 6, 'CROSSES_BRANCH' FROM fx_edges a JOIN part b ON a.dataset_id = b.dataset_id AND a.edge_id <> b.edge_id,
      LATERAL (SELECT (a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0) AS den, (b.x0-a.x0)*(a.y1-a.y0)-(b.y0-a.y0)*(a.x1-a.x0) AS un,
        (b.x0-a.x0)*(b.y1-b.y0)-(b.y0-a.y0)*(b.x1-b.x0) AS tn, ((b.x0-a.x0)*(a.x1-a.x0)+(b.y0-a.y0)*(a.y1-a.y0)) / pow(a.length, 2) AS p,
        ((b.x1-a.x0)*(a.x1-a.x0)+(b.y1-a.y0)*(a.y1-a.y0)) / pow(a.length, 2) AS q) w
      WHERE CASE WHEN den <> 0 THEN tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1 AND tn / den * a.length > 0.01 AND (1 - tn / den) * a.length > 0.01
        WHEN un = 0 THEN least(1, greatest(p, q)) - greatest(0, least(p, q)) > 0 ELSE false END""",
}


@query("chord_reasons", sql("SELECT DISTINCT dataset_id, edge_id, object_id::VARCHAR AS object_id, code FROM why", "fx_flows", "fx_areas", extra=CHORDS))
def chord_reasons(spark, d):
    """Every rule that a straight pipe in place of each bent one would break."""
    rings = cut(named_rings(spark, d))
    return routes.chord_reasons(bent(spark, d), rings, rings)


@query("route_explanations", sql(f"""SELECT k.dataset_id, k.edge_id, round(l, 6) AS length, round(s, 6) AS straight, round(greatest(0, l - s), 6) AS detour,
  (tp > 0)::BIGINT AS bends, tp::DOUBLE AS turn_metres, coalesce(jp, 0)::DOUBLE AS joint_metres,
  coalesce(CASE w.r WHEN 4 THEN 'CLEARANCE' WHEN 5 THEN 'ENTRY_ANGLE' WHEN 6 THEN 'CROSSES_BRANCH' END, 'NOT_PROVEN') AS first_reason, coalesce(w.n, 0) AS reasons
  FROM (SELECT *, sqrt(pow(mx-x0, 2)+pow(my-y0, 2)) + sqrt(pow(x1-mx, 2)+pow(y1-my, 2)) AS l, sqrt(pow(x1-x0, 2)+pow(y1-y0, 2)) AS s,
    {_TP} AS tp FROM (SELECT *, ang AS a FROM kt)) k LEFT JOIN (SELECT dataset_id, edge_id, min(r) AS r, count(*) AS n FROM why GROUP BY 1, 2) w USING (dataset_id, edge_id)
  LEFT JOIN (SELECT dataset_id, edge_id, {_TP} AS jp FROM (SELECT c.dataset_id, c.edge_id,
    acos(least(1, abs(cos(atan2(c.my - c.y0, c.mx - c.x0) - atan2(q.y1 - q.my, q.x1 - q.mx))))) AS a
    FROM kk c JOIN kk q ON q.dataset_id = c.dataset_id AND q.edge_id = c.start_id)) j USING (dataset_id, edge_id)""",
                                 "fx_flows", "fx_areas", extra=CHORDS))
def route_explanations(spark, d):
    """Length, detour, turns and the gravest reason for every bent pipe."""
    e, rings = bent(spark, d), cut(named_rings(spark, d))
    out = routes.explain_routes(e, cut(routes.chord_reasons(e, rings, rings)))
    return out.select("dataset_id", "edge_id", *[F.round(c, 6).alias(c) for c in ("length", "straight", "detour")], "bends", "turn_metres",
                      "joint_metres", "first_reason", "reasons")


# ---- places for new ties and roots, and consumers to group ----
LIMIT = 5


def old_network(spark, d):
    """(consumers with a size, old pipes, old chambers with room for up to two branches)."""
    n = bridge.nodes(spark, d)
    users = n.filter("demand > 0").select("dataset_id", F.col("src").alias("entry_id"), "x", "y", rules.diameter(F.col("demand")).alias("dn"))
    lines = bridge.with_path(bridge.pipes(spark, d)).select("dataset_id", F.concat(F.lit("P"), F.col("object_id").cast("string")).alias("object_id"), "path")
    chambers = n.filter("node_type = 'chamber'").select(
        "dataset_id", F.concat(F.lit("C"), F.col("src").cast("string")).alias("object_id"), "x", "y", (F.col("src") % 3).alias("spare"),
        (F.col("src") % 7 * 0.3).cast("double").alias("axis"))
    return users, lines, chambers


_KEY = "floor({0} * 1000 + 0.5)::BIGINT || ':' || floor({1} * 1000 + 0.5)::BIGINT"
OLD = {
    "usr": f"""SELECT dataset_id, src AS entry_id, x AS ex, y AS ey, ({rules.RUN_LIMIT})[least(18, len(list_filter({rules.CAPACITY}, lambda c: demand > c + 1e-9)) + 2)] AS r
      FROM fx_nodes WHERE demand > 0""",
    "cam": "SELECT dataset_id, 'C' || src AS cam, x AS cx, y AS cy, src % 3 AS spare, src % 7 * 0.3::DOUBLE AS axis FROM fx_nodes WHERE node_type = 'chamber'",
    "pos": """SELECT *, x0 + u / len * (x1 - x0) AS x, y0 + u / len * (y1 - y0) AS y FROM (SELECT *, unnest([t * len, 0, len, greatest(0, t * len - 15), least(len, t * len + 15), len / 2]) AS u
      FROM (SELECT q.*, e.* EXCLUDE (dataset_id), sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len, greatest(0, least(1,
        ((ex - x0) * (x1 - x0) + (ey - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t FROM fx_pipes q JOIN usr e ON e.dataset_id = q.dataset_id
        AND least(x0, x1) <= ex + r AND greatest(x0, x1) >= ex - r AND least(y0, y1) <= ey + r AND greatest(y0, y1) >= ey - r))""",
    "onl": "SELECT dataset_id, entry_id, ex, ey, r, 'P' || object_id AS existing_id, x, y FROM pos WHERE sqrt(pow(x - ex, 2) + pow(y - ey, 2)) <= r",
    "lnt": """SELECT o.*, cam, cx, cy, spare, sqrt(pow(cx - x, 2) + pow(cy - y, 2)) AS gap FROM onl o JOIN cam c ON c.dataset_id = o.dataset_id
      AND abs(cx - ex) <= r AND abs(cy - ey) <= r AND sqrt(pow(cx - x, 2) + pow(cy - y, 2)) <= 10.000001""",
    "tgt": """SELECT dataset_id, entry_id, ex, ey, r, existing_id, x, y FROM onl o WHERE NOT EXISTS (FROM lnt l WHERE l.dataset_id = o.dataset_id AND l.entry_id = o.entry_id
      AND l.existing_id = o.existing_id AND l.x = o.x AND l.y = o.y AND (spare > 0 OR gap < 0.26))
      UNION ALL SELECT dataset_id, entry_id, ex, ey, r, cam, cx, cy FROM lnt WHERE spare > 0
      UNION ALL SELECT u.dataset_id, entry_id, ex, ey, r, cam, cx, cy FROM usr u JOIN cam c ON c.dataset_id = u.dataset_id AND spare > 0""",
    "far": f"""SELECT dataset_id, entry_id, existing_id, {_KEY.format('x', 'y')} AS place, min(sqrt(pow(x - ex, 2) + pow(y - ey, 2))) AS distance
      FROM tgt WHERE sqrt(pow(x - ex, 2) + pow(y - ey, 2)) BETWEEN 0.1000000001 AND r GROUP BY 1, 2, 3, 4""",
}


@query("tie_candidates", sql(f"""SELECT dataset_id, entry_id, rank, existing_id, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset_id, entry_id ORDER BY floor(distance * 1e6 + 0.5), place, existing_id) AS rank FROM far) WHERE rank <= {LIMIT}""", "fx_nodes", "fx_pipes", extra=OLD))
def tie_candidates(spark, d):
    """The nearest places on old pipes and chambers for every consumer."""
    return ties.tie_candidates(*old_network(spark, d), LIMIT).select(
        "dataset_id", "entry_id", F.col("rank").cast("long").alias("rank"), "existing_id", F.round("distance", 5).alias("distance"))


_BASE = """(SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM fx_pipes) q"""
ROOTS = {
    "usr": OLD["usr"], "cam": OLD["cam"],
    "mid": "SELECT dataset_id, ex, ey FROM usr UNION ALL SELECT dataset_id, avg(ex), avg(ey) FROM usr GROUP BY 1",
    "spt": f"""SELECT dataset_id, object_id, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y, atan2(y1 - y0, x1 - x0) AS axis FROM (SELECT q.*, greatest(0, least(1,
      ((ex - x0) * (x1 - x0) + (ey - y0) * (y1 - y0)) / (len * len))) AS t FROM {_BASE} JOIN mid ON mid.dataset_id = q.dataset_id WHERE len >= 0.5
      UNION ALL SELECT q.*, 0.5 FROM {_BASE} WHERE len >= 0.5 AND dataset_id IN (SELECT dataset_id FROM usr))""",
    "plc": f"""SELECT dataset_id, existing_id, place, min(x) AS x, min_by(y, x) AS y, any_value(axis) AS axis FROM (SELECT *, 'P' || object_id AS existing_id, {_KEY.format('x', 'y')} AS place FROM spt) s
      WHERE NOT EXISTS (FROM cam WHERE cam.dataset_id = s.dataset_id AND spare > 0 AND sqrt(pow(cx - x, 2) + pow(cy - y, 2)) <= 10.000001) GROUP BY 1, 2, 3
      UNION ALL SELECT dataset_id, cam, {_KEY.format('cx', 'cy')}, cx, cy, axis FROM cam WHERE spare > 0""",
    "rkd": """SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(distance * 1e6 + 0.5), existing_id, place) AS i FROM (
      SELECT p.*, (SELECT avg(sqrt(pow(p.x - ex, 2) + pow(p.y - ey, 2))) FROM usr WHERE usr.dataset_id = p.dataset_id) AS distance FROM plc p)""",
    "grd": """SELECT dataset_id, 0::BIGINT AS i, [{'i': 0::BIGINT, 'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'axis': 0.0::DOUBLE}][1:0] AS got FROM rkd GROUP BY 1
      UNION ALL SELECT g.dataset_id, r.i, CASE WHEN len(list_filter(got, lambda s: sqrt(pow(s.x - r.x, 2) + pow(s.y - r.y, 2)) < 20 AND
        least(abs(r.axis - s.axis - pi() / 4 * round_even((r.axis - s.axis) / (pi() / 4), 0)), pi() / 4 - abs(r.axis - s.axis - pi() / 4 * round_even((r.axis - s.axis) / (pi() / 4), 0))) < radians(0.5))) > 0
        THEN got ELSE list_append(got, {'i': r.i, 'x': r.x, 'y': r.y, 'axis': r.axis}) END FROM grd g JOIN rkd r ON r.dataset_id = g.dataset_id AND r.i = g.i + 1""",
}


@query("root_shortlist", sql(f"""SELECT r.dataset_id, r.existing_id, round(r.distance, 5) AS distance, list_position(list_transform(got, lambda s: s.i), r.i)::BIGINT AS rank
  FROM rkd r JOIN (SELECT dataset_id, max_by(got, i) AS got FROM grd GROUP BY 1) g ON g.dataset_id = r.dataset_id
  WHERE list_position(list_transform(got, lambda s: s.i), r.i) <= {LIMIT}""", "fx_nodes", "fx_pipes", extra=ROOTS))
def root_shortlist(spark, d):
    """The best places for one root of every map, no two of them beside each other along one axis."""
    places = ties.root_candidates(*old_network(spark, d))
    return ties.spread_places(places, LIMIT).select("dataset_id", "existing_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("demand_groups", sql("""SELECT DISTINCT dataset_id, array_to_string(m, ',') AS members, len(m)::BIGINT AS size FROM (
  SELECT a.dataset_id, list_sort(list(n.src)) AS m FROM fx_anc a JOIN fx_nodes n ON n.dataset_id = a.dataset_id AND n.node_id = a.node_id AND n.demand > 0
    WHERE a.anc > 0 GROUP BY a.dataset_id, a.anc HAVING count(*) BETWEEN 2 AND 4
  UNION ALL SELECT dataset_id, list_sort(l[1:k]) FROM (SELECT dataset_id, a, list(b ORDER BY d, b) AS l FROM (SELECT p.dataset_id, p.src AS a, q.src AS b,
    sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM fx_nodes p JOIN fx_nodes q ON q.dataset_id = p.dataset_id AND p.demand > 0 AND q.demand > 0) GROUP BY 1, 2),
    (VALUES (2), (3), (4)) v(k) WHERE len(l) >= k)""", "fx_anc"))
def demand_groups(spark, d):
    """Small subtrees and nearest neighbours as sets of consumers."""
    n = bridge.nodes(spark, d).filter("demand > 0")
    found = ties.demand_groups(bridge.edges(spark, d), n.select("dataset_id", F.col("src").alias("demand_id"), F.col("node_id").alias("end_id")),
                               n.select("dataset_id", F.col("src").alias("demand_id"), "x", "y"))
    return found.select("dataset_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.col("size").cast("long").alias("size"))
