"""Exported layouts read back from their text and audited against the map, with seeded defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import audit, evaluate, graph
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.evaluate_queries import NET_SQL, demands, net
from utilnet.plans.registry import query
from utilnet.session import cut
from utilnet.sources import networks as src

KINDS = 20  # each map has the defect of its number modulo this
FACTS = {n: c for c, n, _ in src.SUMMARY_FACTS}


def degrees(x, y):
    lon, lat = geo.from_utm(x, y)
    return F.struct(lon.alias("x"), lat.alias("y"))


def layout(spark, d):
    """(nodes, edges) of the trees under audit: ties on old chambers in maps of odd number, on old pipes in the others."""
    n = net(spark, d)
    old = F.when((F.col("node_id") == 0) & (F.col("dataset_id") % 2 == 1), F.concat(F.lit("C"), F.col("dataset_id").cast("string")))
    n = n.withColumn("out_id", F.coalesce(old, F.col("entry_id").cast("string"))).withColumn("out_is_int", old.isNull())
    return n, cut(graph.flows(n, bridge.with_path(bridge.edges(spark, d))))


def exported(spark, d):
    """Every pipe in two pieces, as GeoJSON text, with a summary."""
    n, sized = layout(spark, d)
    half = F.col("length") / 2
    pieces = sized.select("dataset_id", "edge_id", F.explode(F.array(
        F.struct(F.lit(0.0).alias("s_from"), half.alias("s_to")),
        F.struct(half.alias("s_from"), F.col("length").alias("s_to")))).alias("_s")).select(
        "dataset_id", "edge_id", "_s.*", F.lit(1.0).alias("factor"), F.lit("base").alias("method"))
    wanted = demands(spark, d)
    served = n.filter("entry_id IS NOT NULL")
    totals = evaluate.network_summary(n.join(served.select("dataset_id", "node_id", F.lit(1).alias("_s")), ["dataset_id", "node_id"], "left")
                                      .withColumn("entry_id", F.when(F.col("_s") == 1, F.col("entry_id"))).drop("_s"), sized, pieces, wanted)
    gone = wanted.join(served.select("dataset_id", F.col("entry_id").alias("demand_id")), ["dataset_id", "demand_id"], "left_anti")
    listed = gone.groupBy("dataset_id").agg(F.sort_array(F.collect_list("demand_id")).alias("unconnected_oks_ids"))
    own = {"connected": "connected", "ties": "chamber_ties", "penalty": "missing_penalty"}
    summary = totals.join(listed, "dataset_id", "left").select(
        "dataset_id", *[F.coalesce(F.col(own.get(c, c)), F.lit(0)).alias(name) for name, c in FACTS.items()],
        F.coalesce("unconnected_oks_ids", F.array().cast("array<long>")).alias("unconnected_oks_ids"))
    prefix = n.select("dataset_id").distinct().withColumn("prefix", F.lit("tt:v1:"))
    text = src.export_features(n, sized, cut(pieces), evaluate.new_chambers(n, sized), prefix, cut(summary))
    return cut(text.select("dataset_id", "value"))


def town(spark, d):
    """The maps the layouts were made for: consumers, an old chamber or an old pipe under each tie."""
    n = net(spark, d)
    at = degrees(F.col("x"), F.col("y"))
    users = n.filter("demand > 0").select(
        "dataset_id", F.concat(F.lit("#"), F.col("src").cast("string")).alias("object_id"), F.lit("oks_connection_point").alias("object_type"),
        F.col("demand").alias("flow"), F.array(at).alias("path"))
    ties = n.filter("node_id = 0")
    none = F.lit(None).cast("double").alias("flow")
    chambers = ties.filter("dataset_id % 2 = 1").select(
        "dataset_id", F.concat(F.lit("C"), F.col("dataset_id").cast("string")).alias("object_id"), F.lit("heat_chamber").alias("object_type"),
        none, F.array(at).alias("path"))
    y = F.col("y") + F.when(F.col("dataset_id") % KINDS == 16, 5.0).otherwise(0.0)
    pipes = ties.select("dataset_id", F.concat(F.lit("P"), F.col("dataset_id").cast("string")).alias("object_id"),
                        F.lit("heat_network").alias("object_type"), none,
                        F.array(degrees(F.col("x") - 10, y), degrees(F.col("x") + 10, y)).alias("path"))
    return users.unionByName(chambers).unionByName(pipes)


def seeded(objects):
    """The objects with one defect a map, of ``KINDS`` kinds."""
    kind, v = F.col("dataset_id") % KINDS, "tt:v1:"

    def at(number, name):
        return (kind == number) & (F.col("id") == f"{v}{name}")

    def moved(place):
        return F.transform("path", lambda p, i: F.when(i == place, F.struct((p["x"] + 1e-4).alias("x"), p["y"].alias("y"))).otherwise(p))

    facts = F.col("summary")
    first = F.concat(F.lit("#"), (F.col("dataset_id") * 40 + 14).cast("string"))
    told = [facts.withField("unconnected", F.concat(facts["unconnected"], F.array(first, F.lit("ghost")))),
            facts.withField("unconnected", F.array().cast("array<string>")), facts.withField("connected", facts["connected"] + 1)]
    rows = objects.filter(~((kind == 19) & (F.col("object_type") == "variant_summary"))).withColumns({
        "method": F.when(at(4, "5:0"), "air").otherwise(F.col("method")),
        "flow": F.when(at(6, "14:1"), F.lit(1e9)).otherwise(F.col("flow")),
        "dn": F.when(at(7, "14:1"), 40).when(at(13, "3"), 40).when(at(0, "14:1"), 1400).otherwise(F.col("dn")),
        "path": F.when(at(8, "14:1"), moved(0)).when(at(9, "14:1"), moved(1)).otherwise(F.col("path")),
        "start_id": F.when(at(10, "14:0"), "nobody").otherwise(F.col("start_id")),
        "cost": F.when(at(5, "5:1"), F.col("cost") - 1e5).when(at(14, "3"), F.col("cost") + 1).otherwise(F.col("cost")),
        "summary": F.when(kind == 15, told[0]).when(kind == 17, told[1]).when(kind == 18, told[2]).otherwise(facts)})

    def more(base, number, **values):
        return rows.filter((kind == number) & (F.col("id") == f"{v}{base}")).withColumns(
            {c: F.lit(x) if not isinstance(x, F.Column) else x for c, x in values.items()})

    extra = [more("5:node:0", 1, id="odd", object_type="valve"), more("5:node:0", 2),
             more("5:node:0", 3, id=F.concat(F.lit("P"), F.col("dataset_id").cast("string"))),
             more("14:1", 11, id="again", start_id=f"{v}2"),
             more("5:node:0", 12, id="y1"), more("5:node:0", 12, id="y2"),
             more("14:1", 12, id="c1", start_id="y1", end_id="y2"), more("14:1", 12, id="c2", start_id="y2", end_id="y1")]
    for df in extra:
        rows = rows.unionByName(df)
    return rows


# The same layouts and defects in SQL, by their ids; no coordinates but for what was moved.
_DN, _CAP, _LIM, _NEW = rules.DN, rules.CAPACITY, rules.RUN_LIMIT, rules.PRICE_NEW
_CAM = "CASE WHEN {0} <= 200 THEN 3e6 WHEN {0} <= 500 THEN 5e6 WHEN {0} <= 1000 THEN 8e6 ELSE 12e6 END"
SEEDED = {
    **NET_SQL,
    "nm": """SELECT dataset_id, node_id, CASE WHEN node_id = 0 AND dataset_id % 2 = 1 THEN 'C' || dataset_id
      WHEN demand > 0 AND src % 29 <> 3 THEN '#' || src ELSE 'tt:v1:' || node_id END AS name FROM fx_nodes""",
    "pc0": f"""SELECT f.dataset_id, 'tt:v1:' || edge_id || ':' || n AS id, edge_id, n, 'base' AS method, f.flow, length / 2 AS length,
      ({_DN})[dn_idx + 1] AS dn, length / 2 * ({_NEW})[dn_idx + 1] AS cost, false AS off_start, false AS off_end,
      CASE WHEN n = 0 THEN s.name ELSE 'tt:v1:' || edge_id || ':node:0' END AS a,
      CASE WHEN n = 1 THEN e.name ELSE 'tt:v1:' || edge_id || ':node:0' END AS b FROM fx_flows f
      JOIN nm s ON s.dataset_id = f.dataset_id AND s.node_id = f.start_id
      JOIN nm e ON e.dataset_id = f.dataset_id AND e.node_id = f.end_id, (VALUES (0), (1)) h(n)""",
    "pc": f"""SELECT dataset_id, id, CASE WHEN k = 4 AND id = 'tt:v1:5:0' THEN 'air' ELSE method END AS method,
      CASE WHEN k = 6 AND id = 'tt:v1:14:1' THEN 1e9 ELSE flow END AS flow, length,
      CASE WHEN k = 7 AND id = 'tt:v1:14:1' THEN 40 WHEN k = 0 AND id = 'tt:v1:14:1' THEN 1400 ELSE dn END AS dn,
      CASE WHEN k = 5 AND id = 'tt:v1:5:1' THEN cost - 1e5 ELSE cost END AS cost,
      k = 8 AND id = 'tt:v1:14:1' AS off_start, k = 9 AND id = 'tt:v1:14:1' AS off_end,
      CASE WHEN k = 10 AND id = 'tt:v1:14:0' THEN 'nobody' ELSE a END AS a, b FROM (SELECT *, dataset_id % {KINDS} AS k FROM pc0)
      UNION ALL SELECT dataset_id, 'again', method, flow, length, dn, cost, true, false, 'tt:v1:2', b
        FROM pc0 WHERE dataset_id % {KINDS} = 11 AND id = 'tt:v1:14:1'
      UNION ALL SELECT dataset_id, c, method, flow, length, dn, cost, true, true, p, q
        FROM pc0, (VALUES ('c1', 'y1', 'y2'), ('c2', 'y2', 'y1')) v(c, p, q) WHERE dataset_id % {KINDS} = 12 AND id = 'tt:v1:14:1'""",
    "cam0": """SELECT n.dataset_id, 'tt:v1:' || n.node_id AS id, greatest(50, coalesce(max(dn), 50)) AS dn FROM net n
      LEFT JOIN pc0 ON pc0.dataset_id = n.dataset_id AND 'tt:v1:' || n.node_id IN (a, b)
      WHERE node_type = 'chamber' OR existing_type = 'heat_network' GROUP BY 1, 2""",
    "cam": f"""SELECT dataset_id, id, CASE WHEN k = 13 AND id = 'tt:v1:3' THEN 40 ELSE dn END AS dn,
      {_CAM.format("dn")} + CASE WHEN k = 14 AND id = 'tt:v1:3' THEN 1 ELSE 0 END AS cost FROM (SELECT *, dataset_id % {KINDS} AS k FROM cam0)""",
    "place": f"""SELECT dataset_id, id AS node, 'heat_chamber' AS kind, 'new' AS origin FROM cam
      UNION ALL SELECT dataset_id, 'tt:v1:' || edge_id || ':node:0', 'technical_node', 'new' FROM fx_edges
      UNION ALL SELECT dataset_id, y, 'technical_node', 'new' FROM (SELECT DISTINCT dataset_id FROM pc0 WHERE id = 'tt:v1:14:1'),
        (VALUES ('y1'), ('y2')) v(y) WHERE dataset_id % {KINDS} = 12
      UNION ALL SELECT dataset_id, '#' || demand_id, 'oks_connection_point', 'old' FROM dem
      UNION ALL SELECT dataset_id, 'C' || dataset_id, 'heat_chamber', 'old' FROM fx_nodes WHERE node_id = 0 AND dataset_id % 2 = 1""",
    "lk": """SELECT p.*, s.kind AS sk, s.origin AS so, e.kind AS ek, e.origin AS eo FROM pc p
      LEFT JOIN place s ON s.dataset_id = p.dataset_id AND s.node = p.a LEFT JOIN place e ON e.dataset_id = p.dataset_id AND e.node = p.b""",
    "feed": "SELECT dataset_id, b AS node, count(*) AS n, min(id) AS up, min_by(a, id) AS src FROM pc GROUP BY 1, 2",
    "root": "SELECT DISTINCT l.dataset_id, l.a AS node, l.sk, l.so FROM lk l ANTI JOIN feed f ON f.dataset_id = l.dataset_id AND f.node = l.a",
    "wet": """SELECT dataset_id, node FROM root UNION ALL SELECT f.dataset_id, f.node FROM wet w
      JOIN feed f ON f.dataset_id = w.dataset_id AND f.src = w.node""",
    "chain": "SELECT p.*, f.up, u.dn AS up_dn FROM pc p LEFT JOIN feed f ON f.dataset_id = p.dataset_id AND f.node = p.a "
             "LEFT JOIN pc u ON u.dataset_id = p.dataset_id AND u.id = f.up",
    "run": f"""SELECT dataset_id, id, dn, length AS r FROM chain WHERE (up IS NULL OR up_dn <> dn) AND list_contains({_DN}, dn)
      UNION ALL SELECT c.dataset_id, c.id, c.dn, r.r + c.length FROM run r JOIN chain c ON c.dataset_id = r.dataset_id AND c.up = r.id AND c.dn = r.dn""",
    "tot": """SELECT d.dataset_id, (SELECT sum(cost) FROM pc WHERE dataset_id = d.dataset_id) AS pipes,
      (SELECT sum(cost) FROM cam WHERE dataset_id = d.dataset_id) AS cams, (SELECT sum(length) FROM pc WHERE dataset_id = d.dataset_id) AS len,
      (SELECT count(*) FROM lk WHERE dataset_id = d.dataset_id AND sk = 'heat_chamber' AND so = 'old') AS ties,
      (SELECT count(*) FROM dem WHERE dataset_id = d.dataset_id AND EXISTS (FROM pc WHERE pc.dataset_id = dem.dataset_id AND b = '#' || demand_id)) AS conn,
      (SELECT coalesce(sum(100e6 + 500000 * flow), 0) FROM dem WHERE dataset_id = d.dataset_id
        AND NOT EXISTS (FROM pc WHERE pc.dataset_id = dem.dataset_id AND b = '#' || demand_id)) AS pen FROM (SELECT DISTINCT dataset_id FROM pc) d""",
    "said": f"""SELECT d.dataset_id, (SELECT sum(cost) FROM pc0 WHERE dataset_id = d.dataset_id) AS pipes,
      (SELECT sum({_CAM.format("dn")}) FROM cam0 WHERE dataset_id = d.dataset_id) AS cams, (SELECT sum(length) FROM pc0 WHERE dataset_id = d.dataset_id) AS len,
      (SELECT count(*) FROM pc0 WHERE dataset_id = d.dataset_id AND a = 'C' || d.dataset_id) AS ties,
      (SELECT count(*) FROM dem WHERE dataset_id = d.dataset_id AND NOT missing) + CASE WHEN d.dataset_id % {KINDS} = 18 THEN 1 ELSE 0 END AS conn,
      (SELECT coalesce(sum(100e6 + 500000 * flow), 0) FROM dem WHERE dataset_id = d.dataset_id AND missing) AS pen
      FROM (SELECT DISTINCT dataset_id FROM pc) d WHERE d.dataset_id % {KINDS} <> 19""",
    "find": f"""SELECT dataset_id, 'odd' AS object_id, 'UNKNOWN_TYPE' AS code FROM pc0 WHERE dataset_id % {KINDS} = 1 AND id = 'tt:v1:5:0'
      UNION ALL SELECT dataset_id, 'tt:v1:5:node:0', 'DUPLICATE_ID' FROM pc0 WHERE dataset_id % {KINDS} = 2 AND id = 'tt:v1:5:0'
      UNION ALL SELECT dataset_id, 'P' || dataset_id, 'ID_OF_THE_MAP' FROM pc0 WHERE dataset_id % {KINDS} = 3 AND id = 'tt:v1:5:0'
      UNION ALL SELECT dataset_id, id, 'UNKNOWN_METHOD' FROM pc WHERE method NOT IN ('base', 'special')
      UNION ALL SELECT dataset_id, id, 'UNKNOWN_START' FROM lk WHERE sk IS NULL OR sk = 'oks_connection_point'
      UNION ALL SELECT dataset_id, id, 'UNKNOWN_END' FROM lk WHERE ek IS NULL OR (ek = 'heat_chamber' AND eo = 'old')
      UNION ALL SELECT dataset_id, id, 'START_ELSEWHERE' FROM lk WHERE off_start AND sk IS NOT NULL
      UNION ALL SELECT dataset_id, id, 'END_ELSEWHERE' FROM lk WHERE off_end AND ek IS NOT NULL
      UNION ALL SELECT dataset_id, id, 'UNKNOWN_DIAMETER' FROM pc WHERE NOT list_contains({_DN}, dn)
      UNION ALL SELECT dataset_id, id, 'OVER_CAPACITY' FROM pc WHERE flow > ({_CAP})[list_position({_DN}, dn)] + 1e-7
      UNION ALL SELECT dataset_id, id, 'BELOW_PRICE' FROM pc WHERE cost < length * ({_NEW})[list_position({_DN}, dn)] - 0.03
      UNION ALL SELECT dataset_id, node, 'SEVERAL_PARENTS' FROM feed WHERE n > 1
      UNION ALL SELECT dataset_id, node, 'ROOT_WITHOUT_CHAMBER' FROM root WHERE sk IS DISTINCT FROM 'heat_chamber'
      UNION ALL SELECT f.dataset_id, f.node, 'CYCLE' FROM feed f ANTI JOIN wet w ON w.dataset_id = f.dataset_id AND w.node = f.node
      UNION ALL SELECT dataset_id, id, 'DIAMETER_GROWS' FROM chain WHERE dn > up_dn
      UNION ALL SELECT dataset_id, id, 'RUN_TOO_LONG' FROM run WHERE r > ({_LIM})[list_position({_DN}, dn)] + 0.02
      UNION ALL SELECT p.dataset_id, p.id, 'FLOW_LOST' FROM pc p JOIN feed f ON f.dataset_id = p.dataset_id AND f.node = p.b AND f.n = 1
        JOIN (SELECT dataset_id, a, sum(flow) AS below FROM pc GROUP BY 1, 2) q ON q.dataset_id = p.dataset_id AND q.a = p.b
        WHERE abs(p.flow - below) > 1e-5
      UNION ALL SELECT c.dataset_id, c.id, 'CHAMBER_TOO_SMALL' FROM cam c LEFT JOIN pc ON pc.dataset_id = c.dataset_id AND c.id IN (a, b)
        GROUP BY 1, 2, c.dn HAVING NOT list_contains({_DN}, c.dn) OR c.dn < greatest(50, coalesce(max(pc.dn), 50))
      UNION ALL SELECT dataset_id, id, 'CHAMBER_PRICE' FROM cam WHERE list_contains({_DN}, dn) AND abs(cost - {_CAM.format("dn")}) > 0.03
      UNION ALL SELECT dataset_id, node, 'ROOT_OFF_PIPE' FROM root WHERE so = 'new' AND sk = 'heat_chamber' AND dataset_id % {KINDS} = 16
      UNION ALL SELECT dataset_id, NULL, 'NO_SUMMARY' FROM tot WHERE dataset_id % {KINDS} = 19
      UNION ALL SELECT t.dataset_id, NULL, c.code FROM tot t JOIN said s USING (dataset_id), (VALUES ('STATED_TIES'), ('STATED_TIE_COST'),
        ('STATED_CONNECTED'), ('STATED_CHAMBER_COST'), ('STATED_LENGTH'), ('STATED_PENALTY'), ('STATED_CONSTRUCTION_COST'),
        ('STATED_CALCULATED_COST'), ('STATED_SCORE')) c(code) WHERE CASE c.code WHEN 'STATED_TIES' THEN t.ties <> s.ties
        WHEN 'STATED_TIE_COST' THEN t.ties <> s.ties WHEN 'STATED_CONNECTED' THEN t.conn <> s.conn
        WHEN 'STATED_CHAMBER_COST' THEN abs(t.cams - s.cams) > 0.03 WHEN 'STATED_LENGTH' THEN abs(t.len - s.len) > 0.03
        WHEN 'STATED_PENALTY' THEN abs(t.pen - s.pen) > 0.03
        WHEN 'STATED_CONSTRUCTION_COST' THEN abs(t.pipes + t.cams + 5e6 * t.ties - s.pipes - s.cams - 5e6 * s.ties) > 0.03
        WHEN 'STATED_CALCULATED_COST' THEN abs(t.pipes + t.cams + 5e6 * t.ties + t.pen - s.pipes - s.cams - 5e6 * s.ties - s.pen) > 0.03
        ELSE abs(0.7 * (t.pipes + t.cams + 5e6 * t.ties + t.pen - s.pipes - s.cams - 5e6 * s.ties - s.pen) / 25e6
          + 0.3 * (t.len - s.len) / 100) > 1e-4 END
      UNION ALL SELECT DISTINCT dataset_id, 'ghost', 'LISTED_UNKNOWN' FROM pc0 WHERE dataset_id % {KINDS} = 15
      UNION ALL SELECT d.dataset_id, '#' || demand_id, 'LISTED_BUT_REACHED' FROM dem d SEMI JOIN pc ON pc.dataset_id = d.dataset_id AND b = '#' || demand_id
        WHERE d.dataset_id % {KINDS} = 15 AND demand_id % 40 = 14
      UNION ALL SELECT dataset_id, '#' || (dataset_id * 40 + 14), 'LISTED_UNKNOWN' FROM (SELECT DISTINCT dataset_id FROM pc0 WHERE dataset_id % {KINDS} = 15) x
        WHERE NOT EXISTS (FROM dem WHERE dem.dataset_id = x.dataset_id AND demand_id = x.dataset_id * 40 + 14)
      UNION ALL SELECT dataset_id, '#' || demand_id, 'NOT_LISTED' FROM dem WHERE missing AND dataset_id % {KINDS} = 17""",
}


@query("export_audit", sql("SELECT dataset_id, 'v1' AS variant_id, object_id, code FROM find", "fx_flows", extra=SEEDED))
def export_audit(spark, d):
    """Layouts exported as text, read back, given one defect a map, and audited by their ids and numbers alone."""
    objects = cut(seeded(src.read_export(exported(spark, d))))
    return audit.audit_export(objects, town(spark, d))


@query("export_subtotals", sql(f"""SELECT dataset_id, round(pipes, 1) AS pipe_cost, round(cams, 1) AS chamber_cost, round(len, 5) AS new_length, ties::BIGINT AS ties,
  conn::BIGINT AS connected, round(pipes + cams + 5e6 * ties + pen, 1) AS calculated_cost,
  round(0.7 * (pipes + cams + 5e6 * ties + pen) / 25e6 + 0.3 * len / 100, 5) AS score_raw, round(s.pipes + s.cams + 5e6 * s.ties, 1) AS stated_construction_cost
  FROM (SELECT t.*, {{'pipes': s.pipes, 'cams': s.cams, 'ties': s.ties}} AS s FROM tot t LEFT JOIN said s USING (dataset_id))""", "fx_flows", extra=SEEDED))
def export_subtotals(spark, d):
    """What the exported objects add up to, by object type, beside what their summaries state."""
    objects, features = cut(seeded(src.read_export(exported(spark, d)))), cut(town(spark, d))
    totals = audit.audit_totals(objects, features, cut(audit.export_links(objects, features)))
    return totals.select("dataset_id", *[F.round(c, 1).alias(c) for c in ("pipe_cost", "chamber_cost")], F.round("new_length", 5).alias("new_length"),
                         "ties", "connected", F.round("calculated_cost", 1).alias("calculated_cost"), F.round("score_raw", 5).alias("score_raw"),
                         F.round("stated_construction_cost", 1).alias("stated_construction_cost"))


# ---- the wall that a pipe comes through ----
HALF, SHIFT, SHORT = 1.413, 0.371, 0.5  # of the consumers' buildings and of legs that begin inside, m


def entry_layout(spark, d):
    """Last legs towards consumers in square buildings (some off the middle, some elsewhere), and the buildings' sides."""
    e = bridge.edges(spark, d).join(bridge.nodes(spark, d).filter("demand > 0").select(
        "dataset_id", F.col("node_id").alias("edge_id"), "src"), ["dataset_id", "edge_id"])
    kind = F.col("src") % 7
    dx, dy = F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")
    part = F.when(kind == 6, SHORT / F.col("length")).otherwise(1.0)
    links = e.select(
        "dataset_id", F.lit("v1").alias("variant_id"), F.col("src").cast("string").alias("id"),
        F.struct(F.lit("old").alias("origin"), F.lit("oks_connection_point").alias("kind")).alias("end"),
        F.array(degrees(F.col("x1") + part * dx, F.col("y1") + part * dy), degrees(F.col("x1"), F.col("y1"))).alias("path"))
    along = F.abs(dx) >= F.abs(dy)
    # Shifted towards the pipe, the building has its consumer nearer to the wall behind.
    shift = F.when(kind == 3, SHIFT).when(kind == 5, 1000 * HALF).otherwise(0.0)
    cx = F.col("x1") + F.when(along, F.signum(dx) * shift).otherwise(0.0)
    cy = F.col("y1") + F.when(along, 0.0).otherwise(F.signum(dy) * shift)
    houses = e.select("dataset_id", F.col("src").alias("object_id"), F.lit(0).alias("ring"), (cx - HALF).alias("minx"),
                      (cy - HALF).alias("miny"), (cx + HALF).alias("maxx"), (cy + HALF).alias("maxy"))
    return cut(links), cut(bridge.box_ring(houses).select("dataset_id", "object_id", "ring", "x0", "y0", "x1", "y1"))


ENTRIES = {
    "leg": f"""SELECT e.dataset_id, src, x1 AS ex, y1 AS ey, x1 + p * (x0 - x1) AS ax, y1 + p * (y0 - y1) AS ay, abs(x0 - x1) >= abs(y0 - y1) AS along,
      sign(x0 - x1) AS sx, sign(y0 - y1) AS sy FROM (SELECT e.*, src, CASE WHEN src % 7 = 6 THEN {SHORT} / length ELSE 1 END AS p
      FROM fx_edges e JOIN fx_nodes n ON n.dataset_id = e.dataset_id AND n.node_id = e.edge_id AND n.demand > 0) e""",
    "house": f"""SELECT dataset_id, src AS house, ex + CASE WHEN along THEN sx * s ELSE 0 END AS cx, ey + CASE WHEN along THEN 0 ELSE sy * s END AS cy
      FROM (SELECT *, CASE src % 7 WHEN 3 THEN {SHIFT} WHEN 5 THEN {1000 * HALF} ELSE 0 END AS s FROM leg)""",
    "own": f"""SELECT l.dataset_id, src, min(house) AS house FROM leg l JOIN house h ON h.dataset_id = l.dataset_id
      AND abs(ex - cx) <= {HALF} AND abs(ey - cy) <= {HALF} GROUP BY 1, 2""",
    "side": f"""SELECT l.*, cx + u0 * {HALF} AS x0, cy + v0 * {HALF} AS y0, cx + u1 * {HALF} AS x1, cy + v1 * {HALF} AS y1
      FROM leg l JOIN own o USING (dataset_id, src) JOIN house h ON h.dataset_id = o.dataset_id AND h.house = o.house,
      (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) w(u0, v0, u1, v1)""",
    "hit": """SELECT *, CASE WHEN t BETWEEN -1e-7 AND 1.0000001 AND u BETWEEN -1e-7 AND 1.0000001 THEN ax + t * (ex - ax) END AS hx, ay + t * (ey - ay) AS hy,
      CASE WHEN x0 = x1 THEN sqrt(pow(ex - x0, 2) + pow(ey - greatest(least(y0, y1), least(greatest(y0, y1), ey)), 2))
           ELSE sqrt(pow(ey - y0, 2) + pow(ex - greatest(least(x0, x1), least(greatest(x0, x1), ex)), 2)) END AS far FROM (SELECT *,
      ((x0 - ax) * (y1 - y0) - (y0 - ay) * (x1 - x0)) / nullif((ex - ax) * (y1 - y0) - (ey - ay) * (x1 - x0), 0) AS t,
      ((x0 - ax) * (ey - ay) - (y0 - ay) * (ex - ax)) / nullif((ex - ax) * (y1 - y0) - (ey - ay) * (x1 - x0), 0) AS u FROM side)""",
    "judged": """SELECT dataset_id, src, count(hx) AS hits, min(far) AS least FROM hit GROUP BY 1, 2""",
    "through": """SELECT DISTINCT n.dataset_id, n.src FROM hit n JOIN judged j USING (dataset_id, src) JOIN hit h ON h.dataset_id = n.dataset_id
      AND h.src = n.src AND h.hx IS NOT NULL WHERE n.far <= j.least + 0.06 AND sqrt(
      pow(h.hx - greatest(least(n.x0, n.x1), least(greatest(n.x0, n.x1), h.hx)), 2) + pow(h.hy - greatest(least(n.y0, n.y1), least(greatest(n.y0, n.y1), h.hy)), 2)) < 0.06""",
}


@query("entry_audit", sql("""SELECT dataset_id, 'v1' AS variant_id, src::VARCHAR AS object_id, 'OUTSIDE_BUILDINGS' AS code FROM leg l ANTI JOIN own USING (dataset_id, src)
  UNION ALL SELECT dataset_id, 'v1', src::VARCHAR, 'NO_WALL_CROSSED' FROM judged WHERE hits = 0
  UNION ALL SELECT dataset_id, 'v1', src::VARCHAR, 'FARTHER_WALL' FROM judged j ANTI JOIN through USING (dataset_id, src) WHERE hits > 0""",
                          "fx_edges", extra=ENTRIES))
def entry_audit(spark, d):
    """Every consumer's last leg against the nearest outer wall of the building it ends in."""
    return audit.entry_findings(*entry_layout(spark, d))


@query("rank_audit", """WITH v AS (SELECT o_custkey AS dataset_id, o_orderkey AS variant_id, floor(o_totalprice / 20000)::DOUBLE AS score FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score, variant_id) + CASE WHEN variant_id % 9 = 4 THEN 1 ELSE 0 END AS rank FROM v)
  SELECT a.dataset_id, a.variant_id, 'STATED_RANK' AS code FROM r a JOIN r b USING (dataset_id) GROUP BY a.dataset_id, a.variant_id, a.rank, a.score
  HAVING a.rank <= count(*) FILTER (b.score < a.score) OR a.rank > count(*) FILTER (b.score <= a.score) OR count(*) FILTER (b.rank = a.rank) > 1""")
def rank_audit(spark, d):
    """Ranks within each map's variants, every ninth one place too low, against the order of their scores."""
    from utilnet.operators.kernels import running
    rows = bridge.table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("variant_id"),
        F.floor(F.col("o_totalprice") / 20000).cast("double").alias("score_raw"))
    ranks = running(rows, ["dataset_id"], ["score_raw", "variant_id"], row_number="n").select(
        "dataset_id", "variant_id", (F.col("n") + F.when(F.col("variant_id") % 9 == 4, 1).otherwise(0)).alias("rank"))
    return audit.rank_findings(rows, ranks).drop("object_id")
