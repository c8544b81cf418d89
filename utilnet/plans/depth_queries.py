"""Depth profiles on the tree with surface and utility passages derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators import depth
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.registry import query
from utilnet.session import cut

# One passage in the middle of every pipe longer than 20 m, its kind by the pipe's number.
_KIND = ["gas_pipeline", "power_cable", "road"]


def mid_passages(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in _KIND]), (F.col("edge_id") % 3).cast("int"))
    mid = F.col("length") / 2
    ext = F.when(F.col("rule") == "road", 3.0).otherwise(2.0)
    core = F.when(F.col("rule") == "road", 2.0).otherwise(0.0)
    factor = F.when(F.col("rule") == "road", 1.6).when(F.col("rule") == "gas_pipeline", 1.25).otherwise(1.15)
    return bridge.edges(spark, d).filter("length > 20").withColumn("rule", kind).select(
        "dataset_id", "edge_id", (F.col("edge_id") + 500).alias("object_id"), "rule",
        (mid - core - ext).alias("s_from"), (mid + core + ext).alias("s_to"), (mid - core).alias("core_from"),
        (mid + core).alias("core_to"), factor.alias("factor"), "length")


def _sized(spark, d):
    return bridge.edges(spark, d).select("dataset_id", "edge_id", "start_id", "end_id", "length", F.lit(50).alias("dn"))


def solved(spark, d):
    n = bridge.nodes(spark, d).withColumn("node_type", F.when(
        F.col("node_type") == "chamber", "chamber").otherwise(F.col("node_type")))
    bands, links, placed = depth.stations(n, _sized(spark, d), mid_passages(spark, d))
    return bands, links, placed, cut(depth.solve_depths(bands, links))


@query("station_bands", sql("""SELECT dataset_id, edge_id, round(low, 6)::DOUBLE AS low, round(high, 6)::DOUBLE AS high FROM fx_edges,
  LATERAL (SELECT * FROM (VALUES (0, 0.7, 2.475), (0, 3.4, 12.0), (1, 0.7, 2.075), (1, 3.4, 12.0), (2, 1.0, 12.0)) t(k, low, high)
  WHERE k = edge_id % 3) WHERE length > 20""", "fx_edges"))
def station_bands(spark, d):
    bands, _, placed = depth.stations(bridge.nodes(spark, d), _sized(spark, d), mid_passages(spark, d))
    inner = placed.filter("station LIKE 'e:%'").select("dataset_id", "edge_id", "group").distinct()
    return bands.join(inner, ["dataset_id", "group"]).select(
        "dataset_id", "edge_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("solved_depths")
def solved_depths(spark, d):
    return solved(spark, d)[3].select("dataset_id", "group", "low_d", "depth", "code")


def map_passages(spark, d):
    """The passages that the map gives all pipes, with the diameter of an old pipe that is crossed."""
    from utilnet.plans.passage_queries import fx_passages
    old = bridge.utility_lines(spark, d).select("dataset_id", "object_id", F.col("dn").alias("object_dn")).distinct()
    return cut(fx_passages(spark, d).join(old, ["dataset_id", "object_id"], "left"))


def planned(spark, d):
    """(sections with depths, passages, pipes) of all pipes under the passages of the map."""
    found, pipes = map_passages(spark, d), cut(_sized(spark, d))
    bands, links, placed = depth.stations(bridge.nodes(spark, d), pipes, found)
    depths = cut(depth.solve_depths(bands, links))
    return cut(depth.depth_sections(placed, depths, depth.planned_sections(pipes, found))), found, pipes


@query("depth_profiles")
def depth_profiles(spark, d):
    sections, _, pipes = planned(spark, d)
    return depth.profile_report(sections, pipes)


@query("crossing_report")
def crossing_report(spark, d):
    return depth.crossing_report(*planned(spark, d))


@query("depth_audit", sql(f"""SELECT dataset_id, edge_id::VARCHAR AS object_id, code FROM (SELECT *, (1 + 0.1 * greatest(0, h0 - 3) +
    1 + 0.1 * greatest(0, h1 - 3)) / 2 * length * 74023 AS price FROM (SELECT *, 3 + (start_id % 7 - 3) * 0.5 AS h0, 3 + (end_id % 7 - 3) * 0.5 AS h1
    FROM fx_edges)), LATERAL (SELECT unnest([CASE WHEN abs(h1 - h0) / length > 0.10001 THEN 'SLOPE' END,
    CASE WHEN (h0 - 3) * (h1 - 3) < -1e-7 THEN 'NOT_SPLIT_AT_3M' END, CASE WHEN edge_id % 5 = 1 THEN 'PRICE' END]) AS code) WHERE code IS NOT NULL""",
                          "fx_edges"))
def depth_audit(spark, d):
    """Depths by node number, every fifth price off by a thousand."""
    def h(c):
        return 3 + (F.col(c) % 7 - 3) * 0.5
    s = _sized(spark, d).select("dataset_id", "edge_id", "start_id", "end_id", "dn", F.lit(0.0).alias("s_from"),
                                F.col("length").alias("s_to"), F.lit(1.0).alias("factor"), h("start_id").alias("h0"),
                                h("end_id").alias("h1"))
    mean = (rules.depth_factor(F.col("h0")) + rules.depth_factor(F.col("h1"))) / 2
    s = s.withColumn("cost", (F.col("s_to") * rules.PRICE_NEW[0] * mean) + F.when(F.col("edge_id") % 5 == 1, 1000.0).otherwise(0.0))
    return depth.audit_depth(s)


# ---- stored profiles of all pipes with their real passages ----
LEVEL = 3.75  # depth of every pipe's middle third; nodes lie between 3 and that


def stored_profiles(spark, d):
    """(pieces, nodes): every pipe in three pieces, down to a level and up again, with some heights, lengths and prices off."""
    from utilnet.operators import graph
    n = bridge.nodes(spark, d)
    h = lambda c: F.lit(3.0) + (F.col(c) % 4) * 0.25
    e = graph.flows(n, bridge.edges(spark, d)).join(bridge.edges(spark, d).select("dataset_id", "edge_id"), ["dataset_id", "edge_id"])
    third = F.col("length") / 3
    rows = e.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("s_from", third * F.col("n")).withColumn(
        "s_to", F.when(F.col("n") == 2, F.col("length")).otherwise(third * (F.col("n") + 1)))
    rows = rows.withColumn("h0", F.when(F.col("n") == 0, h("start_id")).otherwise(LEVEL)).withColumn(
        "h1", F.when(F.col("n") == 2, h("end_id")).otherwise(LEVEL))
    joint = F.concat(F.col("edge_id").cast("string"), F.lit(":"))
    name = lambda c, k, last: F.when(F.col("n") == last, F.col(c).cast("string")).otherwise(F.concat(joint, (F.col("n") + k).cast("string")))

    def vertex(share: float, off=0.0):
        at = (F.col("s_from") + share * (F.col("s_to") - F.col("s_from"))) / F.col("length")
        return F.struct((F.col("x0") + at * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + at * (F.col("y1") - F.col("y0"))).alias("y"),
                        (-(F.col("h0") + share * (F.col("h1") - F.col("h0"))) + off).alias("z"))

    lift = F.when((F.col("edge_id") % 13 == 4) & (F.col("n") == 1), 0.01).otherwise(0.0)
    unit, mean = rules.price_new(F.col("dn_idx")), (rules.depth_factor(F.col("h0")) + rules.depth_factor(F.col("h1"))) / 2
    path = F.array(vertex(0.0), vertex(0.5, lift), vertex(1.0))
    pieces = cut(rows.select(
        "dataset_id", "edge_id", F.concat(joint, F.lit("p"), F.col("n").cast("string")).alias("piece_id"), name("start_id", 0, 0).alias("start_id"),
        name("end_id", 1, 2).alias("end_id"), "s_from", "s_to", "h0", "h1", "dn", path.alias("path"),
        (F.col("s_to") - F.col("s_from") + F.when((F.col("edge_id") % 17 == 6) & (F.col("n") == 0), 1.0).otherwise(0.0)).alias("length"),
        ((F.col("s_to") - F.col("s_from")) * unit * mean).alias("cost")))
    low = F.when((F.col("dataset_id") % 5 == 2) & (F.col("node_id") == 7), 0.1).otherwise(0.0)
    nodes = n.select("dataset_id", F.col("node_id").cast("string").alias("node_id"), (-h("node_id") + low).alias("z")).unionByName(
        pieces.filter("start_id LIKE '%:%'").select("dataset_id", F.col("start_id").alias("node_id"), F.lit(-LEVEL).alias("z")))
    return pieces, cut(nodes)


def _profiles():
    from utilnet.plans.passage_queries import SECT
    heights = ", ".join(f"('{r[0]}', {r[2]}, {r[4]}::DOUBLE, {r[7]}::DOUBLE, {r[8]}::DOUBLE, {r[9]}::DOUBLE)" for r in rules.RESTRICTIONS if not r[1])
    new, high = rules.PRICE_NEW, rules.HEIGHT
    return {
        **SECT, "rl": f"SELECT * FROM (VALUES {heights}) t(rule, poly, ext, gap, oldh, top)",
        "ph": f"SELECT dataset_id, edge_id, length AS len, (3 + start_id % 4 * 0.25)::DOUBLE AS a, (3 + end_id % 4 * 0.25)::DOUBLE AS b, start_id, end_id, dn_idx FROM fx_flows",
        "crs": """SELECT c.dataset_id, c.edge_id, c.object_id, poly, gap, oldh, top, c0 - ext AS f, c1 + ext AS t, greatest(0, c0 - ext) AS sf, least(len, c1 + ext) AS st, len, a, b, dn_idx
          FROM core c JOIN rl USING (rule) JOIN ph ON ph.dataset_id = c.dataset_id AND ph.edge_id = c.edge_id""",
        "smp": """SELECT *, (sf + st) / 2 AS x, true AS mid FROM crs UNION ALL SELECT *, sf, false FROM crs UNION ALL SELECT *, st, false FROM crs
          UNION ALL SELECT crs.*, len * k / 3, false FROM crs, (VALUES (1), (2)) v(k) WHERE len * k / 3 > sf AND len * k / 3 < st""",
        "dep": f"""SELECT *, CASE WHEN x <= len / 3 THEN a + ({LEVEL} - a) * x / (len / 3) WHEN x <= 2 * len / 3 THEN {LEVEL} ELSE {LEVEL} + (b - {LEVEL}) * (x - 2 * len / 3) / (len / 3) END AS h FROM smp""",
        "mids": "SELECT *, h AS m FROM dep WHERE mid",
        "pz": f"""SELECT dataset_id, edge_id, n, len * n / 3 AS s0, len * (n + 1) / 3 AS s1, CASE n WHEN 0 THEN a ELSE {LEVEL}::DOUBLE END AS h0, CASE n WHEN 2 THEN b ELSE {LEVEL}::DOUBLE END AS h1,
          start_id, end_id, dn_idx FROM ph, (VALUES (0), (1), (2)) v(n)""",
        "prc": f"""SELECT dataset_id, edge_id, n, sum((r - l) * ({new})[dn_idx + 1] * factor * (1 + 0.1 * (h0 + (h1 - h0) * (l - s0) / (s1 - s0) - 3) + 1 + 0.1 * (h0 + (h1 - h0) * (r - s0) / (s1 - s0) - 3)) / 2) AS price,
          any_value((s1 - s0) * ({new})[dn_idx + 1] * (2 + 0.1 * (h0 - 3) + 0.1 * (h1 - 3)) / 2) AS cost FROM (SELECT pz.*, factor, greatest(s0, f) AS l, least(s1, t) AS r
          FROM pz JOIN sec ON sec.dataset_id = pz.dataset_id AND sec.edge_id = pz.edge_id) WHERE r - l > 1e-9 GROUP BY 1, 2, 3""",
        "bad": f"""SELECT DISTINCT dataset_id, edge_id || '|' || object_id AS object_id, 'PLATEAU_TRUNCATED' AS code FROM crs WHERE f < -0.002 OR t > len + 0.002
          UNION ALL SELECT DISTINCT d.dataset_id, d.edge_id || '|' || d.object_id, 'PLATEAU_NOT_LEVEL' FROM dep d JOIN mids m ON m.dataset_id = d.dataset_id AND m.edge_id = d.edge_id
            AND m.object_id = d.object_id AND m.sf = d.sf AND m.st = d.st WHERE abs(d.h - m.m) >= 0.001
          UNION ALL SELECT DISTINCT dataset_id, edge_id || '|' || object_id, 'VERTICAL_CLEARANCE' FROM mids WHERE CASE WHEN poly THEN m ELSE greatest(top - m - ({high})[dn_idx + 1], m - top - oldh) END < gap - 1e-5
          UNION ALL SELECT dataset_id, edge_id || ':p1', 'Z_OFF' FROM ph WHERE edge_id % 13 = 4
          UNION ALL SELECT dataset_id, edge_id || ':p0', 'LENGTH' FROM ph WHERE edge_id % 17 = 6
          UNION ALL SELECT dataset_id, edge_id || ':p' || n, 'NODE_DEPTH' FROM pz WHERE dataset_id % 5 = 2 AND ((n = 0 AND start_id = 7) OR (n = 2 AND end_id = 7))
          UNION ALL SELECT dataset_id, edge_id || ':p' || n, 'PRICE' FROM prc WHERE abs(price - cost) >= 3""",
    }


@query("profile_audit", sql("SELECT * FROM bad", "fx_flows", "fx_areas", "fx_ulines", extra=_profiles()))
def profile_audit(spark, d):
    """Stored profiles of all pipes against their real passages: level stretches, gaps, heights of vertices and nodes, prices."""
    from utilnet.plans.passage_queries import fx_passages
    pieces, nodes = stored_profiles(spark, d)
    return depth.audit_profiles(pieces, nodes, cut(fx_passages(spark, d))).distinct()


@query("profile_totals", sql(f"""SELECT dataset_id, code FROM (SELECT dataset_id, unnest([CASE WHEN dataset_id % 6 = 0 THEN 'STATED_MIN_DEPTH' END, CASE WHEN dataset_id % 6 = 1 THEN 'STATED_MAX_DEPTH' END,
  CASE WHEN dataset_id % 6 = 2 THEN 'STATED_MAX_SLOPE' END, CASE WHEN dataset_id % 6 = 3 THEN 'STATED_LENGTH' END, CASE WHEN dataset_id % 6 = 4 THEN 'STATED_COST' END]) AS code
  FROM fx_edges GROUP BY 1) WHERE code IS NOT NULL""", "fx_edges"))
def profile_totals(spark, d):
    """Totals of stored profiles against a report with one figure off in most maps."""
    pieces, _ = stored_profiles(spark, d)
    totals = cut(depth.profile_totals(pieces))
    kind = F.col("dataset_id") % 6
    shift = {"min_depth": (0, 0.01), "max_depth": (1, 0.01), "max_slope": (2, 0.001), "length": (3, 0.5), "cost": (4, 100.0)}
    stated = totals.withColumns({c: F.col(c) + F.when(kind == k, by).otherwise(0.0) for c, (k, by) in shift.items()})
    return depth.total_findings(totals, stated)


_STORED = ("fx_flows", "fx_areas", "fx_ulines")


@query("short_plateaus", sql("""SELECT DISTINCT dataset_id, edge_id, object_id, 'PLATEAU_TOO_SHORT' AS code FROM crs
  WHERE f < -1e-8 OR t > len + 1e-8""", *_STORED, extra=_profiles()))
def short_plateaus(spark, d):
    """Passages of all pipes whose level stretch an end of the pipe cuts off."""
    from utilnet.plans.passage_queries import fx_passages
    return depth.short_plateaus(fx_passages(spark, d), _sized(spark, d)).distinct()


@query("depth_at_points", sql(f"""SELECT dataset_id, edge_id, share::BIGINT AS share, round(CASE WHEN share <= 1 THEN a + ({LEVEL} - a) * share * 0.75
  WHEN share = 2 THEN {LEVEL} ELSE {LEVEL} + (b - {LEVEL}) * 0.25 END::DOUBLE, 6) AS depth FROM ph, (VALUES (0), (1), (2), (3)) v(share)""", *_STORED, extra=_profiles()))
def depth_at_points(spark, d):
    """Depths at the start and at every quarter of all pipes' stored profiles."""
    pieces, _ = stored_profiles(spark, d)
    size = pieces.groupBy("dataset_id", "edge_id").agg(F.max("s_to").alias("length"))
    points = size.withColumn("point_id", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("at", F.col("length") * F.col("point_id") / 4)
    return depth.depth_at(pieces.select("dataset_id", "edge_id", "s_from", "s_to", "h0", "h1"), points.drop("length")).select(
        "dataset_id", "edge_id", F.col("point_id").cast("long").alias("share"), F.round("depth", 6).alias("depth"))


@query("stored_crossings", sql(f"""SELECT dataset_id, edge_id, object_id, round(sf, 4) AS s_from, round(st, 4) AS s_to, round(m, 6) AS depth,
  CASE WHEN poly THEN 'under_surface' WHEN up >= gap - 1e-8 THEN 'above' ELSE 'below' END AS position, gap AS required, round(real, 6) AS actual,
  CASE WHEN real < gap - 1e-8 THEN 'VERTICAL_CLEARANCE' END AS code FROM (SELECT *, CASE WHEN poly THEN m WHEN up >= gap - 1e-8 THEN up ELSE m - top - oldh END AS real
  FROM (SELECT *, top - m - ({rules.HEIGHT})[dn_idx + 1] AS up FROM mids))""", *_STORED, extra=_profiles()))
def stored_crossings(spark, d):
    """Every real passage under the stored profiles: which side the pipe takes, and the gap it keeps."""
    from utilnet.plans.passage_queries import fx_passages
    pieces, _ = stored_profiles(spark, d)
    sizes = pieces.groupBy("dataset_id", "edge_id").agg(F.max("dn").alias("dn"), F.max("s_to").alias("length"))
    out = depth.crossing_report(pieces.select("dataset_id", "edge_id", "s_from", "s_to", "h0", "h1"), cut(fx_passages(spark, d)), cut(sizes))
    return out.select("dataset_id", "edge_id", "object_id", *[F.round(c, 4).alias(c) for c in ("s_from", "s_to")], F.round("depth", 6).alias("depth"),
                      "position", "required", F.round("actual", 6).alias("actual"), "code")


@query("stored_profile_report", sql(f"""SELECT dataset_id, least(3, min(least(h0, h1))) AS min_depth, greatest(3, max(greatest(h0, h1))) AS max_depth,
  round(max(abs(h1 - h0) / (s1 - s0)), 8) AS max_slope, round(sum((s1 - s0) * ({rules.PRICE_NEW})[dn_idx + 1] * (0.1 * (h0 - 3) + 0.1 * (h1 - 3)) / 2), 1) AS depth_cost
  FROM pz GROUP BY 1""", *_STORED, extra=_profiles()))
def stored_profile_report(spark, d):
    """Range, slope and what the depth adds to the price, per map."""
    pieces, _ = stored_profiles(spark, d)
    sizes = pieces.groupBy("dataset_id", "edge_id").agg(F.max("dn").alias("dn"))
    flat = pieces.select("dataset_id", "edge_id", "s_from", "s_to", "h0", "h1", F.lit(1.0).alias("factor"))
    return depth.profile_report(flat, sizes).select("dataset_id", "min_depth", "max_depth", F.round("max_slope", 8).alias("max_slope"),
                                                    F.round("depth_cost", 1).alias("depth_cost"))


@query("depth_objectives", sql(f"""SELECT p.dataset_id, round(sum(v * (h0 + h1) / 2), 3) AS trench_volume, round(sum(v * greatest(0, (h0 + h1) / 2 - 3)), 3) AS deep_volume,
  sum((sl <> 0 AND sl <> before)::INT)::BIGINT AS depth_changes, round(sum(abs(h1 - h0)), 6) AS vertical_change, greatest(3, max(greatest(h0, h1))) AS max_depth,
  round(sum(CASE WHEN (h0 + h1) / 2 > 3.01 THEN s1 - s0 ELSE 0 END), 4) AS deep_length FROM (SELECT *, coalesce(lag(sl) OVER (PARTITION BY dataset_id, edge_id ORDER BY n), 0) AS before
  FROM (SELECT *, (s1 - s0) * (1 + 2 * ({rules.HEIGHT})[dn_idx + 1] + CASE WHEN ({rules.DN})[dn_idx + 1] <= 150 THEN 0.15 ELSE 0.25 END) AS v,
  CASE WHEN h1 - h0 > 0.01 THEN 1 WHEN h1 - h0 < -0.01 THEN -1 ELSE 0 END AS sl FROM pz)) p GROUP BY 1""", *_STORED, extra=_profiles()))
def depth_objectives(spark, d):
    """Earthwork and installation figures of pipes with a depth profile: volumes, changes of slope, vertical change, deep length."""
    from utilnet.operators import evaluate
    pieces, _ = stored_profiles(spark, d)
    sizes = pieces.groupBy("dataset_id", "edge_id").agg(F.max("dn").alias("dn"))
    flat = pieces.select("dataset_id", "edge_id", "s_from", "s_to", "h0", "h1", F.lit(1.0).alias("factor"))
    stats = spark.createDataFrame([], "dataset_id long, turn_metres double")
    out = evaluate.objectives(flat, sizes, stats)
    return out.select("dataset_id", *[F.round(c, 3).alias(c) for c in ("trench_volume", "deep_volume")], F.col("depth_changes").cast("long").alias("depth_changes"),
                      F.round("vertical_change", 6).alias("vertical_change"), "max_depth", F.round("deep_length", 4).alias("deep_length"))
