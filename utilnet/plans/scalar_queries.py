"""Scalar functions and the rule catalogue over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo, rules, text
from utilnet.functions.register import register_functions
from utilnet.plans import bridge
from utilnet.plans.bridge import sql, table
from utilnet.plans.registry import query

DN = f"({rules.DN})"
IDX = f"len(list_filter({rules.CAPACITY}, lambda c: v > c + 1e-9))"


@query("diameter_for_flow", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {DN}[len(list_filter({rules.CAPACITY}, lambda c: l_extendedprice / 5 > c + 1e-9)) + 1]::BIGINT AS dn,
  l_extendedprice / 5 > 22501.9 + 1e-9 AS too_large FROM lineitem""")
def diameter_for_flow(spark, d):
    flow = F.col("l_extendedprice") / 5
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        rules.diameter(flow).cast("long").alias("dn"),
        (rules.flow_index(flow) == rules.OVERSIZE).alias("too_large"))


@query("pipe_rules", f"""SELECT object_id, dn, round(2 * ({rules.HEIGHT})[list_position({DN}, dn)]
  + CASE WHEN dn <= 150 THEN 0.15 ELSE 0.25 END, 9)::DOUBLE AS width,
  CASE WHEN dn < 500 THEN 5.0 WHEN dn <= 800 THEN 7.0 ELSE 9.0 END::DOUBLE AS clearance,
  CASE WHEN dn <= 200 THEN 3e6 WHEN dn <= 500 THEN 5e6 WHEN dn <= 1000 THEN 8e6 ELSE 12e6 END::DOUBLE
    AS chamber, round(1 + 0.1 * greatest(0, object_id % 10 - 3), 9)::DOUBLE AS depth_factor,
  round(2 * (CASE WHEN dn < 500 THEN 5.0 WHEN dn <= 800 THEN 7.0 ELSE 9.0 END +
    (2 * ({rules.HEIGHT})[list_position({DN}, dn)] + CASE WHEN dn <= 150 THEN 0.15 ELSE 0.25 END) / 2)
    + 0.05, 9)::DOUBLE AS approach
  FROM (SELECT p_partkey AS object_id, {DN}[p_partkey % 18 + 1]::BIGINT AS dn FROM part)""")
def pipe_rules(spark, d):
    key = F.col("p_partkey")
    dn = F.col("dn")
    base = table(spark, d, "part").select(
        key.alias("object_id"), rules.dn_of((key % 18).cast("int")).cast("long").alias("dn"))
    return base.select(
        "object_id", "dn", F.round(rules.pipe_width(dn), 9).alias("width"),
        rules.building_clearance(dn).alias("clearance"), rules.chamber_price(dn).alias("chamber"),
        F.round(rules.depth_factor((F.col("object_id") % 10).cast("double")), 9)
         .alias("depth_factor"),
        F.round(rules.approach_length(dn), 9).alias("approach"))


@query("rule_lookup", sql(f"""SELECT b.dataset_id, b.object_id, b.rule, clearance, extension, factor
  FROM fx_boxes b JOIN (VALUES {", ".join(
      f"('{r[0]}', {r[3]}::DOUBLE, {r[4]}::DOUBLE, {r[5]}::DOUBLE)" for r in rules.RESTRICTIONS)})
  AS t(rule, clearance, extension, factor) USING (rule)""", "fx_boxes"))
def rule_lookup(spark, d):
    table11 = rules.restriction_table(spark).select("rule", "clearance", "extension", "factor")
    return bridge.boxes(spark, d).join(F.broadcast(table11), "rule").select(
        "dataset_id", "object_id", "rule", "clearance", "extension", "factor")


@query("network_scores", sql("""SELECT network_id, round(0.7*cost/25e6 + 0.3*length/100, 9) AS contest,
  round(0.3*cost/25e6 + 0.7*length/100, 9) AS protocol FROM fx_variants""", "fx_variants"))
def network_scores(spark, d):
    c, n = F.col("cost"), F.col("length")
    return bridge.variants(spark, d).select(
        "network_id", F.round(rules.score(c, n), 9).alias("contest"),
        F.round(rules.score(c, n, "protocol"), 9).alias("protocol"))


@query("score_rounding", """SELECT o_orderkey, round((o_totalprice / 1000)::VARCHAR::DECIMAL(38,18), 4)
  ::DOUBLE AS score4 FROM orders""")
def score_rounding(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", rules.score4(F.col("o_totalprice") / 1000).alias("score4"))


_TURN = """CASE WHEN t < 1e-5 THEN 0 WHEN abs(t - pi()/2) < 1e-5 THEN 25
  WHEN abs(t - pi()/4) < 1e-5 THEN 50 WHEN abs(t - 3*pi()/4) < 1e-5 THEN 75
  WHEN t < radians(4) THEN 35 WHEN abs(t - pi()/2) < radians(4) THEN 35
  WHEN abs(t - pi()/4) < radians(4) THEN 60 WHEN abs(t - 3*pi()/4) < radians(4) THEN 85
  ELSE 100 END::DOUBLE"""


@query("turn_penalties", sql(f"""SELECT dataset_id, edge_id, round(t, 6) AS turn, {_TURN} AS penalty,
    round(j, 6) AS joint FROM (
  SELECT e.dataset_id, e.edge_id, acos(greatest(-1, least(1, cos(a - b)))) AS t,
    acos(least(1, abs(cos(a - b)))) AS j FROM (
    SELECT e.dataset_id, e.edge_id, atan2(e.y1-e.y0, e.x1-e.x0) AS a,
           atan2(p.y1-p.y0, p.x1-p.x0) AS b
    FROM fx_edges e JOIN fx_edges p ON p.dataset_id = e.dataset_id AND p.end_id = e.start_id) e)""",
                             "fx_edges"))
def turn_penalties(spark, d):
    e = bridge.edges(spark, d).withColumn("a", geo.bearing(*map(F.col, ("x0", "y0", "x1", "y1"))))
    up = e.select("dataset_id", F.col("end_id").alias("start_id"), F.col("a").alias("b"))
    turned = e.join(up, ["dataset_id", "start_id"]).withColumn(
        "t", geo.turn_angle(F.col("a"), F.col("b")))
    return turned.select("dataset_id", "edge_id", F.round("t", 6).alias("turn"),
                         geo.turn_penalty(F.col("t")).alias("penalty"),
                         F.round(geo.joint_angle(F.col("a"), F.col("b")), 6).alias("joint"))


@query("frame_differences", """SELECT c_custkey, round(least(d, pi()/2 - d), 9) AS gap FROM (
  SELECT c_custkey, abs(v - (pi()/2) * round_even(v / (pi()/2), 0)) AS d FROM (
  SELECT c_custkey, c_acctbal / 1000 AS v FROM customer))""")
def frame_differences(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.round(geo.frame_difference(F.col("c_acctbal") / 1000, F.lit(0.0)), 9)
        .alias("gap"))


@query("coordinate_keys", """SELECT event_id, floor(value * 1000 + 0.5)::BIGINT || ':' ||
  floor(-value * 250 + 0.5)::BIGINT AS coord_key FROM events""")
def coordinate_keys(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", geo.coordinate_key(v, -v / 4).alias("coord_key"))


@query("range_guard", """SELECT c_custkey, abs(c_acctbal / 40) <= 180 AND c_acctbal / 90 >= 0
  AND c_acctbal / 90 <= 84 AS usable FROM customer""")
def range_guard(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", geo.in_range(b / 40, b / 90).alias("usable"))


def _series(coefs, fn, outer, a, b):
    return " + ".join(f"{c!r} * {fn}({2 * j} * {a}) * {outer}({2 * j} * {b})"
                      for j, c in enumerate(coefs, 1))


_UTM = f"""SELECT c_custkey, round(500000 + {geo.RADIUS!r} * (eta + {_series(
    geo.ALPHA, "cos", "sinh", "xi", "eta")}), 3) AS x, round({geo.RADIUS!r} * (xi + {_series(
    geo.ALPHA, "sin", "cosh", "xi", "eta")}), 3) AS y FROM (
  SELECT c_custkey, atan2(t, cos(lam)) AS xi,
    asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM (
  SELECT c_custkey, radians(37 + (c_custkey % 4000) / 1000.0::DOUBLE) - radians(39) AS lam,
    sinh(atanh(sin(p)) - {geo._ECC!r} * atanh({geo._ECC!r} * sin(p))) AS t
  FROM (SELECT c_custkey, radians(55 + (c_custkey * 7 % 1000) / 1000.0::DOUBLE) AS p FROM customer)))"""


def _lonlat(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", (37 + (k % 4000) / 1000.0).alias("lon"),
        (55 + (k * 7 % 1000) / 1000.0).alias("lat"))


@query("project_utm", _UTM)
def project_utm(spark, d):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    return _lonlat(spark, d).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("unproject_utm", """SELECT c_custkey, round(37 + (c_custkey % 4000) / 1000.0, 9)::DOUBLE AS lon,
  round(55 + (c_custkey * 7 % 1000) / 1000.0, 9)::DOUBLE AS lat FROM customer""")
def unproject_utm(spark, d):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"))
    return (_lonlat(spark, d).select("c_custkey", x.alias("x"), y.alias("y"))
            .select("c_custkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat")))


@query("text_digests", """SELECT doc_id, sha256(text) AS sha, CASE WHEN
  ('0x' || substr(sha256(text), 1, 2))::BIGINT % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
  trim(source) <> '' AND length(source) <= 256 AS id_ok FROM documents""")
def text_digests(spark, d):
    sha = text.sha256(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", sha.alias("sha"), text.map_split(sha).alias("split"),
        text.valid_id(F.col("source")).alias("id_ok"))


@query("option_keys", """SELECT event_id, sha256('k=' || json_extract_string(props, '$.k') || '&mode=' ||
  event_type || CASE WHEN event_type = 'click' THEN '&treeSingleRootRequired=true' ELSE '' END || '#' ||
  user_id::VARCHAR) AS run_key FROM events""")
def option_keys(spark, d):
    tree = F.when(F.col("event_type") == "click", "tree").otherwise("balanced")
    options = F.create_map(
        F.lit("mode"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"),
        F.lit("routingStrategy"), tree, F.lit("rlSeed"), F.col("event_id").cast("string"),
        F.lit("treeSingleRootRequired"), F.lit("true"))
    return table(spark, d, "events").select(
        "event_id", text.options_key(options, F.col("user_id").cast("string")).alias("run_key"))


@query("line_measures", sql("""SELECT dataset_id, object_id, round(len, 6) AS len,
    round(x0 + (x1-x0) * 0.25, 6) AS qx, round(y0 + (y1-y0) * 0.25, 6) AS qy,
    round(greatest(0, least(1, ((500-x0)*(x1-x0)+(500-y0)*(y1-y0))/(len*len))) * len, 6) AS at_center
  FROM (SELECT *, sqrt((x1-x0)**2+(y1-y0)**2) AS len FROM fx_ulines)""", "fx_ulines"))
def line_measures(spark, d):
    path = F.col("path")
    mid = F.transform(path, lambda p: p)  # the line with its own midpoint added, still straight
    three = F.array(F.get(mid, F.lit(0)), F.struct(
        ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")),
        F.get(mid, F.lit(1)))
    lines = bridge.with_path(bridge.utility_lines(spark, d)).withColumn("path", three)
    length = geo.path_length(path)
    return lines.select(
        "dataset_id", "object_id", F.round(length, 6).alias("len"),
        F.round(geo.point_at(path, length / 4)["x"], 6).alias("qx"),
        F.round(geo.point_at(path, length / 4)["y"], 6).alias("qy"),
        F.round(geo.project(path, F.lit(500.0), F.lit(500.0)), 6).alias("at_center"))


@query("straightness", sql("""SELECT dataset_id, edge_id, abs((x1-x0)*(my-y0)-(y1-y0)*(mx-x0)) <=
    sqrt((x1-x0)**2+(y1-y0)**2) * 1e-5 AND sqrt((x1-x0)**2+(y1-y0)**2) >= 1e-8 AS straight
  FROM (SELECT *, (x0+x1)/2 + (edge_id % 3) * 0.5 AS mx, (y0+y1)/2 AS my FROM fx_edges)""", "fx_edges"))
def straightness(spark, d):
    mid = F.struct(((F.col("x0") + F.col("x1")) / 2 + (F.col("edge_id") % 3) * 0.5).alias("x"),
                   ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    e = bridge.with_path(bridge.edges(spark, d))
    path = F.array(F.get("path", F.lit(0)), mid, F.get("path", F.lit(1)))
    return e.select("dataset_id", "edge_id", geo.is_straight(path).alias("straight"))


@query("residual_labels", sql("""SELECT group_id, line, part, supp, round(ln(1 + greatest(0, score - bound)), 9)
  AS target, round(bound + exp(least(20, greatest(0, ln(1 + score - bound)))) - 1, 6) AS priority
  FROM fx_cands""", "fx_cands"))
def residual_labels(spark, d):
    s, b = F.col("score"), F.col("bound")
    target = F.log1p(F.greatest(F.lit(0.0), s - b))
    back = b + F.expm1(F.least(F.lit(20.0), F.greatest(F.lit(0.0), target)))
    return bridge.candidates(spark, d).select(
        "group_id", "line", "part", "supp", F.round(target, 9).alias("target"),
        F.round(back, 6).alias("priority"))


@query("bounded_rewards", sql("""SELECT job_id, event_id, round(CASE WHEN complete THEN
  -(score/17)/(1 + score/17) ELSE -2 - 3/17.0 END, 9)::DOUBLE AS reward FROM fx_attempts""",
                              "fx_attempts"))
def bounded_rewards(spark, d):
    from utilnet.operators.learn import reward
    a = bridge.attempts(spark, d)
    connected = F.when(F.col("complete"), 17).otherwise(14)
    return a.select("job_id", "event_id", F.round(
        reward(F.col("score"), connected, F.lit(17)), 9).alias("reward"))


@query("sql_functions", sql(f"""SELECT network_id, {DN}[len(list_filter({rules.CAPACITY},
    lambda c: length * 20 > c + 1e-9)) + 1]::BIGINT AS dn,
    round(0.7*cost/25e6 + 0.3*length/100, 9) AS score,
    round(1 + 0.1 * greatest(0, bends - 3), 9)::DOUBLE AS depth_factor FROM fx_variants""", "fx_variants"))
def sql_functions(spark, d):
    register_functions(spark)
    return bridge.variants(spark, d).selectExpr(
        "network_id", "CAST(tn_diameter(length * 20) AS BIGINT) AS dn",
        "round(tn_score(cost, length), 9) AS score",
        "round(tn_depth_factor(CAST(bends AS DOUBLE)), 9) AS depth_factor")
