"""Costs, scores and the flagship chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import evaluate, existing, graph, ordering, passages
from utilnet.plans import bridge
from utilnet.plans.bridge import sql
from utilnet.plans.existing_queries import _REC, _ties, _tree_objects
from utilnet.plans.graph_queries import CHAINS, LARGE, LARGE_CHAINS, large_nodes
from utilnet.plans.passage_queries import KINK, SECT, fx_passages, kinked
from utilnet.plans.registry import query
from utilnet.session import cut

NET_SQL = {
    "net": """SELECT *, CASE WHEN node_id = 0 THEN CASE WHEN dataset_id % 2 = 0 THEN 'heat_network'
      ELSE 'heat_chamber' END END AS existing_type FROM fx_nodes""",
    "dem": "SELECT dataset_id, src AS demand_id, demand AS flow, src % 29 = 3 AS missing FROM fx_nodes WHERE demand > 0",
}


def net(spark, d):
    """The tree as a network under audit: what its tie sits on, and which terminal serves whom."""
    kind = F.when(F.col("dataset_id") % 2 == 0, "heat_network").otherwise("heat_chamber")
    return bridge.nodes(spark, d).withColumn(
        "existing_type", F.when(F.col("node_id") == 0, kind)).withColumn(
        "entry_id", F.when((F.col("demand") > 0) & (F.col("src") % 29 != 3), F.col("src")))


def demands(spark, d):
    return bridge.nodes(spark, d).filter("demand > 0").select(
        "dataset_id", F.col("src").alias("demand_id"), F.col("demand").alias("flow"))


# Level-by-level sizes of the chain tree in SQL (the trees are four levels deep).
_LIM = str(rules.RUN_LIMIT)
DP = {
    **CHAINS,
    "rc": """SELECT dataset_id, edge_id, edge_id AS chain_id, length AS reach FROM fx_flows JOIN hd USING
      (dataset_id, edge_id) WHERE edge_id = chain_id UNION ALL SELECT r.dataset_id, f.edge_id, r.chain_id,
      r.reach + f.length FROM rc r JOIN fx_flows f ON f.dataset_id = r.dataset_id AND f.start_id = r.edge_id
      JOIN hd ON hd.dataset_id = f.dataset_id AND hd.edge_id = f.edge_id AND hd.chain_id = r.chain_id""",
    "ct": """SELECT c.dataset_id, c.chain_id, c.chain_idx, u.chain_id AS up_chain, u.reach AS attach, own.own_reach
      FROM cidx c JOIN fx_flows h ON h.dataset_id = c.dataset_id AND h.edge_id = c.chain_id
      LEFT JOIN rc u ON u.dataset_id = c.dataset_id AND u.edge_id = h.start_id
      JOIN (SELECT dataset_id, chain_id, max(reach) AS own_reach FROM rc GROUP BY 1, 2) own
        ON own.dataset_id = c.dataset_id AND own.chain_id = c.chain_id""",
    "lv": """SELECT *, 0 AS lev FROM ct WHERE up_chain IS NULL UNION ALL SELECT ct.*, lev + 1 FROM lv
      JOIN ct ON ct.dataset_id = lv.dataset_id AND ct.up_chain = lv.chain_id""",
}
_LEVELS = 5
for _l in range(_LEVELS, -1, -1):
    _gain = "0" if _l == _LEVELS else "coalesce(max(b.attach + b.r), 0)"
    _join = "" if _l == _LEVELS else f"""LEFT JOIN q{_l + 1} b ON b.dataset_id = c.dataset_id
      AND b.up_chain = c.chain_id AND b.i = s.i AND b.chain_idx <= s.i AND b.nat >= s.i"""
    DP[f"r{_l}"] = f"""SELECT c.dataset_id, c.chain_id, c.chain_idx, c.up_chain, c.attach, s.i,
      greatest(c.own_reach, {_gain}) AS r FROM lv c CROSS JOIN (SELECT unnest(range(18)) AS i) s {_join}
      WHERE lev = {_l} GROUP BY 1, 2, 3, 4, 5, 6, c.own_reach"""
    DP[f"q{_l}"] = f"""SELECT *, coalesce(min(i) FILTER (i >= chain_idx AND r <= ({_LIM})[i + 1] + 0.001)
      OVER (PARTITION BY dataset_id, chain_id), 18) AS nat FROM r{_l}"""
DP["natl"] = " UNION ALL ".join(
    f"SELECT DISTINCT dataset_id, chain_id, up_chain, nat FROM q{_l}" for _l in range(_LEVELS + 1))
DP["fin2"] = """SELECT dataset_id, chain_id, nat FROM natl WHERE up_chain IS NULL UNION ALL
  SELECT n.dataset_id, n.chain_id, least(n.nat, f.nat) FROM fin2 f JOIN natl n
  ON n.dataset_id = f.dataset_id AND n.up_chain = f.chain_id"""
DP["sized"] = f"""SELECT f.dataset_id, f.edge_id, f.start_id, f.end_id, f.length, f.flow, f.dn_idx, nat AS i,
  ({rules.DN})[nat + 1] AS dn FROM fx_flows f JOIN hd USING (dataset_id, edge_id)
  JOIN fin2 USING (dataset_id, chain_id)"""
SUMMARY = {
    **DP, **NET_SQL,
    "pc": f"""SELECT dataset_id, sum(length) AS len, sum(length * ({rules.PRICE_NEW})[i + 1]) AS pipes
      FROM sized GROUP BY 1""",
    "inc2": """SELECT dataset_id, node_id, max(dn) AS dn FROM (SELECT dataset_id, start_id AS node_id, dn FROM sized
      UNION ALL SELECT dataset_id, end_id, dn FROM sized) GROUP BY 1, 2""",
    "cm": """SELECT n.dataset_id, sum(CASE WHEN coalesce(dn, 50) <= 200 THEN 3e6 WHEN dn <= 500 THEN 5e6
      WHEN dn <= 1000 THEN 8e6 ELSE 12e6 END) AS cam FROM net n LEFT JOIN inc2 USING (dataset_id, node_id)
      WHERE node_type = 'chamber' OR existing_type = 'heat_network' GROUP BY 1""",
    "ti": """SELECT e.dataset_id, sum(CASE WHEN existing_type = 'heat_chamber' THEN 5e6 ELSE 0 END) AS ties
      FROM sized e JOIN net n ON n.dataset_id = e.dataset_id AND n.node_id = e.start_id AND n.node_type = 'tie'
      GROUP BY 1""",
    "ms": """SELECT dataset_id, count(*) AS required, count(*) FILTER (NOT missing) AS connected,
      sum(CASE WHEN missing THEN 100e6 + 500000 * flow ELSE 0 END) AS pen FROM dem GROUP BY 1""",
    "total": """SELECT pc.dataset_id, len, pipes, coalesce(cam, 0) AS cam, coalesce(ties, 0) AS ties, required,
      connected, coalesce(pen, 0) AS pen, 0.7 * (pipes + coalesce(cam, 0) + coalesce(ties, 0) + coalesce(pen, 0)) / 25e6
      + 0.3 * len / 100 AS s FROM pc LEFT JOIN cm USING (dataset_id) LEFT JOIN ti USING (dataset_id)
      LEFT JOIN ms USING (dataset_id)""",
}


@query("flagship", sql("""SELECT dataset_id // 4 AS district, dataset_id, round(pipes + cam + ties + pen, 2) AS cost,
  round(len, 4) AS length, round(s, 4) AS score, row_number() OVER w AS rank,
  round(100 * min(s) OVER (PARTITION BY dataset_id // 4) / s, 4) AS rating FROM total
  WINDOW w AS (PARTITION BY dataset_id // 4 ORDER BY s, dataset_id)""", "fx_flows", extra=SUMMARY))
def flagship(spark, d):
    """Price every network and rank the networks of each district."""
    priced = evaluate.price_networks(net(spark, d), bridge.edges(spark, d), demands(spark, d))
    priced = priced.withColumn("district", bridge.div(F.col("dataset_id"), 4))
    ranked = ordering.rank_variants(priced.drop("score").withColumnRenamed("score_raw", "score"),
                                    ["district"], ["score", "dataset_id"])
    return ranked.select(
        "district", "dataset_id", F.round("calculated_cost", 2).alias("cost"),
        F.round("length", 4).alias("length"), F.round("score", 4).alias("score"),
        F.col("rank").cast("long").alias("rank"), F.round("rating", 4).alias("rating"))


@query("unpriced_networks", sql("""SELECT dataset_id, NOT bool_or(chain_idx >= 18) AS priced, NOT bool_or(chain_idx >= 18) AS ranked
  FROM cidx GROUP BY 1""", "fx_flows", extra=LARGE_CHAINS))
def unpriced_networks(spark, d):
    """A network with a pipe that no diameter can be has no cost, no score and no rank."""
    wanted = demands(spark, d).withColumn("flow", F.col("flow") * LARGE)
    priced = evaluate.price_networks(large_nodes(net(spark, d)), bridge.edges(spark, d), wanted)
    ranked = ordering.rank_variants(priced.drop("score").withColumnRenamed("score_raw", "score").withColumn(
        "district", bridge.div(F.col("dataset_id"), 4)), ["district"], ["score", "dataset_id"])
    return ranked.select("dataset_id", (F.col("calculated_cost").isNotNull() & F.col("score").isNotNull()).alias("priced"),
                         F.col("rank").isNotNull().alias("ranked"))


@query("repaired_diameters", sql("""SELECT dataset_id, edge_id, dn::BIGINT AS dn, i > dn_idx AS raised_for_length
  FROM sized""", "fx_flows", extra=DP))
def repaired_diameters(spark, d):
    from utilnet.plans.graph_queries import repaired
    return graph.length_checks(repaired(spark, d)).select(
        "dataset_id", "edge_id", F.col("dn").cast("long").alias("dn"), "raised_for_length")


FINAL_RUNS = {**DP, "last_run": """SELECT s.dataset_id, s.edge_id, s.length AS run_length, s.i FROM sized s
      LEFT JOIN sized p ON p.dataset_id = s.dataset_id AND p.end_id = s.start_id
      WHERE p.edge_id IS NULL OR p.i <> s.i UNION ALL
      SELECT s.dataset_id, s.edge_id, r.run_length + s.length, s.i FROM last_run r
      JOIN sized s ON s.dataset_id = r.dataset_id AND s.start_id = r.edge_id AND s.i = r.i"""}


@query("length_checks", sql(f"""SELECT s.dataset_id, s.edge_id, s.dn::BIGINT AS dn, round(run_length, 6) AS run_length,
  ({rules.RUN_LIMIT})[s.i + 1]::DOUBLE AS run_limit, round(s.flow, 6) AS flow, ({rules.CAPACITY})[s.i + 1]::DOUBLE AS capacity,
  s.i > s.dn_idx AS raised_for_length FROM sized s JOIN last_run r ON r.dataset_id = s.dataset_id AND r.edge_id = s.edge_id""",
                            "fx_flows", extra=FINAL_RUNS))
def length_checks(spark, d):
    from utilnet.plans.graph_queries import repaired
    return graph.length_checks(repaired(spark, d)).select(
        "dataset_id", "edge_id", F.col("dn").cast("long").alias("dn"), F.round("run_length", 6).alias("run_length"), "run_limit",
        F.round("flow", 6).alias("flow"), "capacity", "raised_for_length")


@query("network_completion", sql("""SELECT dataset_id, count(*) AS required, count(*) FILTER (NOT missing) AS connected,
  sum(CASE WHEN missing THEN 100e6 + 500000 * flow ELSE 0 END)::DOUBLE AS missing_penalty,
  NOT bool_or(missing) AS complete FROM dem GROUP BY 1""", "fx_nodes", extra=NET_SQL))
def network_completion(spark, d):
    return evaluate.completion(demands(spark, d), net(spark, d).filter("entry_id IS NOT NULL"))


@query("unconnected_demands", sql("SELECT dataset_id, demand_id, flow FROM dem WHERE missing", "fx_nodes",
                                  extra=NET_SQL))
def unconnected_demands(spark, d):
    return evaluate.unconnected(demands(spark, d), net(spark, d)).select(
        "dataset_id", "demand_id", "flow")


_FLOWNET = {**NET_SQL,
            "sized": f"SELECT *, dn_idx AS i, ({rules.DN})[dn_idx + 1] AS dn FROM fx_flows",
            "inc2": SUMMARY["inc2"], "cm": SUMMARY["cm"], "ti": SUMMARY["ti"], "pc": SUMMARY["pc"]}


@query("chamber_costs", sql("""SELECT n.dataset_id, n.node_id, greatest(50, coalesce(dn, 50))::BIGINT AS chamber_dn,
  CASE WHEN coalesce(dn, 50) <= 200 THEN 3e6 WHEN dn <= 500 THEN 5e6 WHEN dn <= 1000 THEN 8e6 ELSE 12e6 END::DOUBLE AS cost
  FROM net n LEFT JOIN inc2 USING (dataset_id, node_id) WHERE node_type = 'chamber' OR existing_type = 'heat_network'""",
                            "fx_flows", extra=_FLOWNET))
def chamber_costs(spark, d):
    n = net(spark, d)
    return evaluate.new_chambers(n, graph.flows(n, bridge.edges(spark, d))).select(
        "dataset_id", "node_id", F.col("chamber_dn").cast("long").alias("chamber_dn"), "cost")


@query("tie_costs", sql("""SELECT e.dataset_id, sum((existing_type = 'heat_chamber')::INT)::BIGINT AS chamber_ties,
  sum(CASE WHEN existing_type = 'heat_chamber' THEN 5e6 ELSE 0 END)::DOUBLE AS tie_cost,
  (count(*) * 5e6)::DOUBLE AS engineering_tie_cost FROM fx_edges e JOIN net n ON n.dataset_id = e.dataset_id
  AND n.node_id = e.start_id AND n.node_type = 'tie' GROUP BY 1""", "fx_edges", extra=NET_SQL))
def tie_costs(spark, d):
    return evaluate.tie_cost(net(spark, d), bridge.edges(spark, d))


@query("cost_lower_bounds", sql("""SELECT pc.dataset_id, round(0.7 * (pipes + coalesce(cam, 0) + coalesce(ties, 0)) / 25e6
  + 0.3 * len / 100, 6) AS lower_bound FROM pc LEFT JOIN cm USING (dataset_id) LEFT JOIN ti USING (dataset_id)""",
                                "fx_flows", extra=_FLOWNET))
def cost_lower_bounds(spark, d):
    n = net(spark, d)
    return evaluate.cost_lower_bound(n, graph.flows(n, bridge.edges(spark, d))).select(
        "dataset_id", F.round("lower_bound", 6).alias("lower_bound"))


_SPRICE = {**SECT, "sized": _FLOWNET["sized"]}


@query("pipe_costs", sql(f"""SELECT sec.dataset_id, round(sum((t - f) * factor * ({rules.PRICE_NEW})[i + 1]), 1) AS pipe_cost,
  round(sum((t - f) * factor), 4) AS weighted_length,
  round(sum(CASE WHEN factor > 1 THEN t - f ELSE 0 END), 4) AS special_length,
  round(sum((t - f) * factor) / sum(t - f), 6) AS complexity
  FROM sec JOIN sized USING (dataset_id, edge_id) GROUP BY 1""", "fx_flows", "fx_areas", "fx_ulines",
                         extra=_SPRICE))
def pipe_costs(spark, d):
    from utilnet.operators.passages import sections
    e = graph.flows(bridge.nodes(spark, d), bridge.edges(spark, d))
    out = evaluate.pipe_cost(sections(bridge.edges(spark, d), fx_passages(spark, d)), e)
    return out.select("dataset_id", F.round("pipe_cost", 1).alias("pipe_cost"),
                      F.round("weighted_length", 4).alias("weighted_length"),
                      F.round("special_length", 4).alias("special_length"),
                      F.round(F.col("weighted_length") / F.col("new_length"), 6).alias("complexity"))


@query("earthwork_indices", sql(f"""SELECT dataset_id, round(sum((t - f) * w * 3), 4) AS trench_volume,
  round(sum((t - f) * w * 3 * greatest(0, factor - 1)), 4) AS special_volume,
  round(sum((t - f) * w * 3 * (1 + 3 * greatest(0, factor - 1))), 3) AS earthwork_index FROM (
  SELECT sec.*, 1 + 2 * ({rules.HEIGHT})[i + 1] + CASE WHEN dn <= 150 THEN 0.15 ELSE 0.25 END AS w
  FROM sec JOIN sized USING (dataset_id, edge_id)) GROUP BY 1""", "fx_flows", "fx_areas", "fx_ulines",
                                extra=_SPRICE))
def earthwork_indices(spark, d):
    from utilnet.operators.passages import sections
    e = graph.flows(bridge.nodes(spark, d), bridge.edges(spark, d))
    stats = spark.createDataFrame([], "dataset_id long, turn_metres double")
    out = evaluate.objectives(sections(bridge.edges(spark, d), fx_passages(spark, d)), e, stats)
    return out.select("dataset_id", F.round("trench_volume", 4).alias("trench_volume"),
                      F.round("special_volume", 4).alias("special_volume"),
                      F.round("earthwork_index", 3).alias("earthwork_index"))


_TP = """CASE WHEN a < 1e-5 THEN 0 WHEN abs(a - pi()/2) < 1e-5 THEN 25 WHEN abs(a - pi()/4) < 1e-5 THEN 50
  WHEN abs(a - 3*pi()/4) < 1e-5 THEN 75 WHEN a < radians(4) OR abs(a - pi()/2) < radians(4) THEN 35
  WHEN abs(a - pi()/4) < radians(4) THEN 60 WHEN abs(a - 3*pi()/4) < radians(4) THEN 85 ELSE 100 END"""


@query("turn_statistics", sql(f"""SELECT dataset_id, count(*) FILTER (p > 0 AND NOT j) AS bends,
  count(*) FILTER (p > 0 AND j) AS connection_turns, sum(p)::DOUBLE AS turn_metres FROM (
  SELECT dataset_id, j, {_TP} AS p FROM (SELECT dataset_id, ang AS a, false AS j FROM kt UNION ALL
  SELECT c.dataset_id, acos(least(1, abs(cos(atan2(c.my - c.y0, c.mx - c.x0) - atan2(q.y1 - q.my, q.x1 - q.mx))))), true
  FROM kk c JOIN kk q ON q.dataset_id = c.dataset_id AND q.edge_id = c.start_id)) GROUP BY 1""",
                              "fx_edges", extra=KINK))
def turn_statistics(spark, d):
    e = kinked(spark, d)
    segs = geo.explode_segments(e.select("dataset_id", "edge_id", "path"))
    return evaluate.turn_stats(evaluate.turns(segs, bridge.edges(spark, d))).select(
        "dataset_id", "bends", "connection_turns", "turn_metres")


# ---- all profiles and objectives over real passages, reconstruction and penalties ----
RUNS = [("contest", "balanced"), ("appendix", "balanced"), ("appendix", "earthworks"), ("protocol", "balanced"), ("protocol", "installation")]
HUGE = 30000.0  # t/h, beyond the widest pipe

_PROFILES = {
    **SECT, **_FLOWNET, **_REC,
    # In every eleventh map an old pipe has to carry more than any diameter, in another its flow is not known.
    "sp": _REC["sp"].replace(
        "sum(demand) AS f", f"sum(CASE WHEN a.dataset_id % 11 = 3 AND a.node_id = 13 THEN {HUGE} ELSE demand END) AS f").replace(
        "demand FROM fx_nodes WHERE demand > 0", f"CASE WHEN dataset_id % 11 = 3 AND node_id = 13 THEN {HUGE} ELSE demand END FROM fx_nodes WHERE demand > 0"),
    "pc3": """SELECT sp.*, CASE WHEN n.dataset_id % 11 = 5 AND object_id = 2 THEN NULL ELSE src % 5 + f END AS fl
      FROM sp JOIN fx_nodes n ON n.dataset_id = sp.dataset_id AND n.node_id = sp.object_id""",
    "ix": f"SELECT *, CASE WHEN fl IS NOT NULL THEN len(list_filter({rules.CAPACITY}, lambda c: fl > c + 1e-9)) END AS i FROM pc3",
    "rec": f"""SELECT dataset_id, CASE WHEN bool_and(i IS NOT NULL AND i < 18) THEN sum((b - a) * ({rules.PRICE_RECON})[i + 1]) END AS recon, sum(b - a) AS rlen
      FROM ix WHERE i > 0 OR i IS NULL GROUP BY 1""",
    "pcs": f"""SELECT dataset_id, sum((t - f) * factor * ({rules.PRICE_NEW})[i + 1]) AS pipes, sum(t - f) AS len,
      sum((t - f) * (1 + 2 * ({rules.HEIGHT})[i + 1] + CASE WHEN dn <= 150 THEN 0.15 ELSE 0.25 END) * 3 * (1 + 3 * greatest(0, factor - 1))) AS earth
      FROM sec JOIN sized USING (dataset_id, edge_id) GROUP BY 1""",
    "trn": f"""SELECT dataset_id, sum({_TP}) AS metres FROM (SELECT c.dataset_id,
      acos(least(1, abs(cos(atan2(c.y1 - c.y0, c.x1 - c.x0) - atan2(q.y1 - q.y0, q.x1 - q.x0))))) AS a
      FROM fx_edges c JOIN fx_edges q ON q.dataset_id = c.dataset_id AND q.edge_id = c.start_id) GROUP BY 1""",
    "pnl": "SELECT dataset_id, sum(node_id % 3)::DOUBLE AS facade, sum(node_id % 2)::DOUBLE AS wall FROM fx_nodes GROUP BY 1",
    "ms": """SELECT dataset_id, sum(CASE WHEN missing THEN 100e6 + 500000 * flow ELSE 0 END) AS pen FROM dem GROUP BY 1""",
    "ties2": """SELECT e.dataset_id, sum(CASE WHEN existing_type = 'heat_chamber' THEN 5e6 ELSE 0 END) AS ties, count(*) * 5e6 AS eties
      FROM fx_edges e JOIN net n ON n.dataset_id = e.dataset_id AND n.node_id = e.start_id AND n.node_type = 'tie' GROUP BY 1""",
    "parts": """SELECT dataset_id, pipes, len, earth, coalesce(cam, 0) AS cam, coalesce(ties, 0) AS ties, coalesce(eties, 0) AS eties, coalesce(pen, 0) AS pen,
      CASE WHEN rlen IS NULL THEN 0 ELSE recon END AS recon, coalesce(rlen, 0) AS rlen, coalesce(metres, 0) AS metres, facade, wall
      FROM pcs LEFT JOIN cm USING (dataset_id) LEFT JOIN ties2 USING (dataset_id) LEFT JOIN ms USING (dataset_id)
      LEFT JOIN rec USING (dataset_id) LEFT JOIN trn USING (dataset_id) LEFT JOIN pnl USING (dataset_id)""",
    "bal": """SELECT p.*, profile, objective, pipes + cam + eties + recon AS engineering_cost,
      CASE WHEN profile = 'contest' THEN 0.7 * (pipes + cam + ties + pen) / 25e6 + 0.3 * len / 100 ELSE
      wc * (pipes + cam + eties + recon + pen) / 25e6 + wl * (len + rlen + facade + wall + metres) / 100 END AS b
      FROM parts p, (VALUES ('contest', 'balanced', 0.7, 0.3), ('appendix', 'balanced', 0.7, 0.3), ('appendix', 'earthworks', 0.7, 0.3),
      ('protocol', 'balanced', 0.3, 0.7), ('protocol', 'installation', 0.3, 0.7)) r(profile, objective, wc, wl)""",
}


@query("profile_scores", sql("""SELECT dataset_id, profile, objective, round(engineering_cost, 0) AS engineering_cost, round(CASE objective
  WHEN 'earthworks' THEN earth / 400 + 0.08 * b WHEN 'installation' THEN metres / 70 + 0.08 * b ELSE b END, 3) AS score FROM bal""",
                             "fx_flows", "fx_areas", "fx_ulines", extra=_PROFILES))
def profile_scores(spark, d):
    """Every network under each profile and objective; no engineering score where an old pipe can't be sized."""
    objects = _tree_objects(spark, d).withColumn("flow", F.when(~((F.col("dataset_id") % 11 == 5) & (F.col("object_id") == 2)), F.col("flow")))
    ties = _ties(spark, d).withColumn("flow", F.when((F.col("dataset_id") % 11 == 3) & (F.col("existing_id") == 13), HUGE).otherwise(F.col("flow")))
    recon = cut(existing.reconstruction_totals(existing.reconstruction(objects, ties)))
    n = net(spark, d)
    metres = n.groupBy("dataset_id").agg(F.sum(F.col("node_id") % 3).cast("double").alias("facade_metres"),
                                         F.sum(F.col("node_id") % 2).cast("double").alias("wall_metres"))
    e = cut(graph.flows(n, bridge.with_path(bridge.edges(spark, d))))
    pieces = cut(passages.sections(bridge.edges(spark, d), fx_passages(spark, d)))
    segments = cut(geo.explode_segments(e.select("dataset_id", "edge_id", "path")))
    out = None
    for profile, objective in RUNS:
        one = evaluate.network_summary(n, e, pieces, demands(spark, d), segments, recon, metres, profile, objective).select(
            "dataset_id", F.lit(profile).alias("profile"), F.lit(objective).alias("objective"),
            F.round("engineering_cost", 0).alias("engineering_cost"), F.round("score_raw", 3).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out
