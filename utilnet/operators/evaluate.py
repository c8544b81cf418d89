"""Costs, indices and the one-row-per-network summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import graph, passages as pas
from utilnet.operators.kernels import running
from utilnet.session import cut

KEYS = ("dataset_id",)


def _depth_factor(sections: DataFrame):
    """Mean depth factor of a section; 1 where no profile has been planned."""
    if "h0" not in sections.columns:
        return F.lit(1.0)
    return F.coalesce((rules.depth_factor(F.col("h0")) + rules.depth_factor(F.col("h1"))) / 2,
                      F.lit(1.0))


def _whole_sum(value):
    """The sum, or NULL if any value is NULL."""
    return F.when(F.bool_and(value.isNotNull()), F.sum(value))


def pipe_cost(sections: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Construction cost, weighted and special length per network.

    A network with a pipe that has no price has no cost.
    """
    length = F.col("s_to") - F.col("s_from")
    weight = length * F.col("factor") * _depth_factor(sections)
    sized = edges.select(*keys, "edge_id", "dn")
    cost = weight * rules.price_new(rules.dn_index(F.col("dn")))
    return sections.join(sized, [*keys, "edge_id"]).groupBy(*keys).agg(
        _whole_sum(cost).alias("pipe_cost"),
        F.sum(length).alias("new_length"), F.sum(weight).alias("weighted_length"),
        F.sum(F.when(F.col("factor") > 1 + 1e-9, length).otherwise(0.0)).alias("special_length"))


def incident_dn(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    ends = edges.select(*keys, F.col("start_id").alias("node_id"), "dn").unionByName(
        edges.select(*keys, F.col("end_id").alias("node_id"), "dn"))
    return ends.groupBy(*keys, "node_id").agg(
        F.max("dn").alias("dn"), F.bool_or(F.col("dn").isNull()).alias("unsized"))


def new_chambers(nodes: DataFrame, edges: DataFrame, pieces: DataFrame | None = None,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Chambers to build (new nodes and ties on old pipes) with diameter and price.

    ``nodes`` may carry existing_type and existing_dn of the object a tie sits on; ``pieces``
    (keys, node_id, required_dn) are reconstructed pieces that touch the tie.
    """
    keys = list(keys)
    typed = "existing_type" in nodes.columns
    wanted = F.col("node_type") == "chamber"
    if typed:
        wanted = wanted | ((F.col("node_type") == "tie") & (F.col("existing_type") == "heat_network"))
    else:
        wanted = wanted | (F.col("node_type") == "tie")
    out = nodes.filter(wanted).join(incident_dn(edges, keys), keys + ["node_id"], "left")
    parts = [F.lit(50), F.col("dn")]
    if "existing_dn" in nodes.columns:
        parts.append(F.col("existing_dn"))
    if pieces is not None:
        touching = pieces.groupBy(*keys, "node_id").agg(F.max("required_dn").alias("_required"))
        out = out.join(touching, keys + ["node_id"], "left")
        parts.append(F.col("_required"))
    # next to a pipe without a diameter a chamber has none either
    out = out.withColumn("chamber_dn", F.when(~F.coalesce("unsized", F.lit(False)), F.greatest(*parts)))
    return out.select(*keys, "node_id", "chamber_dn",
                      F.when(F.col("chamber_dn").isNotNull(), rules.chamber_price(F.col("chamber_dn"))).alias("cost"))


def tie_cost(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ties per network: every branch at an existing chamber (contest) or at any root (engineering)."""
    keys = list(keys)
    roots = nodes.filter("node_type = 'tie'").select(
        *keys, F.col("node_id").alias("start_id"), "existing_type")
    per = edges.join(roots, keys + ["start_id"])
    at_chamber = F.sum((F.col("existing_type") == "heat_chamber").cast("long"))
    return per.groupBy(*keys).agg(
        at_chamber.alias("chamber_ties"), (at_chamber * rules.TIE_COST).alias("tie_cost"),
        (F.count(F.lit(1)) * rules.TIE_COST).alias("engineering_tie_cost"))


def unconnected(demands: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Demands (demand_id, flow) that no terminal of the network serves."""
    served = nodes.filter("node_type = 'oks'").select(*keys, F.col("entry_id").alias("demand_id"))
    return demands.join(served, [*keys, "demand_id"], "left_anti")


def completion(demands: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Required and connected counts and the penalty for what is missing."""
    served = (nodes.filter("node_type = 'oks'")
              .select(*keys, F.col("entry_id").alias("demand_id")).distinct()
              .withColumn("_served", F.lit(1)))
    marked = demands.join(served, [*keys, "demand_id"], "left")
    gone = F.col("_served").isNull()
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("required"), F.count("_served").alias("connected"),
        F.sum(F.when(gone, rules.MISSING_BASE + rules.MISSING_PER_TPH * F.col("flow"))
              .otherwise(0.0)).alias("missing_penalty"),
        (F.count(F.lit(1)) == F.count("_served")).alias("complete"))


def turns(segments: DataFrame, edges: DataFrame, axes: DataFrame | None = None,
          keys: Sequence[str] = KEYS) -> DataFrame:
    """Every turn of a network: bends inside pipes and joints at the node a pipe starts from.

    A joint is measured against the last heading of the incoming pipe, or against ``axes`` (keys,
    edge_id, axis) for pipes that start on the old network.
    """
    keys = list(keys)
    inner = pas.bends(segments, keys).select(*keys, "edge_id", "angle", F.lit(False).alias("joint"))
    heading = geo.bearing(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    marked = segments.select(*keys, "edge_id", "seq", heading.alias("h"))
    ends = marked.groupBy(*keys, "edge_id").agg(F.min_by("h", "seq").alias("first"),
                                                F.max_by("h", "seq").alias("last"))
    placed = edges.select(*keys, "edge_id", "start_id", "end_id").join(ends, keys + ["edge_id"])
    axis = placed.select(*keys, F.col("end_id").alias("start_id"), F.col("last").alias("axis"))
    joints = placed.join(axis, keys + ["start_id"]).select(*keys, "edge_id", "first", "axis")
    if axes is not None:
        joints = joints.unionByName(ends.join(axes, keys + ["edge_id"]).select(
            *keys, "edge_id", "first", "axis"))
    return inner.unionByName(joints.select(
        *keys, "edge_id", geo.joint_angle(F.col("first"), F.col("axis")).alias("angle"),
        F.lit(True).alias("joint")))


def turn_stats(all_turns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    kinds = all_turns.withColumn("kind", geo.turn_kind(F.col("angle"))).withColumn(
        "penalty", geo.turn_penalty(F.col("angle")))

    def n(condition):
        return F.count(F.when(condition, 1))

    return kinds.groupBy(*keys).agg(
        n(F.col("kind") == "45").alias("turns_45"), n(F.col("kind") == "90").alias("turns_90"),
        n(F.col("kind") == "135").alias("turns_135"), n(F.col("kind") == "other").alias("turns_other"),
        n(~F.col("joint") & (F.col("penalty") > 0)).alias("bends"),
        n(F.col("joint") & (F.col("penalty") > 0)).alias("connection_turns"),
        F.sum("penalty").alias("turn_metres"))


def objectives(sections: DataFrame, edges: DataFrame, stats: DataFrame,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Earthwork and installation indices. Sections without a profile lie at ordinary depth."""
    keys = list(keys)
    base = rules.BASE_DEPTH
    has = "h0" in sections.columns
    a = F.coalesce(F.col("h0"), F.lit(base)) if has else F.lit(base)
    b = F.coalesce(F.col("h1"), F.lit(base)) if has else F.lit(base)
    rows = sections.join(edges.select(*keys, "edge_id", "dn"), keys + ["edge_id"]).select(
        *keys, "edge_id", "s_from", (F.col("s_to") - F.col("s_from")).alias("len"), "factor",
        (rules.pipe_width(F.col("dn")) + 1.0).alias("w"), a.alias("a"), b.alias("b"))
    delta, mean = F.col("b") - F.col("a"), (F.col("a") + F.col("b")) / 2
    rows = rows.withColumn("slope", F.when(delta > 0.01, 1).when(delta < -0.01, -1).otherwise(0))
    # A change is a slope that differs from the one just before it; level stretches reset it.
    if has:
        rows = running(rows, [*keys, "edge_id"], ["s_from"], lasts={"_prev": "slope"})
        changed = (F.col("slope") != 0) & (F.col("slope") != F.coalesce("_prev", F.lit(0)))
    else:
        changed = F.lit(False)
    vol = F.col("len") * F.col("w")
    out = rows.groupBy(*keys).agg(
        F.sum(vol * mean).alias("trench_volume"),
        F.sum(vol * F.greatest(F.lit(0.0), mean - base)).alias("deep_volume"),
        F.sum(vol * mean * F.greatest(F.lit(0.0), F.col("factor") - 1)).alias("special_volume"),
        F.count(F.when(changed, 1)).alias("depth_changes"),
        F.sum(F.abs(delta)).alias("vertical_change"),
        F.greatest(F.lit(base), F.max(F.greatest("a", "b"))).alias("max_depth"),
        F.sum(F.when(mean > base + 0.01, F.col("len")).otherwise(0.0)).alias("deep_length"))
    out = out.join(stats.select(*keys, "turn_metres"), keys, "left").fillna(0.0, ["turn_metres"])
    return out.withColumn(
        "earthwork_index",
        F.col("trench_volume") + 2 * F.col("deep_volume") + 3 * F.col("special_volume")).withColumn(
        "installation_index",
        F.col("turn_metres") + 50 * F.col("depth_changes") + 100 * F.col("vertical_change")
        + 90 * F.greatest(F.lit(0.0), F.col("max_depth") - base) + 3 * F.col("deep_length"))


def network_summary(nodes: DataFrame, edges: DataFrame, sections: DataFrame, demands: DataFrame,
                    segments: DataFrame | None = None, recon: DataFrame | None = None,
                    penalties: DataFrame | None = None, profile: str = "contest",
                    objective: str = "balanced", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per network: costs, lengths, scores.

    ``recon`` (keys, recon_cost, recon_length, chamber_recon_cost) and ``penalties`` (keys,
    facade_metres, wall_metres) count in the engineering profiles only; a NULL in them leaves the
    network without an engineering cost and score. The contest profile uses
    new length alone and has no turn, facade or wall terms.
    """
    keys = list(keys)
    chambers = new_chambers(nodes, edges, keys=keys).groupBy(*keys).agg(
        F.sum("cost").alias("chamber_cost"), F.count(F.when(F.col("cost").isNull(), 1)).alias("_unpriced"))
    out = (pipe_cost(sections, edges, keys).join(chambers, keys, "left")
           .join(tie_cost(nodes, edges, keys), keys, "left")
           .join(completion(demands, nodes, keys), keys, "left"))
    zero = ["chamber_cost", "tie_cost", "engineering_tie_cost", "missing_penalty"]
    if segments is not None:
        stats = turn_stats(turns(segments, edges, keys=keys), keys)
        out = out.join(stats, keys, "left").join(
            objectives(sections, edges, stats, keys).drop("turn_metres"), keys, "left")
        zero.append("turn_metres")
    for extra, columns in ((recon, ["recon_cost", "recon_length", "chamber_recon_cost"]),
                           (penalties, ["facade_metres", "wall_metres"])):
        if extra is not None:
            # Zero where there is nothing to do; a NULL that comes with a row stays, and leaves no score.
            out = out.join(extra.select(*keys, *columns, F.lit(True).alias("_row")), keys, "left").withColumns(
                {c: F.when(F.col("_row"), F.col(c)).otherwise(0.0) for c in columns}).drop("_row")
        else:
            out = out.withColumns({c: F.lit(0.0) for c in columns})
    out = out.fillna(0.0, [c for c in zero if c in out.columns]).withColumn(
        "chamber_cost", F.when(F.coalesce("_unpriced", F.lit(0)) == 0, F.col("chamber_cost"))).drop("_unpriced")
    construction = F.col("pipe_cost") + F.col("chamber_cost") + F.col("tie_cost")
    calculated = construction + F.col("missing_penalty")
    engineering = (F.col("pipe_cost") + F.col("chamber_cost") + F.col("engineering_tie_cost")
                   + F.col("recon_cost") + F.col("chamber_recon_cost"))
    length = F.col("new_length") + F.col("recon_length")
    out = (out.withColumn("construction_cost", construction)
           .withColumn("calculated_cost", calculated)
           .withColumn("engineering_cost", engineering).withColumn("length", length)
           .withColumn("contest_score", rules.score(calculated, F.col("new_length")))
           .withColumn("engineering_score",
                       rules.score(engineering + F.col("missing_penalty"), length, profile))
           .withColumn("complexity", F.when(F.col("new_length") > 0, F.col("weighted_length")
                                            / F.col("new_length")).otherwise(1.0)))
    if profile == "contest":
        balanced = F.col("contest_score")
    else:
        metres = F.col("facade_metres") + F.col("wall_metres")
        if segments is not None:
            metres = metres + F.col("turn_metres")
        balanced = F.col("engineering_score") + rules.score(F.lit(0.0), metres, profile)
    out = out.withColumn("balanced_score", balanced)
    score = F.col("balanced_score")
    if objective == "earthworks":
        score = F.col("earthwork_index") / 400 + 0.08 * F.col("balanced_score")
    elif objective == "installation":
        score = F.col("installation_index") / 70 + 0.08 * F.col("balanced_score")
    out = out.withColumn("score_raw", score)
    return out.withColumn("score", rules.score4(F.col("score_raw")) if profile == "contest"
                          else F.col("score_raw"))


def cost_lower_bound(nodes: DataFrame, edges: DataFrame, objective: str = "balanced",
                     depth: bool = False, bends: DataFrame | None = None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """A score no priced network of this topology can undercut: no special or depth premium.

    ``edges`` carries length and dn; with a chord for the length it bounds a proposed topology.
    """
    keys = list(keys)
    pipes = edges.groupBy(*keys).agg(
        _whole_sum(F.col("length") * rules.price_new(rules.dn_index(F.col("dn")))).alias("_pipes"),
        F.sum("length").alias("_length"),
        F.sum(F.col("length") * (rules.pipe_width(F.col("dn")) + 1.0)).alias("_area"))
    chambers = new_chambers(nodes, edges, keys=keys).groupBy(*keys).agg(
        _whole_sum(F.col("cost")).alias("_cam"), F.lit(True).alias("_any"))
    ties = tie_cost(nodes, edges, keys)
    out = pipes.join(chambers, keys, "left").join(ties, keys, "left").fillna(0.0, ["tie_cost"]).withColumn(
        "_cam", F.when(F.col("_any"), F.col("_cam")).otherwise(0.0))
    balanced = rules.score(F.col("_pipes") + F.col("_cam") + F.col("tie_cost"), F.col("_length"))
    bound = balanced
    if objective == "earthworks":
        bound = F.col("_area") * (rules.MIN_DEPTH if depth else rules.BASE_DEPTH) / 400 + 0.08 * balanced
    elif objective == "installation" and bends is not None:
        out = out.join(bends.groupBy(*keys).agg(
            F.sum(geo.turn_penalty(F.col("angle"))).alias("_bends")), keys, "left")
        bound = F.coalesce("_bends", F.lit(0.0)) / 70 + 0.08 * balanced
    return out.select(*keys, bound.alias("lower_bound"))


def price_networks(nodes: DataFrame, edges: DataFrame, demands: DataFrame,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """The whole chain without obstacles: flows, chains, diameters, repair, cost, score."""
    sized = cut(graph.repair_dn(graph.flow_chains(graph.flows(nodes, edges, keys), keys), keys)
                .select(*keys, "edge_id", "start_id", "end_id", "length", "flow", "dn"))
    plain = sized.select(*keys, "edge_id", F.lit(0.0).alias("s_from"), F.col("length").alias("s_to"),
                         F.lit(1.0).alias("factor"))
    return network_summary(nodes, sized, plain, demands, keys=keys)
