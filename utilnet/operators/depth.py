"""Depth profiles along a network: stations, bands, feasible depths, ramps, crossings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators.kernels import components, running
from utilnet.operators.passages import sections as cut_sections
from utilnet.session import cut

KEYS = ("dataset_id",)
EPS = 1e-8


def vertical_gap(profile: str = "appendix") -> Column:
    return F.greatest(F.lit(0.7), F.col("vertical")) if profile == "protocol" else F.col("vertical")


def _enriched(found: DataFrame, edges: DataFrame, profile: str, keys: Sequence[str]) -> DataFrame:
    """Passages with their rule, the pipe's height and the height of what is crossed."""
    catalogue = F.broadcast(rules.restriction_table(found.sparkSession).select(
        "rule", "is_polygon", "extension", "vertical", "own_height", "top"))
    out = found.drop("factor", "length").join(catalogue, "rule").join(
        edges.select(*keys, "edge_id", "dn", "length"), [*keys, "edge_id"])
    if "object_dn" not in found.columns:
        out = out.withColumn("object_dn", F.lit(None).cast("int"))
    old = F.when(F.col("rule") == "heat_network", rules.height(rules.dn_index(F.col("object_dn")))).otherwise(
        F.col("own_height"))
    return (out.withColumn("gap", vertical_gap(profile)).withColumn("old_height", F.coalesce(old, F.lit(0.0)))
            .withColumn("new_height", rules.height(rules.dn_index(F.col("dn")))))


def short_plateaus(found: DataFrame, edges: DataFrame, profile: str = "appendix",
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Passages whose level stretch is cut off by an end of the pipe."""
    p = _enriched(found, edges, profile, keys)
    return p.filter((F.col("core_from") < F.col("extension") - EPS)
                    | (F.col("length") - F.col("core_to") < F.col("extension") - EPS)).select(
        *keys, "edge_id", "object_id", F.lit("PLATEAU_TOO_SHORT").alias("code"))


def stations(nodes: DataFrame, edges: DataFrame, found: DataFrame, min_depth: float = rules.MIN_DEPTH,
             max_depth: float = 12.0, profile: str = "appendix",
             keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups with their allowed bands, links between groups, stations along the pipes).

    A station is a pipe end or a passage end. Stations under one passage share a depth and form a
    group, as do all pipes' ends at one node. Bands: keys, group, low, high, in order; a group
    without a band is infeasible.
    """
    keys = list(keys)
    edge = [*keys, "edge_id"]
    p = cut(_enriched(found, edges, profile, keys))
    ends = edges.select(*edge, F.explode(F.array(F.lit(0.0), F.col("length"))).alias("at"))
    inner = p.select(*edge, F.explode(F.array("s_from", "s_to")).alias("at"))
    # Cuts closer than a tenth of a micrometre are one station.
    spots = ends.unionByName(inner).select(*edge, F.round("at", 7).alias("at")).distinct()
    # Pipes that come twice have their stations once: there is nothing between two that coincide.
    names = edges.select(*edge, "start_id", "end_id", F.round("length", 7).alias("_len")).distinct()
    spots = cut(spots.join(names, edge).withColumn("station", F.when(
        F.col("at") == 0, F.concat(F.lit("n:"), F.col("start_id").cast("string"))).when(
        F.col("at") == F.col("_len"), F.concat(F.lit("n:"), F.col("end_id").cast("string"))).otherwise(
        F.concat(F.lit("e:"), F.col("edge_id").cast("string"), F.lit(":"), F.col("at").cast("string"))))
        .select(*edge, "at", "station"))
    steps = cut(running(spots, edge, ["at"], lasts={"prev_at": "at", "prev": "station"})
                .filter("prev IS NOT NULL"))
    mid = (F.col("at") + F.col("prev_at")) / 2
    cover = steps.join(p.select(*edge, "s_from", "s_to"), edge).filter(
        (mid >= F.col("s_from") - EPS) & (mid <= F.col("s_to") + EPS))
    flat = cut(cover.select(*edge, "at", "prev", "station").distinct())
    every = spots.select(*keys, "station").distinct()
    labels = components(every, flat.select(*keys, F.col("prev").alias("a"), F.col("station").alias("b")),
                        keys, "station").withColumnRenamed("label", "group")
    placed = cut(spots.join(labels, keys + ["station"]))
    # Bands: start from the whole range and cut out what each passage and end node forbids.
    hi_gap = F.col("top") + F.col("old_height") + F.col("gap")
    lo_gap = F.col("top") - F.col("gap") - F.col("new_height")
    inside = placed.join(p, edge).filter((F.col("at") >= F.round("s_from", 7) - EPS)
                                         & (F.col("at") <= F.round("s_to", 7) + EPS))
    holes = inside.select(*keys, "group", F.when(F.col("is_polygon"), float("-inf")).otherwise(lo_gap).alias("lo"),
                          F.when(F.col("is_polygon"), F.col("gap")).otherwise(hi_gap).alias("hi"))
    fixed = placed.join(nodes.filter(F.col("node_type").isin("tie", "oks")).select(*keys, F.concat(
        F.lit("n:"), F.col("node_id").cast("string")).alias("station")), keys + ["station"], "left_semi")
    pinned = fixed.select(*keys, "group").distinct().withColumn("pin", F.lit(rules.BASE_DEPTH))
    groups = placed.select(*keys, "group").distinct()
    # Forbidden open intervals merge into islands; bands are what lies between them.
    marks = (holes.unionByName(groups.select(*keys, "group", F.lit(float("-inf")).alias("lo"), F.lit(min_depth).alias("hi")))
             .unionByName(groups.select(*keys, "group", F.lit(max_depth).alias("lo"), F.lit(float("inf")).alias("hi")))
             .groupBy(*keys, "group", "lo").agg(F.max("hi").alias("hi")))
    swept = running(marks, [*keys, "group"], ["lo"], maxs={"reach": "hi"})
    bands = (swept.filter(F.col("reach").isNotNull() & (F.col("lo") >= F.col("reach") - EPS))
             .select(*keys, "group", F.col("reach").alias("low"), F.greatest("lo", "reach").alias("high"))
             .join(pinned, keys + ["group"], "left")
             .filter("pin IS NULL OR (pin >= low - 1e-8 AND pin <= high + 1e-8)")
             .select(*keys, "group", F.coalesce("pin", "low").alias("low"), F.coalesce("pin", "high").alias("high")))
    names2 = placed.select(*keys, "station", "group").distinct()
    ramps = (steps.join(flat.select(*edge, "at", F.lit(True).alias("_flat")), edge + ["at"], "left").filter("_flat IS NULL")
             .join(names2.withColumnRenamed("group", "b"), keys + ["station"])
             .join(names2.select(*keys, F.col("station").alias("prev"), F.col("group").alias("a")), keys + ["prev"])
             .filter("a <> b")
             .select(*keys, "a", "b", (rules.MAX_SLOPE * (F.col("at") - F.col("prev_at"))).alias("limit")))
    links = (ramps.unionByName(ramps.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "limit"))
             .groupBy(*keys, "a", "b").agg(F.min("limit").alias("limit")))
    return cut(bands), cut(links), placed


def solve_depths(bands: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Least feasible depth per group, then the greatest one up to 3 m in the band it fell into.

    Both are monotone fixpoints: lower bounds spread along the links minus what a slope of 0.10
    allows and round up past forbidden bands; upper values spread plus that allowance. ``code`` is
    RAMP_OR_DEPTH_LIMIT where no band is high enough.
    """
    keys = list(keys)
    state = cut(bands.groupBy(*keys, "group").agg(F.min("low").alias("d"))
                .withColumn("code", F.lit(None).cast("string")))
    while True:
        need = (links.join(state.filter("code IS NULL").select(*keys, F.col("group").alias("a"), "d"), keys + ["a"])
                .groupBy(*keys, F.col("b").alias("group")).agg(F.max(F.col("d") - F.col("limit")).alias("need")))
        raised = (state.filter("code IS NULL").join(need, keys + ["group"]).filter("need > d + 1e-8")
                  .select(*keys, "group", "need"))
        # The first band whose top reaches the need.
        fit = raised.join(bands, keys + ["group"]).filter("need <= high + 1e-8").groupBy(*keys, "group").agg(
            F.min_by(F.greatest("low", F.least("need", "high")), "low").alias("up"))
        moved = cut(raised.join(fit, keys + ["group"], "left"))
        if moved.isEmpty():
            break
        state = cut(state.join(moved.select(*keys, "group", "up", F.lit(True).alias("_m")), keys + ["group"], "left").select(
            *keys, "group", F.coalesce("up", "d").alias("d"),
            F.when(F.col("_m") & F.col("up").isNull(), "RAMP_OR_DEPTH_LIMIT").otherwise(F.col("code")).alias("code")))
    low = state.withColumnRenamed("d", "low_d")
    own = low.join(bands, keys + ["group"]).filter(
        (F.col("low_d") >= F.col("low") - EPS) & (F.col("low_d") <= F.col("high") + EPS)).groupBy(
        *keys, "group", "low_d", "code").agg(F.min("high").alias("top"))
    upper = cut(own.withColumn("d", F.when(F.col("low_d") < rules.BASE_DEPTH - EPS,
                                           F.least(F.lit(rules.BASE_DEPTH), F.col("top")))
                               .otherwise(F.col("low_d"))).drop("top"))
    while True:
        cap = (links.join(upper.select(*keys, F.col("group").alias("a"), F.col("d").alias("_d")), keys + ["a"])
               .groupBy(*keys, F.col("b").alias("group")).agg(F.min(F.col("_d") + F.col("limit")).alias("cap")))
        moved = cut(upper.join(cap, keys + ["group"]).filter("cap < d - 1e-8")
                    .select(*keys, "group", F.greatest("cap", "low_d").alias("down")).join(
                        upper.select(*keys, "group", F.col("d").alias("_old")), keys + ["group"])
                    .filter("down < _old - 1e-8").drop("_old"))
        if moved.isEmpty():
            break
        upper = cut(upper.join(moved, keys + ["group"], "left").withColumn("d", F.coalesce("down", "d")).drop("down"))
    return upper.select(*keys, "group", "low_d", F.col("d").alias("depth"), "code")


def ramp_sections(steps: DataFrame, min_depth: float = rules.MIN_DEPTH, max_depth: float = 12.0) -> DataFrame:
    """Pieces (s_from, s_to, ha, hb) broken where the profile's bounding lines cross.

    Between two stations the pipe lies as near to 3 m as slope and range allow.
    """
    slope, base = rules.MAX_SLOPE, rules.BASE_DEPTH
    length = F.col("s_to") - F.col("s_from")
    a, b = F.col("ha"), F.col("hb")
    lines = [(F.lit(min_depth), 0.0), (F.lit(max_depth), 0.0), (F.lit(base), 0.0), (a, -slope),
             (b - slope * length, slope), (a, slope), (b + slope * length, -slope)]
    spots = [F.lit(0.0), length]
    for i, (p, m) in enumerate(lines):
        for q, n in lines[i + 1:]:
            if abs(m - n) > EPS:
                x = (q - p) / (m - n)
                spots.append(F.when((x > EPS) & (x < length - EPS), x))
    xs = F.array_sort(F.array_distinct(F.transform(F.array_compact(F.array(*spots)), lambda v: F.round(v, 9))))
    cols = [c for c in steps.columns if c not in ("s_from", "s_to", "ha", "hb")]
    rows = steps.withColumn("_xs", xs).withColumn("_len", length)
    pairs = F.arrays_zip(F.slice("_xs", 1, F.size("_xs") - 1).alias("l"), F.slice("_xs", 2, F.size("_xs") - 1).alias("r"))
    rows = rows.select(*cols, "s_from", "ha", "hb", "_len", F.explode(pairs).alias("_q"))

    def level(x):
        lo = F.greatest(F.lit(min_depth), F.col("ha") - slope * x, F.col("hb") - slope * (F.col("_len") - x))
        hi = F.least(F.lit(max_depth), F.col("ha") + slope * x, F.col("hb") + slope * (F.col("_len") - x))
        return F.greatest(lo, F.least(F.lit(base), hi))

    return rows.filter("_q.r - _q.l > 1e-8").select(
        *cols, (F.col("s_from") + F.col("_q.l")).alias("s_from"), (F.col("s_from") + F.col("_q.r")).alias("s_to"),
        level(F.col("_q.l")).alias("h0"), level(F.col("_q.r")).alias("h1"))


def planned_sections(edges: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The section operator's plan, cut at the seven digits of the stations."""
    at = {c: F.round(c, 7) for c in ("s_from", "s_to")}
    return cut_sections(edges.withColumn("length", F.round("length", 7)), found.withColumns(at), keys)


def depth_sections(placed: DataFrame, depths: DataFrame, plan: DataFrame,
                   keys: Sequence[str] = KEYS, **limits) -> DataFrame:
    """Priced sections with depths: station steps, their ramps, and the factor of the plan.

    ``plan`` is the result of the section operator (edge, s_from, s_to, factor, method); its cuts
    are the stations, so every ramp piece lies in one planned piece. A step to or from a station
    that no depth fits stays as a section without depths; ``code`` says why: DEPTH_DOMAIN_EMPTY for
    a group without a band, or what ``depths`` says of the group.
    """
    keys = list(keys)
    edge = [*keys, "edge_id"]
    told = depths.select(*keys, "group", "depth", "code")
    known = placed.join(told, keys + ["group"], "left").select(*edge, "at", F.struct(
        "at", "group", F.when(F.col("code").isNull(), F.col("depth")).alias("depth"),
        F.coalesce("code", F.when(F.col("depth").isNull(), "DEPTH_DOMAIN_EMPTY")).alias("code")).alias("_here"))
    steps = running(known, edge, ["at"], lasts={"_before": "_here"}).filter("_before IS NOT NULL").select(
        *edge, F.col("_before.at").alias("s_from"), F.col("at").alias("s_to"), F.col("_before.depth").alias("ha"),
        F.col("_here.depth").alias("hb"), (F.col("_here.group") == F.col("_before.group")).alias("_flat"),
        F.coalesce("_before.code", "_here.code").alias("code"))
    keyed = plan.select(*edge, F.round("s_from", 7).alias("s_from"), "factor", "method")
    steps = cut(steps.join(keyed, edge + ["s_from"], "left").fillna({"factor": 1.0, "method": "base"}))
    unknown = steps.filter("code IS NOT NULL").select(*edge, "code", "factor", "method", "s_from", "s_to",
                                                      *[F.lit(None).cast("double").alias(h) for h in ("h0", "h1")])
    steps = steps.filter("code IS NULL")
    # Stations of one group share their depth: between them the pipe is level.
    level = steps.filter("_flat").select(*edge, "code", "factor", "method", "s_from", "s_to", F.col("ha").alias("h0"),
                                         F.col("hb").alias("h1"))
    return level.unionByName(ramp_sections(steps.filter("NOT _flat").drop("_flat"), **limits)).unionByName(unknown)


def profile_report(sections: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Depth range, steepest slope and what the depth adds to the price, per network.

    Of sections that say by a ``code`` why they have no depth, ``unplanned`` is the length.
    """
    span = F.col("s_to") - F.col("s_from")
    mean = (rules.depth_factor(F.col("h0")) + rules.depth_factor(F.col("h1"))) / 2
    extra = span * rules.price_new(rules.dn_index(F.col("dn"))) * F.col("factor") * (mean - 1)
    unplanned = [F.sum(F.when(F.col("code").isNotNull(), span).otherwise(0.0)).alias("unplanned")] if "code" in sections.columns else []
    return sections.join(edges.select(*keys, "edge_id", "dn"), [*keys, "edge_id"]).groupBy(*keys).agg(
        F.least(F.lit(rules.BASE_DEPTH), F.min(F.least("h0", "h1"))).alias("min_depth"),
        F.greatest(F.lit(rules.BASE_DEPTH), F.max(F.greatest("h0", "h1"))).alias("max_depth"),
        F.max(F.abs(F.col("h1") - F.col("h0")) / span).alias("max_slope"), F.sum(extra).alias("depth_cost"), *unplanned)


def depth_at(sections: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Depth at measures of pipes (keys, edge_id, point_id, at): the first section that covers them."""
    edge = [*keys, "edge_id"]
    span = F.col("s_to") - F.col("s_from")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at") - F.col("s_from")) / span))
    return (points.join(sections, edge).filter((F.col("at") >= F.col("s_from") - EPS) & (F.col("at") <= F.col("s_to") + EPS))
            .groupBy(*edge, "point_id", "at").agg(F.min_by(
                F.col("h0") + (F.col("h1") - F.col("h0")) * share, "s_from").alias("depth")))


def crossing_report(sections: DataFrame, found: DataFrame, edges: DataFrame, profile: str = "appendix",
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Per passage: which side the pipe takes, actual and required clearance.

    A passage in a section without a depth has the section's ``code`` and neither side nor clearance.
    """
    keys = list(keys)
    p = _enriched(found, edges, profile, keys).withColumn(
        "point_id", F.concat_ws("|", F.col("object_id").cast("string"), F.round("s_from", 6).cast("string"))).withColumn(
        "at", (F.col("s_from") + F.col("s_to")) / 2)
    spot = [*keys, "edge_id", "point_id", "at"]
    mids = p.select(*spot).distinct()
    out = p.join(depth_at(sections, mids, keys), spot)
    code = F.lit(None).cast("string")
    if "code" in sections.columns:
        why = sections.filter("code IS NOT NULL").select(*keys, "edge_id", "s_from", "s_to", F.col("code").alias("_why"))
        why = mids.join(why, [*keys, "edge_id"]).filter((F.col("at") >= F.col("s_from") - EPS) & (F.col("at") <= F.col("s_to") + EPS))
        out = out.join(why.groupBy(*spot).agg(F.min("_why").alias("_why")), spot, "left")
        code = F.when(F.col("depth").isNull(), F.col("_why"))
    above = (~F.col("is_polygon")) & (F.col("top") - F.col("depth") - F.col("new_height") >= F.col("gap") - EPS)
    side = F.when(F.col("is_polygon"), "under_surface").when(above, "above").otherwise("below")
    actual = (F.when(F.col("is_polygon"), F.col("depth"))
              .when(above, F.col("top") - F.col("depth") - F.col("new_height"))
              .otherwise(F.col("depth") - F.col("top") - F.col("old_height")))
    return out.select(*keys, "edge_id", "object_id", "rule", "s_from", "s_to", "depth",
                      F.when(F.col("depth").isNotNull(), side).alias("position"), F.col("gap").alias("required"), actual.alias("actual"),
                      F.coalesce(code, F.when(actual < F.col("gap") - EPS, "VERTICAL_CLEARANCE")).alias("code"))


def audit_depth(sections: DataFrame, min_depth: float = rules.MIN_DEPTH, max_depth: float = 12.0,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Stored profiles checked without planning: range, slope, split at 3 m, continuity, price.

    ``sections`` carries dn, start_id/end_id of the piece and its stored cost.
    """
    keys = list(keys)
    span = F.col("s_to") - F.col("s_from")
    base = rules.BASE_DEPTH
    mean = (rules.depth_factor(F.col("h0")) + rules.depth_factor(F.col("h1"))) / 2
    price = span * rules.price_new(rules.dn_index(F.col("dn"))) * F.col("factor") * mean
    codes = F.array_compact(F.array(
        F.when((F.least("h0", "h1") < min_depth - 1e-7) | (F.greatest("h0", "h1") > max_depth + 1e-7), "DEPTH_RANGE"),
        F.when(F.abs(F.col("h1") - F.col("h0")) / span > 0.10001, "SLOPE"),
        F.when((F.col("h0") - base) * (F.col("h1") - base) < -1e-7, "NOT_SPLIT_AT_3M"),
        F.when(F.abs(price - F.col("cost")) >= 3, "PRICE")))
    single = sections.select(*keys, F.col("edge_id").cast("string").alias("object_id"), F.explode(codes).alias("code"))
    ends = sections.select(*keys, F.col("start_id").alias("node_id"), F.col("h0").alias("h")).unionByName(
        sections.select(*keys, F.col("end_id").alias("node_id"), F.col("h1").alias("h")))
    torn = ends.groupBy(*keys, "node_id").agg((F.max("h") - F.min("h")).alias("spread")).filter("spread > 1e-7").select(
        *keys, F.col("node_id").cast("string").alias("object_id"), F.lit("NODE_DEPTH").alias("code"))
    return single.unionByName(torn)


def audit_profiles(pieces: DataFrame, nodes: DataFrame, found: DataFrame, profile: str = "appendix",
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Stored profiles against the map, without planning: keys, object_id, code.

    ``pieces``: keys, edge_id, piece_id, start_id, end_id, s_from, s_to, h0, h1, dn, length, cost and path with
    (x, y, z); ``nodes``: keys, node_id, z; ``found``: passages with their cores and factors. The profile is sampled
    where passages begin, end and have their middle and where pieces meet inside them: it has to be level there and
    to keep the vertical gap. Every vertex has to lie on its piece's straight depth line, every node at the depth of
    the pieces that meet in it, and prices are made anew from the cuts that the passages make.
    """
    keys = list(keys)
    edge, piece = [*keys, "edge_id"], [*keys, "edge_id", "piece_id"]
    sizes = cut(pieces.groupBy(*edge).agg(F.max("s_to").alias("length"), F.max("dn").alias("dn")))
    p = _enriched(found, sizes, profile, keys).withColumn(
        "point_id", F.concat_ws("|", F.col("object_id").cast("string"), F.round("core_from", 6).cast("string")))
    whole = [F.col("core_from") - F.col("extension"), F.col("core_to") + F.col("extension")]
    p = cut(p.withColumn("truncated", (whole[0] < -0.002) | (whole[1] > F.col("length") + 0.002))
            .withColumn("s_from", F.greatest(F.lit(0.0), whole[0])).withColumn("s_to", F.least("length", whole[1])))
    spot = [*edge, "point_id"]
    middle = ((F.col("s_from") + F.col("s_to")) / 2).alias("at")
    ends = p.select(*spot, F.explode(F.array("s_from", "s_to")).alias("at"))
    joints = p.select(*spot, "s_from", "s_to").join(pieces.select(*edge, F.col("s_from").alias("at")), edge).filter(
        "at > s_from AND at < s_to").select(*spot, "at")
    profiles = pieces.select(*edge, "s_from", "s_to", "h0", "h1")
    mids = cut(depth_at(profiles, p.select(*spot, middle).distinct(), keys).select(*spot, F.col("depth").alias("mid")))
    around = depth_at(profiles, ends.unionByName(joints).distinct(), keys).join(mids, spot)
    uneven = around.groupBy(*spot).agg(F.max(F.abs(F.col("depth") - F.col("mid"))).alias("off")).filter("off >= 0.001")
    above, below = (F.col("top") - F.col("mid") - F.col("new_height")), (F.col("mid") - F.col("top") - F.col("old_height"))
    actual = F.when(F.col("is_polygon"), F.col("mid")).otherwise(F.greatest(above, below))

    def told(df: DataFrame, code, name: str) -> DataFrame:
        code = F.lit(code) if isinstance(code, str) else code
        return df.select(*keys, F.col(name).cast("string").alias("object_id"), code.alias("code"))

    label = p.withColumn("label", F.concat_ws("|", F.col("edge_id").cast("string"), F.col("object_id").cast("string")))
    parts = [told(label.filter("truncated"), "PLATEAU_TRUNCATED", "label"),
             told(label.join(uneven, spot, "left_semi"), "PLATEAU_NOT_LEVEL", "label"),
             told(label.join(mids, spot).filter(actual < F.col("gap") - 1e-5), "VERTICAL_CLEARANCE", "label")]

    # Vertices on the depth line of their piece.
    run = F.aggregate(F.sequence(F.lit(1), F.size("path") - 1), F.struct(F.lit(0.0).alias("at"), F.array(F.lit(0.0)).alias("out")),
                      lambda acc, i: _further(acc, F.get("path", i - 1), F.get("path", i)), lambda acc: acc["out"])
    measured = cut(pieces.withColumn("_run", run).withColumn("_size", F.element_at("_run", -1)))
    line = F.transform("path", lambda v, i: F.abs(v["z"] + F.col("h0") + (F.col("h1") - F.col("h0")) * F.get("_run", i) / F.col("_size")))
    parts += [told(measured.filter(F.coalesce(F.array_max(line) >= 1e-5, F.lit(True)) | F.exists("path", lambda v: v["z"].isNull())), "Z_OFF", "piece_id"),
              told(measured.filter(F.abs(F.col("_size") - F.col("length")) >= 0.002), "LENGTH", "piece_id")]
    # Nodes at the depth of the pieces that end there.
    tips = pieces.select(*keys, "piece_id", F.explode(F.array(F.struct(F.col("start_id").alias("node_id"), F.col("h0").alias("h")),
                                                              F.struct(F.col("end_id").alias("node_id"), F.col("h1").alias("h")))).alias("t"))
    met = tips.select(*keys, "piece_id", "t.*").join(nodes.select(*keys, "node_id", "z"), keys + ["node_id"], "left")
    parts.append(told(met.filter(~F.coalesce(F.abs(F.col("z") + F.col("h")) < 1e-7, F.lit(False))), "NODE_DEPTH", "piece_id").distinct())
    # Prices from the cuts of passages and pieces.
    named = found.select("rule", "factor").distinct()
    factors = cut(cut_sections(sizes, p.join(named, "rule").select(*edge, "s_from", "s_to", "factor"), keys))
    both = pieces.join(factors.select(*edge, F.col("s_from").alias("_f"), F.col("s_to").alias("_t"), F.col("factor").alias("_k")), edge).withColumn(
        "_l", F.greatest("s_from", "_f")).withColumn("_r", F.least("s_to", "_t")).filter("_r - _l > 1e-9")
    span = F.col("s_to") - F.col("s_from")

    def at(x: str) -> Column:
        return rules.depth_factor(F.col("h0") + (F.col("h1") - F.col("h0")) * (F.col(x) - F.col("s_from")) / span)

    price = (F.col("_r") - F.col("_l")) * rules.price_new(rules.dn_index(F.col("dn"))) * F.col("_k") * (at("_l") + at("_r")) / 2
    priced = both.groupBy(*piece).agg(F.sum(price).alias("price"), F.max("cost").alias("cost"))
    parts.append(told(priced.filter(~F.coalesce(F.abs(F.col("price") - F.col("cost")) < 3, F.lit(False))), "PRICE", "piece_id"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _further(acc: Column, a: Column, b: Column) -> Column:
    """One more vertex of a running length."""
    to = acc["at"] + F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)
    return F.struct(to.alias("at"), F.concat(acc["out"], F.array(to)).alias("out"))


def profile_totals(pieces: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Range, steepest slope, length and price of stored profiles per network, to hold against what a report states."""
    span = F.col("s_to") - F.col("s_from")
    return pieces.groupBy(*keys).agg(
        F.least(F.lit(rules.BASE_DEPTH), F.min(F.least("h0", "h1"))).alias("min_depth"),
        F.greatest(F.lit(rules.BASE_DEPTH), F.max(F.greatest("h0", "h1"))).alias("max_depth"),
        F.max(F.abs(F.col("h1") - F.col("h0")) / span).alias("max_slope"), F.sum(span).alias("length"), F.sum("cost").alias("cost"))


def total_findings(totals: DataFrame, stated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stated totals (same names) that differ from the profiles', or are missing: keys, code."""
    slack = {"min_depth": 1e-3, "max_depth": 1e-3, "max_slope": 1e-5, "length": 1e-2, "cost": 10.0}
    said = stated.select(*keys, *[F.col(c).alias(f"_{c}") for c in slack])
    codes = [F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) < s, F.lit(False)), f"STATED_{c.upper()}") for c, s in slack.items()]
    return totals.join(said, list(keys), "left").select(*keys, F.explode(F.array_compact(F.array(*codes))).alias("code"))
