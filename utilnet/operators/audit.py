"""Audits of exported layouts that trust nothing of what produced them.

``objects`` are the features of an export as read back from its text (``sources.networks.read_export``):
keys, id, object_type, start_id, end_id, flow, dn, length, method, cost, path (degrees). The old map comes
the same way as ``features`` (dataset_id, object_id, object_type, flow, path), with ``walls`` (dataset_id,
object_id, ring, x0, y0, x1, y1 in metres) for the sides of its buildings. Findings are rows
(keys, object_id, code). Nothing is taken from the nodes, flows or sums of the library's own chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import graph, spatial
from utilnet.operators.kernels import climb
from utilnet.session import cut

KEYS = ("dataset_id", "variant_id")
EXPORTED = ["heat_network", "heat_chamber", "technical_node", "variant_summary"]
MONEY, METRES, FLOW, DEGREES = 0.03, 0.02, 1e-5, 1e-7  # what two roundings may differ by
ON_PIPE, ON_WALL = 0.3, 0.06  # m
OLD, NEW = "old", "new"


def _findings(df: DataFrame, keys: Sequence[str], code: Column | str, name: str = "id") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(*keys, F.col(name).cast("string").alias("object_id"), code.alias("code")).filter("code IS NOT NULL")


def _off(a: Column, b: Column, slack: float) -> Column:
    """Two amounts that do not agree; an amount that is missing agrees with nothing."""
    return F.coalesce(F.abs(a - b) > slack, F.lit(True))


def _places(objects: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All ids a pipe may end at: new nodes of the export, old chambers and consumers of its map."""
    first = F.element_at("path", 1)
    new = objects.filter(F.col("object_type").isin("heat_chamber", "technical_node")).select(
        *keys, F.col("id").alias("node_id"), F.lit(NEW).alias("origin"), F.col("object_type").alias("kind"), first.alias("at"))
    maps = objects.select(*keys).distinct()
    old = features.filter(F.col("object_type").isin("heat_chamber", "oks_connection_point")).select(
        "dataset_id", F.col("object_id").alias("node_id"), F.lit(OLD).alias("origin"), F.col("object_type").alias("kind"),
        F.element_at("path", 1).alias("at"))
    # An id of the export hides one of the map; that it is no new id is a finding of its own.
    both = new.unionByName(maps.join(old, "dataset_id").select(new.columns))
    return both.groupBy(*keys, "node_id").agg(F.min_by(F.struct("origin", "kind", "at"), F.col("origin")).alias("p")).select(
        *keys, "node_id", "p.*")


def export_links(objects: DataFrame, features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every exported pipe beside the places its two ids name (NULL where there is none)."""
    keys = list(keys)
    places = _places(objects, features, keys)
    out = objects.filter("object_type = 'heat_network'")
    for side in ("start", "end"):
        out = out.join(places.select(*keys, F.col("node_id").alias(f"{side}_id"), F.struct("origin", "kind", "at").alias(side)),
                       keys + [f"{side}_id"], "left")
    return out


def id_findings(objects: DataFrame, features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unknown types, ids used twice within a map's exports, and new ids that the map already has."""
    keys = list(keys)
    kinds = _findings(objects.filter(~F.col("object_type").isin(EXPORTED) | F.col("object_type").isNull()), keys, "UNKNOWN_TYPE")
    copies = objects.groupBy("dataset_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twice = _findings(objects.join(copies, ["dataset_id", "id"], "left_semi").distinct(), keys, "DUPLICATE_ID").distinct()
    taken = _findings(objects.join(features.select("dataset_id", F.col("object_id").alias("id")), ["dataset_id", "id"], "left_semi"),
                      keys, "ID_OF_THE_MAP").distinct()
    return kinds.unionByName(twice).unionByName(taken)


def pipe_findings(links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What each pipe shows by itself: ends, diameter, capacity, price floor and method."""
    row = rules.dn_index(F.col("dn"))
    starts = F.col("start.kind").isNotNull() & ~F.col("start.kind").eqNullSafe("oks_connection_point")
    ends = F.col("end.kind").isNotNull() & ~(F.col("end.kind").eqNullSafe("heat_chamber") & (F.col("end.origin") == OLD))

    def apart(vertex: Column, side: str) -> Column:
        at = F.col(f"{side}.at")
        return ~F.coalesce(geo.distance(vertex["x"], vertex["y"], at["x"], at["y"]) < DEGREES, F.lit(False))

    codes = [
        F.when(~starts, "UNKNOWN_START"), F.when(~ends, "UNKNOWN_END"),
        F.when(starts & apart(F.element_at("path", 1), "start"), "START_ELSEWHERE"),
        F.when(ends & apart(F.element_at("path", -1), "end"), "END_ELSEWHERE"),
        F.when(row.isNull(), "UNKNOWN_DIAMETER"),
        F.when(row.isNotNull() & ~F.coalesce(F.col("flow") <= rules.capacity(row) + DEGREES, F.lit(False)), "OVER_CAPACITY"),
        F.when(row.isNotNull() & ~F.coalesce(F.col("cost") >= F.col("length") * rules.price_new(row) - MONEY, F.lit(False)),
               "BELOW_PRICE"),
        F.when(~F.coalesce(F.col("method").isin("base", "special"), F.lit(False)), "UNKNOWN_METHOD"),
    ]
    return _findings(links.withColumn("_code", F.explode(F.array_compact(F.array(*codes)))), keys, F.col("_code"))


def graph_findings(links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The exported ids read as a graph: one pipe into each node, roots where water comes from, no cycle,
    no diameter that grows downstream, no run of one diameter beyond its limit, and flow that adds up."""
    keys = list(keys)
    pipes = cut(links.select(*keys, F.col("id").alias("edge_id"), "start_id", "end_id", "length", "flow", "dn",
                             F.col("start.kind").alias("kind"), F.col("start.origin").alias("origin")))
    into = pipes.groupBy(*keys, F.col("end_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("edge_id", "start_id")).alias("up"))
    several = _findings(into.filter("n > 1"), keys, "SEVERAL_PARENTS", "node_id")
    nodes = pipes.select(*keys, F.col("start_id").alias("node_id")).unionByName(into.select(*keys, "node_id")).distinct()
    placed = nodes.join(into.select(*keys, "node_id", F.col("up.start_id").alias("up")), keys + ["node_id"], "left")
    loops = cut(climb(placed, keys, "node_id", "up").filter("status = 'cycle'").select(*keys, "node_id"))
    cycle = _findings(loops, keys, "CYCLE", "node_id")
    roots = pipes.select(*keys, F.col("start_id").alias("node_id"), "kind", "origin").distinct().join(into, keys + ["node_id"], "left_anti")
    dry = _findings(roots.filter(~F.col("kind").eqNullSafe("heat_chamber")), keys, "ROOT_WITHOUT_CHAMBER", "node_id")

    # The pipe above: of several into one node the first by id, as above.
    up = into.select(*keys, F.col("node_id").alias("start_id"), F.col("up.edge_id").alias("up_edge"))
    rows = pipes.join(up, keys + ["start_id"], "left")
    above = pipes.select(*keys, F.col("edge_id").alias("up_edge"), F.col("dn").alias("up_dn"))
    grows = _findings(rows.join(above, keys + ["up_edge"]).filter("dn > up_dn"), keys, "DIAMETER_GROWS", "edge_id")
    # On a cycle a run has no beginning to be measured from.
    known = rows.withColumn("dn_idx", rules.dn_index(F.col("dn"))).filter("dn_idx IS NOT NULL").join(
        loops.withColumnRenamed("node_id", "end_id"), keys + ["end_id"], "left_anti")
    runs = _findings(graph.path_runs(known, keys).filter(F.col("run_length") > F.col("run_limit") + METRES),
                     keys, "RUN_TOO_LONG", "edge_id")
    below = pipes.groupBy(*keys, F.col("start_id").alias("end_id")).agg(F.sum("flow").alias("below"))
    lost = _findings(pipes.join(into.filter("n = 1").select(*keys, F.col("node_id").alias("end_id")), keys + ["end_id"])
                     .join(below, keys + ["end_id"]).filter(_off(F.col("flow"), F.col("below"), FLOW)), keys, "FLOW_LOST", "edge_id")
    return reduce(DataFrame.unionByName, [several, cycle, dry, grows, runs, lost])


def chamber_findings(objects: DataFrame, features: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """New chambers thinner than what they join, at another price, or rooted beside every old pipe."""
    keys = list(keys)
    ends = [links.select(*keys, F.col(f"{s}_id").alias("id"), F.col("dn").alias("joined")) for s in ("start", "end")]
    widest = ends[0].unionByName(ends[1]).groupBy(*keys, "id").agg(F.max("joined").alias("joined"))
    chambers = objects.filter("object_type = 'heat_chamber'").join(widest, keys + ["id"], "left")
    small = rules.dn_index(F.col("dn")).isNull() | (F.col("dn") < F.greatest(F.lit(50), "joined"))
    size = _findings(chambers.filter(small), keys, "CHAMBER_TOO_SMALL")
    price = _findings(chambers.filter(rules.dn_index(F.col("dn")).isNotNull() & _off(
        F.col("cost"), rules.chamber_price(F.col("dn")), MONEY)), keys, "CHAMBER_PRICE")
    fed = links.select(*keys, F.col("end_id").alias("id"))
    roots = objects.filter("object_type = 'heat_chamber'").join(
        links.select(*keys, F.col("start_id").alias("id")), keys + ["id"], "left_semi").join(fed, keys + ["id"], "left_anti")
    # Projected coordinates are written: folded into the tests below, their series would be repeated there.
    spots = cut(_metres(roots.select(*keys, "id", F.element_at("path", 1).alias("_p"))))
    old = geo.explode_segments(cut(_metric_path(features.filter("object_type = 'heat_network'").select("dataset_id", "object_id", "path"))))
    near = spatial.bbox_join(spatial.as_points(spots), old, ON_PIPE, keys=["dataset_id"]).filter(
        geo.point_segment_distance(F.col("a_x0"), F.col("a_y0"), *[F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]) < ON_PIPE)
    near = near.select("dataset_id", *[F.col(f"a_{k}").alias(k) for k in [*keys[1:], "id"]])
    return size.unionByName(price).unionByName(_findings(spots.join(near, keys + ["id"], "left_anti"), keys, "ROOT_OFF_PIPE"))


def _metres(points: DataFrame) -> DataFrame:
    x, y = geo.to_utm(F.col("_p.x"), F.col("_p.y"))
    return points.withColumn("x", x).withColumn("y", y).drop("_p")


def _metric_path(lines: DataFrame) -> DataFrame:
    def metric(p):
        x, y = geo.to_utm(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))
    return lines.withColumn("path", F.transform("path", metric))


def entry_findings(links: DataFrame, walls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last legs that do not come through a nearest outer wall of the building their consumer is in.

    ``walls``: dataset_id, object_id, ring, x0 .. y1 in metres, ring 0 outside. Maps without buildings are not
    judged. A consumer in several buildings is judged by the one of the smallest id, one in none is a finding.
    """
    keys = list(keys)
    last = [F.element_at("path", k) for k in (-2, -1)]
    legs = cut(_metric_path(links.filter("end.kind = 'oks_connection_point' AND size(path) > 1").select(*keys, "id", F.array(*last).alias("path"))))
    legs = legs.select(*keys, "id", *[F.element_at("path", k)[c].alias(f"{p}{c}") for k, p in ((1, "a"), (2, "b")) for c in ("x", "y")])
    legs = cut(legs.join(walls.select("dataset_id").distinct(), "dataset_id", "left_semi"))
    outer = geo.with_box(walls.filter("ring = 0").select("dataset_id", "object_id", "x0", "y0", "x1", "y1"))
    name = F.struct(*[F.col(k) for k in [*keys[1:], "id"]])
    spots = legs.select("dataset_id", name.alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y"))
    own = spatial.contained(spots, outer, keys=["dataset_id"]).groupBy("dataset_id", "point_id").agg(F.min("object_id").alias("object_id"))
    held = legs.withColumn("point_id", name).join(own, ["dataset_id", "point_id"], "left")
    outside = _findings(held.filter("object_id IS NULL"), keys, "OUTSIDE_BUILDINGS")
    wall = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    t, u = geo.crossing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), *wall)
    hit = t.between(-1e-7, 1 + 1e-7) & u.between(-1e-7, 1 + 1e-7)
    sides = cut(held.join(outer.select("dataset_id", "object_id", *wall), ["dataset_id", "object_id"]).select(
        *keys, "id", *wall, geo.point_segment_distance(F.col("bx"), F.col("by"), *wall).alias("far"),
        F.when(hit, F.struct((F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"),
                             (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))).alias("spot")))
    least = sides.groupBy(*keys, "id").agg(F.min("far").alias("least"), F.count("spot").alias("hits"))
    near = sides.join(least, keys + ["id"]).filter(F.col("far") <= F.col("least") + ON_WALL).drop("spot")
    spots = sides.filter("spot IS NOT NULL").select(*keys, "id", "spot")
    through = near.join(spots, keys + ["id"]).filter(
        geo.point_segment_distance(F.col("spot.x"), F.col("spot.y"), *wall) < ON_WALL).select(*keys, "id").distinct()
    uncrossed = _findings(least.filter("hits = 0"), keys, "NO_WALL_CROSSED")
    farther = _findings(least.filter("hits > 0").join(through, keys + ["id"], "left_anti"), keys, "FARTHER_WALL")
    return outside.unionByName(uncrossed).unionByName(farther)


def audit_totals(objects: DataFrame, features: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per exported layout: subtotals by object type and what its summary says of them.

    Columns come in pairs ``x`` (added up from the exported objects and the map) and ``stated_x``.
    """
    keys = list(keys)

    def part(kind: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("object_type") == kind, F.col(column))), F.lit(0.0))

    own = objects.groupBy(*keys).agg(
        part("heat_network", "cost").alias("pipe_cost"), part("heat_chamber", "cost").alias("chamber_cost"),
        part("heat_network", "length").alias("new_length"))
    ties = links.filter(F.col("start.kind").eqNullSafe("heat_chamber") & (F.col("start.origin") == OLD)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ties"))
    reached = links.filter("end.kind = 'oks_connection_point'").select(*keys, F.col("end_id").alias("object_id")).distinct()
    wanted = objects.select(*keys).distinct().join(
        features.filter("object_type = 'oks_connection_point'").select("dataset_id", "object_id", "flow"), "dataset_id")
    gone = wanted.join(reached.withColumn("_hit", F.lit(1)), keys + ["object_id"], "left")
    served = gone.groupBy(*keys).agg(
        F.count("_hit").alias("connected"),
        F.sum(F.when(F.col("_hit").isNull(), rules.MISSING_BASE + rules.MISSING_PER_TPH * F.col("flow")).otherwise(0.0)).alias("penalty"))
    stated = objects.filter("object_type = 'variant_summary'").groupBy(*keys).agg(F.min("summary").alias("s")).select(
        *keys, *[F.col(f"s.{c}").alias(f"stated_{c}") for c in (
            "connected", "ties", "tie_cost", "chamber_cost", "new_length", "construction_cost", "penalty", "calculated_cost", "score")])
    out = own.join(ties, keys, "left").join(served, keys, "left").fillna(0, ["ties", "connected"]).fillna(0.0, ["penalty"])
    out = out.withColumn("tie_cost", F.col("ties") * rules.TIE_COST).withColumn(
        "construction_cost", F.col("pipe_cost") + F.col("chamber_cost") + F.col("tie_cost")).withColumn(
        "calculated_cost", F.col("construction_cost") + F.col("penalty"))
    out = out.withColumn("score_raw", rules.score(F.col("calculated_cost"), F.col("new_length"))).withColumn(
        "score", rules.score4(F.col("score_raw")))
    return out.join(stated, keys, "left")


def total_findings(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Summaries that disagree with their own objects; a layout without a summary is one finding."""
    checks = [("ties", "TIES", 0.0), ("connected", "CONNECTED", 0.0), ("tie_cost", "TIE_COST", MONEY),
              ("chamber_cost", "CHAMBER_COST", MONEY), ("new_length", "LENGTH", MONEY), ("penalty", "PENALTY", MONEY),
              ("construction_cost", "CONSTRUCTION_COST", MONEY), ("calculated_cost", "CALCULATED_COST", MONEY), ("score", "SCORE", 1e-4)]
    missing = reduce(Column.__and__, [F.col(f"stated_{c}").isNull() for c, *_ in checks])
    codes = [F.when(missing, "NO_SUMMARY")] + [
        F.when(~missing & _off(F.col(c).cast("double"), F.col(f"stated_{c}").cast("double"), slack), f"STATED_{code}")
        for c, code, slack in checks]
    rows = totals.withColumn("_code", F.explode(F.array_compact(F.array(*codes)))).withColumn("id", F.lit(None).cast("string"))
    return _findings(rows, keys, F.col("_code"))


def listing_findings(objects: DataFrame, features: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Consumers that a summary lists as unconnected though a pipe reaches them, and those it leaves out."""
    keys = list(keys)
    told = objects.filter("object_type = 'variant_summary'")
    listed = told.select(*keys, F.explode("summary.unconnected").alias("object_id")).distinct().withColumn("_listed", F.lit(1))
    reached = links.filter("end.kind = 'oks_connection_point'").select(*keys, F.col("end_id").alias("object_id")).distinct().withColumn("_hit", F.lit(1))
    wanted = told.select(*keys).distinct().join(features.filter("object_type = 'oks_connection_point'").select(
        "dataset_id", "object_id").withColumn("_known", F.lit(1)), "dataset_id")
    rows = wanted.join(reached, keys + ["object_id"], "left").join(listed, keys + ["object_id"], "full")
    code = (F.when(F.col("_known").isNull(), "LISTED_UNKNOWN").when(F.col("_hit").isNotNull() & F.col("_listed").isNotNull(), "LISTED_BUT_REACHED")
            .when(F.col("_hit").isNull() & F.col("_listed").isNull(), "NOT_LISTED"))
    return _findings(rows, keys, code, "object_id")


def rank_findings(totals: DataFrame, ranks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stated ranks (keys, rank) that break the order of the recomputed scores within a map.

    A rank is right if it counts the layouts of smaller score, and one; equal scores may share out
    their places in any order, but no place is used twice.
    """
    keys = list(keys)
    rows = totals.join(ranks, keys)
    scores = totals.select("dataset_id", "score_raw").groupBy("dataset_id", "score_raw").agg(F.count(F.lit(1)).alias("same"))
    from utilnet.operators.kernels import running
    before = running(scores, ["dataset_id"], ["score_raw"], sums={"before": "same"})
    placed = rows.join(before, ["dataset_id", "score_raw"])
    first = F.coalesce("before", F.lit(0))
    wrong = placed.filter(~F.coalesce((F.col("rank") > first) & (F.col("rank") <= first + F.col("same")), F.lit(False)))
    used = rows.groupBy("dataset_id", "rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twice = rows.join(used, ["dataset_id", "rank"], "left_semi")
    both = wrong.select(keys).unionByName(twice.select(keys)).distinct().withColumn("id", F.lit(None).cast("string"))
    return _findings(both, keys, "STATED_RANK")


def audit_export(objects: DataFrame, features: DataFrame, walls: DataFrame | None = None, ranks: DataFrame | None = None,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """All findings (keys, object_id, code) about exported layouts against the maps they were made for."""
    keys = list(keys)
    objects, features = cut(objects), cut(features)
    links = cut(export_links(objects, features, keys))
    totals = audit_totals(objects, features, links, keys)
    parts = [id_findings(objects, features, keys), pipe_findings(links, keys), graph_findings(links, keys),
             chamber_findings(objects, features, links, keys), total_findings(totals, keys),
             listing_findings(objects, features, links, keys)]
    if walls is not None:
        parts.append(entry_findings(links, walls, keys))
    if ranks is not None:
        parts.append(rank_findings(cut(totals), ranks, keys))
    return reduce(DataFrame.unionByName, parts)
