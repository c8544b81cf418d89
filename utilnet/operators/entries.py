"""Where pipes come into buildings: interior rules, entry reports, wall preference, and layout integrity.

The only way into a building is the straight last leg of the pipe that serves it, from the first wall its ray
meets on the way out; that wall has to be one of the nearest to the consumer's point. Tables: edges(keys,
edge_id, path, dn), segments and rings as in ``spatial``, rings of buildings only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.operators import spatial
from utilnet.session import cut

KEYS = ("dataset_id",)
EPS = 1e-6
WALL_WEIGHT = 8.0  # metres of penalty for each metre to a farther wall
ON_SOURCE, AT_NODE = 0.01, 0.001  # m
_WINDOW = [f"window_{c}" for c in ("x0", "y0", "x1", "y1")]


def is_building(object_type: Column, restriction: Column) -> Column:
    """Existing and future buildings, and restrictions of that kind."""
    return F.coalesce(object_type.isin("oks_existing", "oks_future") | ((object_type == "restriction") & (restriction == "oks")),
                      F.lit(False))


def entry_portals(edges: DataFrame, owners: DataFrame, rings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The wall crossing of each pipe that ends inside the building it serves.

    ``owners``: keys, edge_id, building_id. Result: keys, edge_id, building_id, portal_x, portal_y, indoor
    (metres behind the wall), reference (distance of the consumer's nearest wall), the window of the wall
    that was crossed, and the distances of that window and of the nearest usable one from the pipe's first
    point. A pipe whose last leg comes through no usable window of a nearest wall has NULLs; an end on or
    outside the outline has no row, as it needs no entry.
    """
    keys = list(keys)
    tail, aim, head = F.element_at("path", -1), F.element_at("path", -2), F.element_at("path", 1)
    rays = cut(edges.join(owners, keys + ["edge_id"]).select(
        *keys, F.col("edge_id").alias("point_id"), F.col("edge_id").alias("ray_id"), "building_id", "dn", tail["x"].alias("x"),
        tail["y"].alias("y"), aim["x"].alias("tx"), aim["y"].alias("ty"), head["x"].alias("hx"), head["y"].alias("hy")))
    strict = spatial.contained(rays.select(*keys, "point_id", "x", "y"), rings, keys=keys).filter(F.col("edge_distance") > EPS)
    rays = cut(rays.join(strict.select(*keys, "point_id", F.col("object_id").alias("building_id")), keys + ["point_id", "building_id"], "left_semi"))
    walls = cut(spatial.entry_walls(rays.select(*keys, "point_id", "x", "y"), rings,
                                    rays.select(*keys, "point_id", "building_id", "dn"), keys=keys))
    exits = cut(spatial.terminal_crossing(rays, rings, walls, "ray_id", keys=keys))
    window = [F.col(c) for c in _WINDOW]
    sides = walls.filter("usable").join(rays.select(*keys, "point_id", "hx", "hy"), keys + ["point_id"]).join(
        exits.select(*keys, "point_id", "exit_x", "exit_y"), keys + ["point_id"], "left")
    crossed = geo.point_segment_distance(F.col("exit_x"), F.col("exit_y"), *window) <= EPS
    far = geo.point_segment_distance(F.col("hx"), F.col("hy"), *window)
    judged = sides.groupBy(*keys, "point_id").agg(
        F.min(far).alias("nearest_to_network"), F.min(F.when(crossed, F.struct(*_WINDOW, far.alias("far")))).alias("_w"))
    reference = walls.groupBy(*keys, "point_id").agg(F.min("distance").alias("reference"))
    return (rays.select(*keys, "point_id", "building_id").join(exits.drop("ray_id"), keys + ["point_id"], "left")
            .join(judged, keys + ["point_id"], "left").join(reference, keys + ["point_id"], "left")
            .select(*keys, F.col("point_id").alias("edge_id"), "building_id", F.col("exit_x").alias("portal_x"),
                    F.col("exit_y").alias("portal_y"), F.col("exit_distance").alias("indoor"), "reference",
                    *[F.col(f"_w.{c}").alias(c) for c in _WINDOW], F.col("_w.far").alias("wall_to_network"), "nearest_to_network"))


def outside_interval(start: Column, end: Column, low: Column, high: Column) -> Column:
    """How much of [start, end] lies outside [low, high]."""
    zero = F.lit(0.0)
    return (F.greatest(zero, F.least(end, low) - start) + F.greatest(zero, end - F.greatest(start, high)))


def entry_violations(edges: DataFrame, segments: DataFrame, rings: DataFrame, portals: DataFrame,
                     assigned: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pipes inside buildings anywhere but on their own last leg, or through another wall than the assigned one.

    The stretches of a pipe inside a building, less the allowed last leg, must leave nothing. ``assigned``:
    keys, edge_id, wall_x0 .. wall_y1. Result: keys, edge_id, object_id, code.
    """
    keys = list(keys)
    inside = spatial.polygon_intervals(segments, rings, keys=keys)
    size = segments.groupBy(*keys, "edge_id").agg(F.max("at1").alias("len"))
    own = portals.select(*keys, "edge_id", F.col("building_id").alias("object_id"), "indoor", "portal_x", "portal_y")
    spans = inside.join(size, keys + ["edge_id"]).join(own, keys + ["edge_id", "object_id"], "left").withColumn(
        "left_over", F.when(F.col("indoor").isNull(), F.col("core_to") - F.col("core_from")).otherwise(
            outside_interval(F.col("core_from"), F.col("core_to"), F.col("len") - F.col("indoor"), F.col("len"))))
    spans = cut(spans.groupBy(*keys, "edge_id", "object_id").agg(
        F.max("left_over").alias("left_over"), F.max("portal_x").alias("portal_x"), F.max("portal_y").alias("portal_y")))
    parts = [spans.filter(F.col("left_over") > 2 * EPS).select(*keys, "edge_id", "object_id", F.lit("BUILDING_INTERSECTION").alias("code")),
             own.filter("indoor IS NULL").select(*keys, "edge_id", "object_id", F.lit("BUILDING_ENTRY_INVALID").alias("code"))]
    if assigned is not None:
        off = geo.point_segment_distance(F.col("portal_x"), F.col("portal_y"), *[F.col(f"wall_{c}") for c in ("x0", "y0", "x1", "y1")]) > EPS
        parts.append(spans.filter((F.col("left_over") <= 2 * EPS) & F.col("portal_x").isNotNull()).join(assigned, keys + ["edge_id"])
                     .filter(off).select(*keys, "edge_id", "object_id", F.lit("BUILDING_ENTRY_WALL").alias("code")))
    return reduce(DataFrame.unionByName, parts)


def entry_report(portals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per valid entry: where the wall is crossed, what runs indoors, and whether a nearer wall was free."""
    extra = F.greatest(F.lit(0.0), F.col("wall_to_network") - F.col("nearest_to_network"))
    return portals.filter("indoor IS NOT NULL").select(
        *keys, "edge_id", "building_id", "portal_x", "portal_y", "indoor", "reference", "wall_to_network", "nearest_to_network",
        (extra <= 1e-4).alias("faces_network"), (WALL_WEIGHT * extra).alias("wall_metres"))


def wall_penalty(report: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Indoor length and penalty metres per network."""
    return report.groupBy(*keys).agg(F.sum("indoor").alias("indoor_length"), F.sum("wall_metres").alias("wall_metres"))


def ties_on_sources(nodes: DataFrame, sources: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ties and the place on the old object they name: keys, node_id, distance, at (measure on its line).

    ``sources``: keys, object_id, x0 .. y1, at0, at1 and box, chambers as points. A tie farther than
    ``ON_SOURCE`` from its object has no row. Of places equally near the first counts.
    """
    keys = list(keys)
    ties = spatial.as_points(nodes.filter("node_type = 'tie'").select(*keys, "node_id", "existing_id", "x", "y"))
    side = [F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]
    px, py = F.col("a_x0"), F.col("a_y0")
    near = spatial.bbox_join(ties, sources.select(*keys, "object_id", "x0", "y0", "x1", "y1", "at0", "at1", *spatial.BOX), ON_SOURCE, keys=keys, sizes=(0.0, None))
    near = near.filter(F.col("a_existing_id") == F.col("b_object_id")).withColumn(
        "distance", geo.point_segment_distance(px, py, *side)).filter(F.col("distance") <= ON_SOURCE)
    at = F.col("b_at0") + geo.segment_position(px, py, *side) * (F.col("b_at1") - F.col("b_at0"))
    return near.groupBy(*keys, F.col("a_node_id").alias("node_id")).agg(F.min(F.struct("distance", at.alias("at"))).alias("_p")).select(
        *keys, "node_id", "_p.distance", "_p.at")


def layout_violations(nodes: DataFrame, edges: DataFrame, entries: DataFrame, sources: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stored layouts whose topology does not match the map or their own geometry: keys, object_id, code.

    ``entries``: keys, entry_id, x, y, the consumers' points; ``sources`` as for ``ties_on_sources`` with
    object_type. Consumers are leaves at their own point, each served once; ties lie on an old pipe or
    chamber; pipes have a length and end where their nodes are.
    """
    keys = list(keys)

    def found(df: DataFrame, code: Column | str, name: str = "node_id") -> DataFrame:
        code = F.lit(code) if isinstance(code, str) else code
        return df.select(*keys, F.col(name).cast("string").alias("object_id"), code.alias("code")).filter("code IS NOT NULL")

    ends = [edges.select(*keys, "edge_id", F.col(f"{s}_id").alias("node_id"), F.lit(s == "start").alias("out")) for s in ("start", "end")]
    degree = ends[0].unionByName(ends[1]).groupBy(*keys, "node_id").agg(
        F.count(F.lit(1)).alias("degree"), F.count(F.when(F.col("out"), 1)).alias("children"))
    users = nodes.filter("node_type = 'oks'").select(*keys, "node_id", "entry_id", "x", "y")
    points = entries.select(*keys, "entry_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    placed = users.join(points, keys + ["entry_id"], "left")
    moved = F.when(F.col("ex").isNull(), "UNKNOWN_ENTRY").when(geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey")) > EPS, "ENTRY_MOVED")
    shared = users.groupBy(*keys, "entry_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND entry_id IS NOT NULL").drop("n")
    leaves = users.join(degree, keys + ["node_id"], "left").filter(
        (F.coalesce("children", F.lit(0)) > 0) | (F.coalesce("degree", F.lit(0)) != 1))
    missing = points.join(users.select(*keys, "entry_id"), keys + ["entry_id"], "left_anti")
    kinds = sources.filter(F.col("object_type").isin("heat_network", "heat_chamber")).select(
        *keys, F.col("object_id").alias("existing_id"), F.lit(True).alias("_known")).distinct()
    on = ties_on_sources(nodes, sources, keys).select(*keys, "node_id", F.lit(True).alias("_on"))
    ties = nodes.filter("node_type = 'tie'").join(kinds, keys + ["existing_id"], "left").join(on, keys + ["node_id"], "left")
    tie_code = F.when(F.col("_known").isNull(), "UNKNOWN_SOURCE").when(F.col("_on").isNull(), "TIE_OFF_SOURCE")
    rows = edges
    for side in ("start", "end"):
        rows = rows.join(nodes.select(*keys, F.col("node_id").alias(f"{side}_id"), F.struct("x", "y").alias(side)), keys + [f"{side}_id"], "left")

    def apart(vertex: Column, side: str) -> Column:
        return geo.distance(vertex["x"], vertex["y"], F.col(f"{side}.x"), F.col(f"{side}.y")) > AT_NODE

    codes = F.array_compact(F.array(
        F.when(F.col("start").isNull() | F.col("end").isNull(), "EDGE_NODE_MISSING"),
        F.when(~F.coalesce(F.col("length") > 0, F.lit(False)), "EDGE_EMPTY"),
        F.when(apart(F.element_at("path", 1), "start"), "EDGE_OFF_START"), F.when(apart(F.element_at("path", -1), "end"), "EDGE_OFF_END")))
    return reduce(DataFrame.unionByName, [
        found(placed, moved), found(users.join(shared, keys + ["entry_id"], "left_semi"), "REPEATED_ENTRY"), found(leaves, "NOT_A_LEAF"),
        found(missing, "ENTRY_MISSING", "entry_id"), found(ties, tie_code),
        found(nodes.filter(~F.col("node_type").isin("oks", "chamber", "tie") | F.col("node_type").isNull()), "UNKNOWN_NODE_TYPE"),
        found(nodes.filter("node_type <> 'tie' AND existing_id IS NOT NULL"), "FOREIGN_TIE"),
        found(rows.withColumn("_code", F.explode(codes)), F.col("_code"), "edge_id")])
