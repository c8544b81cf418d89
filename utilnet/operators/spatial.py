"""Spatial joins on a multi-level grid and what is built on them.

Tables: segments(keys, id, seq, x0, y0, x1, y1, at0, at1, minx, miny, maxx, maxy) for lines and
rings(dataset_id, object_id, seq, x0, ..., maxy) for areas. Distances are exact; the grid only
proposes candidates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.session import cut

KEYS = ("dataset_id",)
LEVELS, STEP = 4, 8          # cell, 8, 64 and 512 cells wide; the last takes all larger boxes
BOX = ("minx", "miny", "maxx", "maxy")


def _level(size: float | None, cell: float) -> int:
    """The coarsest level that boxes up to this size can have, with room for rounding."""
    if size is None or math.isnan(size):
        return LEVELS - 1
    return sum(size + 1e-6 * (1 + size) > cell * STEP ** (level - 1) for level in range(1, LEVELS))


def _cells(df: DataFrame, side: str, cell: float, own_only: bool, above: bool, top: int = LEVELS - 1) -> DataFrame:
    """Rows times the grid cells they cover, at their own level and, if asked, at coarser ones up to ``top``."""
    box = [F.col(f"_{side}{c}") for c in BOX]
    size = F.greatest(box[2] - box[0], box[3] - box[1])
    own = F.lit(0)
    for level in range(1, LEVELS):
        own = own + (size > cell * STEP ** (level - 1)).cast("int")
    own_name = f"_{side}_level"
    df = df.withColumn(own_name, own)
    if own_only:
        df = df.withColumn("_level", F.col(own_name))
    else:
        start = F.col(own_name) + (1 if above else 0)
        df = df.filter(start <= top).withColumn(
            "_level", F.explode(F.sequence(start, F.lit(top))))
    width = cell * F.pow(F.lit(float(STEP)), F.col("_level"))
    for name, c in (("x0", box[0]), ("y0", box[1]), ("x1", box[2]), ("y1", box[3])):
        df = df.withColumn(f"_{side}c{name}", F.floor(c / width).cast("long"))
    return (df.withColumn("_cx", F.explode(F.sequence(f"_{side}cx0", f"_{side}cx1")))
            .withColumn("_cy", F.explode(F.sequence(f"_{side}cy0", f"_{side}cy1"))))


def bbox_join(a: DataFrame, b: DataFrame, r: float = 0.0, cell: float = 64.0,
              keys: Sequence[str] = KEYS, sizes: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Pairs of rows whose boxes come within r of each other on both axes, each pair once.

    Result: keys, the columns of a as ``a_*`` and those of b as ``b_*``. A box lives on the grid level whose cells are at
    least its own size, so it covers at most four cells unless it is wider than the coarsest ones; a pair meets on the
    coarser of its two levels, in the one shared cell with the lowest coordinates. ``sizes``: what the boxes of a and of b
    do not exceed, where that is known (0 for points); no row is laid on levels that the other side does not have.
    """
    keys = list(keys)

    def side(df: DataFrame, name: str, grow: float) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys],
                         *[(F.col(c) + (grow if c.startswith("max") else -grow))
                           .alias(f"_{name}{c}") for c in BOX]).repartition(*keys, *[f"_{name}{c}" for c in BOX])

    left, right = side(a, "a", r), side(b, "b", 0.0)
    on = [*keys, "_level", "_cx", "_cy"]
    top_a, top_b = _level(None if sizes[0] is None else sizes[0] + 2 * r, cell), _level(sizes[1], cell)
    # Sorted, not broadcast: the cells of a small file may be many rows.
    pairs = _cells(left, "a", cell, False, False, top_b).hint("merge").join(_cells(right, "b", cell, True, False), on)
    if top_a > 0:
        coarse_a = _cells(left, "a", cell, True, False).hint("merge").join(_cells(right, "b", cell, False, True, top_a), on)
        pairs = pairs.unionByName(coarse_a)
    owner = ((F.col("_cx") == F.greatest("_acx0", "_bcx0"))
             & (F.col("_cy") == F.greatest("_acy0", "_bcy0")))
    overlap = ((F.col("_aminx") <= F.col("_bmaxx")) & (F.col("_amaxx") >= F.col("_bminx"))
               & (F.col("_aminy") <= F.col("_bmaxy")) & (F.col("_amaxy") >= F.col("_bminy")))
    return pairs.filter(owner & overlap).select(
        *keys, *[f"a_{c}" for c in a.columns if c not in keys],
        *[f"b_{c}" for c in b.columns if c not in keys])


def _seg(side: str) -> list[Column]:
    return [F.col(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")]


def as_points(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as zero-length segments with boxes, so that one kernel serves all shapes."""
    rest = [c for c in df.columns if c not in (x, y)]
    px, py = F.col(x), F.col(y)
    return df.select(*rest, px.alias("x0"), py.alias("y0"), px.alias("x1"), py.alias("y1"),
                     px.alias("minx"), py.alias("miny"), px.alias("maxx"), py.alias("maxy"))


def boxes_of(segments: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Box of each object from its segments."""
    return segments.groupBy(*ids).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                                      F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def within(a: DataFrame, b: DataFrame, r: float, a_id: str, b_id: str,
           keys: Sequence[str] = KEYS, cell: float = 64.0,
           sizes: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Object pairs whose lines, rings or points come within r: keys, a_id, b_id, distance."""
    apart = geo.segment_distance(*_seg("a"), *_seg("b"))
    pairs = geo.once(bbox_join(a, b, r, cell, keys, sizes), "distance", apart).filter(F.col("distance") <= r)
    return pairs.groupBy(*keys, f"a_{a_id}", f"b_{b_id}").agg(F.min("distance").alias("distance"))


def nearest(a: DataFrame, b: DataFrame, k: int, a_id: str, b_id: str,
            keys: Sequence[str] = KEYS, cell: float = 64.0) -> DataFrame:
    """The k nearest b objects of each a row, ties by id: keys, a_id, b_id, distance, rank.

    Searches within a radius and keeps the rows that found k objects inside it: nothing nearer
    can be missing. The rest go on with a radius four times as large, up to the dataset's extent.
    """
    keys = list(keys)
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    every = a.select(*keys, *BOX, wide.alias("_a"), F.lit(None).cast("double").alias("_b")).unionByName(
        b.select(*keys, *BOX, F.lit(None).cast("double").alias("_a"), wide.alias("_b")))
    extents = every.groupBy(*keys).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"),
                                       F.max("maxy").alias("maxy"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    area, *sizes = (float(v or 0) for v in extents.agg(F.max(wide), F.max("_a"), F.max("_b")).first())
    reach = 2 * area + 1
    open_rows = a.join(b.select(*keys).distinct(), keys, "left_semi")
    done, r = None, float(cell)
    order = W.partitionBy(*keys, f"a_{a_id}").orderBy("distance", f"b_{b_id}")
    while True:
        # Cells a little wider than the search: points cover at most four of one level.
        found = within(open_rows, b, r, a_id, b_id, keys, 2 * r + 1, tuple(sizes))
        found = cut(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        if r >= reach:
            done = found if done is None else done.unionByName(found)
            return done
        full = found.filter(F.col("rank") == k).select(*keys, F.col(f"a_{a_id}").alias(a_id))
        part = found.join(full.withColumnRenamed(a_id, f"a_{a_id}"), [*keys, f"a_{a_id}"],
                          "left_semi")
        done = part if done is None else done.unionByName(part)
        open_rows = cut(open_rows.join(full, [*keys, a_id], "left_anti"))
        if open_rows.isEmpty():
            return done
        r *= 4


def contained(points: DataFrame, rings: DataFrame, point_id: str = "point_id",
              keys: Sequence[str] = KEYS, eps: float = 1e-6) -> DataFrame:
    """(point, area) pairs where the point is inside or within eps of the boundary.

    Parity over all rings of the area, holes included; pairs come from the areas' boxes.
    """
    keys = list(keys)
    candidates = bbox_join(
        as_points(points.select(*keys, point_id, "x", "y")),
        boxes_of(rings, [*keys, "object_id"]), eps, keys=keys, sizes=(0.0, None)).select(
        *keys, F.col("b_object_id").alias("object_id"), F.col(f"a_{point_id}").alias(point_id),
        F.col("a_x0").alias("px"), F.col("a_y0").alias("py"))
    sides = rings.select(*keys, "object_id", "x0", "y0", "x1", "y1")
    side = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    tested = candidates.join(sides, keys + ["object_id"]).groupBy(*keys, point_id, "object_id").agg(
        F.sum(geo.ray_hits(F.col("px"), F.col("py"), *side)).alias("hits"),
        F.min(geo.point_segment_distance(F.col("px"), F.col("py"), *side)).alias("edge_distance"))
    return tested.filter((F.col("hits") % 2 == 1) | (F.col("edge_distance") <= eps)).select(
        *keys, point_id, "object_id", "edge_distance")


def resolve_building(points: DataFrame, rings: DataFrame, point_id: str = "point_id",
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """The building of each entry point: the containing one, else the one it names.

    ``points`` may carry ``oks_id``. Several containing buildings give no building and the code
    AMBIGUOUS_BUILDING_ENTRY.
    """
    keys = list(keys)
    inside = contained(points, rings, point_id, keys).groupBy(*keys, point_id).agg(
        F.count(F.lit(1)).alias("containing"), F.min("object_id").alias("_inside"))
    out = points.join(inside, keys + [point_id], "left").fillna(0, ["containing"])
    named = F.lit(None).cast(rings.schema["object_id"].dataType)
    if "oks_id" in points.columns:
        known = rings.select(*keys, F.col("object_id").alias("oks_id")).distinct().withColumn(
            "_known", F.lit(True))
        out = out.join(known, keys + ["oks_id"], "left")
        named = F.when(F.col("_known"), F.col("oks_id"))
    return out.select(
        *keys, point_id, "containing",
        F.when(F.col("containing") == 1, F.col("_inside"))
         .when(F.col("containing") == 0, named).alias("building_id"),
        F.when(F.col("containing") > 1, "AMBIGUOUS_BUILDING_ENTRY").alias("code"))


def _sides_may_meet() -> Column:
    """Cheap necessary test: neither segment lies wholly on one side of the other's line."""
    def straddles(p, q):
        (x0, y0, x1, y1), (u0, v0, u1, v1) = _seg(p), _seg(q)
        dx, dy = x1 - x0, y1 - y0
        c0, c1 = dx * (v0 - y0) - dy * (u0 - x0), dx * (v1 - y0) - dy * (u1 - x0)
        slack = 1e-6 * (F.abs(dx) + F.abs(dy)) + 1e-9
        return (F.least(c0, c1) <= slack) & (F.greatest(c0, c1) >= -slack)
    return straddles("a", "b") & straddles("b", "a")


def split_segments(segments: DataFrame, step: float) -> DataFrame:
    """Segments cut into pieces no longer than the step, so that slanted ones have small boxes."""
    cols = [c for c in segments.columns if c not in ("x0", "y0", "x1", "y1", *BOX)]
    side = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    n = F.greatest(F.lit(1), F.ceil(geo.distance(*side) / step).cast("int"))
    rows = segments.select(*cols, *side, n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    t0, t1 = F.col("_i") / F.col("_n"), (F.col("_i") + 1) / F.col("_n")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return geo.with_box(rows.select(
        *cols, (F.col("x0") + t0 * dx).alias("x0"), (F.col("y0") + t0 * dy).alias("y0"),
        (F.col("x0") + t1 * dx).alias("x1"), (F.col("y0") + t1 * dy).alias("y1")))


def line_hits(segments: DataFrame, others: DataFrame, edge_id: str = "edge_id",
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Where edges meet other lines: keys, edge, object, measure on the edge, point, collinear."""
    t, _ = geo.crossing(*_seg("a"), *_seg("b"))
    span = F.col("a_at1") - F.col("a_at0")
    meets = geo.segments_meet(*_seg("a"), *_seg("b"))
    ax0, ay0, ax1, ay1 = _seg("a")
    # Ends that lie on the other segment stand for touching and collinear contact.
    ends = []
    for px, py in ((F.col("b_x0"), F.col("b_y0")), (F.col("b_x1"), F.col("b_y1"))):
        pos = geo.segment_position(px, py, ax0, ay0, ax1, ay1)
        on = geo.point_segment_distance(px, py, ax0, ay0, ax1, ay1) <= 1e-9
        ends.append(F.when(on, pos))
    for share, px, py in ((0.0, ax0, ay0), (1.0, ax1, ay1)):
        ends.append(F.when(geo.point_segment_distance(px, py, *_seg("b")) <= 1e-9, F.lit(share)))
    # A lambda over the array would take its whole arithmetic out of the compiled code, so empty places stay in.
    spots = F.array(F.when(meets, t), *ends)
    met = bbox_join(segments, others, 1e-9, keys=keys).filter(_sides_may_meet())
    return (geo.once(met, "_spots", spots).filter(F.array_max("_spots").isNotNull())
            .select(*keys, F.col(f"a_{edge_id}").alias(edge_id),
                    F.col("b_object_id").alias("object_id"),
                    "a_at0", "a_at1", "a_x0", "a_y0", "a_x1", "a_y1", F.explode("_spots").alias("_t"),
                    (t.isNull() & (F.array_max("_spots") - F.array_min("_spots") > 0))
                    .alias("parallel"),
                    ((F.array_max("_spots") - F.array_min("_spots")) * span).alias("shared_length"))
            .filter("_t IS NOT NULL")
            .select(*keys, edge_id, "object_id",
                    (F.col("a_at0") + F.col("_t") * (F.col("a_at1") - F.col("a_at0"))).alias("at"),
                    (F.col("a_x0") + F.col("_t") * (F.col("a_x1") - F.col("a_x0"))).alias("x"),
                    (F.col("a_y0") + F.col("_t") * (F.col("a_y1") - F.col("a_y0"))).alias("y"),
                    "parallel", "shared_length"))


def polygon_intervals(segments: DataFrame, rings: DataFrame, edge_id: str = "edge_id",
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Stretches of each edge inside each area: keys, edge, object, core_from, core_to.

    Windows here run over one edge and one area, both single rows of their tables, so a group is
    bounded by the vertices of two geometries.
    """
    keys = list(keys)
    pair = [*keys, edge_id, "object_id"]
    hits = cut(line_hits(segments, rings, edge_id, keys).select(*pair, "at").distinct())
    # A pipe that touches no side of an area is inside it only if its first point is.
    starts = segments.filter("seq = 0").select(*keys, edge_id, F.col("x0").alias("x"), F.col("y0").alias("y"))
    met = hits.select(*pair).unionByName(contained(starts, rings, edge_id, keys, 1e-9).select(*pair)).distinct()
    lengths = segments.groupBy(*keys, edge_id).agg(F.max("at1").alias("len"))
    near = met.join(lengths, keys + [edge_id]).select(
        *pair, F.explode(F.array(F.lit(0.0), F.col("len"))).alias("at"))
    stops = near.unionByName(hits).distinct()
    order = W.partitionBy(*pair).orderBy("at")
    spans = stops.withColumn("to", F.lead("at").over(order)).filter(F.col("to") - F.col("at") > 1e-9)
    # The midpoint of a span decides for the whole span.
    mid = (F.col("at") + F.col("to")) / 2
    legs = segments.select(*keys, edge_id, "x0", "y0", "x1", "y1", "at0", "at1")
    share = (mid - F.col("at0")) / (F.col("at1") - F.col("at0"))
    probe = (spans.join(legs, keys + [edge_id])
             .filter((mid >= F.col("at0")) & (mid < F.col("at1")))
             .select(*pair, "at", "to", (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("px"),
                     (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("py")))
    side = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    inside = (probe.join(rings.select(*keys, "object_id", "x0", "y0", "x1", "y1"),
                         keys + ["object_id"])
              .groupBy(*pair, "at", "to").agg(
                  F.sum(geo.ray_hits(F.col("px"), F.col("py"), *side)).alias("hits"),
                  F.min(geo.point_segment_distance(F.col("px"), F.col("py"), *side)).alias("d"))
              .filter((F.col("hits") % 2 == 1) | (F.col("d") <= 1e-9)))
    joined = merge_intervals(inside, pair, "at", "to", 1e-9)
    return joined.filter(F.col("to") - F.col("at") > 1e-5).select(
        *pair, F.col("at").alias("core_from"), F.col("to").alias("core_to"))


def merge_intervals(df: DataFrame, group: Sequence[str], start: str, end: str,
                    gap: float) -> DataFrame:
    """Islands of overlapping intervals per group (one edge with one object)."""
    order = W.partitionBy(*group).orderBy(start, end)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    flagged = df.withColumn("_new", F.coalesce(
        F.col(start) > F.max(end).over(before) + gap, F.lit(True)).cast("int"))
    island = flagged.withColumn("_island", F.sum("_new").over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*group, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def crossing_violations(edges: DataFrame, segments: DataFrame, nodes: DataFrame,
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """New pipes that meet anywhere but at a shared node, and pipes that cross themselves.

    Contacts are proper crossings and ends within 1e-5 m of the other pipe. A contact is legal
    within 1 cm of a node both pipes end at, or of ties of both on one object under 1 mm apart.
    """
    keys = list(keys)
    xy = nodes.select(*keys, F.col("node_id"), F.col("x"), F.col("y"), "node_type",
                      *(["existing_id"] if "existing_id" in nodes.columns else
                        [F.lit(None).cast("string").alias("existing_id")]))
    ends = edges.select(*keys, "edge_id", "edge_ord", "start_id", "end_id")
    for side in ("start", "end"):
        ends = ends.join(xy.select(*keys, F.col("node_id").alias(f"{side}_id"), F.struct(
            "x", "y", "node_type", "existing_id").alias(f"{side}_node")), keys + [f"{side}_id"], "left")
    rows = segments.join(ends, keys + ["edge_id"])
    ca, cb = F.col("a_edge_ord"), F.col("b_edge_ord")
    later = (ca < cb) | ((ca == cb) & (F.col("a_seq") + 1 < F.col("b_seq")))
    t, _ = geo.crossing(*_seg("a"), *_seg("b"))
    ax0, ay0, ax1, ay1 = _seg("a")
    bx0, by0, bx1, by1 = _seg("b")

    def spot(x, y, near):
        return F.when(near, F.struct(x.alias("x"), y.alias("y")))

    spots = [spot(ax0 + t * (ax1 - ax0), ay0 + t * (ay1 - ay0),
                  geo.segments_meet(*_seg("a"), *_seg("b")))]
    for x, y, s in ((ax0, ay0, "b"), (ax1, ay1, "b"), (bx0, by0, "a"), (bx1, by1, "a")):
        spots.append(spot(x, y, geo.point_segment_distance(x, y, *_seg(s)) <= 1e-5))
    sx, sy = F.col("_spot.x"), F.col("_spot.y")
    legal = F.lit(False)
    for p in ("start", "end"):
        for q in ("start", "end"):
            same = F.col(f"a_{p}_id") == F.col(f"b_{q}_id")
            m, n = F.col(f"a_{p}_node"), F.col(f"b_{q}_node")
            tied = ((m["node_type"] == "tie") & (n["node_type"] == "tie")
                    & (m["existing_id"] == n["existing_id"])
                    & (geo.distance(m["x"], m["y"], n["x"], n["y"]) < 1e-3))
            near = geo.distance(sx, sy, m["x"], m["y"]) < 0.01
            legal = legal | F.coalesce((ca != cb) & (same | F.coalesce(tied, F.lit(False))) & near,
                                       F.lit(False))
    met = geo.once(bbox_join(rows, rows, 1e-5, keys=keys).filter(later), "_spots", F.array(*spots))
    return (met.filter(F.coalesce(*[F.get("_spots", F.lit(i)) for i in range(len(spots))]).isNotNull())
            .withColumn("_spot", F.explode("_spots")).filter("_spot IS NOT NULL").filter(~legal)
            .select(*keys, F.col("a_edge_id").alias("edge_id"), F.col("b_edge_id").alias("other_id"),
                    F.when(ca == cb, "SELF_CROSSING").otherwise("CROSSING").alias("code"))
            .distinct())


def entry_walls(points: DataFrame, rings: DataFrame, owners: DataFrame,
                point_id: str = "point_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """Walls of the owning building nearest to each entry, shrunk by half the pipe at both ends.

    ``owners``: keys, point_id, building_id, dn. ``rings`` carries ``ring`` 0 for exteriors when
    there are holes. ``display`` marks the wall shown: longest, then smallest coordinates.
    """
    from utilnet.functions.rules import pipe_width
    keys = list(keys)
    outer = rings.filter("ring = 0") if "ring" in rings.columns else rings
    walls = outer.select(*keys, F.col("object_id").alias("building_id"), "x0", "y0", "x1", "y1")
    flip = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    walls = walls.select(
        *keys, "building_id", *[F.when(flip, F.col(q)).otherwise(F.col(p)).alias(p)
                                for p, q in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])
    side = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    rows = (points.select(*keys, point_id, "x", "y").join(owners, keys + [point_id])
            .join(walls, keys + ["building_id"])
            .withColumn("wall_length", geo.distance(*side)).filter("wall_length >= 1e-6")
            .withColumn("distance", geo.point_segment_distance(F.col("x"), F.col("y"), *side)))
    least = rows.groupBy(*keys, point_id).agg(F.min("distance").alias("_least"))
    close = rows.join(least, keys + [point_id]).filter(F.col("distance") <= F.col("_least") + 1e-6)
    shown = close.groupBy(*keys, point_id).agg(
        F.min(F.struct(-F.col("wall_length"), *side)).alias("_shown"))
    half = pipe_width(F.col("dn")) / 2
    share = half / F.col("wall_length")
    return close.join(shown, keys + [point_id]).select(
        *keys, point_id, "building_id", *side, "wall_length", "distance",
        (F.struct(-F.col("wall_length"), *side) == F.col("_shown")).alias("display"),
        (F.col("wall_length") > 2 * half + 2e-6).alias("usable"),
        (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("window_x0"),
        (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("window_y0"),
        (F.col("x1") - share * (F.col("x1") - F.col("x0"))).alias("window_x1"),
        (F.col("y1") - share * (F.col("y1") - F.col("y0"))).alias("window_y1"))


def ray_exits(rays: DataFrame, rings: DataFrame, ray_id: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """First boundary point of the owning building along each ray.

    ``rays``: keys, ray_id, building_id, x, y (the entry) and tx, ty (a point to aim at). Rays
    along a wall have no single exit and give NULL. The ray runs past the building's own extent.
    """
    keys = list(keys)
    d = geo.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    sides = rings.select(*keys, F.col("object_id").alias("building_id"), "x0", "y0", "x1", "y1")
    ux, uy = (F.col("tx") - F.col("x")) / F.col("_d"), (F.col("ty") - F.col("y")) / F.col("_d")
    vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cx, cy = F.col("x0") - F.col("x"), F.col("y0") - F.col("y")
    den = ux * vy - uy * vx
    safe = F.nullif(den, F.lit(0.0))
    t, u = (cx * vy - cy * vx) / safe, (cx * uy - cy * ux) / safe
    along = (den == 0) & (F.abs(cx * uy - cy * ux) <= 1e-9) & (
        F.greatest(cx * ux + cy * uy, (cx + vx) * ux + (cy + vy) * uy) > 0)
    hit = F.when((t > 1e-6) & (u >= 0) & (u <= 1), t)
    return (rays.withColumn("_d", d).filter("_d >= 1e-6").join(sides, keys + ["building_id"])
            .withColumn("_ux", ux).withColumn("_uy", uy)
            .groupBy(*keys, ray_id, "building_id", "x", "y", "_d", "_ux", "_uy")
            .agg(F.min(hit).alias("_t"), F.bool_or(along).alias("_along"))
            .select(*keys, ray_id, "building_id", F.col("_d").alias("target_distance"),
                    F.when(~F.col("_along"), F.col("_t")).alias("exit_distance"),
                    F.when(~F.col("_along"), F.col("x") + F.col("_t") * F.col("_ux")).alias("exit_x"),
                    F.when(~F.col("_along"), F.col("y") + F.col("_t") * F.col("_uy")).alias("exit_y")))


def terminal_crossing(rays: DataFrame, rings: DataFrame, walls: DataFrame, ray_id: str,
                      point_id: str = "point_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rays whose first exit lies on an allowed window of the entry's walls.

    ``rays`` has ray_id, point_id and the ray columns; the target must lie beyond the exit.
    """
    keys = list(keys)
    exits = ray_exits(rays, rings, ray_id, keys).join(
        rays.select(*keys, ray_id, point_id), keys + [ray_id])
    exits = exits.filter("exit_distance IS NOT NULL AND target_distance >= exit_distance - 1e-6")
    windows = walls.filter("usable").select(*keys, point_id, "window_x0", "window_y0", "window_x1",
                                            "window_y1")
    near = geo.point_segment_distance(
        F.col("exit_x"), F.col("exit_y"),
        *[F.col(f"window_{c}") for c in ("x0", "y0", "x1", "y1")]) <= 1e-6
    return (exits.join(windows, keys + [point_id]).filter(near)
            .select(*keys, ray_id, point_id, "exit_x", "exit_y", "exit_distance").distinct())
