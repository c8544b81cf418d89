"""Where a new pipe could start on the old network, and which consumers to lay out together."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import graph, spatial
from utilnet.operators.kernels import climb, fold_subtrees
from utilnet.session import cut, discard

KEYS = ("dataset_id",)
BESIDE = 15.0  # m either side of the nearest point of a pipe
OWNED = 10.000001  # m around a chamber with room in which it takes the connection
TOO_NEAR = 0.26  # m around any chamber in which a pipe takes none
AT_SELF = 0.1  # m
APART, SAME_AXIS = 20.0, math.radians(0.5)  # root places nearer than this with one axis are one
SHORTEST = 0.5  # m, of a pipe's segment that can hold a root
MICRON = 1e6  # distances are compared to a micrometre: equal ones are told apart by place


def _rounded(distance: Column) -> Column:
    return F.floor(distance * MICRON + 0.5)


def reach(dn: Column) -> Column:
    """How far from a consumer ties are looked for: the run limit of the next diameter up."""
    return rules.run_limit(F.least(F.lit(len(rules.DN) - 1), rules.dn_index(dn) + 1))


def tie_candidates(entries: DataFrame, lines: DataFrame, chambers: DataFrame, limit: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``limit`` nearest places for a new tie of each consumer: keys, entry_id, rank, existing_id, x, y, distance.

    ``entries``: keys, entry_id, x, y, dn; ``lines``: keys, object_id, path; ``chambers``: keys, object_id, x, y,
    spare (branches it has room for). Places of a pipe are its point nearest to the consumer, 15 m either side of
    it, its ends and its middle. A place within 10 m of chambers with room becomes those chambers; one beside a
    full chamber is none. Equal places of one object count once.
    """
    keys = list(keys)
    entry = [*keys, "entry_id"]
    r = reach(F.col("dn"))
    spots = cut(entries.filter(rules.dn_index(F.col("dn")).isNotNull()).select(
        *entry, F.col("x").alias("ex"), F.col("y").alias("ey"), r.alias("r"), (F.col("x") - r).alias("minx"), (F.col("y") - r).alias("miny"),
        (F.col("x") + r).alias("maxx"), (F.col("y") + r).alias("maxy")))
    xs, ys = F.transform("path", lambda p: p["x"]), F.transform("path", lambda p: p["y"])
    boxes = lines.select(*keys, "object_id", "path", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                         F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    near = spatial.bbox_join(spots, boxes, keys=keys).select(
        *keys, F.col("a_entry_id").alias("entry_id"), F.col("a_ex").alias("ex"), F.col("a_ey").alias("ey"), F.col("a_r").alias("r"),
        F.col("b_object_id").alias("object_id"), F.col("b_path").alias("path"))
    near = cut(near.withColumn("at", geo.project(F.col("path"), F.col("ex"), F.col("ey"))).withColumn("len", geo.path_length(F.col("path"))))
    at, size = F.col("at"), F.col("len")
    places = F.array_distinct(F.array(at, F.lit(0.0), size, F.greatest(F.lit(0.0), at - BESIDE), F.least(size, at + BESIDE), size / 2))
    on = near.withColumn("_at", F.explode(places)).withColumn("p", geo.point_at(F.col("path"), F.col("_at"))).select(
        *entry, "ex", "ey", "r", "object_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    on = cut(on.filter(geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey")) <= F.col("r")))
    # Chambers by the places beside them; like the pipes, only those in the consumer's box.
    cams = spatial.as_points(chambers.select(*keys, "object_id", "x", "y", "spare"))
    met = spatial.bbox_join(spatial.as_points(on.withColumnRenamed("object_id", "line_id")), cams, OWNED, keys=keys)
    gap = geo.distance(F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0"))
    boxed = (F.abs(F.col("b_x0") - F.col("a_ex")) <= F.col("a_r")) & (F.abs(F.col("b_y0") - F.col("a_ey")) <= F.col("a_r"))
    place = [F.col(f"a_{c}").alias(c) for c in ("entry_id", "ex", "ey", "r", "line_id", "x0", "y0")]
    met = cut(met.filter(boxed & (gap <= OWNED)).select(
        *keys, *place, gap.alias("gap"), F.col("b_object_id").alias("cam"), F.col("b_x0").alias("cx"), F.col("b_y0").alias("cy"), F.col("b_spare").alias("spare")))
    taken = met.filter((F.col("spare") > 0) | (F.col("gap") < TOO_NEAR)).select(
        *entry, F.col("line_id").alias("object_id"), F.col("x0").alias("x"), F.col("y0").alias("y")).distinct()
    free = on.join(taken, [*entry, "object_id", "x", "y"], "left_anti").select(*entry, "ex", "ey", "r", F.col("object_id").alias("existing_id"), "x", "y")
    lent = met.filter("spare > 0").select(*entry, "ex", "ey", "r", F.col("cam").alias("existing_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    direct = spatial.bbox_join(spots, cams.filter("spare > 0"), keys=keys).select(
        *keys, *[F.col(f"a_{c}").alias(c) for c in ("entry_id", "ex", "ey", "r")], F.col("b_object_id").alias("existing_id"),
        F.col("b_x0").alias("x"), F.col("b_y0").alias("y"))
    every = free.unionByName(lent).unionByName(direct).withColumn(
        "distance", geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))).filter((F.col("distance") > AT_SELF) & (F.col("distance") <= F.col("r")))
    key = geo.coordinate_key(F.col("x"), F.col("y"))
    one = every.withColumn("place", key).groupBy(*entry, "existing_id", "place").agg(
        F.min("distance").alias("distance"), F.min_by(F.struct("x", "y"), "distance").alias("p"))
    order = W.partitionBy(*entry).orderBy(_rounded(F.col("distance")), "place", "existing_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        *entry, "rank", "existing_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "distance")


def root_candidates(entries: DataFrame, lines: DataFrame, chambers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Places where one root could serve a whole map: keys, existing_id, place, x, y, axis, distance (mean, to all consumers).

    On each segment of an old pipe: its middle, the point nearest to the consumers' centre and those nearest to each
    consumer, unless a chamber with room lies within 10 m; and the chambers with room (keys, object_id, x, y, spare,
    axis). The mean distance needs every place with every consumer of its own map.
    """
    keys = list(keys)
    points = cut(entries.select(*keys, F.col("x").alias("ex"), F.col("y").alias("ey")))
    centre = points.groupBy(*keys).agg(F.avg("ex").alias("ex"), F.avg("ey").alias("ey"))
    side = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    segments = cut(geo.explode_segments(lines.select(*keys, "object_id", "path")).filter(geo.distance(*side) >= SHORTEST))
    before = segments.select(*keys, "object_id", (F.col("seq") + 1).alias("seq"), geo.bearing(*side).alias("before"))
    segments = segments.join(before, keys + ["object_id", "seq"], "left")
    share = geo.segment_position(F.col("ex"), F.col("ey"), *side)
    spread = segments.join(points.unionByName(centre), keys).select(*keys, "object_id", *side, "before", share.alias("t"))
    middles = segments.select(*keys, "object_id", *side, "before", F.lit(0.5).alias("t"))
    # At its first vertex a segment is reached by the one before it.
    axis = F.when((F.col("t") * geo.distance(*side) <= 1e-7) & F.col("before").isNotNull(), F.col("before")).otherwise(geo.bearing(*side))
    on = spread.unionByName(middles).select(
        *keys, F.col("object_id").alias("existing_id"), (F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).alias("x"),
        (F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))).alias("y"), axis.alias("axis"))
    key = geo.coordinate_key(F.col("x"), F.col("y"))
    on = cut(on.withColumn("place", key).groupBy(*keys, "existing_id", "place").agg(F.min(F.struct("x", "y", "axis")).alias("p")).select(
        *keys, "existing_id", "place", "p.*"))
    room = chambers.filter("spare > 0")
    owned = spatial.bbox_join(spatial.as_points(on), spatial.as_points(room.select(*keys, "object_id", "x", "y")), OWNED, keys=keys).filter(
        geo.distance(F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0")) <= OWNED).select(
        *keys, F.col("a_existing_id").alias("existing_id"), F.col("a_place").alias("place")).distinct()
    free = on.join(owned, keys + ["existing_id", "place"], "left_anti")
    old = room.select(*keys, F.col("object_id").alias("existing_id"), key.alias("place"), "x", "y", "axis")
    every = cut(free.unionByName(old))
    far = every.join(points, keys).groupBy(*keys, "existing_id", "place").agg(
        F.avg(geo.distance(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))).alias("distance"))
    return every.join(far, keys + ["existing_id", "place"])


def spread_places(places: DataFrame, limit: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The best ``limit`` places of each map of which no two lie within 20 m with one axis: keys, rank, and the columns of ``places``.

    Taking the best and dropping its neighbours, over and over, chooses exactly the places that have no better
    chosen neighbour; every round settles all that have no better open neighbour left, wherever they lie.
    """
    keys = list(keys)
    name = [*keys, "existing_id", "place"]
    order = F.struct(_rounded(F.col("distance")).alias("d"), "existing_id", "place")
    rows = cut(places.withColumn("order", order))
    turn = geo.frame_difference(F.col("a_axis"), F.col("b_axis"), math.pi / 4)
    points = spatial.as_points(rows.select(*name, "x", "y", "axis", "order"))
    pairs = spatial.bbox_join(points, points, APART, keys=keys).filter(
        (geo.distance(F.col("a_x0"), F.col("a_y0"), F.col("b_x0"), F.col("b_y0")) < APART) & (turn < SAME_AXIS) & (F.col("a_order") < F.col("b_order")))
    links = cut(pairs.select(*keys, F.col("a_order").alias("better"), F.col("b_order").alias("worse")))
    state = cut(rows.select(*keys, "order"))
    chosen = None
    while not state.isEmpty():
        live = links.join(state.withColumnRenamed("order", "worse"), keys + ["worse"], "left_semi").join(
            state.withColumnRenamed("order", "better"), keys + ["better"], "left_semi")
        won = cut(state.join(live.select(*keys, F.col("worse").alias("order")), keys + ["order"], "left_anti"))
        lost = links.join(won.withColumnRenamed("order", "better"), keys + ["better"], "left_semi").select(*keys, F.col("worse").alias("order"))
        last, state = state, cut(state.join(won, keys + ["order"], "left_anti").join(lost, keys + ["order"], "left_anti"))
        discard(last)
        chosen = won if chosen is None else chosen.unionByName(won)
    if chosen is None:
        return rows.withColumn("rank", F.lit(0)).drop("order")
    ranked = rows.join(chosen, keys + ["order"], "left_semi").withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("order")))
    return ranked.filter(F.col("rank") <= limit).drop("order")


def demand_groups(edges: DataFrame, terminals: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS, least: int = 2, most: int = 4) -> DataFrame:
    """Sets of ``least`` to ``most`` consumers worth laying out together, each set once: keys, members (sorted), size.

    Those of every small subtree of the network (``edges`` with ``terminals``: keys, demand_id, end_id) and, for each
    consumer (``points``: keys, demand_id, x, y), itself with its nearest. Subtrees that hold the same consumers are
    one stretch of the tree; a consumer climbs from stretch to stretch, at most ``most`` times, so no list of what is
    below a node is ever longer than a group.
    """
    keys = list(keys)
    tree = graph.parents(edges.select(*keys, "edge_id", "start_id", "end_id"), keys).select(*keys, "edge_id", "up_edge", "end_id")
    own = terminals.groupBy(*keys, "end_id").agg(F.count(F.lit(1)).alias("n"))
    counted = fold_subtrees(tree.join(own, keys + ["end_id"], "left").fillna(0, ["n"]), keys, "edge_id", "up_edge", sums=["n"])
    small = cut(tree.join(counted.filter((F.col("n") >= 1) & (F.col("n") <= most)), keys + ["edge_id"]))
    above = small.select(*keys, F.col("edge_id").alias("up_edge"), F.col("n").alias("up_n"))
    placed = cut(small.join(above, keys + ["up_edge"], "left").withColumn("same", F.when(F.col("up_n") == F.col("n"), F.col("up_edge"))))
    tops = cut(climb(placed, keys, "edge_id", "same").filter("status = 'ok'").select(*keys, "edge_id", F.col("top").alias("stretch")))
    exits = placed.filter("up_n > n").select(*keys, F.col("edge_id").alias("stretch"), F.col("up_edge").alias("edge_id"))
    onward = cut(exits.join(tops.withColumnRenamed("stretch", "next"), keys + ["edge_id"]).select(*keys, "stretch", "next"))
    front = terminals.join(placed.select(*keys, "edge_id", "end_id"), keys + ["end_id"]).join(tops, keys + ["edge_id"]).select(*keys, "demand_id", "stretch")
    members = front
    for _ in range(most - 1):
        front = front.join(onward, keys + ["stretch"]).select(*keys, "demand_id", F.col("next").alias("stretch"))
        members = members.unionByName(front)
    subtrees = members.groupBy(*keys, "stretch").agg(F.sort_array(F.collect_set("demand_id")).alias("members")).drop("stretch")
    spots = spatial.as_points(points.select(*keys, "demand_id", "x", "y"))
    near = spatial.nearest(spots, spots.withColumnRenamed("demand_id", "other_id"), most, "demand_id", "other_id", keys)
    lists = near.groupBy(*keys, "a_demand_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "b_other_id"))), lambda s: s["b_other_id"]).alias("l"))
    sizes = F.explode(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(F.size("l") >= k, F.sort_array(F.slice("l", 1, k)))))
    both = subtrees.unionByName(lists.select(*keys, sizes.alias("members")).filter("members IS NOT NULL"))
    return both.filter((F.size("members") >= least) & (F.size("members") <= most)).distinct().withColumn("size", F.size("members"))
