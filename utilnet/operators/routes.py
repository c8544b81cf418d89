"""Why a pipe is not straight: the chord between its ends held against every rule.

The chord is laid as if it were the pipe, with the pipe's size, and the same rule operators judge it as judge
built pipes. Nothing here says that a detour is needed as a whole; a pipe with bends whose chord breaks no
rule is told apart (NOT_PROVEN).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.functions import geo, rules
from utilnet.operators import entries, evaluate, passages, spatial
from utilnet.session import cut

KEYS = ("dataset_id",)
NEAR_END = 0.01  # m from a node within which another pipe may touch
#: Reasons from the gravest to the mildest; the first one found is the one to show.
PRECEDENCE = ["BUILDING_INTERSECTION", "BUILDING_ENTRY_INVALID", "BUILDING_ENTRY_WALL", "CLEARANCE", "ENTRY_ANGLE",
              "CROSSES_BRANCH", "NOT_PROVEN"]


def chords(edges: DataFrame) -> DataFrame:
    """The edges with two-point paths and their straight length; coincident ends leave no chord."""
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    straight = geo.distance(first["x"], first["y"], last["x"], last["y"])
    return edges.withColumn("length", straight).withColumn("path", F.array(first, last)).filter("length > 1e-8")


def branch_crossings(chord: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Other pipes that a chord would cross, or run along, away from its own ends: keys, edge_id, object_id."""
    keys = list(keys)
    own = cut(geo.explode_segments(chord.select(*keys, "edge_id", "path")))
    others = cut(geo.explode_segments(edges.select(*keys, F.col("edge_id").alias("object_id"), "path")))
    size = chord.select(*keys, "edge_id", "length")
    hits = spatial.line_hits(own, others, keys=keys).filter("edge_id <> object_id").join(size, keys + ["edge_id"])
    inner = (F.col("at") > NEAR_END) & (F.col("length") - F.col("at") > NEAR_END)
    return hits.filter(inner | F.col("parallel")).select(*keys, "edge_id", "object_id").distinct()


def received_axes(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The heading of the pipe that each edge starts from: keys, edge_id, axis."""
    keys = list(keys)
    a, b = F.element_at("path", -2), F.element_at("path", -1)
    last = edges.select(*keys, F.col("end_id").alias("start_id"), geo.bearing(a["x"], a["y"], b["x"], b["y"]).alias("axis"))
    return edges.select(*keys, "edge_id", "start_id").join(last, keys + ["start_id"]).select(*keys, "edge_id", "axis")


def chord_reasons(edges: DataFrame, hard: DataFrame, soft: DataFrame | None = None, owners: DataFrame | None = None,
                  assigned: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rules that the chords of pipes would break: keys, edge_id, object_id, code.

    ``edges``: keys, edge_id, start_id, end_id, path, dn. ``hard`` and ``soft`` are rings with their rule;
    ``owners`` (keys, edge_id, building_id) names the building that a pipe serves, which its last leg may
    enter. Any angle to the receiving pipe is allowed, so a joint is no reason.
    """
    keys = list(keys)
    chord = cut(chords(edges))
    segments = cut(geo.explode_segments(chord.select(*keys, "edge_id", "path")))
    name = [*keys, "edge_id", "object_id", "code"]
    parts, kept = [], None
    if owners is not None:
        houses = hard.filter("rule = 'oks'")
        doors = cut(entries.entry_portals(chord, owners, houses, keys))
        wrong = cut(entries.entry_violations(chord, segments, houses, doors, assigned, keys).select(*name))
        approach = F.greatest(F.lit(0.0), F.col("length") - rules.approach_length(F.col("dn")) - F.coalesce("indoor", F.lit(0.0)))
        kept = owners.join(chord.select(*keys, "edge_id", "length", "dn"), keys + ["edge_id"]).join(
            doors.select(*keys, "edge_id", "indoor"), keys + ["edge_id"], "left").select(
            *keys, "edge_id", F.col("building_id").alias("object_id"), F.lit(0.0).alias("keep_from"), approach.alias("keep_to"))
        near = passages.hard_clearance(chord, segments, hard, kept, keys).select(*name)
        # What is inside a building is not also too near to it.
        parts += [wrong, near.join(wrong.select(*keys, "edge_id", "object_id"), keys + ["edge_id", "object_id"], "left_anti")]
    else:
        parts.append(passages.hard_clearance(chord, segments, hard, None, keys).select(*name))
    if soft is not None:
        found = passages.passages(chord, segments, soft, None, keys=keys)
        parts.append(passages.steep_entries(found, chord, soft, keys).select(*name))
    parts.append(branch_crossings(chord, edges, keys).withColumn("code", F.lit("CROSSES_BRANCH")).select(*name))
    text = [df.withColumn("object_id", F.col("object_id").cast("string")) for df in parts]
    return reduce(DataFrame.unionByName, text).distinct()


def explain_routes(edges: DataFrame, reasons: DataFrame, axes: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row a pipe: length, straight length, detour, bends and joint with their penalties, and why it is not straight.

    ``first_reason`` is the gravest code, ``reasons`` counts them all. A straight pipe may have reasons too:
    it breaks rules as built. ``axes`` (keys, edge_id, axis) adds what pipes on the old network start from.
    """
    keys = list(keys)
    edge = [*keys, "edge_id"]
    rank = F.array_position(F.array(*[F.lit(c) for c in PRECEDENCE]), F.col("code"))
    told = reasons.groupBy(*edge).agg(F.min(F.struct(rank.alias("r"), "code")).alias("_first"), F.count(F.lit(1)).alias("reasons"))
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    own = received_axes(edges, keys)
    second = F.element_at("path", 2)
    joint = geo.turn_penalty(geo.joint_angle(geo.bearing(first["x"], first["y"], second["x"], second["y"]), F.col("axis")))
    joints = edges.join(own if axes is None else own.unionByName(axes.select(own.columns)), edge).select(*edge, joint.alias("joint_metres"))
    rows = edges.select(*edge, F.size("path").alias("_n"), geo.path_length(F.col("path")).alias("length"),
                        geo.distance(first["x"], first["y"], last["x"], last["y"]).alias("straight"), "path")
    bends = passages.bends(geo.explode_segments(rows.select(*edge, "path")), keys).withColumn("joint", F.lit(False))
    stats = evaluate.turn_stats(bends.select(*edge, "angle", "joint"), edge).select(*edge, "bends", "turns_45", "turns_90", "turns_135", "turn_metres")
    out = rows.drop("path").join(stats, edge, "left").join(told, edge, "left").join(joints, edge, "left")
    unproven = F.when((F.col("_n") > 2) & F.col("_first").isNull(), "NOT_PROVEN")
    return out.select(*edge, "length", "straight", F.greatest(F.lit(0.0), F.col("length") - F.col("straight")).alias("detour"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bends", "turns_45", "turns_90", "turns_135")],
                      *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("turn_metres", "joint_metres")],
                      F.coalesce(F.col("_first.code"), unproven).alias("first_reason"),
                      F.coalesce("reasons", F.lit(0)).cast("long").alias("reasons"))
