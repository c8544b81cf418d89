"""Comparing stored networks and choosing among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilnet.functions import geo
from utilnet.operators import spatial
from utilnet.operators.ordering import top_k
from utilnet.session import cut

KEYS = ("dataset_id",)
SLICE, CORRIDOR = 12.0, 6.0


def outside_share(edges: DataFrame, segments: DataFrame, pairs: DataFrame,
                  keys: Sequence[str] = KEYS, step: float = SLICE,
                  radius: float = CORRIDOR) -> DataFrame:
    """Share of network a's length that lies farther than the radius from network b.

    ``pairs``: keys, a, b (network ids, both directions if both are wanted). Each edge of a is cut into equal slices
    no longer than the step, which count by their midpoints. Edges meet the segments of b as wholes and are sliced
    behind the join, so what is shuffled are edges and the numbers of their near slices, never the slices themselves.
    """
    keys = list(keys)
    edge = [*keys, "network_id", "b", "edge_id"]
    bent = "path" in edges.columns
    shape = ["path"] if bent else ["x0", "y0", "x1", "y1"]
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / step).cast("int"))
    rows = cut(edges.select(*keys, "network_id", "edge_id", "length", n.alias("n"), *shape).join(
        pairs.select(*keys, F.col("a").alias("network_id"), "b"), keys + ["network_id"]))
    if bent:
        boxed = rows.select("*", F.array_min("path.x").alias("minx"), F.array_min("path.y").alias("miny"),
                            F.array_max("path.x").alias("maxx"), F.array_max("path.y").alias("maxy"))
    else:
        boxed = geo.with_box(rows)
    other = segments.select(*keys, F.col("network_id").alias("b"), *[c for c in (
        "x0", "y0", "x1", "y1", *spatial.BOX)])
    wall = [F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]
    met = spatial.bbox_join(boxed, other, radius, keys=[*keys, "b"])
    if not bent:
        # A midpoint lies on its edge; the slack covers the rounding of its place.
        leg = [F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")]
        met = geo.once(met, "_apart", geo.segment_distance(*leg, *wall)).filter(F.col("_apart") <= radius * (1 + 1e-6) + 1e-6)
    slices = met.select("*", F.explode(F.sequence(F.lit(0), F.col("a_n") - 1)).alias("slice"))
    at = (F.col("slice") + 0.5) / F.col("a_n")
    if bent:
        spot = geo.once(slices, "_p", geo.point_at(F.col("a_path"), at * F.col("a_length")))
        x, y = F.col("_p.x"), F.col("_p.y")
    else:
        spot = slices
        x = F.col("a_x0") + at * (F.col("a_x1") - F.col("a_x0"))
        y = F.col("a_y0") + at * (F.col("a_y1") - F.col("a_y0"))
    near = geo.once(spot, "_off", geo.point_segment_distance(x, y, *wall)).filter(F.col("_off") <= radius).groupBy(
        *keys, F.col("a_network_id").alias("network_id"), "b", F.col("a_edge_id").alias("edge_id")).agg(
        F.size(F.collect_set("slice")).alias("_near"))
    marked = rows.select(*edge, "length", "n").join(near, edge, "left").fillna(0, ["_near"])
    out = F.col("length") * (F.col("n") - F.col("_near")) / F.col("n")
    return marked.groupBy(*keys, F.col("network_id").alias("a"), "b").agg(
        F.sum("length").alias("_total"), F.sum(out).alias("_out")).select(
        *keys, "a", "b", F.when(F.col("_total") < 1e-6, 0.0).otherwise(F.col("_out") / F.col("_total"))
        .alias("outside"))


def route_difference(edges: DataFrame, segments: DataFrame, pairs: DataFrame,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Larger of the two outside shares per unordered pair (a < b)."""
    keys = list(keys)
    both = pairs.select(*keys, "a", "b").unionByName(
        pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    share = outside_share(edges, segments, both, keys)
    return share.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max("outside").alias("difference"))


def same_sets(members: DataFrame, pairs: DataFrame, value: Sequence[str],
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether networks a and b have equal sets: no member of either is missing in the other.

    ``members``: keys, network_id and the value columns. Rows are matched by hash join, so sets of
    any size compare without being gathered.
    """
    keys, value = list(keys), list(value)
    rows = members.select(*keys, "network_id", *value).distinct()
    left = pairs.join(rows.withColumnRenamed("network_id", "a"), keys + ["a"]).withColumn("_l", F.lit(1))
    right = pairs.join(rows.withColumnRenamed("network_id", "b"), keys + ["b"]).withColumn("_r", F.lit(1))
    odd = left.join(right, keys + ["a", "b", *value], "full").filter(
        "_l IS NULL OR _r IS NULL").select(*keys, "a", "b").distinct().withColumn("_odd", F.lit(True))
    return pairs.join(odd, keys + ["a", "b"], "left").select(
        *keys, "a", "b", F.col("_odd").isNull().alias("equal"))


def structural_difference(roots: DataFrame, groups: DataFrame, pairs: DataFrame,
                          keys: Sequence[str] = KEYS) -> DataFrame:
    """Other tie objects or other branch groups. ``roots``: keys, network_id, existing_id;
    ``groups``: keys, network_id, n, last_id, digest_a, digest_b."""
    keys = list(keys)
    ties = same_sets(roots, pairs, ["existing_id"], keys).withColumnRenamed("equal", "_ties")
    branch = same_sets(groups, pairs, ["n", "last_id", "digest_a", "digest_b"], keys)
    return ties.join(branch, keys + ["a", "b"]).select(
        *keys, "a", "b", (~(F.col("_ties") & F.col("equal"))).alias("structural"))


def distinct_from(difference: Column, structural: Column) -> Column:
    return (difference >= 0.06) | ((difference >= 0.03) & structural)


def improved(value: Column, base: Column) -> Column:
    return value < base - F.greatest(F.lit(0.001), base * 0.005)


def same_network(summary: DataFrame, edges: DataFrame, segments: DataFrame, pairs: DataFrame,
                 roots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal counts, roots under 2 m apart on one object, and each network within 2 m of the other.

    The 2 m corridor is probed every 25 cm along both networks, a stated approximation.
    ``summary``: keys, network_id, demand_digest, root_count, edge_count.
    """
    keys = list(keys)
    facts = ["demand_digest", "root_count", "edge_count"]
    left = summary.select(*keys, F.col("network_id").alias("a"), *facts)
    right = summary.select(*keys, F.col("network_id").alias("b"), *[F.col(f).alias(f"_{f}") for f in facts])
    alike = pairs.join(left, keys + ["a"]).join(right, keys + ["b"])
    ok = F.lit(True)
    for f in facts:
        ok = ok & F.col(f).eqNullSafe(F.col(f"_{f}"))
    alike = cut(alike.filter(ok).select(*keys, "a", "b"))
    mine = alike.join(roots.select(*keys, F.col("network_id").alias("a"), "root_id", "existing_id", "x", "y"),
                      keys + ["a"])
    theirs = roots.select(*keys, F.col("network_id").alias("b"), "existing_id", F.col("x").alias("x2"),
                          F.col("y").alias("y2"))
    d = geo.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    matched = mine.join(theirs, keys + ["b", "existing_id"]).filter(d < 2).select(
        *keys, "a", "b", "root_id").distinct()
    lonely = mine.join(matched, keys + ["a", "b", "root_id"], "left_anti").select(*keys, "a", "b").distinct()
    both = alike.unionByName(alike.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    share = outside_share(edges, segments, both, keys, 0.25, 2.0)
    far = share.filter("outside > 0").select(
        *keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    same = alike.join(lonely, keys + ["a", "b"], "left_anti").join(far, keys + ["a", "b"], "left_anti")
    return pairs.join(same.withColumn("_same", F.lit(True)), keys + ["a", "b"], "left").select(
        *keys, "a", "b", F.col("_same").isNotNull().alias("same"))


def choose_variants(summary: DataFrame, pairs: DataFrame, limit: int = 3,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Balanced, earthworks and installation variants per dataset.

    ``summary``: keys, network_id, score, earthwork_index, installation_index. ``pairs``: keys, a, b
    (a < b), difference, structural. Of all earthworks candidates the first that leaves room for an
    installation variant wins, true trade-offs before the rest; without one, the first candidate.
    """
    keys = list(keys)
    s = summary.select(*keys, "network_id", "score", "earthwork_index", "installation_index")
    balanced = top_k(s, keys, ["score", "network_id"], 1).drop("rank")
    roles = balanced.select(*keys, "network_id", F.lit("balanced").alias("role"))
    if limit == 1:
        return roles
    apart = pairs.filter(distinct_from(F.col("difference"), F.col("structural"))).select(*keys, "a", "b")
    apart = cut(apart.unionByName(apart.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    base = balanced.select(*keys, F.col("network_id").alias("_b"), F.col("earthwork_index").alias("_be"),
                           F.col("installation_index").alias("_bi"))
    far = s.join(base, keys).filter(F.col("network_id") != F.col("_b")).join(
        apart.select(*keys, F.col("a").alias("network_id"), F.col("b").alias("_b")), keys + ["network_id", "_b"],
        "left_semi")
    earth = cut(far.filter(improved(F.col("earthwork_index"), F.col("_be"))).select(
        *keys, F.col("network_id").alias("e"), F.col("earthwork_index").alias("ee"),
        F.col("installation_index").alias("ei"), F.col("score").alias("es")))
    chosen = top_k(earth, keys, ["ee", "es", "e"], 1).select(
        *keys, "e", F.lit(None).cast(summary.schema["network_id"].dataType).alias("i"))
    if limit > 2:
        install = far.filter(improved(F.col("installation_index"), F.col("_bi"))).select(
            *keys, F.col("network_id").alias("i"), F.col("earthwork_index").alias("ie"),
            F.col("installation_index").alias("ii"), F.col("score").alias("isc"))
        # Partners come from the list of distinct pairs, not from all pairs of a dataset.
        triples = (earth.join(apart.select(*keys, F.col("a").alias("e"), F.col("b").alias("i")), keys + ["e"])
                   .join(install, keys + ["i"]).filter(improved(F.col("ii"), F.col("ei")))
                   .withColumn("tradeoff", improved(F.col("ee"), F.col("ie"))))
        best = top_k(triples.withColumn("_t", F.when(F.col("tradeoff"), 0).otherwise(1)), keys,
                     ["_t", "ee", "es", "e", "ii", "isc", "i"], 1).select(*keys, "e", "i")
        chosen = best.unionByName(chosen.join(best, keys, "left_anti"))
    picked = chosen.select(*keys, F.explode(F.array(
        F.struct(F.col("e").alias("network_id"), F.lit("earthworks").alias("role")),
        F.struct(F.col("i").alias("network_id"), F.lit("installation").alias("role")))).alias("_r")).select(
        *keys, "_r.*").filter("network_id IS NOT NULL")
    return roles.unionByName(picked)


def audit_variants(summary: DataFrame, roles: DataFrame, pairs: DataFrame,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Roles unique, chosen networks 6 % apart, role metrics really better: one row per failure."""
    keys = list(keys)
    twice = roles.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *keys, F.col("role").alias("object_id"), F.lit("ROLE_TWICE").alias("code"))
    mine = roles.select(*keys, F.col("network_id").alias("a"))
    close = (pairs.join(mine, keys + ["a"]).join(mine.withColumnRenamed("a", "b"), keys + ["b"])
             .filter("difference < 0.06").select(*keys, F.concat_ws("-", "a", "b").alias("object_id"),
                                                 F.lit("TOO_CLOSE").alias("code")))
    values = roles.join(summary, keys + ["network_id"])
    base = values.filter("role = 'balanced'").select(*keys, F.col("earthwork_index").alias("_be"),
                                                     F.col("installation_index").alias("_bi"))
    worse = values.join(base, keys).filter(
        ((F.col("role") == "earthworks") & ~(F.col("earthwork_index") < F.col("_be") * 0.995))
        | ((F.col("role") == "installation") & ~(F.col("installation_index") < F.col("_bi") * 0.995)))
    return twice.unionByName(close).unionByName(worse.select(
        *keys, F.col("role").alias("object_id"), F.lit("NOT_BETTER").alias("code")))


def compare_runs(before: DataFrame, after: DataFrame, keys: Sequence[str],
                 metrics: Sequence[str]) -> DataFrame:
    """Metric changes between two runs with equal options and input; unmatched rows are marked."""
    a = before.select(*keys, *[F.col(m).alias(f"before_{m}") for m in metrics], F.lit(True).alias("_a"))
    b = after.select(*keys, *[F.col(m).alias(f"after_{m}") for m in metrics], F.lit(True).alias("_b"))
    return a.join(b, list(keys), "full").select(
        *keys, *[(F.col(f"after_{m}") - F.col(f"before_{m}")).alias(f"delta_{m}") for m in metrics],
        F.when(F.col("_a").isNull(), "only_after").when(F.col("_b").isNull(), "only_before")
         .otherwise("both").alias("presence"))


def recheck(current: DataFrame, prior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored networks whose score moved by more than 1e-6 under current data."""
    old = prior.select(*keys, F.col("score").alias("stored_score"))
    return current.select(*keys, "score").join(old, list(keys)).withColumn(
        "delta", F.col("score") - F.col("stored_score")).filter(F.abs("delta") > 1e-6)


def tree_signature(edges: DataFrame, terminals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free signature of a network's geometry and terminals: counts and two digest sums."""
    parts = edges.select(*keys, F.col("part")).unionByName(terminals.select(*keys, F.col("part")))
    md = F.md5("part")
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum(F.conv(F.substring(md, 1, 8), 16, 10).cast("long")).alias("digest_a"),
        F.sum(F.conv(F.substring(md, 9, 8), 16, 10).cast("long")).alias("digest_b"))
