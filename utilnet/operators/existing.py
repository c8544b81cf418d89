"""The network that is already in the ground: references, orientation, reconstruction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators import spatial
from utilnet.operators.kernels import climb, components, fold_subtrees, running
from utilnet.session import cut

KEYS = ("dataset_id",)
CARRIERS = ["heat_network", "heat_chamber"]


def dangling_refs(objects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Objects whose upstream reference names nothing in the dataset."""
    known = objects.select(*keys, F.col("object_id").alias("upstream_id"))
    return (objects.filter("upstream_id IS NOT NULL").join(known, [*keys, "upstream_id"], "left_anti")
            .select(*keys, "object_id", "upstream_id", F.lit("UNKNOWN_UPSTREAM").alias("code")))


def upstream_violations(objects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pipes and chambers whose chain of references does not end at the source."""
    keys = list(keys)
    linked = objects.filter(F.col("object_type").isin(*CARRIERS, "source")).withColumn(
        "_up", F.when(F.col("object_type") != "source", F.col("upstream_id")))
    tops = climb(linked, keys, "object_id", "_up")
    kinds = objects.select(*keys, F.col("object_id").alias("top"), F.col("object_type").alias("_kind"))
    judged = tops.join(kinds, keys + ["top"], "left")
    code = (F.when(F.col("status") == "cycle", "CYCLE")
            .when(F.col("_kind").isNull(), "MISSING_TARGET")
            .when(F.col("_kind") != "source", F.when(F.col("status") == "dangling", "WRONG_TARGET")
                  .otherwise("NO_UPSTREAM")))
    return judged.withColumn("code", code).filter("code IS NOT NULL").select(
        *keys, "object_id", "code")


def effective_pipe(objects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The pipe each object hangs on, chambers skipped; NULL when the source comes first."""
    keys = list(keys)
    kinds = objects.select(*keys, F.col("object_id").alias("upstream_id"),
                           F.col("object_type").alias("_up_kind"))
    placed = objects.filter("object_type <> 'source'").join(kinds, keys + ["upstream_id"], "left")
    # A chamber passes its own upstream object on; everything else is where the walk stops.
    chambers = placed.filter("object_type = 'heat_chamber'").select(
        *keys, "object_id", F.when(F.col("_up_kind") == "heat_chamber", F.col("upstream_id"))
        .alias("_next"))
    last = climb(chambers, keys, "object_id", "_next").filter("status = 'ok'").select(
        *keys, F.col("object_id").alias("_chamber"), F.col("top").alias("_last"))
    final = placed.filter("object_type = 'heat_chamber'").select(
        *keys, F.col("object_id").alias("_last"), F.col("upstream_id").alias("_beyond"),
        F.col("_up_kind").alias("_beyond_kind"))
    reach = last.join(final, keys + ["_last"])
    own = placed.filter("_up_kind IS NULL OR _up_kind <> 'heat_chamber'").select(
        *keys, "object_id", F.when(F.col("_up_kind") == "heat_network", F.col("upstream_id"))
        .alias("pipe_id"))
    through = placed.filter("_up_kind = 'heat_chamber'").join(
        reach, (placed["upstream_id"] == reach["_chamber"])
        & _same(placed, reach, keys), "left").select(
        *[placed[k] for k in keys], placed["object_id"],
        F.when(F.col("_beyond_kind") == "heat_network", F.col("_beyond")).alias("pipe_id"))
    return own.unionByName(through)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def dn_monotone(objects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pipes that are wider than the pipe they hang on."""
    keys = list(keys)
    above = objects.select(*keys, F.col("object_id").alias("pipe_id"), F.col("dn").alias("up_dn"))
    return (objects.filter("object_type = 'heat_network'").select(*keys, "object_id", "dn")
            .join(effective_pipe(objects, keys), keys + ["object_id"])
            .join(above, keys + ["pipe_id"]).filter("up_dn < dn")
            .select(*keys, "object_id", "pipe_id", F.lit("DN_SHRINKS").alias("code")))


def inference_notes(objects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pipes with a known parent and how many of those parents are thinner."""
    keys = list(keys)
    above = objects.select(*keys, F.col("object_id").alias("upstream_id"), F.col("dn").alias("up_dn"),
                           F.col("object_type").alias("up_type"))
    rows = objects.filter("object_type = 'heat_network'").join(above, keys + ["upstream_id"])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inferred"),
        F.count(F.when((F.col("up_type") == "heat_network") & (F.col("up_dn") < F.col("dn")), 1))
        .alias("transitions"))


def cluster_endpoints(ends: DataFrame, keys: Sequence[str] = KEYS,
                      tolerance: float = rules.SNAP) -> DataFrame:
    """Vertices: points (keys, end_id, x, y) linked within the tolerance, by smallest end id.

    Ends at one position are one node, so that many pipes ending together are never paired.
    """
    keys = list(keys)
    pts = cut(ends.select(*keys, "end_id", "x", "y"))
    spots = cut(pts.groupBy(*keys, "x", "y").agg(F.min("end_id").alias("end_id")))
    near = spatial.within(spatial.as_points(spots), spatial.as_points(spots), tolerance, "end_id",
                          "end_id", keys, cell=4 * tolerance, sizes=(0.0, 0.0)).filter("a_end_id < b_end_id")
    labels = components(spots, near.select(*keys, F.col("a_end_id").alias("a"),
                                           F.col("b_end_id").alias("b")), keys, "end_id")
    vertices = spots.join(labels, keys + ["end_id"]).select(*keys, "x", "y", F.col("label").alias("vertex_id"))
    return pts.join(vertices, keys + ["x", "y"]).select(*keys, "end_id", "x", "y", "vertex_id")


def ambiguous_clusters(clustered: DataFrame, keys: Sequence[str] = KEYS,
                       tolerance: float = rules.SNAP) -> DataFrame:
    """Vertices with two members farther apart than the tolerance.

    A cluster whose box has a side longer than the tolerance is ambiguous at once, and one whose
    box has a diagonal within it never is. Only the distinct positions of the clusters in between
    are compared, and those lie in a quarter-metre square.
    """
    keys = list(keys)
    box = clustered.groupBy(*keys, "vertex_id").agg(
        F.count(F.lit(1)).alias("members"),
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    wide = box.filter((F.col("w") > tolerance + 1e-8) | (F.col("h") > tolerance + 1e-8))
    unsure = box.filter((F.col("w") <= tolerance + 1e-8) & (F.col("h") <= tolerance + 1e-8)
                        & (F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")) > tolerance + 1e-8))
    # Distinct positions only: copies of one point add nothing to the spread.
    spots = clustered.join(unsure.select(*keys, "vertex_id"), keys + ["vertex_id"], "left_semi")
    spots = spots.select(*keys, "vertex_id", "x", "y").distinct()
    other = spots.select(*keys, "vertex_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    far = (spots.join(other, keys + ["vertex_id"]).filter(d > tolerance + 1e-8)
           .select(*keys, "vertex_id").distinct())
    return wide.select(*keys, "vertex_id").unionByName(far).withColumn(
        "code", F.lit("AMBIGUOUS_CLUSTER"))


def cluster_conflicts(clustered: DataFrame, ends: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chambers or the source sharing a vertex, and pipes whose two ends fell together.

    ``ends``: keys, end_id, object_id, object_type.
    """
    keys = list(keys)
    placed = ends.join(clustered.select(*keys, "end_id", "vertex_id"), keys + ["end_id"])
    shared = (placed.filter(F.col("object_type").isin("heat_chamber", "source"))
              .groupBy(*keys, "vertex_id").agg(F.count(F.lit(1)).alias("n"),
                                               F.min("object_id").alias("object_id"))
              .filter("n > 1").select(*keys, "object_id", F.lit("COINCIDING_NODES").alias("code")))
    loops = (placed.filter("object_type = 'heat_network'").groupBy(*keys, "object_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vertex_id").alias("v"))
        .filter("n > 1 AND v = 1").select(*keys, "object_id", F.lit("LOOP_OR_SHORT").alias("code")))
    return shared.unionByName(loops)


def infer_upstream(lines: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS
                   ) -> tuple[DataFrame, DataFrame]:
    """Orient the network away from its source by breadth-first rounds over vertices.

    ``lines``: keys, object_id, dn, va, vb (vertices of the two ends). ``points``: keys,
    object_id, object_type (heat_chamber or source), vertex_id. Each round extends the frontier of
    all datasets by one pipe. Returns (objects with upstream_id and dn, violations).
    """
    keys = list(keys)
    both = cut(lines.select(*keys, "object_id", F.col("va").alias("at"), F.col("vb").alias("to"))
               .unionByName(lines.select(*keys, "object_id", F.col("vb").alias("at"),
                                         F.col("va").alias("to"))))
    at_vertex = points.groupBy(*keys, "vertex_id").agg(F.min("object_id").alias("node_object"))
    front = cut(points.filter("object_type = 'source'").select(
        *keys, F.col("vertex_id").alias("at"), F.lit(None).cast(
            lines.schema["object_id"].dataType).alias("parent_pipe")))
    # A step from one distance leads to the same distance or to its neighbours, so only the last
    # two frontiers can have been reached before.
    last, seen = front, front.select(*keys, "at")
    vertex_parent = front
    while True:
        # The pipe that led here is not walked back.
        steps = front.join(both, keys + ["at"]).filter(
            ~F.col("object_id").eqNullSafe(F.col("parent_pipe")))
        reached = steps.groupBy(*keys, F.col("to").alias("at")).agg(
            F.min("object_id").alias("parent_pipe"), F.count(F.lit(1)).alias("ways"))
        fresh = cut(reached.join(seen, keys + ["at"], "left_anti"))
        if fresh.isEmpty():
            break
        front = fresh.select(*keys, "at", "parent_pipe")
        vertex_parent = vertex_parent.unionByName(front)
        last, seen = front, last.select(*keys, "at").unionByName(front.select(*keys, "at"))
    parent = cut(vertex_parent)
    tree = parent.select(*keys, F.col("parent_pipe").alias("object_id")).filter("object_id IS NOT NULL")
    in_reach = both.join(parent.select(*keys, "at"), keys + ["at"], "left_semi").select(
        *keys, "object_id").distinct()
    rings = in_reach.join(tree, keys + ["object_id"], "left_anti").withColumn("code", F.lit("RING"))
    far = lines.select(*keys, "object_id").join(in_reach, keys + ["object_id"], "left_anti").withColumn(
        "code", F.lit("UNREACHABLE_PIPE"))
    lost = (points.filter("object_type = 'heat_chamber'").select(
        *keys, "object_id", F.col("vertex_id").alias("at"))
        .join(parent.select(*keys, "at"), keys + ["at"], "left_anti")
        .select(*keys, "object_id", F.lit("UNREACHABLE_CHAMBER").alias("code")))
    # A pipe hangs on the object at its near vertex, or on the pipe that reached that vertex.
    child = parent.select(*keys, F.col("at").alias("to"), F.col("parent_pipe").alias("object_id"))
    near = both.join(child.filter("object_id IS NOT NULL"), keys + ["object_id", "to"])
    near = (near.join(parent, keys + ["at"])
            .join(at_vertex.withColumnRenamed("vertex_id", "at"), keys + ["at"], "left")
            .select(*keys, "object_id", F.coalesce("node_object", "parent_pipe").alias("upstream_id")))
    pipe_dn = both.join(lines.select(*keys, "object_id", "dn"), keys + ["object_id"])
    widest = pipe_dn.groupBy(*keys, "at").agg(F.max("dn").alias("dn"))
    chambers = (points.filter("object_type = 'heat_chamber'").select(
        *keys, "object_id", F.col("vertex_id").alias("at"))
        .join(parent, keys + ["at"]).join(widest, keys + ["at"], "left")
        .select(*keys, "object_id", F.lit("heat_chamber").alias("object_type"),
                F.col("parent_pipe").alias("upstream_id"), "dn"))
    pipes = near.join(lines.select(*keys, "object_id", "dn"), keys + ["object_id"]).select(
        *keys, "object_id", F.lit("heat_network").alias("object_type"), "upstream_id", "dn")
    violations = rings.unionByName(far).unionByName(lost)
    if "declared_id" in lines.columns:
        clash = (near.join(lines.select(*keys, "object_id", "declared_id"), keys + ["object_id"])
                 .filter("declared_id IS NOT NULL AND declared_id <> upstream_id")
                 .select(*keys, "object_id", F.lit("CONTRADICTS_DECLARED").alias("code")))
        violations = violations.unionByName(clash)
    return pipes.unionByName(chambers), violations


def chamber_diameters(chambers: DataFrame, pipe_ends: DataFrame,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Widest pipe ending within 25 cm of each chamber, and how many end there.

    ``pipe_ends``: keys, object_id, end, x, y, dn. A chamber with no pipe gets NULL.
    """
    keys = list(keys)
    near = spatial.bbox_join(spatial.as_points(chambers.select(*keys, "object_id", "x", "y")),
                             spatial.as_points(pipe_ends), rules.SNAP, cell=8.0, keys=keys)
    d = F.sqrt((F.col("a_x0") - F.col("b_x0")) ** 2 + (F.col("a_y0") - F.col("b_y0")) ** 2)
    found = near.filter(d <= rules.SNAP).groupBy(
        *keys, F.col("a_object_id").alias("object_id")).agg(
        F.max("b_dn").alias("chamber_dn"), F.countDistinct("b_object_id").alias("degree"))
    return chambers.join(found, keys + ["object_id"], "left").select(
        *keys, "object_id", "chamber_dn", F.coalesce("degree", F.lit(0)).alias("degree"))


def reconstruction(objects: DataFrame, ties: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pieces of old pipe that need a larger diameter once the new flow is added.

    ``objects``: keys, object_id, object_type, upstream_id, dn, flow, length, start_near (true when
    the pipe's first vertex is the end nearer to its upstream object). ``ties``: keys, root_id,
    existing_id, at (measure on the pipe; NULL on a chamber), flow. A pipe carries in full what is
    tied in below it, which is a subtree total; what is tied to the pipe itself covers the stretch
    from the tie to the upstream end. A piece that no diameter can carry (CAPACITY_EXCEEDED) or whose
    old flow is not known (UNKNOWN_FLOW) has a code and no size or cost. Prefix sums over the stretch
    ends give the added flow.
    """
    keys = list(keys)
    tied = ties.groupBy(*keys, F.col("existing_id").alias("object_id")).agg(
        F.sum("flow").alias("_tied"))
    carried = objects.filter("object_type <> 'source'").join(tied, keys + ["object_id"], "left").select(
        *keys, "object_id", F.when(F.col("upstream_id").isNotNull(), F.col("upstream_id")).alias("_up"),
        F.coalesce("_tied", F.lit(0.0)).alias("_below"), F.coalesce("_tied", F.lit(0.0)).alias("_own"))
    known = carried.select(*keys, F.col("object_id").alias("_up"), F.lit(True).alias("_known"))
    carried = carried.join(known, keys + ["_up"], "left").withColumn(
        "_up", F.when(F.col("_known"), F.col("_up"))).drop("_known")
    total = fold_subtrees(carried, keys, "object_id", "_up", sums=["_below"])
    pipes = objects.filter("object_type = 'heat_network'")
    whole = (pipes.join(total, keys + ["object_id"]).join(tied, keys + ["object_id"], "left")
             .withColumn("f", F.col("_below") - F.coalesce("_tied", F.lit(0.0)))
             .filter("f > 1e-9 AND length > 1e-7")
             .select(*keys, "object_id", F.lit(0.0).alias("a"), F.col("length").alias("b"), "f"))
    own = ties.select(*keys, F.col("existing_id").alias("object_id"), "at", F.col("flow").alias("f")).join(
        pipes.select(*keys, "object_id", "length", "start_near"), keys + ["object_id"])
    own = own.select(*keys, "object_id",
                     F.when(F.col("start_near"), 0.0).otherwise(F.col("at")).alias("a"),
                     F.when(F.col("start_near"), F.col("at")).otherwise(F.col("length")).alias("b"),
                     "f").filter("b - a > 1e-7")
    spans = whole.unionByName(own)
    events = (spans.select(*keys, "object_id", F.col("a").alias("at"), "f")
              .unionByName(spans.select(*keys, "object_id", F.col("b").alias("at"),
                                        (-F.col("f")).alias("f")))
              .groupBy(*keys, "object_id", "at").agg(F.sum("f").alias("f")))
    swept = running(events, [*keys, "object_id"], ["at"], sums={"added": "f"}, lasts={"s_from": "at"})
    return (swept.filter("at - s_from > 1e-7 AND added > 1e-7")
            .join(pipes.select(*keys, "object_id", "dn", F.col("flow").alias("old_flow")),
                  keys + ["object_id"])
            .withColumn("_idx", rules.flow_index(F.col("old_flow") + F.col("added")))
            .withColumn("required_dn", rules.dn_of(F.col("_idx")))
            .filter("required_dn > dn OR required_dn IS NULL")
            .select(*keys, "object_id", "s_from", F.col("at").alias("s_to"), "added", "required_dn",
                    ((F.col("at") - F.col("s_from"))
                     * rules.price_recon(rules.dn_index(F.col("required_dn")))).alias("cost"),
                    F.when(F.col("_idx").isNull(), "UNKNOWN_FLOW").when(F.col("_idx") == rules.OVERSIZE, "CAPACITY_EXCEEDED").alias("code")))


def reconstruction_totals(pieces: DataFrame, chambers: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cost and length of reconstruction per network: keys, recon_cost, recon_length, chamber_recon_cost.

    A piece or chamber without a cost leaves its network without one: it can't be priced as if nothing
    had to be done there. A network without pieces has no row.
    """
    keys = list(keys)

    def whole(column: str):
        return F.when(F.bool_and(F.col(column).isNotNull()), F.sum(column))

    out = pieces.groupBy(*keys).agg(whole("cost").alias("recon_cost"), F.sum(F.col("s_to") - F.col("s_from")).alias("recon_length"))
    if chambers is None:
        return out.withColumn("chamber_recon_cost", F.lit(0.0))
    grown = chambers.groupBy(*keys).agg(whole("cost").alias("chamber_recon_cost"), F.lit(True).alias("_any"))
    return out.join(grown, keys, "full").select(
        *keys, F.when(F.col("recon_length").isNull(), 0.0).otherwise(F.col("recon_cost")).alias("recon_cost"),
        F.coalesce("recon_length", F.lit(0.0)).alias("recon_length"),
        F.when(F.col("_any"), F.col("chamber_recon_cost")).otherwise(0.0).alias("chamber_recon_cost"))


def chamber_reconstruction(chambers: DataFrame, branch_dn: DataFrame, touching: DataFrame,
                           keys: Sequence[str] = KEYS) -> DataFrame:
    """Old chambers that grow: the widest of their own, the new branches, the pieces that touch.

    ``branch_dn`` and ``touching``: keys, object_id, dn. Beside a branch or piece without a size a
    chamber has no size and no cost either.
    """
    keys = list(keys)
    offers = branch_dn.select(*keys, "object_id", F.col("dn").alias("_dn")).unionByName(
        touching.select(*keys, "object_id", F.col("dn").alias("_dn")))
    need = offers.groupBy(*keys, "object_id").agg(F.when(F.bool_and(F.col("_dn").isNotNull()), F.max("_dn")).alias("required_dn"))
    return chambers.join(need, keys + ["object_id"]).filter("required_dn > dn OR required_dn IS NULL").select(
        *keys, "object_id", "required_dn",
        F.when(F.col("required_dn").isNotNull(), rules.chamber_price(F.col("required_dn"))).alias("cost"))
