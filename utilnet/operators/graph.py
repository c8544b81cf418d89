"""Operators over directed pipe forests: validation, flow, diameters, length limits.

Tables: nodes(keys, node_id, node_type, x, y, demand), edges(keys, edge_id, edge_ord, start_id,
end_id, length). ``keys`` is the dataset alone or dataset and network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators.kernels import climb, fold_subtrees
from utilnet.session import cut

KEYS = ("dataset_id",)


def parents(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each edge with the edge above it (NULL under a root), found by the shared node."""
    above = edges.select(*keys, F.col("end_id").alias("start_id"),
                         F.col("edge_id").alias("up_edge"))
    return edges.join(above, [*keys, "start_id"], "left")


def forest_violations(nodes: DataFrame, edges: DataFrame,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows (keys, object_id, code): what keeps the network from being a rooted forest."""
    keys = list(keys)
    ids = nodes.select(*keys, "node_id", "node_type")
    ends = (edges.select(*keys, "edge_id", F.col("start_id").alias("node_id"))
            .unionByName(edges.select(*keys, "edge_id", F.col("end_id").alias("node_id"))))
    missing = (ends.join(ids, keys + ["node_id"], "left_anti")
               .select(*keys, F.col("edge_id").alias("object_id"),
                       F.lit("MISSING_NODE").alias("code")).distinct())
    incoming = edges.groupBy(*keys, F.col("end_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("start_id").alias("up"))
    several = incoming.filter("n > 1").select(
        *keys, F.col("node_id").alias("object_id"), F.lit("SEVERAL_PARENTS").alias("code"))
    placed = ids.join(incoming, keys + ["node_id"], "left")
    fed_root = placed.filter("node_type = 'tie' AND n IS NOT NULL").select(
        *keys, F.col("node_id").alias("object_id"), F.lit("ROOT_WITH_PARENT").alias("code"))
    tops = climb(placed, keys, "node_id", "up")
    cycle = tops.filter("status = 'cycle'").select(
        *keys, F.col("node_id").alias("object_id"), F.lit("CYCLE").alias("code"))
    roots = ids.filter("node_type = 'tie'").select(*keys, F.col("node_id").alias("top"))
    stray = (tops.filter("status <> 'cycle'").join(roots, keys + ["top"], "left_anti")
             .select(*keys, F.col("node_id").alias("object_id"),
                     F.lit("NO_ROOT").alias("code")))
    return (missing.unionByName(several).unionByName(fed_root)
            .unionByName(cycle).unionByName(stray))


def flows(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with the demand below them and the diameter that carries it."""
    keys = list(keys)
    demand = nodes.select(*keys, F.col("node_id").alias("end_id"),
                          F.col("demand").cast("double").alias("flow"))
    placed = parents(edges, keys).join(demand, keys + ["end_id"])
    total = fold_subtrees(placed, keys, "edge_id", "up_edge", sums=["flow"])
    return (edges.join(total, keys + ["edge_id"])
            .withColumn("dn_idx", rules.flow_index(F.col("flow")))
            .withColumn("dn", rules.dn_of(F.col("dn_idx"))).hint("merge"))


def root_of(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every node with the node its water comes from and the number of edges between."""
    keys = list(keys)
    up = edges.select(*keys, F.col("end_id").alias("node_id"), F.col("start_id").alias("up"))
    return climb(nodes.select(*keys, "node_id").join(up, keys + ["node_id"], "left"),
                 keys, "node_id", "up").withColumnRenamed("top", "root_id")


def terminals_below(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per edge the set of served terminals as size, range and digest (one row per edge)."""
    keys = list(keys)
    served = (F.col("demand") > 0)
    # Two independent 52-bit digests: equal sets agree, and chance collisions need both.
    md = F.md5(F.col("node_id").cast("string"))
    leaf = nodes.select(
        *keys, F.col("node_id").alias("end_id"), served.cast("long").alias("n"),
        F.when(served, F.col("node_id")).alias("last_id"),
        F.when(served, F.conv(F.substring(md, 1, 8), 16, 10).cast("long"))
         .otherwise(F.lit(0).cast("long")).alias("digest_a"),
        F.when(served, F.conv(F.substring(md, 9, 8), 16, 10).cast("long"))
         .otherwise(F.lit(0).cast("long")).alias("digest_b"))
    placed = parents(edges, keys).join(leaf, keys + ["end_id"])
    return fold_subtrees(placed, keys, "edge_id", "up_edge",
                         sums=["n", "digest_a", "digest_b"], maxs=["last_id"])


def branch_groups(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct terminal sets that serve more than one and fewer than all terminals."""
    keys = list(keys)
    below = terminals_below(nodes, edges, keys)
    total = nodes.groupBy(*keys).agg(F.sum((F.col("demand") > 0).cast("long")).alias("total"))
    return (below.join(total, keys).filter("n > 1 AND n < total")
            .select(*keys, "n", "last_id", "digest_a", "digest_b").distinct())


def branch_members(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same sets spelled out: one row per (edge, terminal below it), never one long array."""
    keys = list(keys)
    groups = (terminals_below(nodes, edges, keys)
              .join(nodes.groupBy(*keys).agg(
                  F.sum((F.col("demand") > 0).cast("long")).alias("total")), keys)
              .filter("n > 1 AND n < total").select(*keys, "edge_id"))
    up = parents(edges, keys).select(*keys, "edge_id", "up_edge", "end_id")
    leaf = nodes.filter("demand > 0").select(*keys, F.col("node_id").alias("end_id"))
    front = cut(up.join(leaf, keys + ["end_id"])
                .select(*keys, F.col("end_id").alias("terminal_id"), "edge_id", "up_edge"))
    step = cut(up.select(*keys, F.col("edge_id").alias("up_edge"),
                         F.col("up_edge").alias("next_up")))
    done = front.select(*keys, "terminal_id", "edge_id")
    while not (front := front.filter("up_edge IS NOT NULL")).isEmpty():
        front = cut(front.join(step, keys + ["up_edge"]).select(
            *keys, "terminal_id", F.col("up_edge").alias("edge_id"),
            F.col("next_up").alias("up_edge")))
        done = done.unionByName(front.select(*keys, "terminal_id", "edge_id"))
    return done.join(groups, keys + ["edge_id"], "left_semi")


def flow_chains(flowed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with the head of their constant-flow chain and the chain's whole length."""
    keys = list(keys)
    up = parents(flowed, keys)
    above = flowed.select(*keys, F.col("edge_id").alias("up_edge"), F.col("flow").alias("up_flow"))
    same = up.join(above, keys + ["up_edge"], "left").withColumn(
        "same_up", F.when(F.abs(F.col("flow") - F.col("up_flow")) < 1e-8, F.col("up_edge")))
    heads = climb(same, keys, "edge_id", "same_up").select(
        *keys, "edge_id", F.col("top").alias("chain_id"))
    member = cut(same.join(heads, keys + ["edge_id"]))
    size = member.groupBy(*keys, "chain_id").agg(F.sum("length").alias("chain_length"))
    return member.join(size, keys + ["chain_id"]).drop("same_up", "up_flow").hint("merge")


def chain_dn(chains: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per chain: smallest size for flow and length, and never thinner than below it."""
    keys = list(keys)
    heads = chains.filter(F.col("edge_id") == F.col("chain_id")).select(
        *keys, "chain_id", "flow", "chain_length", F.col("up_edge").alias("head_up"))
    owner = chains.select(*keys, F.col("edge_id").alias("head_up"),
                          F.col("chain_id").alias("up_chain"))
    placed = heads.join(owner, keys + ["head_up"], "left").withColumn(
        "own_idx", F.greatest(rules.flow_index(F.col("flow")),
                              rules.run_index(F.col("chain_length"))))
    folded = fold_subtrees(placed.withColumn("chain_idx", F.col("own_idx")), keys, "chain_id",
                           "up_chain", maxs=["chain_idx"])
    return placed.join(folded, keys + ["chain_id"]).select(
        *keys, "chain_id", "up_chain", "flow", "chain_length", "own_idx", "chain_idx")


def path_runs(sized: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges (with dn_idx and up_edge) plus the length of one diameter that ends at each."""
    keys = list(keys)
    above = sized.select(*keys, F.col("edge_id").alias("up_edge"),
                         F.col("dn_idx").alias("up_idx"), F.lit(1).alias("_hit"))
    same = sized.join(above, keys + ["up_edge"], "left").withColumn(
        "same_up", F.when(F.col("dn_idx") == F.col("up_idx"), F.col("up_edge")))
    runs = climb(same, keys, "edge_id", "same_up", sums=["length"]).select(
        *keys, "edge_id", F.col("top").alias("run_head"), F.col("length").alias("_above"))
    head_len = sized.select(*keys, F.col("edge_id").alias("run_head"),
                            F.col("length").alias("_head"))
    # The climb totals every edge below the head, so the head itself is added once.
    return (sized.join(runs, keys + ["edge_id"]).join(head_len, keys + ["run_head"])
            .withColumn("run_length", F.col("_above") + F.col("_head"))
            .withColumn("run_limit", rules.run_limit(F.col("dn_idx")))
            .drop("_above", "_head"))


def repair_dn(chains: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with final diameters after every overlong run of one diameter has been broken.

    The cheapest way to break a run is to enlarge the chain at its head by one size: sizes never
    shrink toward the root, so any lower candidate would drag the head along and cost strictly
    more. A head stays offending until it is enlarged and enlargements commute, so the outcome is
    the least fixed point, and that has a closed form. Let r(c, i) be the longest run that starts
    at the head of chain c when c has size i, and natural(c) the first size, from the chain's own
    minimum up, whose limit covers r(c, i). A child chain joins its parent's run at size i exactly
    when natural(child) >= i, which gives r from the leaves up; the final size of a chain is the
    smallest natural size on its way to the root. One pass per level of the chain tree, touching
    only that level's rows. Chains that would outgrow the largest size come back with NULL.
    """
    keys = list(keys)
    sizes = range(len(rules.DN))
    base = chain_dn(chains, keys).select(*keys, "chain_id", "up_chain", "own_idx", "chain_idx")
    inside = chains.withColumn(
        "_up", F.when(F.col("edge_id") != F.col("chain_id"), F.col("up_edge")))
    reach = climb(inside, keys, "edge_id", "_up", sums=["length"]).select(
        *keys, "edge_id", F.col("length").alias("_below_head"))
    heads = chains.select(*keys, F.col("edge_id").alias("chain_id"),
                          F.col("length").alias("_head"), F.col("up_edge").alias("attach_edge"))
    placed = cut(chains.select(*keys, "edge_id", "chain_id").join(reach, keys + ["edge_id"])
                 .join(heads.drop("attach_edge"), keys + ["chain_id"])
                 .withColumn("reach", F.col("_below_head") + F.col("_head"))
                 .select(*keys, "edge_id", "chain_id", "reach"))
    longest = placed.groupBy(*keys, "chain_id").agg(F.max("reach").alias("own_reach"))
    attach = placed.select(*keys, F.col("edge_id").alias("attach_edge"),
                           F.col("reach").alias("attach_at"))
    level = climb(base, keys, "chain_id", "up_chain").select(
        *keys, "chain_id", F.col("hops").alias("level"))
    tree = cut(base.join(longest, keys + ["chain_id"]).join(level, keys + ["chain_id"])
               .join(heads.drop("_head"), keys + ["chain_id"])
               .join(attach, keys + ["attach_edge"], "left"))
    deepest = tree.agg(F.max("level")).first()[0]
    solved, below = None, None
    for at in range(deepest if deepest is not None else -1, -1, -1):
        rows = tree.filter(F.col("level") == at)
        if below is None:
            runs = [F.col("own_reach").alias(f"r{i}") for i in sizes]
        else:
            gains = below.groupBy(*keys, F.col("up_chain").alias("chain_id")).agg(*[
                F.max(F.when((F.col("natural") >= i) & (F.col("chain_idx") <= i),
                             F.col("attach_at") + F.col(f"r{i}"))).alias(f"g{i}")
                for i in sizes])
            rows = rows.join(gains, keys + ["chain_id"], "left")
            runs = [F.greatest("own_reach", f"g{i}").alias(f"r{i}") for i in sizes]
        natural = F.lit(len(rules.DN))
        for i in reversed(sizes):
            natural = F.when((F.col("chain_idx") <= i)
                             & (F.col(f"r{i}") <= rules.RUN_LIMIT[i] + 1e-3), i).otherwise(natural)
        below = cut(rows.select(*keys, "chain_id", "up_chain", "chain_idx", "attach_at", *runs)
                    .withColumn("natural", natural))
        part = below.select(*keys, "chain_id", "up_chain", "natural")
        solved = part if solved is None else solved.unionByName(part)
    if solved is None:
        solved = base.select(*keys, "chain_id", "up_chain", F.lit(0).alias("natural")).limit(0)
    final = climb(solved, keys, "chain_id", "up_chain", mins=["natural"]).select(
        *keys, "chain_id", F.when(F.col("natural") < len(rules.DN), F.col("natural"))
        .alias("dn_idx"))
    return path_runs(chains.drop("dn_idx", "dn").join(final, keys + ["chain_id"]), keys).withColumn(
        "dn", rules.dn_of(F.col("dn_idx")))


def length_checks(repaired: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return repaired.select(
        *keys, "edge_id", "dn", F.col("run_length"), "run_limit", "flow",
        rules.capacity(F.col("dn_idx")).alias("capacity"),
        (F.col("dn_idx") > rules.flow_index(F.col("flow"))).alias("raised_for_length"))


def size_violations(repaired: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges without a diameter: more flow than the largest carries, or no size may run so far."""
    over = F.col("flow") > rules.CAPACITY[-1] + 1e-9
    return repaired.filter("dn IS NULL").select(
        *keys, F.col("edge_id").alias("object_id"),
        F.when(over, "CAPACITY_EXCEEDED").otherwise("RUN_TOO_LONG").alias("code"))


def degrees(nodes: DataFrame, edges: DataFrame, existing: DataFrame | None = None,
            keys: Sequence[str] = KEYS, limit: int = 4) -> DataFrame:
    """Pipes meeting at each node plus what the existing network already has there.

    ``existing``: keys, node_id, existing_id, existing_degree for nodes placed on the old network
    (2 on a pipe). Branches of several roots at one existing chamber are counted together.
    """
    keys = list(keys)
    ends = (edges.select(*keys, F.col("start_id").alias("node_id"), F.lit(1).alias("_c"))
            .unionByName(edges.select(*keys, F.col("end_id").alias("node_id"),
                                      F.lit(0).alias("_c"))))
    count = ends.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("new_degree"),
                                               F.sum("_c").alias("children"))
    out = nodes.select(*keys, "node_id", "node_type").join(count, keys + ["node_id"], "left")
    out = out.fillna(0, ["new_degree", "children"])
    if existing is None:
        return out.select(*keys, "node_id", F.col("new_degree").alias("degree"),
                          (F.col("new_degree") > limit).alias("over_limit"))
    old = existing.select(*keys, "node_id", "existing_id", "existing_type", "existing_degree")
    out = out.join(old, keys + ["node_id"], "left").fillna(0, ["existing_degree"])
    shared = (out.filter("existing_type = 'heat_chamber' AND node_type = 'tie'")
              .groupBy(*keys, "existing_id").agg(F.sum("children").alias("shared_children")))
    out = out.join(shared, keys + ["existing_id"], "left")
    degree = F.when(F.col("existing_type") == "heat_chamber",
                    F.coalesce("shared_children", "new_degree")).otherwise(F.col("new_degree"))
    return out.select(*keys, "node_id", (degree + F.col("existing_degree")).alias("degree"),
                      (degree + F.col("existing_degree") > limit).alias("over_limit"))
