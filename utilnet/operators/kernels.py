"""Distributed building blocks: running aggregates, pointer doubling, subtree folds, components.

All of them move rows by key and never gather a whole group in one task, so a single group
that holds a large share of the rows is spread over the cluster like everything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.session import cut, discard


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    mins: dict[str, str] | None = None,
    maxs: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    inclusive: bool = False,
    row_number: str | None = None,
) -> DataFrame:
    """Prefix aggregates along ``order`` inside each key group.

    Each mapping is ``{new column: source column}`` over the rows before the current one, or up
    to and including it when ``inclusive``. ``order`` has to be unique inside a group; descending
    orders are given by negated columns. The rows are range-partitioned by (keys, order), every
    slice is folded on its own, and the per-slice totals (one row per group and slice) are folded
    a second time, so that no group has to fit in one task.
    """
    sums, mins, maxs, lasts = sums or {}, mins or {}, maxs or {}, lasts or {}
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(df.repartitionByRange(slices, *keys, *order)
                 .withColumn("_slice", F.spark_partition_id()))
    end = 0 if inclusive else -1
    local = (W.partitionBy(*keys, "_slice").orderBy(*order)
             .rowsBetween(W.unboundedPreceding, end))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)

    plan = ([(n, c, F.sum) for n, c in sums.items()] + [(n, c, F.min) for n, c in mins.items()]
            + [(n, c, F.max) for n, c in maxs.items()])
    position = F.struct(*order)
    totals = [fn(c).alias(f"_t_{n}") for n, c, fn in plan]
    totals += [F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_t_{n}")
               for n, c in lasts.items()]
    offsets = [fn(f"_t_{n}").over(before).alias(f"_o_{n}") for n, _, fn in plan]
    offsets += [F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_o_{n}") for n in lasts]
    if row_number:
        totals.append(F.count(F.lit(1)).alias("_t_rn"))
        offsets.append(F.sum("_t_rn").over(before).alias("_o_rn"))
    per_slice = sliced.groupBy(*keys, "_slice").agg(*totals)
    carried = per_slice.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                               F.col("_slice").alias("_k_slice"), *offsets)

    own = [fn(c).over(local).alias(f"_w_{n}") for n, c, fn in plan]
    own += [F.last(c, ignorenulls=True).over(local).alias(f"_w_{n}") for n, c in lasts.items()]
    if row_number:
        own.append(F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
                   .alias("_w_rn"))
    rows = sliced.select("*", *own)
    match = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.join(carried, match, "left")

    out: list[Column] = [F.col(c) for c in df.columns]
    for n in sums:
        w, o = F.col(f"_w_{n}"), F.col(f"_o_{n}")
        out.append(F.when(w.isNull(), o).when(o.isNull(), w).otherwise(w + o).alias(n))
    out += [F.least(f"_w_{n}", f"_o_{n}").alias(n) for n in mins]
    out += [F.greatest(f"_w_{n}", f"_o_{n}").alias(n) for n in maxs]
    out += [F.coalesce(f"_w_{n}", f"_o_{n}").alias(n) for n in lasts]
    if row_number:
        out.append((F.col("_w_rn") + F.coalesce("_o_rn", F.lit(0))).alias(row_number))
    return joined.select(*out)


def climb(
    df: DataFrame,
    keys: Sequence[str],
    node: str,
    up: str,
    sums: Sequence[str] = (),
    mins: Sequence[str] = (),
) -> DataFrame:
    """Pointer doubling to the top of each chain.

    ``up`` is NULL at a top. Result: keys, node, ``top``, ``hops``, every column of ``sums``
    totalled over the node itself and its ancestors below the top, every column of ``mins``
    minimised over the node, its ancestors and the top, and ``status``:
    ``ok``, ``dangling`` (the chain leaves the table; ``top`` is the missing id) or ``cycle``.
    Rows that arrived drop out of later rounds, so a popular top is joined to once.
    """
    keys, sums, mins = list(keys), list(sums), list(mins)
    # Sorted, not broadcast: what comes out of joins bears no sign of how many rows it has.
    base = df.select(*keys, F.col(node).alias("_v"), F.col(up).alias("_u"),
                     *[F.col(s).alias(f"_s_{s}") for s in sums],
                     *[F.col(m).alias(f"_m_{m}") for m in mins]).hint("merge")
    parents = base.select(*keys, F.col("_v").alias("_u"), F.col("_u").isNull().alias("_is_top"),
                          *[F.col(f"_m_{m}").alias(f"_pm_{m}") for m in mins])
    # Each row points at `_u`; `_state` says whether that pointer is final.
    state = base.join(parents, keys + ["_u"], "left").select(
        *keys, "_v", F.coalesce("_u", "_v").alias("_u"),
        F.when(F.col("_u").isNull(), 0).otherwise(1).cast("long").alias("_h"),
        *[F.when(F.col("_u").isNull(), F.lit(0.0)).otherwise(F.col(f"_s_{s}")).alias(f"_s_{s}")
          for s in sums],
        *[F.least(f"_m_{m}", F.when(F.col("_is_top"), F.col(f"_pm_{m}"))).alias(f"_m_{m}")
          for m in mins],
        F.when(F.col("_u").isNull() | F.col("_is_top"), "ok")
         .when(F.col("_is_top").isNull(), "dangling").otherwise("open").alias("_state"))
    state = cut(state)
    remaining = state.filter("_state = 'open'").count()
    while remaining:
        ahead = state.select(*keys, F.col("_v").alias("_u"), F.col("_u").alias("_u2"),
                             F.col("_h").alias("_h2"), F.col("_state").alias("_state2"),
                             *[F.col(f"_s_{s}").alias(f"_s2_{s}") for s in sums],
                             *[F.col(f"_m_{m}").alias(f"_m2_{m}") for m in mins])
        moved = state.filter("_state = 'open'").join(ahead, keys + ["_u"]).select(
            *keys, "_v", F.col("_u2").alias("_u"), (F.col("_h") + F.col("_h2")).alias("_h"),
            *[(F.col(f"_s_{s}") + F.col(f"_s2_{s}")).alias(f"_s_{s}") for s in sums],
            *[F.least(f"_m_{m}", f"_m2_{m}").alias(f"_m_{m}") for m in mins],
            F.col("_state2").alias("_state"))
        last, state = state, cut(state.filter("_state <> 'open'").unionByName(moved))
        discard(last)
        left = state.filter("_state = 'open'").count()
        if left == remaining:
            break  # every finite chain got shorter, so what stands still is a cycle
        remaining = left
    return state.select(
        *keys, F.col("_v").alias(node), F.col("_u").alias("top"), F.col("_h").alias("hops"),
        *[F.col(f"_s_{s}").alias(s) for s in sums], *[F.col(f"_m_{m}").alias(m) for m in mins],
        F.when(F.col("_state") == "open", "cycle").otherwise(F.col("_state")).alias("status"))


def fold_subtrees(
    df: DataFrame,
    keys: Sequence[str],
    node: str,
    up: str,
    sums: Sequence[str] = (),
    maxs: Sequence[str] = (),
) -> DataFrame:
    """Totals and maxima over each node and everything below it, in log2(depth) rounds.

    After round k a row holds its value over descendants nearer than 2^k and points at its
    ancestor exactly 2^k away; the next round adds what the descendants at that distance hold.
    One row per node throughout: no ancestor-descendant pairs are written. Forests only; rows on
    a cycle keep their pointer and are cut off after the rounds that any tree would need.
    """
    keys, sums, maxs = list(keys), list(sums), list(maxs)
    vals = sums + maxs
    state = cut(df.select(*keys, F.col(node).alias("_v"), F.col(up).alias("_u"), *vals))
    remaining = state.filter("_u IS NOT NULL").count()
    while remaining:
        gains = (state.filter("_u IS NOT NULL").groupBy(*keys, F.col("_u").alias("_v"))
                 .agg(*[F.sum(s).alias(f"_g_{s}") for s in sums],
                      *[F.max(m).alias(f"_g_{m}") for m in maxs]))
        # Pointers whose target is a top end here; only the others need the second hop.
        ahead = state.filter("_u IS NOT NULL").select(
            *keys, F.col("_v").alias("_u"), F.col("_u").alias("_u2"))
        hop = (state.filter("_u IS NOT NULL").select(*keys, "_v", "_u")
               .join(ahead, keys + ["_u"]).select(*keys, "_v", "_u2").hint("merge"))
        last, state = state, cut(
            state.join(gains, keys + ["_v"], "left").join(hop, keys + ["_v"], "left").select(
                *keys, "_v", F.col("_u2").alias("_u"),
                *[(F.col(s) + F.coalesce(f"_g_{s}", F.lit(0))).alias(s) for s in sums],
                *[F.greatest(m, f"_g_{m}").alias(m) for m in maxs]))
        discard(last)
        left = state.filter("_u IS NOT NULL").count()
        if left == remaining:
            break
        remaining = left
    return state.select(*keys, F.col("_v").alias(node), *vals)


def components(
    nodes: DataFrame,
    pairs: DataFrame,
    keys: Sequence[str],
    node: str = "node_id",
) -> DataFrame:
    """Label every node with the smallest node id it is linked to, directly or not.

    ``pairs`` has columns ``a`` and ``b``. Alternates hooking to the smallest neighbouring label
    with pointer jumping on the labels, so long chains close in logarithmic rounds.
    """
    keys = list(keys)
    both = cut(pairs.select(*keys, "a", "b").unionByName(
        pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut(nodes.select(*keys, F.col(node).alias("_v"), F.col(node).alias("_l")))
    while True:
        labels = state.select(*keys, F.col("_v").alias("b"), F.col("_l").alias("_lb"))
        offers = (both.join(labels, keys + ["b"]).groupBy(*keys, F.col("a").alias("_v"))
                  .agg(F.min("_lb").alias("_o")))
        hooked = state.join(offers, keys + ["_v"], "left").select(
            *keys, "_v", F.col("_l").alias("_old"), F.least("_l", "_o").alias("_l"))
        # The label's own row carries the best offer any of its members received.
        better = (hooked.filter("_l < _old").groupBy(*keys, F.col("_old").alias("_v"))
                  .agg(F.min("_l").alias("_m")))
        lowered = cut(hooked.join(better, keys + ["_v"], "left").select(
            *keys, "_v", "_old", F.least("_l", "_m").alias("_l")))
        jump = lowered.select(*keys, F.col("_v").alias("_l"), F.col("_l").alias("_ll"))
        # Rows that point at themselves need no jump; a popular label is met by AQE's skew split.
        last, state = state, cut(lowered.join(jump, keys + ["_l"]).select(
            *keys, "_v", F.col("_ll").alias("_l"), (F.col("_ll") < F.col("_old")).alias("_moved")))
        discard(last)
        discard(lowered)
        if state.filter("_moved").isEmpty():
            break
    return state.select(*keys, F.col("_v").alias(node), F.col("_l").alias("label"))
