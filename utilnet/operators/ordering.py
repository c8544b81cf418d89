"""Ranks, top-k selections and replay buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.functions.rules import relative_rating
from utilnet.operators.kernels import running
from utilnet.session import cut


GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
SALTS = 32


def rank_variants(networks: DataFrame, keys: Sequence[str], order: Sequence[str],
                  score: str = "score") -> DataFrame:
    """Rank and rating of every network of a dataset; the order ends with a unique column.

    Networks without a score have neither. The rows are written first: a score that is summed again may differ in its
    last bit, and the best one would then be better than the best.
    """
    networks = cut(networks)
    scored = networks.filter(F.col(score).isNotNull())
    best = scored.groupBy(*keys).agg(F.min(score).alias("_best"))
    ranked = (running(scored, keys, order, row_number="rank").join(best, list(keys))
              .withColumn("rating", relative_rating(F.col(score), F.col("_best"))).drop("_best"))
    return ranked.unionByName(networks.filter(F.col(score).isNull()), allowMissingColumns=True)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
          rank: str = "rank") -> DataFrame:
    """First k rows per key.

    Spark cuts each input partition to k rows per key before the shuffle up to k = 1000; for more,
    rows are cut to k per key and salt first, so that no task gets a whole key.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        df = df.withColumn("_salt", salt).withColumn("_n", F.row_number().over(
            W.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_n") <= k).drop("_salt", "_n")
    return df.withColumn(rank, F.row_number().over(
        W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def best_networks(pool: DataFrame, keys: Sequence[str], same: str, k: int = 3) -> DataFrame:
    """Best k networks per dataset after equal networks (same signature) are merged.

    Among equals the lowest score stays; within 1e-8 the earlier one stays.
    """
    low = pool.groupBy(*keys, same).agg(F.min("score").alias("_low"))
    near = pool.join(low, [*keys, same]).filter(F.col("score") <= F.col("_low") + 1e-8)
    kept = near.groupBy(*keys, same).agg(
        F.min_by(F.struct(*[c for c in pool.columns if c not in (*keys, same)]), "ord")
        .alias("_r")).select(*keys, same, "_r.*")
    return top_k(kept, keys, ["score", "ord"], k)


def best_root_outcomes(outcomes: DataFrame, keys: Sequence[str], root: str) -> DataFrame:
    """Per root the outcome that connects most, then scores lowest, then came first."""
    return outcomes.groupBy(*keys, root).agg(
        F.min_by(F.struct("connected", "score", "ord"),
                 F.struct(-F.col("connected"), F.col("score"), F.col("ord"))).alias("_r")
    ).select(*keys, root, "_r.*")


def replay_buffer(rows: DataFrame, keys: Sequence[str], key: str, value: str,
                  order: Sequence[str], limit: int) -> DataFrame:
    """Newest ``limit`` keys by first sight, each with the last value it was given."""
    position = F.struct(*order)
    latest = rows.groupBy(*keys, key).agg(
        F.min(position).alias("first_seen"), F.max_by(value, position).alias(value))
    return top_k(latest, keys, [F.col("first_seen").desc(), F.col(key)], limit)
