"""Learning data: labels, splits, scaling, ordering metrics, preference pairs, model scoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.operators.kernels import running
from utilnet.session import cut

# Order of the candidate and context features.



def reward(score: Column, connected: Column, required: Column) -> Column:
    """Between -1 and 0 for a complete network, below -2 for an incomplete one."""
    need = F.greatest(F.lit(1), required)
    normal = score / need
    return F.when(connected == required, -(normal / (1 + normal))).otherwise(
        -2 - (required - connected) / need)


def running_best(attempts: DataFrame, keys: Sequence[str], order: Sequence[str],
                 before: float | None = None) -> DataFrame:
    """Best complete score so far and whether the attempt improved it by more than 1e-9."""
    usable = F.col("complete") & F.col("score").isNotNull() & ~F.isnan("score")
    rows = attempts.withColumn("_s", F.when(usable, F.col("score")))
    out = running(rows, keys, order, mins={"_before": "_s"}, row_number="attempt")
    prior = F.least(F.col("_before"), F.lit(before).cast("double"))
    return out.withColumn("best_so_far", F.least(prior, F.col("_s"))).withColumn(
        "improved", F.col("_s").isNotNull()
        & F.coalesce(F.col("_s") < prior - 1e-9, F.lit(True))).drop("_before", "_s")


def run_quality(attempts: DataFrame, keys: Sequence[str], order: Sequence[str],
                before: float | None = None) -> DataFrame:
    """One row per job: first, best and last-improving attempt, and the gain in percent."""
    rows = running_best(attempts, keys, order, before).withColumn(
        "_s", F.when(F.col("complete"), F.col("score")))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count("_s").alias("complete_attempts"),
        F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("attempt"))).alias("first_score"),
        F.min(F.when(F.col("_s").isNotNull(), F.col("attempt"))).alias("first_attempt"),
        F.min("_s").alias("best_fresh"),
        F.max(F.when(F.col("improved"), F.col("attempt"))).alias("last_improvement"))
    baseline = F.coalesce(F.lit(before).cast("double"), F.col("first_score"))
    after = F.least(F.lit(before).cast("double"), F.col("best_fresh"))
    return out.select(
        "*", baseline.alias("baseline"), after.alias("best_after"),
        F.when(baseline > 0, 100 * (baseline - after) / baseline).alias("improvement_percent"),
        F.when(after.isNotNull(), F.col("attempts") - F.coalesce("last_improvement", F.lit(0)))
         .alias("since_improvement"))


def territory_split(territory: Column) -> Column:
    """Whole territories per split: 0-47 train, 48-63 validation, 64-79 test."""
    return (F.when(territory < 48, "train").when(territory < 64, "validation")
            .when(territory < 80, "test"))


def ranking_labels(cands: DataFrame, group: Sequence[str]) -> DataFrame:
    """Targets for ranking: infeasible rows sit two points behind the group's worst feasible one.

    Groups without a feasible row are left out. The group maximum is a plain aggregate joined
    back, so a huge group is combined before it is shuffled.
    """
    worst = cands.groupBy(*group).agg(
        F.max(F.when(F.col("feasible"), F.col("score"))).alias("_worst")).filter("_worst IS NOT NULL")
    label = F.when(F.col("feasible"), F.col("score")).otherwise(
        F.greatest(F.col("_worst") + 2.0, F.col("bound")))
    return (cands.join(worst, list(group)).withColumn("label", label).drop("_worst")
            .withColumn("target", F.log1p(F.greatest(F.lit(0.0), F.col("label") - F.col("bound")))))


def visits(cands: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Which candidates a bound-pruned walk in this order would still evaluate.

    Bounds never exceed scores, so a skipped row could not have lowered the best score; the best
    among visited rows therefore equals the best feasible score among all earlier rows.
    """
    rows = cands.withColumn("_s", F.when(F.col("feasible"), F.col("score")))
    out = running(rows, group, order, mins={"_best": "_s"}, row_number="position")
    return out.withColumn(
        "visited", F.coalesce(F.col("bound") <= F.col("_best") + 1e-8, F.lit(True))
    ).drop("_best", "_s")


def ranking_metrics(cands: DataFrame, group: Sequence[str], order: Sequence[str],
                    split: Column | None = None, error: Column | None = None) -> DataFrame:
    """Groups, candidates, evaluated candidates, mean first-feasible regret and mean abs error."""
    walked = visits(cands, group, order)
    per_group = walked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("visited").cast("long")).alias("v"),
        F.min_by("score", F.when(F.col("feasible"), F.col("position"))).alias("first"),
        F.min(F.when(F.col("feasible"), F.col("score"))).alias("best"),
        F.sum(error if error is not None else F.lit(None).cast("double")).alias("err"),
        F.count(error if error is not None else F.lit(None).cast("double")).alias("err_n"))
    per_group = per_group.withColumn("split", split if split is not None else F.lit("all"))
    return per_group.groupBy("split").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("candidates"),
        F.sum("v").alias("visited"), F.avg(F.col("first") - F.col("best")).alias("mean_regret"),
        (F.sum("err") / F.sum("err_n")).alias("mae"))


def fit_scaler(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per position; near-constant positions get scale 1."""
    long = df.select(*by, F.posexplode(features).alias("position", "value"))
    out = long.groupBy(*by, "position").agg(F.avg(F.col("value").cast("double")).alias("mean"),
                                            F.stddev_pop(F.col("value").cast("double")).alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") < 1e-6, 1.0).otherwise(F.col("scale")))


def score_mlp(df: DataFrame, weights: Sequence, biases: Sequence, features: str = "features",
              activation: str = "relu", mean: Sequence[float] | None = None,
              scale: Sequence[float] | None = None, output: str = "prediction") -> DataFrame:
    """Batch scores of a stored multilayer perceptron, one matrix product per Arrow batch."""
    w = [np.asarray(a, dtype=float) for a in weights]
    b = [np.asarray(a, dtype=float) for a in biases]
    mu = None if mean is None else np.asarray(mean, dtype=float)
    sd = None if scale is None else np.asarray(scale, dtype=float)

    @F.pandas_udf("double")
    def forward(column: pd.Series) -> pd.Series:
        out = np.full(len(column), np.nan)
        good = np.array([v is not None and len(v) == w[0].shape[0] for v in column], dtype=bool)
        if good.any():
            x = np.stack([np.asarray(v, dtype=float) for v in column[good]])
            finite = np.isfinite(x).all(axis=1)
            if mu is not None:
                x = (x - mu) / sd
            if activation == "tanh":
                x = np.clip(x, -8, 8)
            for layer, (wi, bi) in enumerate(zip(w, b)):
                x = x @ wi + bi
                if layer + 1 < len(w):
                    x = np.tanh(x) if activation == "tanh" else np.maximum(x, 0)
            out[good] = np.where(finite, x[:, 0], np.nan)
        return pd.Series(out)

    return df.withColumn(output, forward(F.col(features)))


def state_outcomes(traces: DataFrame, keys: Sequence[str] = ("state", "action")) -> DataFrame:
    """Best full score seen after each action; the features of the first sighting stay."""
    return traces.filter("score >= 0 AND features IS NOT NULL").groupBy(*keys).agg(
        F.min("score").alias("score"), F.min_by("features", "seen").alias("features"))


def preference_pairs(outcomes: DataFrame, state: str = "state", top: int = 3,
                     limit: int = 32) -> DataFrame:
    """Pairs (better, worse) per state: the best three against what follows, 32 at most.

    Both numbers are part of the operator. At most three rows of a state meet its other rows, so
    the join stays linear; the ranks come from the sliced prefix count, not from one task.
    """
    ranked = cut(running(outcomes, [state], ["score", "action"], row_number="rank"))
    best = ranked.filter(F.col("rank") <= top).select(
        state, F.col("rank").alias("i"), F.col("action").alias("good"),
        F.col("score").alias("good_score"), F.col("features").alias("good_features"))
    later = ranked.select(
        state, F.col("rank").alias("j"), F.col("action").alias("bad"),
        F.col("score").alias("bad_score"), F.col("features").alias("bad_features"))
    pairs = best.join(later, state).filter(
        (F.col("j") > F.col("i")) & (F.col("bad_score") > F.col("good_score") + 1e-8)
        & ~F.col("good_features").eqNullSafe(F.col("bad_features")))
    kept = pairs.withColumn("n", F.row_number().over(
        W.partitionBy(state).orderBy("i", "j"))).filter(F.col("n") <= limit)
    left, right = F.least("good", "bad"), F.greatest("good", "bad")
    return kept.withColumn("pair_key", F.sha2(F.concat_ws("|", F.col(state).cast("string"), left,
                                                          right), 256)).drop("i", "j", "n")


def preference_loss(pairs: DataFrame, good: str = "good_logit", bad: str = "bad_logit") -> DataFrame:
    """Mean logistic loss of preferring the better action, in the form that cannot overflow."""
    gap = F.col(good) - F.col(bad)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(
        F.greatest(F.lit(0.0), -gap) + F.log1p(F.exp(-F.abs(gap)))).alias("loss"))


def action_probs(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 temperature: float = 1.0) -> DataFrame:
    """Softmax over the actions of a state, and the first action with the largest value."""
    position = F.struct(*order)
    top = df.groupBy(*keys).agg(F.max("logit").alias("_max"))
    rows = df.join(top, list(keys)).withColumn(
        "_e", F.exp((F.col("logit") - F.col("_max")) / temperature))
    total = rows.groupBy(*keys).agg(
        F.sum("_e").alias("_sum"),
        F.min(F.when(F.col("logit") == F.col("_max"), position)).alias("_first"))
    return rows.join(total, list(keys)).withColumn(
        "probability", F.col("_e") / F.col("_sum")).withColumn(
        "greedy", position == F.col("_first")).drop("_max", "_e", "_sum", "_first")


def sample_actions(probs: DataFrame, keys: Sequence[str], order: Sequence[str],
                   seed: int = 0) -> DataFrame:
    """One action per state: the first whose cumulative probability passes the state's draw."""
    out = running(probs, keys, order, sums={"_to": "probability"}, inclusive=True)
    # A repeatable draw per state, so that a rerun task picks the same action.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    position = F.struct(*order)
    chosen = out.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_to") > draw, position)), F.max(position)).alias("_pick"))
    return out.join(chosen, list(keys)).filter(position == F.col("_pick")).drop("_to", "_pick")


def advantages(episodes: DataFrame, batch: Sequence[str], reward_column: str = "reward") -> DataFrame:
    """Reward minus the mean of the others in the batch, over the batch's deviation (>= 0.025)."""
    total = episodes.groupBy(*batch).agg(
        F.sum(reward_column).alias("_sum"), F.count(F.lit(1)).alias("_n"),
        F.stddev_pop(reward_column).alias("_sd"))
    r = F.col(reward_column)
    others = F.when(F.col("_n") > 1, (F.col("_sum") - r) / (F.col("_n") - 1)).otherwise(r)
    return episodes.join(total, list(batch)).withColumn(
        "advantage", (r - others) / F.greatest(F.lit(0.025), F.col("_sd"))).drop(
        "_sum", "_n", "_sd")


def promotion_gate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A model passes on two or more maps when nothing got worse and something got better."""
    a, b = F.col("candidate_reward"), F.col("baseline_reward")
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ~F.isnan(a) & ~F.isnan(b)
    fine = finite & (a + 1e-10 >= b) & (~F.col("baseline_complete") | F.col("candidate_complete"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("maps"),
        ((F.count(F.lit(1)) >= 2) & F.bool_and(F.coalesce(fine, F.lit(False)))
         & F.bool_or(F.coalesce(a > b + 1e-9, F.lit(False)))).alias("passes"))


def weight_delta(a: DataFrame, b: DataFrame, keys: Sequence[str],
                 column: str = "weights") -> DataFrame:
    """Changed count, Euclidean and largest change between two weight vectors."""
    left = a.select(*keys, F.posexplode(column).alias("position", "_a"))
    right = b.select(*keys, F.posexplode(column).alias("position", "_b"))
    d = F.abs(F.col("_b").cast("double") - F.col("_a").cast("double"))
    return left.join(right, [*keys, "position"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weight_count"),
        F.count(F.when(d > 0, 1)).alias("changed"),
        F.sqrt(F.sum(d * d)).alias("delta_l2"), F.max(d).alias("delta_max"))


def unique_maps(descriptors: DataFrame, digest: str = "sha", key: str = "key") -> DataFrame:
    """One descriptor per input digest: the first in key order."""
    rest = [c for c in descriptors.columns if c != digest]
    return descriptors.groupBy(digest).agg(
        F.min_by(F.struct(*rest), key).alias("_r")).select(digest, "_r.*")


def experience_status(descriptors: DataFrame, learning: DataFrame,
                      owner: str = "owner") -> DataFrame:
    """Territories, distinct maps by split, readiness for training, learned rows and steps."""
    maps = descriptors.groupBy(owner).agg(
        F.count(F.lit(1)).alias("territories"),
        F.countDistinct(F.when(F.col("split") == "train", F.col("sha"))).alias("training_maps"),
        F.countDistinct(F.when(F.col("split") != "train", F.col("sha"))).alias("validation_maps"))
    valid = descriptors.filter(F.col("key").rlike("^[a-f0-9]{64}$"))
    steps = valid.join(learning, "key").groupBy(owner).agg(
        F.count(F.lit(1)).alias("learning_territories"), F.sum("updates").alias("learning_steps"))
    return maps.join(steps, owner, "left").fillna(
        0, ["learning_territories", "learning_steps"]).withColumn(
        "can_train", (F.col("training_maps") >= 2) & (F.col("validation_maps") >= 2))


def train_ranker(labelled: DataFrame, validation: DataFrame, features: str = "features",
                 group: Sequence[str] = ("group_id",), order_tie: Sequence[str] = ("candidate",),
                 grid: Sequence[float] = (0.0, 0.01, 0.1)):
    """Choose a ridge model on validation groups: fewest visits, then regret, then error.

    Regularisation strengths stand in for the family of network shapes; training runs on the
    cluster and only coefficients and the three metrics per model reach the driver.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    train = labelled.select(array_to_vector(F.col(features)).alias("x"),
                            F.col("target").alias("y")).persist()
    trials = []
    for strength in grid:
        model = LinearRegression(featuresCol="x", labelCol="y", regParam=strength,
                                 solver="normal").fit(train)
        scored = validation.withColumn("x", array_to_vector(F.col(features)))
        scored = model.setPredictionCol("prediction").transform(scored).drop("x")
        scored = scored.withColumn("priority", F.col("bound") + F.expm1(F.least(
            F.lit(20.0), F.greatest(F.lit(0.0), F.col("prediction")))))
        m = ranking_metrics(scored, group, ["priority", *order_tie],
                            error=F.abs(F.col("prediction") - F.col("target"))).first()
        trials.append((m["visited"], m["mean_regret"], m["mae"], strength, model))
    train.unpersist()
    best = min(trials, key=lambda t: t[:3])
    return best[4], [t[:4] for t in trials]


def fit_preference(pairs: DataFrame, good: str = "good_features", bad: str = "bad_features",
                   strength: float = 0.01):
    """Linear preference model: logistic regression without intercept on mirrored differences."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    diff = F.zip_with(good, bad, lambda a, b: a.cast("double") - b.cast("double"))
    both = pairs.select(F.explode(F.array(
        F.struct(diff.alias("x"), F.lit(1.0).alias("label")),
        F.struct(F.transform(diff, lambda v: -v).alias("x"), F.lit(0.0).alias("label"))))
        .alias("r")).select(array_to_vector("r.x").alias("features"), "r.label")
    return LogisticRegression(fitIntercept=False, regParam=strength,
                              standardization=False).fit(both)
