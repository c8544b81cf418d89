"""Learning data, window operators and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from utilnet.functions import text
from utilnet.operators import learn, ordering
from utilnet.plans import bridge
from utilnet.plans.bridge import sql, table
from utilnet.plans.registry import query

_RUN = {
    "r": """SELECT *, row_number() OVER w AS attempt, CASE WHEN complete THEN score END AS s
      FROM fx_attempts WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)""",
    "q": """SELECT *, min(s) OVER (PARTITION BY job_id ORDER BY attempt
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
      min(s) OVER (PARTITION BY job_id ORDER BY attempt
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM r""",
    "i": "SELECT *, s IS NOT NULL AND (prior IS NULL OR s < prior - 1e-9) AS improved FROM q",
}


@query("running_best", sql("""SELECT job_id, event_id, attempt, best_so_far, improved FROM i""",
                           "fx_attempts", extra=_RUN))
def running_best(spark, d):
    return learn.running_best(bridge.attempts(spark, d), ["job_id"], ["ts", "event_id"]).select(
        "job_id", "event_id", F.col("attempt").cast("long").alias("attempt"), "best_so_far",
        "improved")


@query("run_quality", sql("""SELECT job_id, count(*) AS attempts, count(s) AS complete_attempts,
  arg_min(s, attempt) FILTER (s IS NOT NULL) AS first_score,
  min(attempt) FILTER (s IS NOT NULL) AS first_attempt, min(s) AS best_fresh,
  max(attempt) FILTER (improved) AS last_improvement,
  round(100 * (first_score - best_fresh) / first_score, 6) AS improvement_percent,
  CASE WHEN best_fresh IS NOT NULL THEN attempts - coalesce(last_improvement, 0) END AS since_improvement
  FROM i GROUP BY job_id""", "fx_attempts", extra=_RUN))
def run_quality(spark, d):
    out = learn.run_quality(bridge.attempts(spark, d), ["job_id"], ["ts", "event_id"])
    return out.select("job_id", "attempts", "complete_attempts", "first_score",
                      F.col("first_attempt").cast("long").alias("first_attempt"), "best_fresh",
                      F.col("last_improvement").cast("long").alias("last_improvement"),
                      F.round("improvement_percent", 6).alias("improvement_percent"),
                      F.col("since_improvement").cast("long").alias("since_improvement"))


_VIS = {"v": """SELECT *, row_number() OVER w AS position, coalesce(bound <= min(CASE WHEN feasible
  THEN score END) OVER (PARTITION BY group_id ORDER BY bound, candidate
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-8, true) AS visited FROM fx_cands
  WINDOW w AS (PARTITION BY group_id ORDER BY bound, candidate)"""}


@query("pruned_visits", sql("""SELECT group_id, count(*) AS candidates,
  sum(visited::INT)::BIGINT AS visited FROM v GROUP BY 1""", "fx_cands", extra=_VIS))
def pruned_visits(spark, d):
    walked = learn.visits(bridge.candidates(spark, d), ["group_id"], ["bound", "pos"])
    return walked.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(F.col("visited").cast("long")).alias("visited"))


@query("first_feasible_regret", sql("""SELECT group_id, round(arg_min(score, position) FILTER (feasible)
  - min(score) FILTER (feasible), 6) AS regret FROM v GROUP BY 1 HAVING bool_or(feasible)""",
                                    "fx_cands", extra=_VIS))
def first_feasible_regret(spark, d):
    walked = learn.visits(bridge.candidates(spark, d), ["group_id"], ["bound", "pos"])
    first = F.min_by("score", F.when(F.col("feasible"), F.col("position")))
    best = F.min(F.when(F.col("feasible"), F.col("score")))
    return (walked.groupBy("group_id").agg(F.round(first - best, 6).alias("regret"))
            .filter("regret IS NOT NULL"))


@query("ranking_metrics", sql("""SELECT CASE WHEN g % 80 < 48 THEN 'train' WHEN g % 80 < 64 THEN
  'validation' ELSE 'test' END AS split, count(*) AS groups, sum(n)::BIGINT AS candidates,
  sum(vis)::BIGINT AS visited, round(avg(f - b), 6) AS mean_regret FROM (
  SELECT group_id AS g, count(*) AS n, sum(visited::INT) AS vis,
  arg_min(score, position) FILTER (feasible) AS f, min(score) FILTER (feasible) AS b
  FROM v GROUP BY 1) GROUP BY 1""", "fx_cands", extra=_VIS))
def ranking_metrics(spark, d):
    out = learn.ranking_metrics(
        bridge.candidates(spark, d), ["group_id"], ["bound", "pos"],
        split=learn.territory_split(F.col("group_id") % 80))
    return out.select("split", "groups", "candidates", "visited",
                      F.round("mean_regret", 6).alias("mean_regret"))


@query("ranking_labels", sql("""SELECT group_id, line, part, supp, round(label, 8) AS label,
  round(ln(1 + greatest(0, label - bound)), 9) AS target FROM (
  SELECT *, CASE WHEN feasible THEN score ELSE greatest(w + 2, bound) END AS label FROM (
  SELECT *, max(CASE WHEN feasible THEN score END) OVER (PARTITION BY group_id) AS w FROM fx_cands)
  WHERE w IS NOT NULL)""", "fx_cands"))
def ranking_labels(spark, d):
    return learn.ranking_labels(bridge.candidates(spark, d), ["group_id"]).select(
        "group_id", "line", "part", "supp", F.round("label", 8).alias("label"),
        F.round("target", 9).alias("target"))


@query("feature_scaler", """SELECT label, position, round(avg(v), 6) AS mean,
  round(CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END, 6) AS scale FROM (
  SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS position
  FROM embeddings) GROUP BY 1, 2""")
def feature_scaler(spark, d):
    out = learn.fit_scaler(table(spark, d, "embeddings"), "embedding", by=["label"])
    return out.select("label", F.col("position").cast("long").alias("position"),
                      F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def _weights(size: int):
    """Hand-set two-layer weights by formula, so that SQL can state the same network."""
    w1 = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(3)] for i in range(size)]
    w2 = [[(j - 1) / 2 + 0.25] for j in range(3)]
    return [w1, w2], [[(j - 1) / 10 for j in range(3)], [0.05]]


def _mlp_sql(inner: str, clip: str) -> str:
    return f"""SELECT vec_id, round(sum({inner} * ((j - 1) / 2.0 + 0.25)) + 0.05, 5)::DOUBLE AS prediction
  FROM (SELECT vec_id, j, sum({clip} * ((p * 7 + j * 3) % 11 - 5) / 10.0) + (j - 1) / 10.0 AS h FROM (
    SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p
    FROM embeddings), (VALUES (0), (1), (2)) t(j) GROUP BY 1, 2) GROUP BY 1"""


def _scored(spark, d, activation):
    vectors = table(spark, d, "embeddings")
    head = vectors.select(F.size("embedding")).first()
    w, b = _weights(head[0] if head else 1)
    return learn.score_mlp(vectors, w, b, "embedding", activation).select(
        "vec_id", F.round("prediction", 5).alias("prediction"))


@query("score_relu_mlp", _mlp_sql("greatest(h, 0)", "v"))
def score_relu_mlp(spark, d):
    return _scored(spark, d, "relu")


@query("score_tanh_mlp", _mlp_sql("tanh(h)", "greatest(-8, least(8, v))"))
def score_tanh_mlp(spark, d):
    return _scored(spark, d, "tanh")


def _traces(spark, d):
    pos = F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 4000).cast("string").alias("state"),
        F.col("l_partkey").cast("string").alias("action"), pos.alias("seen"),
        (F.col("l_extendedprice") / 1000).alias("score"),
        F.array("l_quantity", "l_discount").alias("features"))


_OUT = {"o": """SELECT (l_orderkey % 4000)::VARCHAR AS state, l_partkey::VARCHAR AS action,
  min(l_extendedprice / 1000) AS score, arg_min([l_quantity, l_discount], (l_linenumber, l_suppkey,
  l_extendedprice, l_shipdate, l_quantity)) AS f FROM lineitem GROUP BY 1, 2""",
        "k": "SELECT *, row_number() OVER (PARTITION BY state ORDER BY score, action) AS n FROM o",
        "p": """SELECT a.state, a.action AS good, b.action AS bad, a.score AS gs, b.score AS bs,
  row_number() OVER (PARTITION BY a.state ORDER BY a.n, b.n) AS m, a.f AS gf, b.f AS bf FROM k a JOIN k b
  ON a.state = b.state AND a.n <= 3 AND b.n > a.n AND b.score > a.score + 1e-8 AND a.f <> b.f"""}


@query("state_outcomes", sql("""SELECT state, action, score, f[1] AS feature_0, f[2] AS feature_1 FROM o""",
                             extra=_OUT))
def state_outcomes(spark, d):
    return learn.state_outcomes(_traces(spark, d)).select(
        "state", "action", "score", F.get("features", F.lit(0)).alias("feature_0"),
        F.get("features", F.lit(1)).alias("feature_1"))


@query("preference_pairs", sql("""SELECT state, good, bad, sha256(state || '|' || least(good, bad) || '|' ||
  greatest(good, bad)) AS pair_key FROM p WHERE m <= 32""", extra=_OUT))
def preference_pairs(spark, d):
    return learn.preference_pairs(learn.state_outcomes(_traces(spark, d))).select(
        "state", "good", "bad", "pair_key")


@query("preference_loss", sql("""SELECT count(*) AS pairs, round(avg(greatest(0, -g) + ln(1 + exp(-abs(g)))), 8)
  AS loss FROM (SELECT (gf[1] - bf[1]) / 50 - (gf[2] - bf[2]) AS g FROM p WHERE m <= 32)""", extra=_OUT))
def preference_loss(spark, d):
    pairs = learn.preference_pairs(learn.state_outcomes(_traces(spark, d)))
    for side in ("good", "bad"):
        f = F.col(f"{side}_features")
        pairs = pairs.withColumn(f"{side}_logit", F.get(f, F.lit(0)) / 50 - F.get(f, F.lit(1)))
    return learn.preference_loss(pairs).select("pairs", F.round("loss", 8).alias("loss"))


@query("action_probabilities", """SELECT user_id, event_id, round(exp((value - m) / 10) /
  sum(exp((value - m) / 10)) OVER (PARTITION BY user_id), 9) AS probability,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 AS greedy
  FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events)""")
def action_probabilities(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("logit"))
    return learn.action_probs(rows, ["user_id"], ["event_id"], 10.0).select(
        "user_id", "event_id", F.round("probability", 9).alias("probability"), "greedy")


@query("sampled_actions", """SELECT user_id, event_id, round(p, 9) AS probability FROM (
  SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY event_id) AS t, ('0x' || substr(md5('7:' || user_id), 1, 8))::BIGINT / 4294967296.0 AS d
  FROM (SELECT user_id, event_id, exp((value - m) / 10) / sum(exp((value - m) / 10)) OVER (PARTITION BY user_id) AS p
  FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events)))
  QUALIFY event_id = coalesce(min(event_id) FILTER (t > d) OVER (PARTITION BY user_id), max(event_id) OVER (PARTITION BY user_id))""")
def sampled_actions(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("logit"))
    probs = learn.action_probs(rows, ["user_id"], ["event_id"], 10.0)
    return learn.sample_actions(probs, ["user_id"], ["event_id"], seed=7).select(
        "user_id", "event_id", F.round("probability", 9).alias("probability"))


@query("batch_advantages", """SELECT user_id, event_id, round((value - CASE WHEN n > 1 THEN (s - value) / (n - 1)
  ELSE value END) / greatest(0.025, sd), 6) AS advantage FROM (SELECT *, sum(value) OVER w AS s,
  count(*) OVER w AS n, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id))""")
def batch_advantages(spark, d):
    return learn.advantages(table(spark, d, "events"), ["user_id"], "value").select(
        "user_id", "event_id", F.round("advantage", 6).alias("advantage"))


@query("promotion_gate", """SELECT o_custkey, count(*) AS maps, count(*) >= 2 AND
  bool_and(c + 1e-10 >= b AND (o_orderstatus = 'P' OR o_orderkey % 50 <> 0)) AND bool_or(c > b + 1e-9) AS passes
  FROM (SELECT *, -o_totalprice / 1e6 AS b, -o_totalprice / 1e6 + (o_orderkey % 9 - 1) / 100.0::DOUBLE AS c
  FROM orders) GROUP BY 1""")
def promotion_gate(spark, d):
    key, base = F.col("o_orderkey"), -F.col("o_totalprice") / 1e6
    rows = table(spark, d, "orders").select(
        "o_custkey", base.alias("baseline_reward"),
        (base + (key % 9 - 1) / 100.0).alias("candidate_reward"),
        (F.col("o_orderstatus") != "P").alias("baseline_complete"),
        (key % 50 != 0).alias("candidate_complete"))
    return learn.promotion_gate(rows, ["o_custkey"])


@query("weight_delta", """SELECT vec_id, count(*) AS weight_count, count(*) FILTER (dd > 0) AS changed,
  round(sqrt(sum(dd * dd)), 6) AS delta_l2, round(max(dd), 6) AS delta_max FROM (
  SELECT a.vec_id, abs(unnest(b.embedding)::DOUBLE - unnest(a.embedding)::DOUBLE) AS dd
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY 1""")
def weight_delta(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    return learn.weight_delta(e, after, ["vec_id"], "embedding").select(
        "vec_id", "weight_count", "changed", F.round("delta_l2", 6).alias("delta_l2"),
        F.round("delta_max", 6).alias("delta_max"))


@query("unique_maps", """SELECT sha256(text) AS sha, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang
  FROM documents GROUP BY 1""")
def unique_maps(spark, d):
    maps = table(spark, d, "documents").select(
        text.sha256(F.col("text")).alias("sha"), "doc_id", "lang")
    return learn.unique_maps(maps, "sha", "doc_id").select("sha", "doc_id", "lang")


@query("experience_status", """SELECT source AS owner, count(*) AS territories,
  count(DISTINCT sha) FILTER (v) AS validation_maps, count(DISTINCT sha) FILTER (NOT v) AS training_maps,
  count(l.doc_id) AS learning_territories, coalesce(sum(quality + 2), 0)::BIGINT AS learning_steps,
  count(DISTINCT sha) FILTER (v) >= 2 AND count(DISTINCT sha) FILTER (NOT v) >= 2 AS can_train FROM (
  SELECT *, sha256(text) AS sha, ('0x' || substr(sha256(text), 1, 2))::BIGINT % 5 = 0 AS v FROM documents) d
  LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def experience_status(spark, d):
    sha = text.sha256(F.col("text"))
    maps = table(spark, d, "documents").select(
        F.col("source").alias("owner"), sha.alias("sha"), text.map_split(sha).alias("split"),
        text.sha256(F.col("doc_id").cast("string")).alias("key"))
    learned = table(spark, d, "labels").select(
        text.sha256(F.col("doc_id").cast("string")).alias("key"),
        (F.col("quality") + 2).cast("long").alias("updates"))
    return learn.experience_status(maps, learned)


@query("territory_splits", """SELECT o_orderkey, CASE WHEN o_orderkey % 90 < 48 THEN 'train'
  WHEN o_orderkey % 90 < 64 THEN 'validation' WHEN o_orderkey % 90 < 80 THEN 'test' END AS split FROM orders""")
def territory_splits(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", learn.territory_split(F.col("o_orderkey") % 90).alias("split"))


@query("ranker_choice")
def ranker_choice(spark, d):
    """Models trained on one part of the groups and chosen on another; the trials are the rows."""
    cands = bridge.candidates(spark, d).withColumn(
        "features", F.array(F.col("quantity"), F.col("discount"), F.col("tax"), F.col("bound")))
    labelled = learn.ranking_labels(cands, ["group_id"]).withColumn(
        "split", learn.territory_split(F.col("group_id") % 80))
    _, trials = learn.train_ranker(
        labelled.filter("split = 'train'"), labelled.filter("split = 'validation'"),
        order_tie=["pos"])
    return spark.createDataFrame([tuple(map(float, t)) for t in trials],
                                 "visited double, regret double, mae double, strength double")


@query("preference_model")
def preference_model(spark, d):
    pairs = learn.preference_pairs(learn.state_outcomes(_traces(spark, d)))
    model = learn.fit_preference(pairs)
    return spark.createDataFrame(
        [(i, float(c)) for i, c in enumerate(model.coefficients)], "position int, weight double")


# ---- ranks and selections ----

@query("variant_ranks", sql("""SELECT dataset_id, network_id, row_number() OVER w AS rank,
  round(100 * min(s) OVER (PARTITION BY dataset_id) / s, 6) AS rating FROM (
  SELECT *, 0.7*cost/25e6 + 0.3*length/100 AS s FROM fx_variants)
  WINDOW w AS (PARTITION BY dataset_id ORDER BY s, network_id)""", "fx_variants"))
def variant_ranks(spark, d):
    from utilnet.functions.rules import score
    v = bridge.variants(spark, d).withColumn("score", score(F.col("cost"), F.col("length")))
    return ordering.rank_variants(v, ["dataset_id"], ["score", "network_id"]).select(
        "dataset_id", "network_id", F.col("rank").cast("long").alias("rank"),
        F.round("rating", 6).alias("rating"))


@query("network_pool", sql("""SELECT dataset_id, network_id, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset_id ORDER BY cost, bends, network_id) AS rank FROM fx_variants) WHERE rank <= 60""",
                           "fx_variants"))
def network_pool(spark, d):
    return ordering.top_k(bridge.variants(spark, d), ["dataset_id"],
                          ["cost", "bends", "network_id"], 60).select(
        "dataset_id", "network_id", F.col("rank").cast("long").alias("rank"))


@query("best_networks", sql("""SELECT dataset_id, bends, network_id, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset_id ORDER BY cost, network_id) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset_id, bends ORDER BY cost, network_id) AS n FROM fx_variants) WHERE n = 1)
  WHERE rank <= 3""", "fx_variants"))
def best_networks(spark, d):
    pool = bridge.variants(spark, d).select(
        "dataset_id", "bends", F.col("cost").alias("score"), F.col("network_id").alias("ord"))
    return ordering.best_networks(pool, ["dataset_id"], "bends").select(
        "dataset_id", "bends", F.col("ord").alias("network_id"),
        F.col("rank").cast("long").alias("rank"))


@query("root_outcomes", sql("""SELECT dataset_id, bends AS root_id, arg_min(network_id, (-(network_id % 5), cost,
  network_id)) AS network_id FROM fx_variants GROUP BY 1, 2""", "fx_variants"))
def root_outcomes(spark, d):
    v = bridge.variants(spark, d).select(
        "dataset_id", F.col("bends").alias("root_id"), (F.col("network_id") % 5).alias("connected"),
        F.col("cost").alias("score"), F.col("network_id").alias("ord"))
    return ordering.best_root_outcomes(v, ["dataset_id"], "root_id").select(
        "dataset_id", "root_id", F.col("ord").alias("network_id"))


@query("replay_buffer", """SELECT user_id, k, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY fs DESC, k) AS n FROM (SELECT user_id, json_extract_string(props, '$.k') AS k,
  min((ts, event_id)) AS fs, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)) WHERE n <= 20""")
def replay_buffer(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return ordering.replay_buffer(rows, ["user_id"], "k", "value", ["ts", "event_id"], 20).select(
        "user_id", "k", "value")
