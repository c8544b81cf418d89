"""Ingest and quality on feature texts that Spark builds from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from utilnet.functions import rules
from utilnet.operators import quality
from utilnet.plans import bridge
from utilnet.plans.bridge import table
from utilnet.plans.registry import query
from utilnet.session import cut, shared_folder
from utilnet.sources import features as src


def feature_texts(spark, d):
    """Every customer as a point, every part as a box: some rows broken in regular ways."""
    k = F.col("c_custkey")
    lon, lat = 37 + (k % 1000) / 1000.0, F.when(k % 31 == 4, -5.0).otherwise(55 + (k % 700) / 1000.0)
    kind = F.when(k % 40 == 0, "source").when(k % 23 == 5, "well").otherwise("oks_connection_point")
    pid = F.when(k % 3 == 0, k.cast("string")).when(k % 29 == 1, F.lit("[1]")).otherwise(
        F.concat(F.lit('"c'), k.cast("string"), F.lit('"')))
    flow = F.when(k % 7 == 3, F.lit('"x"')).otherwise((k % 20).cast("string"))
    head = F.when(k % 37 == 2, "Thing").otherwise("Feature")
    points = table(spark, d, "customer").select(
        bridge.div(k, 40).alias("dataset_id"), k.alias("pos"), F.concat(
            F.when(k % 41 == 7, "{").otherwise(""), F.lit('{"type":"'), head, F.lit('","geometry":{"type":"Point","coordinates":['), lon.cast("string"),
            F.lit(","), lat.cast("string"), F.lit(']},"properties":{"id":'), pid, F.lit(',"object_type":"'), kind,
            F.lit('","flow_tph":'), flow, F.lit(',"_tt_x":1}}')).alias("body"))
    p = F.col("p_partkey")
    x, y = 37 + (p % 900) / 1000.0, 55 + (p % 800) / 1000.0
    rule = F.get(F.array(*[F.lit(r[0]) for r in rules.RESTRICTIONS[:6]], F.lit("swamp")), (p % 7).cast("int"))

    def at(dx, dy):
        return F.concat(F.lit("["), (x + dx).cast("string"), F.lit(","), (y + dy).cast("string"), F.lit("]"))

    # Every eleventh ring is a bow tie, every thirteenth stays open.
    bow = p % 11 == 3
    ring = F.concat_ws(",", at(0, 0), F.when(bow, at(0.001, 0.001)).otherwise(at(0.001, 0)),
                       F.when(bow, at(0.001, 0)).otherwise(at(0.001, 0.001)), at(0, 0.001),
                       F.when(p % 13 != 5, at(0, 0)))
    boxes = table(spark, d, "part").select(
        bridge.div(p, 40).alias("dataset_id"), (p + 1000000000).alias("pos"), F.concat(
            F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring,
            F.lit(']]},"properties":{"id":"p'), p.cast("string"), F.lit('","object_type":"restriction",'
                                                                       '"restriction_type":"'), rule,
            F.lit('"}}')).alias("body"))
    return points.unionByName(boxes)


_REJECT = """CASE WHEN c_custkey % 41 = 7 THEN 'NOT_JSON' WHEN c_custkey % 37 = 2 THEN 'NOT_FEATURE'
  WHEN c_custkey % 3 <> 0 AND c_custkey % 29 = 1 THEN 'BAD_REFERENCE'
  WHEN c_custkey % 40 <> 0 AND c_custkey % 23 = 5 THEN 'UNKNOWN_TYPE'
  WHEN c_custkey % 31 = 4 THEN 'OUT_OF_RANGE' END"""


def parsed(spark, d):
    """Parsed once, by all tasks: a filter on the result would else be pushed below the parsing and repeat it for every column."""
    return cut(src.parse_features(feature_texts(spark, d).repartition("dataset_id", "pos")))


@query("feature_rejects", f"""SELECT c_custkey // 40 AS dataset_id, c_custkey AS pos, {_REJECT} AS reject FROM customer
  WHERE {_REJECT} IS NOT NULL""")
def feature_rejects(spark, d):
    return parsed(spark, d).filter("reject IS NOT NULL").select("dataset_id", "pos", "reject")


@query("feature_rows", f"""SELECT c_custkey // 40 AS dataset_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR
  ELSE 'c' || c_custkey END AS id, c_custkey % 3 = 0 AS source_id_is_int, CASE WHEN c_custkey % 40 = 0 THEN 'source'
  ELSE 'oks_connection_point' END AS object_type, CASE WHEN c_custkey % 7 <> 3 THEN (c_custkey % 20)::DOUBLE END AS flow_tph
  FROM customer WHERE {_REJECT} IS NULL""")
def feature_rows(spark, d):
    return parsed(spark, d).filter("reject IS NULL AND geom_type = 'Point'").select(
        "dataset_id", "id", "source_id_is_int", "object_type", "flow_tph")


# One collection file per nation, broken in a way that goes by its key.
_FILE = {0: "NOT_JSON", 1: "NOT_A_COLLECTION", 2: "UNKNOWN_CRS", 3: "EMPTY_COLLECTION"}


def collections(spark, d):
    k = F.col("n_nationkey")
    deep = F.when(k % 6 == 4, F.concat(F.repeat(F.lit("["), 70), F.repeat(F.lit("]"), 70))).otherwise(F.lit("1"))
    point = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[37.5,55.5]},"properties":{"id":"n'),
                     k.cast("string"), F.lit('","object_type":"source","note":"[[\\"{","more":'), deep, F.lit("}}"))
    text = (F.when(k % 6 == 0, '{"type":"FeatureColl')
            .when(k % 6 == 1, F.concat(F.lit('{"type":"Topology","features":['), point, F.lit("]}")))
            .when(k % 6 == 2, F.concat(F.lit('{"type":"FeatureCollection","crs":{"properties":{"name":"EPSG:3857"}},"features":['), point, F.lit("]}")))
            .when(k % 6 == 3, '{"type":"FeatureCollection","features":[]}')
            .otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":['), point, F.lit(","), point, F.lit("]}"))))
    return table(spark, d, "nation").select(k.alias("dataset_id"), text.alias("value"))


@query("collection_checks", f"""SELECT n_nationkey::BIGINT AS dataset_id, CASE n_nationkey % 6
  {" ".join(f"WHEN {k} THEN '{c}'" for k, c in _FILE.items())} END AS code FROM nation""")
def collection_checks(spark, d):
    return src.check_collection(collections(spark, d)).select(F.col("dataset_id").cast("long").alias("dataset_id"), "code")


@query("read_round_trip", f"""SELECT n_nationkey::BIGINT AS dataset_id, 2 AS n, CASE n_nationkey % 6
  WHEN 4 THEN 'TOO_DEEP' END AS reject FROM nation WHERE n_nationkey % 6 IN (4, 5) UNION ALL
  SELECT n_nationkey, 1, CASE n_nationkey % 6 {" ".join(f"WHEN {k} THEN '{c}'" for k, c in _FILE.items())} END
  FROM nation WHERE n_nationkey % 6 < 4""")
def read_round_trip(spark, d):
    """Files in the shared folder, read back: every one gives features or a reject."""
    folder = f"{shared_folder(spark)}/collections-{uuid.uuid4().hex}"
    collections(spark, d).withColumnRenamed("dataset_id", "k").repartition("k").write.partitionBy("k").text(folder)
    good, bad = src.read_features(spark, f"{folder}/*")
    rows = good.select("dataset_id", F.lit(None).cast("string").alias("reject")).unionByName(bad.select("dataset_id", "reject"))
    key = F.regexp_extract("dataset_id", r"k=(\d+)/", 1).cast("long")
    return rows.groupBy(key.alias("dataset_id"), "reject").agg(F.count(F.lit(1)).cast("int").alias("n"))


def features(spark, d):
    return cut(src.add_box(parsed(spark, d).filter("reject IS NULL").drop("reject", "body")))


@query("geometry_violations", """SELECT p_partkey // 40 AS dataset_id, 'p' || p_partkey AS object_id, 'RING_NOT_CLOSED' AS code
  FROM part WHERE p_partkey % 13 = 5 UNION ALL SELECT p_partkey // 40, 'p' || p_partkey, 'SELF_INTERSECTION' FROM part
  WHERE p_partkey % 11 = 3 AND p_partkey % 13 <> 5""")
def geometry_violations(spark, d):
    """An open bow tie is only open: the side that would cross is the one that is missing."""
    return quality.geometry_violations(features(spark, d))


@query("feature_violations", f"""SELECT dataset_id, id AS object_id, 'BAD_FLOW' AS rule_code FROM (
  SELECT c_custkey // 40 AS dataset_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE 'c' || c_custkey END AS id
  FROM customer WHERE {_REJECT} IS NULL AND c_custkey % 40 <> 0 AND (c_custkey % 7 = 3 OR c_custkey % 20 = 0))
  UNION ALL SELECT p_partkey // 40, 'p' || p_partkey, 'UNKNOWN_RESTRICTION' FROM part WHERE p_partkey % 7 = 6""")
def feature_violations(spark, d):
    return quality.feature_violations(features(spark, d)).select("dataset_id", "object_id", "rule_code")


@query("demand_view", f"""SELECT c_custkey // 40 AS dataset_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR
  ELSE 'c' || c_custkey END AS demand_id, CASE WHEN c_custkey % 7 <> 3 THEN (c_custkey % 20)::DOUBLE END AS flow,
  c_custkey % 7 = 3 OR c_custkey % 20 = 0 AS invalid FROM customer WHERE {_REJECT} IS NULL AND c_custkey % 40 <> 0""")
def demand_view(spark, d):
    return quality.demands(features(spark, d)).select("dataset_id", "demand_id", "flow", "invalid")


@query("diagnostics", f"""SELECT dataset_id, code, count(*) AS n FROM (
  SELECT c_custkey // 40 AS dataset_id, 'INVALID_FEATURE' AS code FROM customer WHERE {_REJECT} IS NULL
    AND c_custkey % 40 <> 0 AND (c_custkey % 7 = 3 OR c_custkey % 20 = 0) UNION ALL
  SELECT p_partkey // 40, 'INVALID_FEATURE' FROM part WHERE p_partkey % 7 = 6 OR p_partkey % 13 = 5 OR p_partkey % 11 = 3 UNION ALL
  SELECT p_partkey // 40, 'UNSPECIFIED_RESTRICTION' FROM part WHERE p_partkey % 7 = 6 UNION ALL
  SELECT p_partkey // 40, 'INVALID_GEOMETRY' FROM part WHERE p_partkey % 13 = 5 OR p_partkey % 11 = 3 UNION ALL
  SELECT DISTINCT c_custkey // 40, 'INVALID_DEMAND' FROM customer WHERE {_REJECT} IS NULL
    AND c_custkey % 40 <> 0 AND (c_custkey % 7 = 3 OR c_custkey % 20 = 0) UNION ALL
  SELECT dataset_id, 'SOURCE_COUNT' FROM (SELECT c_custkey // 40 AS dataset_id, c_custkey % 40 = 0 AND {_REJECT} IS NULL AS s
    FROM customer WHERE {_REJECT} IS NULL UNION ALL SELECT p_partkey // 40, false FROM part) GROUP BY 1 HAVING count(*) FILTER (s) <> 1 UNION ALL
  SELECT dataset_id, 'NO_DEMAND' FROM (SELECT c_custkey // 40 AS dataset_id, c_custkey % 40 <> 0 AS s
    FROM customer WHERE {_REJECT} IS NULL UNION ALL SELECT p_partkey // 40, false FROM part) GROUP BY 1 HAVING count(*) FILTER (s) = 0)
  GROUP BY 1, 2""")
def diagnostics(spark, d):
    return quality.diagnose(features(spark, d)).groupBy("dataset_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("import_report", f"""SELECT dataset_id, count(*) AS feature_count, count(*) FILTER (s = 1) AS connection_points,
  NOT bool_or(bad) AND count(*) FILTER (s = 0) = 1 AND count(*) FILTER (s = 1) > 0 AS strict_ready, false AS coordinates_changed FROM (
  SELECT c_custkey // 40 AS dataset_id, (c_custkey % 40 <> 0)::INT AS s, c_custkey % 40 <> 0 AND (c_custkey % 7 = 3 OR c_custkey % 20 = 0) AS bad
  FROM customer WHERE {_REJECT} IS NULL UNION ALL
  SELECT p_partkey // 40, 2, p_partkey % 7 = 6 OR p_partkey % 13 = 5 OR p_partkey % 11 = 3 FROM part) GROUP BY 1""")
def import_report(spark, d):
    f = features(spark, d)
    return src.import_report(f, quality.diagnose(f))


@query("duplicate_ids", """SELECT dataset_id, id, count(*) AS copies FROM (SELECT o_custkey AS dataset_id,
  (o_orderkey % 5)::VARCHAR AS id FROM orders) GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_ids(spark, d):
    return quality.duplicate_ids(table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), (F.col("o_orderkey") % 5).cast("string").alias("id")))


@query("scenario_overlay", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 7 = 6 THEN
  'prohibited_site' ELSE ({[r[0] for r in rules.RESTRICTIONS[:6]]})[p_partkey % 7 + 1] END END AS restriction_type,
  CASE WHEN p_partkey % 3 <> 0 THEN round(CASE WHEN p_partkey % 5 = 0 THEN ({rules.CAPACITY})[p_partkey % 18 + 1] * 0.4
  ELSE p_size END, 6)::DOUBLE END AS flow_tph FROM part""")
def scenario_overlay(spark, d):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(r[0]) for r in rules.RESTRICTIONS[:6]], F.lit("swamp"))
    rows = table(spark, d, "part").select(
        bridge.div(k, 40).alias("dataset_id"), k.alias("id"),
        F.when(k % 3 == 0, "restriction").otherwise("heat_network").alias("object_type"),
        F.when(k % 3 == 0, F.get(names, (k % 7).cast("int"))).alias("restriction_type"),
        F.when(k % 3 != 0, rules.dn_of((k % 18).cast("int"))).alias("diameter"),
        F.when((k % 3 != 0) & (k % 5 != 0), F.col("p_size").cast("double")).alias("flow_tph"))
    return quality.scenario(rows, 40.0).select("id", "restriction_type", F.round("flow_tph", 6).alias("flow_tph"))
