"""Stored layouts, exports and streams built from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from utilnet.operators import evaluate, graph
from utilnet.plans import bridge
from utilnet.plans.bridge import sql, table
from utilnet.plans.evaluate_queries import NET_SQL, net
from utilnet.plans.learn_queries import _RUN
from utilnet.plans.registry import query
from utilnet.session import shared_folder
from utilnet.sources import networks as src
from utilnet.streaming import jobs


def documents(spark, d):
    """The trees as layout documents; some repeat a node, lose a coordinate or carry a point."""
    n = net(spark, d)
    twice = n.filter("src % 97 = 11").select("*")
    rows = n.unionByName(twice).select(
        "dataset_id", F.struct(F.col("node_id").cast("string").alias("id"),
                               F.when(F.col("src") % 89 != 3, F.col("x")).alias("x"), "y",
                               F.col("node_type").alias("type"), F.lit(None).cast("string").alias("existingId"),
                               F.col("entry_id").cast("string").alias("entryId")).alias("n"))
    e = bridge.edges(spark, d)
    wkt = F.when(F.col("edge_id") % 17 == 5, F.lit("POINT (1 2)")).otherwise(F.concat(
        F.lit("LINESTRING ("), F.concat_ws(" ", "x0", "y0"), F.lit(", "), F.concat_ws(" ", "x1", "y1"), F.lit(")")))
    lines = e.select("dataset_id", F.struct(
        F.col("edge_id").cast("string").alias("id"), F.col("start_id").cast("string").alias("start"),
        F.col("end_id").cast("string").alias("end"), wkt.alias("wkt")).alias("e"))
    return (rows.groupBy("dataset_id").agg(F.collect_list("n").alias("nodes"))
            .join(lines.groupBy("dataset_id").agg(F.collect_list("e").alias("edges")), "dataset_id")
            .withColumn("network_id", F.lit("n")))


@query("snapshot_rejects", sql("""SELECT dataset_id, node_id::VARCHAR AS object_id, 'DUPLICATE_NODE' AS code FROM fx_nodes WHERE src % 97 = 11
  UNION ALL SELECT dataset_id, node_id::VARCHAR, 'BAD_COORDINATES' FROM fx_nodes WHERE src % 89 = 3 AND src % 97 <> 11
  UNION ALL SELECT dataset_id, edge_id::VARCHAR, 'BAD_GEOMETRY' FROM fx_edges WHERE edge_id % 17 = 5""", "fx_edges"))
def snapshot_rejects(spark, d):
    return src.parse_snapshots(documents(spark, d))[2].select("dataset_id", "object_id", "code")


@query("snapshot_edges", sql("""SELECT dataset_id, edge_id::VARCHAR AS edge_id, start_id::VARCHAR AS start_id, round(length, 6) AS length
  FROM fx_edges WHERE edge_id % 17 <> 5""", "fx_edges"))
def snapshot_edges(spark, d):
    return src.parse_snapshots(documents(spark, d))[1].select(
        "dataset_id", "edge_id", "start_id", F.round("length", 6).alias("length"))


@query("snapshot_round_trip", sql("""SELECT dataset_id, count(*) AS edges, round(sum(length), 4) AS length FROM fx_edges
  WHERE edge_id % 17 <> 5 GROUP BY 1""", "fx_edges"))
def snapshot_round_trip(spark, d):
    """Written as text and read again: nothing about the edges changes."""
    nodes, edges, _ = src.parse_snapshots(documents(spark, d))
    docs = src.write_snapshots(nodes, edges).select("dataset_id", "network_id", F.from_json(
        "value", src.SNAPSHOT).alias("d")).select("dataset_id", "network_id", "d.*")
    back = src.parse_snapshots(docs)[1]
    return back.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("edges"),
                                          F.round(F.sum("length"), 4).alias("length"))


@query("snapshot_files", sql("""SELECT edge_id % 7 AS bucket, 2 * count(*) AS edges, round(2 * sum(length), 3) AS length
  FROM fx_edges WHERE edge_id % 17 <> 5 GROUP BY 1 UNION ALL SELECT -1, 1, 0.0""", "fx_edges"))
def snapshot_files(spark, d):
    """Every layout twice, in files of one array each beside one broken file: nothing is lost or merged."""
    nodes, edges, _ = src.parse_snapshots(documents(spark, d))
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    text = src.write_snapshots(nodes, edges).select(
        F.col("dataset_id").alias("k"), F.concat(F.lit("["), "value", F.lit(","), "value", F.lit("]")).alias("value"))
    broken = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("[{\"nodes\":").alias("value"))
    text.unionByName(broken).repartition("k").write.partitionBy("k").text(folder)
    _, back, rejects = src.read_snapshots(spark, f"{folder}/*")
    lost = rejects.filter("code = 'NOT_A_SNAPSHOT'").agg(
        F.lit(-1).cast("long").alias("bucket"), F.count(F.lit(1)).alias("edges"), F.lit(0.0).alias("length"))
    return back.groupBy((F.col("edge_id").cast("long") % 7).alias("bucket")).agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.sum("length"), 3).alias("length")).unionByName(lost)


@query("variant_prefixes", """SELECT o_custkey AS dataset_id, CASE WHEN NOT bool_or(o_orderkey % 3 = 0) THEN 'tt:v1:'
  WHEN NOT bool_or(o_orderkey % 3 = 1) THEN '_tt:v1:' WHEN NOT bool_or(o_orderkey % 15 = 2) THEN '__tt:v1:' ELSE '___tt:v1:' END AS prefix
  FROM orders GROUP BY 1""")
def variant_prefixes(spark, d):
    k = F.col("o_orderkey")
    bars = F.when(k % 3 == 0, "").when(k % 3 == 1, "_").when(k % 15 == 2, "__").otherwise("x")
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"), F.concat(
        bars, F.lit("tt:v1:"), k.cast("string")).alias("id"))
    return src.variant_prefix(ids, "v1")


_EXP = {**NET_SQL, "cam": "SELECT * FROM net WHERE node_type = 'chamber' OR existing_type = 'heat_network'"}


@query("export_objects", sql("""SELECT dataset_id, 'heat_network' AS object_type, 2 * count(*) AS n, round(sum(length), 2) AS length FROM fx_edges GROUP BY 1
  UNION ALL SELECT dataset_id, 'technical_node', count(*), NULL FROM fx_edges GROUP BY 1
  UNION ALL SELECT dataset_id, 'heat_chamber', count(*), NULL FROM cam GROUP BY 1
  UNION ALL SELECT DISTINCT dataset_id, 'variant_summary', 1, NULL FROM fx_edges""", "fx_edges", extra=_EXP))
def export_objects(spark, d):
    """Every pipe in two pieces, exported as GeoJSON text and counted from that text."""
    n, e = net(spark, d), bridge.with_path(bridge.edges(spark, d))
    sized = graph.flows(n, e)
    half = F.col("length") / 2
    pieces = e.select("dataset_id", "edge_id", F.explode(F.array(
        F.struct(F.lit(0.0).alias("s_from"), half.alias("s_to")),
        F.struct(half.alias("s_from"), F.col("length").alias("s_to")))).alias("_s")).select(
        "dataset_id", "edge_id", "_s.*", F.lit(1.0).alias("factor"), F.lit("base").alias("method"))
    named = n.withColumn("out_id", F.col("entry_id").cast("string")).withColumn("out_is_int", F.lit(True))
    prefix = n.select("dataset_id").distinct().withColumn("prefix", F.lit("tt:v1:"))
    summary = sized.groupBy("dataset_id").agg(F.sum("length").alias("new_network_length"))
    out = src.export_features(named, sized, pieces, evaluate.new_chambers(n, sized), prefix, summary)
    body = F.from_json("value", "struct<properties:struct<object_type:string,length:double>>")
    return out.select("dataset_id", body.alias("b")).groupBy(
        "dataset_id", F.col("b.properties.object_type").alias("object_type")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("b.properties.length"), 2).alias("length"))


@query("label_completeness", """SELECT l_orderkey % 500 AS territory, CASE WHEN l_orderkey % 500 % 7 = 0 THEN 'NO_REPORT' ELSE 'INCOMPLETE' END AS code
  FROM lineitem WHERE l_orderkey % 500 % 7 = 0 OR l_orderkey % 500 % 11 = 3 GROUP BY 1, 2""")
def label_completeness(spark, d):
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("territory"), (F.col("l_returnflag") != "R").alias("feasible"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lowerBound"),
        F.col("l_extendedprice").alias("score"))
    extra = F.when(F.col("territory") % 11 == 3, 1).otherwise(0)
    reports = rows.filter("territory % 7 <> 0").groupBy("territory").agg(F.count(F.lit(1)).alias("n")).select(
        "territory", (F.col("n") + extra).alias("candidates"))
    return src.check_labels(rows, reports).select("territory", "code")


def _run_stream(spark, rows, mode="append"):
    """Run a stream to its present end into a table of the shared folder and read that."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        job = rows.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        job = rows.writeStream.outputMode(mode).foreachBatch(
            lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out"))
    job.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")


@query("live_running_best", sql("SELECT job_id, event_id, attempt, best_so_far, improved FROM i", "fx_attempts", extra=_RUN))
def live_running_best(spark, d):
    rows = _event_stream(spark, d).select(
        F.col("user_id").alias("job_id"), "ts", "event_id", (F.col("event_type") != "error").alias("complete"),
        F.col("value").alias("score"))
    return _run_stream(spark, jobs.live_best(rows)).select("job_id", "event_id", "attempt", "best_so_far", "improved")


@query("live_job_status", """SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status,
  arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def live_job_status(spark, d):
    rows = _event_stream(spark, d).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"),
                                          F.struct("ts", "event_id").alias("updated"))
    return _run_stream(spark, jobs.live_status(rows), "complete").select(
        "job_id", "status", F.col("updated.event_id").alias("event_id"))
