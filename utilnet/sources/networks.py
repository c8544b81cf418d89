"""Stored network layouts, priced exports, candidate labels and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.functions import geo, rules, text

_NODE = "struct<id:string,x:double,y:double,type:string,existingId:string,entryId:string>"
_EDGE = "struct<id:string,start:string,end:string,wkt:string>"
SNAPSHOT = f"nodes array<{_NODE}>, edges array<{_EDGE}>"
_CANDIDATE = ("territory long, `group` long, attempt int, candidate int, features array<double>, "
              "lowerBound double, feasible boolean, score double")
_ATTEMPT = "struct<attempt:int,connected:int,required:int,complete:boolean>"
_REPORT = ("territory long, policy string, elapsedMs long, search struct<status:string,"
           "requiredConnections:int,requestedVariants:int,foundVariants:int,bestConnectedCount:int,"
           f"attempts:array<{_ATTEMPT}>,neuralGuidance:struct<requestedPolicy:string,"
           "effectivePolicy:string,candidates:long,targetsSearched:long,prunedByAnalyticalBound:long,"
           "routeSearches:long>>, variants array<struct<construction_cost:double,"
           "calculated_cost:double,new_network_length:double,score:double,rank:int,rating:double>>")


# Names of the summary's facts in exported files.
SUMMARY_FACTS = [
    ("connected", "connected_connection_count", "long"), ("ties", "existing_chamber_tie_in_count", "long"),
    ("tie_cost", "existing_chamber_tie_in_cost", "double"), ("chamber_cost", "chamber_construction_cost", "double"),
    ("new_length", "new_network_length", "double"), ("construction_cost", "construction_cost", "double"),
    ("penalty", "unconnected_penalty", "double"), ("calculated_cost", "calculated_cost", "double"), ("score", "score", "double"),
]


def parse_snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of layout documents (dataset_id, network_id, nodes, edges arrays)."""
    keys = ["dataset_id", "network_id"]
    nodes = docs.select(*keys, F.posexplode("nodes").alias("node_ord", "_n")).select(
        *keys, "node_ord", F.col("_n.id").alias("node_id"), F.col("_n.x").alias("x"), F.col("_n.y").alias("y"),
        F.col("_n.type").alias("node_type"), F.col("_n.existingId").alias("existing_id"),
        F.col("_n.entryId").alias("entry_id"))
    edges = docs.select(*keys, F.posexplode("edges").alias("edge_ord", "_e")).select(
        *keys, "edge_ord", F.col("_e.id").alias("edge_id"), F.col("_e.start").alias("start_id"),
        F.col("_e.end").alias("end_id"), geo.parse_wkt(F.col("_e.wkt")).alias("path"))

    def finite(c):
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))

    def copies(df, name):
        return df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_copies"))

    nodes = nodes.join(copies(nodes, "node_id"), keys + ["node_id"], "left")
    edges = edges.join(copies(edges, "edge_id"), keys + ["edge_id"], "left")
    node_code = (F.when(F.coalesce("node_id", F.lit("")) == "", "EMPTY_ID")
                 .when(F.col("_copies") > 1, "DUPLICATE_NODE")
                 .when(~finite("x") | ~finite("y"), "BAD_COORDINATES"))
    edge_code = (F.when(F.coalesce("edge_id", F.lit("")) == "", "EMPTY_ID")
                 .when(F.col("_copies") > 1, "DUPLICATE_EDGE").when(F.col("path").isNull(), "BAD_GEOMETRY"))
    shape = docs.filter("nodes IS NULL OR edges IS NULL").select(
        *keys, F.lit(None).cast("string").alias("object_id"), F.lit("NOT_A_SNAPSHOT").alias("code"))
    rejects = (nodes.withColumn("code", node_code).filter("code IS NOT NULL")
               .select(*keys, F.col("node_id").alias("object_id"), "code")
               .unionByName(edges.withColumn("code", edge_code).filter("code IS NOT NULL")
                            .select(*keys, F.col("edge_id").alias("object_id"), "code"))
               .unionByName(shape).distinct())
    good_nodes = nodes.filter(node_code.isNull()).drop("_copies")
    good_edges = edges.filter(edge_code.isNull()).drop("_copies").withColumn(
        "length", geo.path_length(F.col("path")))
    return good_nodes, good_edges, rejects


def read_snapshots(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layouts from JSON files that hold one layout or an array of them, or (``lines``) one per line.

    A layout's network_id is its place in its file, so equal layouts stay apart; with ``lines`` it
    is the line's digest and, for equal lines, a running number, whichever way the file is split.
    A file or line that is no layout is a reject.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("dataset_id"), "value")
    held = F.from_json("value", f"array<struct<{SNAPSHOT}>>")
    if lines:
        named = raw.filter(F.trim("value") != "").groupBy("dataset_id", "value").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        docs = named.select("dataset_id", F.concat_ws("-", F.sha2("value", 256), F.col("_copy").cast("string")).alias("network_id"),
                            F.get(held, F.lit(0)).alias("_d"))
    else:
        docs = raw.select("dataset_id", F.posexplode_outer(held).alias("network_id", "_d"))
    return parse_snapshots(docs.select("dataset_id", F.col("network_id").cast("string").alias("network_id"), "_d.nodes", "_d.edges"))


def write_snapshots(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON document per layout, nodes and edges in their stored order.

    A layout is one document by definition, so its rows meet in one row here.
    """
    keys = ["dataset_id", "network_id"]
    n = nodes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "node_ord", F.col("node_id").alias("id"), "x", "y", F.col("node_type").alias("type"),
        F.col("existing_id").alias("existingId"), F.col("entry_id").alias("entryId")))),
        lambda s: s.dropFields("node_ord")).alias("nodes"))
    e = edges.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "edge_ord", F.col("edge_id").alias("id"), F.col("start_id").alias("start"),
        F.col("end_id").alias("end"), geo.path_wkt(F.col("path")).alias("wkt")))),
        lambda s: s.dropFields("edge_ord")).alias("edges"))
    docs = n.join(e, keys, "left").select(
        *keys, F.to_json(F.struct("nodes", "edges"), {"ignoreNullFields": "false"}).alias("value"))
    if path is not None:
        docs.select("value").write.mode("append").text(path)
    return docs


def variant_prefix(features: DataFrame, variant: str, keys: Sequence[str] = ("dataset_id",),
                   id_column: str = "id") -> DataFrame:
    """Prefix ``tt:<variant>:`` with as many leading underscores as make it new to the dataset.

    A prefix with n underscores collides when some id starts with exactly that text, so the answer
    is the smallest n that no id uses.
    """
    run = F.length(F.regexp_extract(id_column, f"^(_*)tt:{variant}:", 1))
    used = features.filter(F.col(id_column).rlike(f"^_*tt:{variant}:")).select(
        *keys, run.alias("n")).distinct()
    order = W.partitionBy(*keys).orderBy("n")
    # Counting up from zero, the first gap is where the rank departs from the count of underscores.
    taken = used.withColumn("_i", F.row_number().over(order) - 1).filter("n = _i").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_taken"))
    return features.select(*keys).distinct().join(taken, list(keys), "left").select(
        *keys, F.concat(F.repeat(F.lit("_"), F.coalesce("_taken", F.lit(0)).cast("int")),
                        F.lit(f"tt:{variant}:")).alias("prefix"))


def export_features(nodes: DataFrame, edges: DataFrame, sections: DataFrame, chambers: DataFrame,
                    prefixes: DataFrame, summary: DataFrame, variant: str = "v1",
                    keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """GeoJSON features of a priced layout, one JSON text per row.

    ``edges`` carries path, flow and dn; ``nodes`` carries node_type, existing_type and out_id (the
    input id of a terminal or old chamber; out_is_int tells whether it was a number); ``chambers``
    is the list of new chambers. Pieces of a pipe are joined by technical nodes. Coordinates are
    degrees; with a depth profile the third coordinate is the negative depth along the piece.
    """
    keys = list(keys)
    has_depth = "h0" in sections.columns
    h0 = F.col("h0") if has_depth else F.lit(None).cast("double")
    h1 = F.col("h1") if has_depth else F.lit(None).cast("double")
    edge = [*keys, "edge_id"]
    # Pieces are numbered by how many of the same pipe start before them.
    from utilnet.operators.kernels import running
    numbered = running(sections.withColumn("_h0", h0).withColumn("_h1", h1), edge, ["s_from"],
                       row_number="_n").withColumn("ordinal", F.col("_n") - 1)
    last = numbered.groupBy(*edge).agg(F.max("ordinal").alias("_last"))

    def number_or_text(column):
        return F.when(F.col(f"{column}_int"), F.col(column)).otherwise(F.to_json(F.struct(
            F.col(column).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(
                F.col(column).alias("v")))) - 6))

    named = nodes.join(prefixes, keys).select(
        *keys, "node_id", F.coalesce("out_id", F.concat("prefix", F.col("node_id").cast("string")))
        .alias("name"),
        (F.col("out_id").isNotNull() & F.coalesce("out_is_int", F.lit(False))).alias("name_int"))
    rows = (numbered.join(last, edge).join(edges.select(*edge, "start_id", "end_id", "path", "flow", "dn"), edge)
            .join(prefixes, keys)
            .join(named.select(*keys, F.col("node_id").alias("start_id"), F.col("name").alias("s_name"),
                               F.col("name_int").alias("s_name_int")), keys + ["start_id"])
            .join(named.select(*keys, F.col("node_id").alias("end_id"), F.col("name").alias("e_name"),
                               F.col("name_int").alias("e_name_int")), keys + ["end_id"]))
    inner = F.col("ordinal") < F.col("_last")
    rows = (rows.withColumn("a", F.when(F.col("ordinal") == 0, F.col("s_name")).otherwise(
                text.break_id(F.col("prefix"), F.col("edge_id"), F.col("ordinal") - 1)))
            .withColumn("a_int", (F.col("ordinal") == 0) & F.col("s_name_int"))
            .withColumn("b", F.when(inner, text.break_id(F.col("prefix"), F.col("edge_id"), F.col("ordinal")))
                        .otherwise(F.col("e_name")))
            .withColumn("b_int", ~inner & F.col("e_name_int")))
    part = geo.sub_line(F.col("path"), F.col("s_from"), F.col("s_to"))
    rows = rows.withColumn("_part", part)

    def lonlat(x, y, h):
        lon, lat = geo.from_utm(x, y)
        return F.when(h.isNotNull(), F.array(lon, lat, -h)).otherwise(F.array(lon, lat))

    measured = F.concat(
        F.array(F.struct(F.get("_part", F.lit(0))["x"].alias("x"), F.get("_part", F.lit(0))["y"].alias("y"),
                         F.lit(0.0).alias("at"))),
        F.transform(geo.measured_segments(F.col("_part")), lambda s: F.struct(
            s["x1"].alias("x"), s["y1"].alias("y"), s["at1"].alias("at"))))
    span = F.col("s_to") - F.col("s_from")
    coords = F.transform(measured, lambda v: lonlat(
        v["x"], v["y"], F.col("_h0") + (F.col("_h1") - F.col("_h0")) * v["at"] / span))
    factor = F.coalesce((rules.depth_factor(F.col("_h0")) + rules.depth_factor(F.col("_h1"))) / 2, F.lit(1.0))
    cost = span * rules.price_new(rules.dn_index(F.col("dn"))) * F.col("factor") * factor

    def feature(kind, coordinates, props):
        geometry = F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))
        return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props,
                        F.lit("}"))

    def ids(props_struct, *pairs):
        """Properties JSON with id fields put in front in their input type."""
        rest = F.to_json(props_struct)
        front = F.concat(*[F.concat(F.lit(f'"{n}":'), number_or_text(c), F.lit(",")) for n, c in pairs])
        return F.concat(F.lit("{"), front, rest.substr(F.lit(2), F.length(rest)))

    pipes = rows.select(*keys, text.part_id(F.col("prefix"), F.col("edge_id"), F.col("ordinal")).alias("id"),
                        F.lit("heat_network").alias("object_type"), feature(
        "LineString", coords, ids(F.struct(
            text.part_id(F.col("prefix"), F.col("edge_id"), F.col("ordinal")).alias("id"),
            F.lit("heat_network").alias("object_type"), F.lit(variant).alias("variant_id"),
            F.col("flow").alias("flow_tph"), F.col("dn").alias("diameter"), span.alias("length"),
            F.col("method").alias("laying_method"), F.col("_h0").alias("depth_start"),
            F.col("_h1").alias("depth_end"), cost.alias("cost")),
            ("start_node_id", "a"), ("end_node_id", "b"))).alias("value"))
    tail = F.element_at("_part", -1)
    breaks = rows.filter(inner).select(*keys, F.col("b").alias("id"), F.lit("technical_node").alias("object_type"),
                                       feature("Point", lonlat(tail["x"], tail["y"], F.col("_h1")), F.to_json(F.struct(
        F.col("b").alias("id"), F.lit("technical_node").alias("object_type"),
        F.lit(variant).alias("variant_id")))).alias("value"))
    depth = F.col("depth") if "depth" in nodes.columns else F.lit(None).cast("double")
    cams = (chambers.join(nodes.select(*keys, "node_id", "x", "y", depth.alias("depth")), keys + ["node_id"])
            .join(prefixes, keys).withColumn("id", F.concat("prefix", F.col("node_id").cast("string"))))
    cams = cams.select(*keys, "id", F.lit("heat_chamber").alias("object_type"), feature(
        "Point", lonlat(F.col("x"), F.col("y"), F.col("depth")), F.to_json(F.struct(
            "id", F.lit("heat_chamber").alias("object_type"), F.lit(variant).alias("variant_id"),
            F.col("chamber_dn").alias("diameter"), "cost"))).alias("value"))
    facts = [c for c in summary.columns if c not in keys]
    total = summary.join(prefixes, keys).withColumn("id", F.concat("prefix", F.lit("summary")))
    total = total.select(*keys, "id", F.lit("variant_summary").alias("object_type"), F.concat(
        F.lit('{"type":"Feature","geometry":null,"properties":'), F.to_json(F.struct(
            "id", F.lit("variant_summary").alias("object_type"), F.lit(variant).alias("variant_id"), *facts)),
        F.lit("}")).alias("value"))
    return pipes.unionByName(breaks).unionByName(cams).unionByName(total)


def typed_id(value: Column, whole: Column) -> Column:
    """One text for ids that are texts or whole numbers: 5 is ``#5``, and no text looks like it."""
    return F.when(whole, F.concat(F.lit("#"), value)).when(value.startswith("#"), F.concat(F.lit("#"), value)).otherwise(value)


def read_export(lines: DataFrame) -> DataFrame:
    """Exported GeoJSON features (dataset_id, value) as objects, nothing of them taken on trust.

    Ids are ``typed_id`` texts. ``path`` holds the vertices in degrees (one for a point), ``summary``
    the facts of a variant summary. What is missing or of another type is NULL; text that is no JSON
    has nothing but NULLs beside its dataset_id.
    """
    p = F.col("_p")

    def sub(name: str, kind: str) -> Column:
        return F.try_variant_get(p, f"$.{name}", kind)

    def any_id(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
        return F.when(whole | (kind == "STRING"), typed_id(F.try_variant_get(v, "$", "string"), whole))

    rows = lines.withColumn("_v", F.try_parse_json("value")).withColumn("_p", F.try_variant_get("_v", "$.properties", "variant"))
    kind = F.try_variant_get("_v", "$.geometry.type", "string")
    body = F.to_json(F.try_variant_get("_v", "$.geometry.coordinates", "variant"))
    vertices = F.when(kind == "Point", F.array(F.from_json(body, "array<double>"))).when(
        kind == "LineString", F.from_json(body, "array<array<double>>"))
    path = F.transform(vertices, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))
    facts = F.struct(*[sub(n, t).alias(c) for c, n, t in SUMMARY_FACTS],
                     F.transform(sub("unconnected_oks_ids", "array<variant>"), any_id).alias("unconnected"))
    return rows.select(
        "dataset_id", sub("variant_id", "string").alias("variant_id"), any_id(sub("id", "variant")).alias("id"),
        sub("object_type", "string").alias("object_type"), any_id(sub("start_node_id", "variant")).alias("start_id"),
        any_id(sub("end_node_id", "variant")).alias("end_id"), sub("flow_tph", "double").alias("flow"), sub("diameter", "int").alias("dn"),
        sub("length", "double").alias("length"), sub("laying_method", "string").alias("method"), sub("cost", "double").alias("cost"),
        path.alias("path"), F.when(sub("object_type", "string") == "variant_summary", facts).alias("summary"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Candidate label lines with the file they came from."""
    return spark.read.schema(_CANDIDATE).json(path).withColumn("file", F.input_file_name())


def check_labels(labels: DataFrame, reports: DataFrame) -> DataFrame:
    """Territories whose label count differs from what their report states, or lack one of the two."""
    have = labels.groupBy("territory").agg(F.count(F.lit(1)).alias("rows"),
                                           F.count(F.when(F.col("feasible") & (
                                               F.col("lowerBound") > F.col("score") + 1e-6), 1)).alias("inadmissible"))
    want = reports.select("territory", F.col("candidates").alias("expected"))
    return have.join(want, "territory", "full").withColumn(
        "code", F.when(F.col("rows").isNull(), "NO_ROWS").when(F.col("expected").isNull(), "NO_REPORT")
        .when(F.col("rows") != F.col("expected"), "INCOMPLETE")
        .when(F.col("inadmissible") > 0, "INADMISSIBLE_BOUND")).filter("code IS NOT NULL")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per run with its guidance counters, attempts, variants) of nested run reports."""
    raw = spark.read.schema(_REPORT).option("multiLine", True).json(path)
    runs = raw.select("territory", "policy", "elapsedMs", "search.status", "search.requiredConnections",
                      "search.foundVariants", "search.bestConnectedCount", "search.neuralGuidance.candidates",
                      "search.neuralGuidance.targetsSearched", "search.neuralGuidance.prunedByAnalyticalBound")
    attempts = raw.select("territory", F.explode_outer("search.attempts").alias("_a")).select(
        "territory", "_a.*")
    variants = raw.select("territory", F.explode_outer("variants").alias("_v")).select("territory", "_v.*")
    return runs, attempts, variants
