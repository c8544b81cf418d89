"""GeoJSON feature maps: reading, rejects, storage, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utilnet.functions import geo, rules, text

# Accepted coordinate reference names (longitude, latitude order).
CRS_NAMES = ["urn:ogc:def:crs:OGC:1.3:CRS84", "OGC:CRS84", "EPSG:4326",
             "urn:ogc:def:crs:EPSG::4326"]
MAX_DEPTH = 64  # brackets inside each other
_DEPTHS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _sub(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _is_int(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")


def _points(c: Column) -> Column:
    return F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def _parts(kind: Column, body: Column) -> Column:
    """Coordinates as polygon, ring, vertex, whatever the geometry type."""
    one = F.array(F.from_json(body, "array<double>"))
    line = F.from_json(body, "array<array<double>>")
    rings = F.from_json(body, "array<array<array<double>>>")
    many = F.from_json(body, "array<array<array<array<double>>>>")
    return (F.when(kind == "Point", F.array(F.array(_points(one))))
            .when(kind == "LineString", F.array(F.array(_points(line))))
            .when(kind == "Polygon", F.array(F.transform(rings, _points)))
            .when(kind == "MultiLineString", F.transform(rings, lambda r: F.array(_points(r))))
            .when(kind == "MultiPolygon", F.transform(many, lambda p: F.transform(p, _points))))


def nesting(body: Column) -> Column:
    """How deep the brackets of a JSON text go, those inside its strings left out."""
    bare = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]", "")
    state = F.aggregate(
        F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: _deeper(s, F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)))
    return state["most"]


def _deeper(state: Column, step: Column) -> Column:
    now = state["now"] + step
    return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))


def parse_features(rows: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One feature per row (dataset_id, pos, body JSON text), lifted to columns, with its reject code.

    Geometry stays in the input's degrees; ``project`` turns it to metres. Reserved ``_tt_`` keys
    are dropped and whole-number ids are remembered. A body nested deeper than ``MAX_DEPTH`` is a
    reject, and so is one over ``max_bytes``, if that is given.
    """
    v = F.col("_v")
    kind = F.col("object_type")
    too_large = F.octet_length("body") > max_bytes if max_bytes is not None else F.lit(False)
    deep = F.coalesce(nesting(F.col("body")) > MAX_DEPTH, F.lit(False))
    df = rows.withColumn("_v", F.when(~too_large, F.try_parse_json("body")))
    df = df.withColumn("_p", _sub(v, "$.properties"))
    names = ("id", "oks_id", "upstream_object_id", "diameter", "flow_tph", "heat_load", "height_m",
             "restriction_type", "object_type")
    df = df.select("*", *[_type(_sub(F.col("_p"), f"$.{n}")).alias(f"_k_{n}") for n in names])
    p = F.col("_p")

    def string(name):
        return F.when(F.col(f"_k_{name}") == "STRING", _sub(p, f"$.{name}", "string")).when(
            _is_int(F.col(f"_k_{name}")), _sub(p, f"$.{name}", "string"))

    def number(name):
        return F.when(_is_number(F.col(f"_k_{name}")), _sub(p, f"$.{name}", "double"))

    geom = _sub(v, "$.geometry.type", "string")
    body = F.to_json(_sub(v, "$.geometry.coordinates"))
    df = df.select(
        "dataset_id", "pos", "body", "_v", "_p", *[f"_k_{n}" for n in names],
        string("id").alias("id"), _is_int(F.col("_k_id")).alias("source_id_is_int"),
        F.when(F.col("_k_object_type") == "STRING", _sub(p, "$.object_type", "string"))
         .alias("object_type"),
        string("oks_id").alias("oks_id"), string("upstream_object_id").alias("upstream_object_id"),
        F.when(_is_int(F.col("_k_diameter")), _sub(p, "$.diameter", "int")).alias("diameter"),
        (F.col("_k_diameter") != "MISSING").alias("has_diameter"),
        number("flow_tph").alias("flow_tph"), number("heat_load").alias("heat_load"),
        number("height_m").alias("height_m"),
        F.when(F.col("_k_restriction_type") == "STRING", _sub(p, "$.restriction_type", "string"))
         .alias("restriction_type"),
        F.from_json(F.to_json(p), "map<string,string>").alias("_map"),
        geom.alias("geom_type"), _parts(geom, body).alias("parts"))
    vertices = F.flatten(F.flatten("parts"))
    df = df.withColumn("_vertices", vertices)
    in_range = F.forall("_vertices", lambda c: geo.in_range(c["x"], c["y"]))
    bad_ref = F.lit(False)
    for n in ("id", "oks_id", "upstream_object_id"):
        bad_ref = bad_ref | ((F.col(f"_k_{n}") != "MISSING") & (F.col(f"_k_{n}") != "STRING")
                             & ~_is_int(F.col(f"_k_{n}")))
    reject = (F.when(too_large, "TOO_LARGE").when(deep, "TOO_DEEP")
              .when(F.col("_v").isNull(), "NOT_JSON")
              .when(F.coalesce(_sub(F.col("_v"), "$.type", "string"), F.lit("")) != "Feature", "NOT_FEATURE")
              .when(F.coalesce(~_type(F.col("_p")).startswith("OBJECT"), F.lit(True)), "NO_PROPERTIES")
              .when(kind.isNull(), "NO_OBJECT_TYPE").when(bad_ref, "BAD_REFERENCE")
              .when(F.col("id").isNull(), "NO_ID").when(~text.valid_id(F.col("id")), "BLANK_ID")
              .when(~kind.isin(rules.OBJECT_TYPES), "UNKNOWN_TYPE")
              .when(F.col("parts").isNull() | (F.size("_vertices") == 0), "BAD_GEOMETRY")
              .when(~F.coalesce(in_range, F.lit(False)), "OUT_OF_RANGE"))
    return df.withColumn("reject", reject).withColumn(
        "properties", F.to_json(F.map_filter("_map", lambda k, _: ~k.startswith("_tt_")))).drop(
        "_v", "_p", "_map", "_vertices", *[f"_k_{n}" for n in names])


def project(features: DataFrame) -> DataFrame:
    """Degrees to metres, with the box of each object."""
    def vertex(c):
        x, y = geo.to_utm(c["x"], c["y"])
        return F.struct(x.alias("x"), y.alias("y"))
    out = features.withColumn("parts", F.transform("parts", lambda p: F.transform(
        p, lambda r: F.transform(r, vertex))))
    return add_box(out)


def add_box(features: DataFrame) -> DataFrame:
    flat = F.flatten(F.flatten("parts"))
    out = features.withColumn("_xs", F.transform(flat, lambda c: c["x"])).withColumn(
        "_ys", F.transform(flat, lambda c: c["y"]))
    return out.select("*", F.array_min("_xs").alias("minx"), F.array_min("_ys").alias("miny"),
                      F.array_max("_xs").alias("maxx"), F.array_max("_ys").alias("maxy")).drop("_xs", "_ys")


def explode_collections(raw: DataFrame) -> DataFrame:
    """Whole FeatureCollection texts (dataset_id, value) to one row per feature."""
    spark = raw.sparkSession
    parsed = raw.select("dataset_id", F.try_parse_json("value").alias("v"))
    return spark.sql(
        "SELECT dataset_id, CAST(t.pos AS BIGINT) AS pos, to_json(t.value) AS body FROM {raw}, "
        "LATERAL variant_explode(try_variant_get(v, '$.features', 'variant')) AS t", raw=parsed)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features in metres, rejects). ``lines`` reads newline-delimited features of any file size.

    A feature's ``pos`` is its place in the collection; with ``lines`` it is a hash of the line and,
    for equal lines, of a running number, whichever way the file is split.
    A file that is no readable, non-empty collection is one reject without a position, so that no
    file goes missing.
    """
    files = None
    if lines:
        read = spark.read.text(path).select(F.input_file_name().alias("dataset_id"), F.col("value").alias("body"))
        rows = read.filter(F.trim("body") != "").groupBy("dataset_id", "body").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(
            "dataset_id", F.xxhash64("body", "_copy").alias("pos"), "body")
    else:
        raw = spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("dataset_id"), "value")
        files = check_collection(raw).filter("code IS NOT NULL")
        rows = explode_collections(raw.join(files.select("dataset_id"), "dataset_id", "left_anti"))
    parsed = parse_features(rows)
    good = project(parsed.filter("reject IS NULL").drop("reject", "body"))
    rejects = parsed.filter("reject IS NOT NULL").select("dataset_id", "pos", "reject", "body")
    if files is not None:
        rejects = rejects.unionByName(files.select(
            "dataset_id", F.lit(None).cast("long").alias("pos"), F.col("code").alias("reject"),
            F.lit(None).cast("string").alias("body")))
    return good, rejects


def check_collection(raw: DataFrame) -> DataFrame:
    """Per file: is it a non-empty FeatureCollection in an accepted reference system."""
    v = F.col("_v")
    crs = F.try_variant_get(v, "$.crs.properties.name", "string")
    has_crs = F.try_variant_get(v, "$.crs", "variant").isNotNull()
    first = F.try_variant_get(v, "$.features[0]", "variant")
    df = raw.withColumn("_v", F.try_parse_json("value"))
    code = (F.when(v.isNull(), "NOT_JSON")
            .when(F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")) != "FeatureCollection",
                  "NOT_A_COLLECTION")
            .when(has_crs & ~F.coalesce(crs.isin(CRS_NAMES), F.lit(False)), "UNKNOWN_CRS")
            .when(first.isNull(), "EMPTY_COLLECTION"))
    return df.select("dataset_id", code.alias("code"))


def write_features(features: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by object type; rows of a dataset stay close, so that boxes prune row groups."""
    cell = F.concat_ws(":", F.floor(F.col("minx") / 1024), F.floor(F.col("miny") / 1024))
    (features.withColumn("_cell", cell)
     .repartitionByRange("object_type", "dataset_id", "_cell", "id")
     .sortWithinPartitions("object_type", "dataset_id", "_cell", "id").drop("_cell")
     .write.mode(mode).partitionBy("object_type").parquet(path))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Digest and size of each file, and the first path that holds the same bytes."""
    files = spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256"))
    first = files.groupBy("sha256").agg(F.min("path").alias("first_path"))
    return files.join(first, "sha256").withColumn("duplicate", F.col("path") != F.col("first_path"))


def import_report(features: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Counts per dataset and whether nothing stands in the way of a strict run."""
    errors = diagnostics.groupBy(F.col("dataset_id").alias("_dataset")).agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"))
    return (features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count(F.when(F.col("object_type") == "oks_connection_point", 1)).alias("connection_points"))
        .join(errors, F.col("dataset_id").eqNullSafe(F.col("_dataset")), "left").fillna(0, ["errors"])
        .select("dataset_id", "feature_count", "connection_points",
                (F.col("errors") == 0).alias("strict_ready"),
                F.lit(False).alias("coordinates_changed")))


def ring_segments(features: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Segments of every part and ring (ring 0 is the exterior) with boxes."""
    rings = features.select(*keys, F.col("id").alias("object_id"), F.posexplode("parts").alias("part", "_r"))
    rings = rings.select(*keys, "object_id", "part", F.posexplode("_r").alias("ring", "_path"))
    return geo.explode_segments(rings.withColumnRenamed("_path", "path"))
