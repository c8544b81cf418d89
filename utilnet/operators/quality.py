"""Per-feature rules, diagnostics, gates and scenario overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.functions import geo, rules, text
from utilnet.operators import spatial
from utilnet.operators.ordering import top_k
from utilnet.session import cut
from utilnet.sources.features import ring_segments

_AREAS = ["Polygon", "MultiPolygon"]
_LINES = ["LineString", "MultiLineString"]
SCENARIO_BLOCKERS = ["INVALID_GEOMETRY", "INVALID_DEMAND", "NO_DEMAND", "SOURCE_COUNT",
                     "UNKNOWN_UPSTREAM", "DIAGNOSTICS_TRUNCATED"]


def _known_dn():
    return F.coalesce(F.col("diameter").isin(rules.DN), F.lit(False))


def feature_violations(features: DataFrame) -> DataFrame:
    """One row per broken rule of a single feature: dataset_id, object_id, rule_code."""
    kind, geom = F.col("object_type"), F.col("geom_type")
    area_rules = [r[0] for r in rules.RESTRICTIONS if r[2]]
    line_rules = [r[0] for r in rules.RESTRICTIONS if not r[2] and r[0] != "heat_network"]
    rule = F.coalesce("restriction_type", F.lit(""))
    flow, load = F.col("flow_tph"), F.col("heat_load")
    has_flow = flow.isNotNull() & ~F.isnan("flow_tph")
    checks = [
        ("BAD_ID", ~text.valid_id(F.col("id"))),
        ("UNKNOWN_TYPE", ~kind.isin(rules.OBJECT_TYPES)),
        ("GEOMETRY_TYPE", kind.isin("source", "heat_chamber", "oks_connection_point") & (geom != "Point")),
        ("GEOMETRY_TYPE", (kind == "heat_network") & (geom != "LineString")),
        ("GEOMETRY_TYPE", kind.isin("oks_future", "oks_existing") & ~geom.isin(_AREAS)),
        ("UNKNOWN_RESTRICTION", (kind == "restriction") & ~rule.isin(area_rules + line_rules)),
        ("GEOMETRY_TYPE", (kind == "restriction") & rule.isin(area_rules) & ~geom.isin(_AREAS)),
        ("GEOMETRY_TYPE", (kind == "restriction") & rule.isin(line_rules) & ~geom.isin(_LINES)),
        ("EMPTY_LINE", (kind == "heat_network") & (geom == "LineString")
         & (F.coalesce(geo.path_length(F.get(F.get("parts", F.lit(0)), F.lit(0))), F.lit(0.0)) <= 0)),
        ("BAD_DIAMETER", (kind == "heat_network") & ~_known_dn()),
        ("BAD_DIAMETER", (kind == "heat_chamber") & F.col("has_diameter") & ~_known_dn()),
        ("BAD_FLOW", (kind == "heat_network") & has_flow & (flow < 0)),
        ("BAD_FLOW", (kind == "oks_future") & ~F.coalesce(has_flow & (flow > 0), F.lit(False))),
        ("BAD_FLOW", (kind == "oks_connection_point") & ~F.coalesce(has_flow & (flow > 0), F.lit(False))),
        ("BAD_HEAT_LOAD", (kind == "oks_future") & ~F.coalesce(load >= 0, F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks]))
    return features.select("dataset_id", F.col("id").alias("object_id"), "object_type",
                           F.explode(found).alias("rule_code"))


def geometry_violations(features: DataFrame) -> DataFrame:
    """Open rings, rings with too few points, and rings that cross themselves or another ring.

    Crossing is found by a self-join of the segments of one object through the grid. Holes nested
    in holes are not examined.
    """
    areas = features.filter(F.col("geom_type").isin(_AREAS))
    rings = areas.select("dataset_id", F.col("id").alias("object_id"), F.explode(F.flatten("parts")).alias("r"))
    first, last = F.get("r", F.lit(0)), F.element_at("r", -1)
    shape = rings.withColumn("code", F.when(F.size("r") < 4, "TOO_FEW_POINTS").when(
        (first["x"] != last["x"]) | (first["y"] != last["y"]), "RING_NOT_CLOSED")).filter(
        "code IS NOT NULL").select("dataset_id", "object_id", "code")
    segs = ring_segments(areas).filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    last_seq = segs.groupBy("dataset_id", "object_id", "part", "ring").agg(F.max("seq").alias("last_seq"))
    segs = cut(segs.join(last_seq, ["dataset_id", "object_id", "part", "ring"]))
    keys = ["dataset_id", "object_id"]
    a, b = [F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]
    t, u = geo.crossing(*a, *b)
    same_ring = (F.col("a_part") == F.col("b_part")) & (F.col("a_ring") == F.col("b_ring"))
    later = (F.struct("a_part", "a_ring", "a_seq") < F.struct("b_part", "b_ring", "b_seq"))
    neighbours = same_ring & ((F.col("b_seq") - F.col("a_seq") == 1)
                              | ((F.col("a_seq") == 0) & (F.col("b_seq") == F.col("a_last_seq"))))
    proper = (t > 1e-12) & (t < 1 - 1e-12) & (u > 1e-12) & (u < 1 - 1e-12)
    # Touching inside one ring pinches it; different rings may share a point.
    touch = same_ring & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossed = (spatial.bbox_join(segs, segs, 0.0, keys=keys).filter(later & ~neighbours & F.coalesce(
        proper | touch, F.lit(False))).select(*keys, F.lit("SELF_INTERSECTION").alias("code")).distinct())
    return shape.unionByName(crossed)


def demands(features: DataFrame) -> DataFrame:
    """Each connection point is its own demand; its building is the one it names, else itself."""
    points = features.filter("object_type = 'oks_connection_point'")
    ok = F.coalesce((F.col("flow_tph") > 0) & (F.abs("flow_tph") < float("inf")), F.lit(False))
    return points.select("dataset_id", F.col("id").alias("demand_id"), F.col("flow_tph").alias("flow"),
                         F.when(F.trim(F.coalesce("oks_id", F.lit(""))) != "", F.col("oks_id"))
                         .otherwise(F.col("id")).alias("building_id"), (~ok).alias("invalid"))


def diagnose(features: DataFrame) -> DataFrame:
    """All findings per dataset: object_id, code, severity. A bad geometry also makes its feature invalid."""
    kind = F.col("object_type")
    pipe = kind.isin("heat_network", "heat_chamber")

    def rows(df, code, severity):
        return df.select("dataset_id", F.col("id").alias("object_id"), F.lit(code).alias("code"),
                         severity.alias("severity") if not isinstance(severity, str)
                         else F.lit(severity).alias("severity"))

    ids = features.select("dataset_id", F.col("id").alias("upstream_object_id"))
    blank = F.trim(F.coalesce("upstream_object_id", F.lit(""))) == ""
    # A diameter that is no whole number is reported by its own code only.
    broken = feature_violations(features.withColumn(
        "diameter", F.when(F.col("diameter").isNull() & pipe, F.lit(rules.DN[0])).otherwise(
            F.col("diameter")))).select(
        "dataset_id", F.col("object_id").alias("id")).distinct()
    bad_shape = geometry_violations(features).select(
        "dataset_id", F.col("object_id").alias("id")).distinct()
    found = [
        rows(broken.union(bad_shape).distinct(), "INVALID_FEATURE", "error"), rows(bad_shape, "INVALID_GEOMETRY", "error"),
        rows(features.filter(pipe & blank), "MISSING_UPSTREAM", "info"),
        rows(features.filter(pipe & ~blank).join(ids, ["dataset_id", "upstream_object_id"], "left_anti"),
             "UNKNOWN_UPSTREAM", "info"),
        rows(features.filter(pipe & F.col("diameter").isNull()), "MISSING_DIAMETER",
             F.when(kind == "heat_network", "error").otherwise("info")),
        rows(features.filter((kind == "heat_network") & F.col("flow_tph").isNull()),
             "MISSING_EXISTING_FLOW", "info"),
        rows(features.filter((kind == "restriction") & ~F.coalesce(
            F.col("restriction_type").isin([r[0] for r in rules.RESTRICTIONS]), F.lit(False))),
            "UNSPECIFIED_RESTRICTION", "error"),
    ]
    whole = features.groupBy("dataset_id").agg(
        F.count(F.when(kind == "source", 1)).alias("s"),
        F.count(F.when(kind == "oks_connection_point", 1)).alias("d"),
        F.count(F.when((kind == "oks_connection_point") & ~F.coalesce(F.col("flow_tph") > 0, F.lit(False)), 1))
        .alias("bad")).withColumn("id", F.lit("dataset"))
    found += [rows(whole.filter("s <> 1"), "SOURCE_COUNT", "error"),
              rows(whole.filter("d = 0"), "NO_DEMAND", "error"),
              rows(whole.filter("bad > 0"), "INVALID_DEMAND", "error")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def first_findings(findings: DataFrame, limit: int) -> DataFrame:
    """For display: the first findings of each dataset; past the limit one row says so."""
    ranked = top_k(findings, ["dataset_id"], ["code", "object_id"], limit + 1)
    over = F.col("rank") > limit
    return ranked.select(
        "dataset_id", F.when(over, "dataset").otherwise(F.col("object_id")).alias("object_id"),
        F.when(over, "DIAGNOSTICS_TRUNCATED").otherwise(F.col("code")).alias("code"),
        F.when(over, "error").otherwise(F.col("severity")).alias("severity"))


def gate(features: DataFrame, findings: DataFrame, mode: str = "strict",
         load_percent: float | None = None, contest: bool = True) -> DataFrame:
    """May a dataset be calculated: any error stops a strict run, listed codes a scenario run."""
    if mode == "strict":
        stop = F.col("severity") == "error"
        marked = findings
    else:
        facts = features.select("dataset_id", F.col("id").alias("object_id"), "object_type", "flow_tph",
                                "restriction_type", "geom_type")
        marked = findings.join(facts, ["dataset_id", "object_id"], "left")
        no_flow = (F.col("object_type") == "heat_network") & F.col("flow_tph").isNull()
        no_rule = ((F.col("object_type") == "restriction") & F.col("geom_type").isin(_AREAS)
                   & ~F.coalesce(F.col("restriction_type").isin([r[0] for r in rules.RESTRICTIONS]), F.lit(False)))
        spared = F.coalesce(no_flow | no_rule, F.lit(False))
        stop = F.col("code").isin(SCENARIO_BLOCKERS) | ((F.col("code") == "INVALID_FEATURE") & ~spared)
    blocked = marked.groupBy("dataset_id").agg(F.count(F.when(stop, 1)).alias("blocking"))
    out = features.select("dataset_id").distinct().join(blocked, "dataset_id", "left").fillna(0, ["blocking"])
    if mode == "scenario" and load_percent is None and not contest:
        need = features.groupBy("dataset_id").agg(F.bool_or(
            (F.col("object_type") == "heat_network") & F.col("flow_tph").isNull()).alias("_needs_load"))
        out = out.join(need, "dataset_id").withColumn(
            "blocking", F.col("blocking") + F.col("_needs_load").cast("int")).drop("_needs_load")
    return out.withColumn("passes", F.col("blocking") == 0)


def scenario(features: DataFrame, load_percent: float) -> DataFrame:
    """Unknown restrictions become prohibited sites, unknown old flows a share of capacity."""
    known = F.coalesce(F.col("restriction_type").isin([r[0] for r in rules.RESTRICTIONS]), F.lit(False))
    swap = (F.col("object_type") == "restriction") & ~known
    fill = (F.col("object_type") == "heat_network") & F.col("flow_tph").isNull()
    return (features.withColumn("original_restriction", F.when(swap, F.col("restriction_type")))
            .withColumn("restriction_type", F.when(swap, "prohibited_site").otherwise(F.col("restriction_type")))
            .withColumn("flow_basis", F.when(fill, "scenario_capacity_percent"))
            .withColumn("flow_tph", F.when(fill, rules.capacity(rules.dn_index(F.col("diameter")))
                                           * load_percent / 100).otherwise(F.col("flow_tph"))))


def scenario_changes(overlaid: DataFrame) -> DataFrame:
    """Pipes and chambers whose flow or place in the network was inferred."""
    inferred = F.col("topology_inferred") if "topology_inferred" in overlaid.columns else F.lit(False)
    return overlaid.filter(F.col("object_type").isin("heat_network", "heat_chamber")
                           & (inferred | F.col("flow_basis").isNotNull())).select(
        "dataset_id", "id", "upstream_object_id", "diameter",
        F.when(F.col("object_type") == "heat_network", F.col("flow_tph")).alias("flow_tph"),
        F.coalesce("flow_basis", F.lit("input")).alias("flow_basis"), inferred.alias("topology_inferred"))


def duplicate_ids(features: DataFrame) -> DataFrame:
    return features.groupBy("dataset_id", "id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def inherit_building_flow(features: DataFrame) -> DataFrame:
    """Opt-in: a connection point without flow takes that of the future building it names."""
    donor = features.filter("object_type = 'oks_future'").select(
        "dataset_id", F.col("id").alias("oks_id"), F.col("flow_tph").alias("_donor"))
    return features.join(donor, ["dataset_id", "oks_id"], "left").withColumn(
        "flow_tph", F.when(F.col("object_type") == "oks_connection_point",
                           F.coalesce("flow_tph", "_donor")).otherwise(F.col("flow_tph"))).drop("_donor")


def validate_input(features: DataFrame, chambers: DataFrame, upstream: DataFrame | None = None,
                   shrinking: DataFrame | None = None) -> DataFrame:
    """Violations before a calculation; the engineering profile adds references and diameters.

    ``chambers``: dataset_id, object_id, chamber_dn, degree. ``upstream`` and ``shrinking`` are the
    results of the reference and diameter operators; with them chambers must equal their pipes.
    """
    base = feature_violations(features.filter(F.col("object_type").isin(
        "heat_network", "heat_chamber", "oks_connection_point", "restriction"))).select(
        "dataset_id", "object_id", F.col("rule_code").alias("code"))
    whole = features.groupBy("dataset_id").agg(
        F.count(F.when(F.col("object_type") == "source", 1)).alias("s"),
        F.count(F.when(F.col("object_type") == "oks_connection_point", 1)).alias("d"))
    counts = whole.filter("s <> 1").select("dataset_id", F.lit("dataset").alias("object_id"),
                                           F.lit("SOURCE_COUNT").alias("code")).unionByName(
        whole.filter("d = 0").select("dataset_id", F.lit("dataset").alias("object_id"),
                                     F.lit("NO_DEMAND").alias("code")))
    crowded = chambers.filter("degree > 4").select("dataset_id", "object_id", F.lit("DEGREE").alias("code"))
    out = base.unionByName(counts).unionByName(crowded)
    if upstream is not None:
        own = features.filter("object_type = 'heat_chamber'").select(
            "dataset_id", F.col("id").alias("object_id"), "diameter")
        odd = own.join(chambers, ["dataset_id", "object_id"]).filter(
            "diameter IS NULL OR chamber_dn IS NULL OR diameter <> chamber_dn").select(
            "dataset_id", "object_id", F.lit("CHAMBER_DN").alias("code"))
        out = out.unionByName(odd).unionByName(upstream.select("dataset_id", "object_id", "code"))
    if shrinking is not None:
        out = out.unionByName(shrinking.select("dataset_id", "object_id", "code"))
    return out
