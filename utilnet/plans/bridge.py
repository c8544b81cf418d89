"""Network-shaped views of the shared tables, in integer arithmetic, for Spark and for SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utilnet.functions import rules


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, joined by sorting: packed keys make a file small that is large on the driver."""
    return spark.read.parquet(f"{folder}/{name}.parquet").hint("merge")


def div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("long")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Forty-node ternary trees: node 0 is the tie, leaves from 13 on carry demand."""
    key = F.col("c_custkey")
    k = key % 40
    return table(spark, folder, "customer").select(
        div(key, 40).alias("dataset_id"), k.alias("node_id"),
        F.when(k > 0, div(k - 1, 3)).alias("parent_id"),
        ((key * 37) % 1000).cast("double").alias("x"),
        ((key * 61) % 1000).cast("double").alias("y"),
        F.when(k >= 13, 1 + key % 20).otherwise(0).cast("double").alias("demand"),
        F.when(k == 0, "tie").when(k >= 13, "oks").otherwise("chamber").alias("node_type"),
        key.alias("src"))


def edges_of(tree: DataFrame) -> DataFrame:
    """Parent-to-child edges of a node view; the edge is named after its lower node."""
    above = tree.select("dataset_id", F.col("node_id").alias("parent_id"),
                        F.col("x").alias("x0"), F.col("y").alias("y0"))
    pairs = tree.filter("parent_id IS NOT NULL").join(above, ["dataset_id", "parent_id"])
    return pairs.select(
        "dataset_id", F.col("node_id").alias("edge_id"), F.col("node_id").alias("edge_ord"),
        F.col("parent_id").alias("start_id"), F.col("node_id").alias("end_id"),
        "x0", "y0", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.sqrt((F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0"))
               + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0"))).alias("length"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges_of(nodes(spark, folder))


def with_path(df: DataFrame) -> DataFrame:
    """Two-point lines as vertex arrays."""
    return df.withColumn("path", F.array(
        F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")),
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Square areas from parts; every eleventh type of the restriction catalogue in turn."""
    key = F.col("p_partkey")
    names = F.array(*[F.lit(r[0]) for r in rules.RESTRICTIONS])
    side = (5 + F.col("p_size") % 20).cast("double")
    x0, y0 = ((key * 53) % 1000).cast("double"), ((key * 29) % 1000).cast("double")
    return table(spark, folder, "part").select(
        div(key, 40).alias("dataset_id"), key.alias("object_id"),
        F.get(names, (key % 11).cast("int")).alias("rule"),
        x0.alias("minx"), y0.alias("miny"), (x0 + side).alias("maxx"), (y0 + side).alias("maxy"))


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """The boxes whose rule is an area."""
    lines = [r[0] for r in rules.RESTRICTIONS if not r[2]]
    return boxes(spark, folder).filter(~F.col("rule").isin(lines))


def utility_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that are lines, drawn as long diagonals."""
    lines = [r[0] for r in rules.RESTRICTIONS if not r[2]]
    key = F.col("object_id")
    return boxes(spark, folder).filter(F.col("rule").isin(lines)).select(
        "dataset_id", "object_id", "rule", F.col("minx").alias("x0"), F.col("miny").alias("y0"),
        (F.col("minx") + 300 + (key * 7) % 200).alias("x1"),
        (F.col("miny") + (key * 13) % 400 - 200).alias("y1"),
        F.get(F.array(*[F.lit(d) for d in rules.DN]), (key % 18).cast("int")).alias("dn"))


def box_ring(df: DataFrame) -> DataFrame:
    """Ring segments of axis-aligned boxes: one row per side."""
    def side(n, a, b, c, d):
        return F.struct(F.lit(n).alias("seq"), F.col(a).alias("x0"), F.col(b).alias("y0"),
                        F.col(c).alias("x1"), F.col(d).alias("y1"))
    sides = F.array(side(0, "minx", "miny", "maxx", "miny"),
                    side(1, "maxx", "miny", "maxx", "maxy"),
                    side(2, "maxx", "maxy", "minx", "maxy"),
                    side(3, "minx", "maxy", "minx", "miny"))
    from utilnet.functions.geo import with_box
    rest = [c for c in df.columns if c not in ("minx", "miny", "maxx", "maxy")]
    return with_box(df.select(*rest, F.explode(sides).alias("_s")).select(*rest, "_s.*"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        div(key, 400).alias("dataset_id"), key.alias("point_id"),
        ((key * 17) % 1000).cast("double").alias("x"),
        ((key * 23) % 1000).cast("double").alias("y"),
        (1 + key % 50).cast("double").alias("flow"))


def pipes(spark: SparkSession, folder: str) -> DataFrame:
    """Existing pipes: three straight lines per dataset."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        div(key, 3).alias("dataset_id"), key.alias("object_id"),
        ((key * 37) % 1000).cast("double").alias("x0"),
        ((key * 61) % 1000).cast("double").alias("y0"),
        ((key * 91 + 300) % 1000).cast("double").alias("x1"),
        ((key * 43 + 500) % 1000).cast("double").alias("y1"),
        F.get(F.array(*[F.lit(d) for d in rules.DN]), (key % 18).cast("int")).alias("dn"))


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """The trees read as an old network: references upstream, some broken, some circular."""
    key = F.col("c_custkey")
    k, ds = key % 40, div(key, 40)
    up = (F.when(k == 0, F.lit(None).cast("long"))
          .when((k == 1) & (ds % 10 == 3), F.lit(4).cast("long"))
          .when(key % 101 == 7, F.lit(999).cast("long"))
          .otherwise(div(k - 1, 3)))
    kind = (F.when(k == 0, "source").when(k % 4 == 1, "heat_chamber").otherwise("heat_network"))
    return table(spark, folder, "customer").select(
        ds.alias("dataset_id"), k.alias("object_id"), kind.alias("object_type"),
        up.alias("upstream_id"),
        F.when(k > 0, F.get(F.array(*[F.lit(d) for d in rules.DN]),
                            (17 - F.least((k * 7 + ds) % 18, k)).cast("int"))).alias("dn"),
        (key % 13).cast("double").alias("flow"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Search progress per job; order inside a job by (ts, event_id)."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id",
        (F.col("event_type") != "error").alias("complete"), F.col("value").alias("score"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate connections: the line number orders them, repeats of it fall back to the rest."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                 "l_discount", "l_tax", "l_shipdate").alias("pos"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        (F.col("l_returnflag") != "R").alias("feasible"),
        (F.col("l_extendedprice") / 1000).alias("score"),
        (F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount"))).alias("bound"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"))


def variants(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("dataset_id"), key.alias("network_id"),
        (F.col("o_totalprice") * 1000).alias("cost"),
        (50 + (key * 13) % 500).cast("double").alias("length"),
        (key % 7).alias("bends"))


# ---- the same views in SQL ----
_DN = str(rules.DN)
_RULES = str([r[0] for r in rules.RESTRICTIONS])
_LINES = "('gas_pipeline','power_cable','heat_network')"
VIEWS = {
    "fx_nodes": """SELECT c_custkey // 40 AS dataset_id, c_custkey % 40 AS node_id,
      CASE WHEN c_custkey % 40 > 0 THEN (c_custkey % 40 - 1) // 3 END AS parent_id,
      ((c_custkey * 37) % 1000)::DOUBLE AS x, ((c_custkey * 61) % 1000)::DOUBLE AS y,
      (CASE WHEN c_custkey % 40 >= 13 THEN 1 + c_custkey % 20 ELSE 0 END)::DOUBLE AS demand,
      CASE WHEN c_custkey % 40 = 0 THEN 'tie' WHEN c_custkey % 40 >= 13 THEN 'oks'
           ELSE 'chamber' END AS node_type, c_custkey AS src FROM customer""",
    "fx_edges": """SELECT n.dataset_id, n.node_id AS edge_id, n.parent_id AS start_id,
      n.node_id AS end_id, p.x AS x0, p.y AS y0, n.x AS x1, n.y AS y1,
      sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)) AS length
      FROM fx_nodes n JOIN fx_nodes p ON p.dataset_id = n.dataset_id AND p.node_id = n.parent_id""",
    "fx_anc": """SELECT dataset_id, node_id, node_id AS anc FROM fx_nodes UNION ALL
      SELECT a.dataset_id, a.node_id, n.parent_id FROM fx_anc a JOIN fx_nodes n
      ON n.dataset_id = a.dataset_id AND n.node_id = a.anc WHERE n.parent_id IS NOT NULL""",
    "fx_flows": f"""SELECT e.dataset_id, e.edge_id, e.start_id, e.end_id, e.length, f.flow,
      len(list_filter({rules.CAPACITY}, lambda c: f.flow > c + 1e-9)) AS dn_idx
      FROM fx_edges e JOIN (SELECT a.dataset_id, a.anc, sum(n.demand) AS flow FROM fx_anc a
        JOIN fx_nodes n ON n.dataset_id = a.dataset_id AND n.node_id = a.node_id
        GROUP BY 1, 2) f ON f.dataset_id = e.dataset_id AND f.anc = e.end_id""",
    "fx_boxes": f"""SELECT p_partkey // 40 AS dataset_id, p_partkey AS object_id,
      ({_RULES})[p_partkey % 11 + 1] AS rule,
      ((p_partkey * 53) % 1000)::DOUBLE AS minx, ((p_partkey * 29) % 1000)::DOUBLE AS miny,
      ((p_partkey * 53) % 1000 + 5 + p_size % 20)::DOUBLE AS maxx,
      ((p_partkey * 29) % 1000 + 5 + p_size % 20)::DOUBLE AS maxy FROM part""",
    "fx_areas": f"SELECT * FROM fx_boxes WHERE rule NOT IN {_LINES}",
    "fx_ulines": f"""SELECT dataset_id, object_id, rule, minx AS x0, miny AS y0,
      minx + 300 + (object_id * 7) % 200 AS x1, miny + (object_id * 13) % 400 - 200 AS y1,
      ({_DN})[object_id % 18 + 1] AS dn FROM fx_boxes WHERE rule IN {_LINES}""",
    "fx_points": """SELECT o_orderkey // 400 AS dataset_id, o_orderkey AS point_id,
      ((o_orderkey * 17) % 1000)::DOUBLE AS x, ((o_orderkey * 23) % 1000)::DOUBLE AS y,
      (1 + o_orderkey % 50)::DOUBLE AS flow FROM orders""",
    "fx_pipes": f"""SELECT s_suppkey // 3 AS dataset_id, s_suppkey AS object_id,
      ((s_suppkey * 37) % 1000)::DOUBLE AS x0, ((s_suppkey * 61) % 1000)::DOUBLE AS y0,
      ((s_suppkey * 91 + 300) % 1000)::DOUBLE AS x1, ((s_suppkey * 43 + 500) % 1000)::DOUBLE AS y1,
      ({_DN})[s_suppkey % 18 + 1] AS dn FROM supplier""",
    "fx_existing": f"""SELECT c_custkey // 40 AS dataset_id, c_custkey % 40 AS object_id,
      CASE WHEN c_custkey % 40 = 0 THEN 'source' WHEN c_custkey % 40 % 4 = 1 THEN 'heat_chamber'
           ELSE 'heat_network' END AS object_type,
      CASE WHEN c_custkey % 40 = 0 THEN NULL
           WHEN c_custkey % 40 = 1 AND c_custkey // 40 % 10 = 3 THEN 4
           WHEN c_custkey % 101 = 7 THEN 999 ELSE (c_custkey % 40 - 1) // 3 END AS upstream_id,
      CASE WHEN c_custkey % 40 > 0 THEN ({_DN})[18 - least((c_custkey % 40 * 7 + c_custkey // 40)
           % 18, c_custkey % 40)] END AS dn, (c_custkey % 13)::DOUBLE AS flow FROM customer""",
    "fx_attempts": """SELECT user_id AS job_id, ts, event_id, event_type <> 'error' AS complete,
      value AS score FROM events""",
    "fx_cands": """SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
      l_shipdate) AS candidate, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
      l_returnflag <> 'R' AS feasible, l_extendedprice / 1000 AS score,
      l_extendedprice / 1000 * (1 - l_discount) AS bound, l_quantity AS quantity,
      l_discount AS discount, l_tax AS tax FROM lineitem""",
    "fx_variants": """SELECT o_custkey AS dataset_id, o_orderkey AS network_id,
      o_totalprice * 1000 AS cost, (50 + (o_orderkey * 13) % 500)::DOUBLE AS length,
      o_orderkey % 7 AS bends FROM orders""",
}
NEEDS = {
    "fx_edges": ["fx_nodes"], "fx_anc": ["fx_nodes"], "fx_flows": ["fx_edges", "fx_anc"],
    "fx_areas": ["fx_boxes"], "fx_ulines": ["fx_boxes"],
}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views (and those they rest on) in front as common tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    named = {**{v: VIEWS[v] for v in order}, **(extra or {})}
    # A view that several others use is computed once; recursive ones are as they are.
    parts = [f"{n} AS {'' if re.search(rf'\\b{n}\\b', q) else 'MATERIALIZED '}({q})"
             for n, q in named.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body if parts else body
