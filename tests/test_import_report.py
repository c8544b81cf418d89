"""The import report says whether the findings let a strict run start."""

import pytest
from pyspark.sql import functions as F

from utilnet.plans import feature_queries
from utilnet.plans.registry import ORACLES
from utilnet.sources import features

#: Maps 1 and 4 have a source and a demand without a finding; each of the others has one or two.
CUSTOMERS, PARTS = [40, 42, 80, 82, 87, 122, 160, 161, 200, 240, 242], [40, 80, 120, 83, 245]


def test_report_follows_the_diagnostics(spark, tmp_path):
    """the findings decide ``strict_ready`` in the query as in its SQL."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(k,) for k in CUSTOMERS], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k,) for k in PARTS], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    report = feature_queries.import_report(spark, str(tmp_path))
    columns = ["dataset_id", "feature_count", "connection_points", "strict_ready", "coordinates_changed"]
    got = sorted(tuple(r) for r in report.select(*columns).collect())
    assert {r[0] for r in got if r[3]} == {1, 4}
    con = duckdb.connect()
    for name in ("customer", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['import_report']})").fetchall())


def test_features_without_a_dataset_have_their_own_findings(spark):
    rows = spark.createDataFrame([(None, "source"), (1, "source")], "dataset_id long, object_type string")
    found = spark.createDataFrame([(None, "error"), (1, "info")], "dataset_id long, severity string")
    got = features.import_report(rows, found).orderBy(F.col("dataset_id").asc_nulls_first()).collect()
    assert [(r["dataset_id"], r["strict_ready"]) for r in got] == [(None, False), (1, True)]
