"""Reading files, findings and pages."""

import json

from pyspark.sql import functions as F

from utilnet.operators import ordering, quality
from utilnet.sources import features, networks

POINT = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [37.5, 55.5]},
         "properties": {"id": "a", "object_type": "source"}}


def nested(depth):
    body = json.loads(json.dumps(POINT))
    value = 1
    for _ in range(depth):
        value = [value]
    body["properties"]["more"] = value
    return body


def test_every_file_gives_features_or_a_reject(spark, tmp_path):
    files = {"good.json": json.dumps({"type": "FeatureCollection", "features": [POINT, nested(100)]}), "broken.json": '{"type": "Feature',
             "empty.json": json.dumps({"type": "FeatureCollection", "features": []}), "other.json": "[1, 2]", "blank.json": " "}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good, bad = features.read_features(spark, str(tmp_path))
    assert [r["id"] for r in good.collect()] == ["a"]
    got = {(r["dataset_id"].rsplit("/", 1)[1], r["reject"]) for r in bad.collect()}
    assert got == {("good.json", "TOO_DEEP"), ("broken.json", "NOT_JSON"), ("empty.json", "EMPTY_COLLECTION"),
                   ("other.json", "NOT_A_COLLECTION"), ("blank.json", "NOT_JSON")}


def test_nesting_looks_past_strings(spark):
    texts = ['{"a": [1, [2]]}', '{"a": "[[[[", "b\\"[": {}}', "1", "[]", '["\\\\", ["["]]']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(features.nesting(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [3, 2, 0, 1, 2]


def test_size_limit_is_the_callers(spark):
    rows = spark.createDataFrame([("d", 0, json.dumps(POINT))], "dataset_id string, pos long, body string")
    assert features.parse_features(rows).first()["reject"] is None
    assert features.parse_features(rows, max_bytes=20).first()["reject"] == "TOO_LARGE"


def test_equal_layouts_of_one_file_stay_apart(spark, tmp_path):
    layout = {"nodes": [{"id": "n", "x": 1.0, "y": 2.0, "type": "tie", "existingId": None, "entryId": None},
                        {"id": "m", "x": 4.0, "y": 6.0, "type": "oks", "existingId": None, "entryId": None}],
              "edges": [{"id": "e", "start": "n", "end": "m", "wkt": "LINESTRING (1 2, 4 6)"}]}
    (tmp_path / "two.json").write_text(json.dumps([layout, layout]))
    (tmp_path / "one.json").write_text(json.dumps(layout))
    (tmp_path / "none.json").write_text("[{")
    nodes, edges, rejects = networks.read_snapshots(spark, str(tmp_path))
    assert nodes.count() == 6 and [r["length"] for r in edges.collect()] == [5.0] * 3
    assert [r["code"] for r in rejects.collect()] == ["NOT_A_SNAPSHOT"]


def test_long_pages_equal_short_ones(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id % 3 AS g", "id", "(id * 7919) % 4999 AS v")
    want = sorted(map(tuple, ordering.top_k(rows, ["g"], ["v", "id"], 900).collect()))
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 10)
    assert sorted(map(tuple, ordering.top_k(rows, ["g"], ["v", "id"], 900).collect())) == want


def test_findings_are_cut_on_demand_only(spark):
    found = spark.createDataFrame([("d", str(k), "CODE", "info") for k in range(9)], "dataset_id string, object_id string, code string, severity string")
    cut = quality.first_findings(found, 4).collect()
    assert len(cut) == 5 and {r["code"] for r in cut} == {"CODE", "DIAGNOSTICS_TRUNCATED"}


def test_lines_keep_their_ids_however_files_are_split(spark, tmp_path):
    from utilnet.sources import features, networks
    layout = '{"nodes":[{"id":"a","x":1,"y":2,"type":"tie"}],"edges":[]}'
    (tmp_path / "n.jsonl").write_text("\n".join([layout, layout, layout.replace('"a"', '"b"'), "", "broken"] * 40))
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[37.5,55.5]},"properties":{"id":"n","object_type":"source"}}'
    (tmp_path / "f.jsonl").write_text("\n".join([point, point, point.replace('"n"', '"m"'), "no"] * 40))
    found = []
    for size in ("134217728", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            nodes, _, rejects = networks.read_snapshots(spark, str(tmp_path / "n.jsonl"), lines=True)
            good, bad = features.read_features(spark, str(tmp_path / "f.jsonl"), lines=True)
            found.append([sorted(map(tuple, df.collect())) for df in (nodes.select("network_id", "node_id"), rejects.select("network_id", "code"),
                                                                      good.select("pos", "id"), bad.select("pos", "reject"))])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1]
    assert [len(set(rows)) for rows in found[0]] == [120, 40, 120, 40]
