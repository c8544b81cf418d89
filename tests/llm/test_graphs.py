"""Small-world graphs against all pairs."""

import numpy as np

from utilnet.llm import graphs

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x)


def exact(rows, queries, k):
    """Every query against every row, in double precision."""
    kept = sorted({(i, tuple(x)) for i, x, *_ in rows if usable(x)}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    unit = lambda x: np.array(x) / np.linalg.norm(np.array(x) / np.abs(x).max()) / np.abs(x).max()
    units = [unit(x) for _, x in kept]
    out = {}
    for i, x in {(i, tuple(x)) for i, x, *_ in queries if usable(x) and i is not None}:
        q = unit(x)
        near = [(-float(u @ q), c is None, c or 0) for (c, y), u in zip(kept, units) if len(y) == len(x) and (c, y) != (i, x)]
        out.setdefault(i, []).extend(sorted(near)[:k])
    return out


def check(found, want, least=1.0):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for i, near in want.items():
        mine = sorted(got.pop(i, []), key=lambda r: r.rank)
        assert len(mine) == len(near)
        hits += len({(r.vec_id is None, r.vec_id or 0) for r in mine} & {n[1:] for n in near})
        total += len(near)
    assert not got and hits >= least * total
    return hits / max(total, 1)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SHARD", 20)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist(), 0) for k in range(60)]
    rows += rows[:10] + [(100 + k, rows[3][1], 1) for k in range(30)] + [(None, rows[3][1], 1), (None, rows[4][1], None), (7, rows[8][1], 1)]
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (203, [float("nan")] + [1.0] * 5, 1), (204, [], 1),
             (205, [1e300, -1e300, 0.0, 1.0, 2.0, 3.0], 1), (206, [1.0, 2.0], 1), (207, [2.0, 1.0], 1), (208, [3.0], 1), (209, [-0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "1 AS shard", "2 AS rank", "3 AS score", "4 AS v")
    found = graphs.search(graphs.index(frame, 5, shard=20), frame, 5, block=16, width=200).collect()
    want = exact(rows, rows, 5)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id is None, r.vec_id or 0))
    assert got.keys() == {i for i, near in want.items() if near}
    for i, near in got.items():
        # Ids are compared where no other score is as close as rounding.
        assert np.allclose(sorted(n[0] for n in near), sorted(n[0] for n in want[i]), atol=1e-12)
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 120), key=lambda r: r.rank)] == [3, 100, 101, 102, 103]
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 206), key=lambda r: r.rank)] == [209, 207]


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graphs.nearest(none, none, 5).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA)
    assert graphs.nearest(one, one, 5).collect() == []
    assert graphs.nearest(one, none, 5).collect() == []


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + rng.normal(size=24) * (0.01 if k % 3 else 1)).tolist(), 0) for k in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = graphs.search(graphs.index(frame, 5, shard=1000), frame.filter("vec_id % 25 = 0"), 5).collect()
    assert check(found, exact(rows, [r for r in rows if r[0] % 25 == 0], 5), 0.9) >= 0.9


def test_every_vector_can_be_found(spark):
    """Hardly a vector is left without a way to it: each is the nearest to itself, but for a few."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = graphs.Graph(x, graphs._heights([f"{v:012x}" for v in rng.integers(1 << 48, size=1500)], graphs.LINKS)).build()
    assert sum(k in graph.search(x[k]) for k in range(1500)) >= 1485


def test_query_on_the_whole_table(spark, data):
    from utilnet.llm.queries import QUERIES
    found = QUERIES["op11_graphs"](spark, data).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert check(found, exact(rows, [r for r in rows if r[0] % 50 == 0], 5), 0.9) >= 0.9
    of = dict(rows)
    for r in found:
        a, b = np.array(of[r.query_id]), np.array(of[r.vec_id])
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
