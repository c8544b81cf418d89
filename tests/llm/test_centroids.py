"""Exact centroid clustering against plain whole-number arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from utilnet.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k, rounds, dim, scale):
    """Every distance to every centroid, in Python's whole numbers."""
    kept = [(i, [math.floor(v * scale) if abs(v) < 2 ** 52 else int(v) * scale for v in x]) for i, x, *_ in rows
            if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=lambda r: digest(r[0]))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(centres)), key=lambda c: (far(x, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x), []).append(x)
        for c, members in groups.items():
            centres[c] = [sum(v) // len(members) for v in zip(*members)]
    return [(i, near(x), far(x, centres[near(x)])) for i, x in kept], centres


def run(spark, rows, k, rounds, dim, scale):
    found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k, rounds, "2", dim, scale)
    return found, centres


@pytest.mark.parametrize("seed", range(3))
def test_like_plain_arithmetic(spark, seed):
    rng = np.random.default_rng(seed)
    grid = rng.integers(-3, 4, (120, 3)) / 2  # many ties and equal vectors
    rows = [(int(i), x.tolist(), 0) for i, x in enumerate(grid)]
    rows += rows[:5] + [(None, [0.5, 0.5, 0.5], 1), (200, None, 1), (201, [1.0, 2.0], 1), (202, [], 1), (203, [1.0, None, 2.0], 1),
                        (204, [1.0, float("nan"), 0.0], None), (205, [float("inf"), 0.0, 0.0], 1), (206, [0.0, 0.0, 0.0], 1)]
    found, centres = run(spark, rows, 9, 5, 3, 4)
    want, want_centres = plain(rows, 9, 5, 3, 4)
    assert centres == want_centres
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(want, key=order)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(10 ** (i * 6 % 40)) * (-1) ** i, 0.25 * i, 1e300 if i == 7 else -1.0], 0) for i in range(12)]
    found, centres = run(spark, rows, 4, 3, 3, 256)
    want, want_centres = plain(rows, 4, 3, 3, 256)
    assert centres == want_centres
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, c, d if d < 2 ** 63 else None) for i, c, d in want)
    out = {r.vec_id: r for r in centroids.with_inertia(found, centres).collect()}
    assert len(out) == 12 and out[0].inertia is None


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [3.0, 3.0], 0)]
    found, centres = run(spark, rows, 5, 2, 2, 1)
    assert len(centres) == 3 and {tuple(r) for r in found.collect()} == {(1, min(c for c in range(3) if centres[c] == [1, 1]), 0),
                                                                         (2, centres.index([3, 3]), 0)}
    clash = spark.createDataFrame([], SCHEMA).selectExpr("*", "'x' AS v", "1 AS cluster", "2 AS distance")
    none = centroids.with_inertia(*centroids.cluster(clash))
    assert none.collect() == [] and "centroid_sha256" in none.columns


def test_query_on_the_whole_table(spark, data):
    from utilnet.llm.queries import QUERIES
    got = QUERIES["op13_centroids"](spark, data).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centres = plain(rows, 40, 5, 64, 256)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    of = {}
    for _, c, d in want:
        of[c] = of.get(c, 0) + d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (of[r.cluster], sum(of.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
