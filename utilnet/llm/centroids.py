"""Exact centroid clustering by bisector tournaments.

Vectors and centroids are whole numbers. Of two centroids a < b the nearer one of a point x is
told by the side of their bisector on which x lies: with normal n = 2 (b - a) and threshold
t = |b|^2 - |a|^2, b is strictly nearer if n.x > t; zero favours a, the smaller number. Normals
and thresholds of all pairs are made once a task, and k - 1 such tests leave one centroid for
each point; only its distance is computed. Every partition hands back one row of sums a
centroid, Spark adds them up, and k rows reach the driver each round.

All arithmetic is exact: 64-bit where every product surely fits, Python's whole numbers where not.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.session import written as cut

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, "2"
SMALL = 1 << 24  # sums of DIM products of differences below twice this fit 64 bits
LIMB = 40  # bits of a sum that one row carries where it does not fit 64
MOST = (1 << 63) - 1


def _whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; an array of Python numbers where one is large."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if not len(x) or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0 ** 52 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(-1, dim)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.object = max(abs(v) for c in centroids for v in c) >= SMALL
        self.centres = np.array(centroids, object if self.object else np.int64)
        squares = (self.centres * self.centres).sum(axis=1)
        self.normals = 2 * (self.centres[None, :, :] - self.centres[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every point."""
        if self.object:
            points = points.astype(object)
        best = np.zeros(len(points), np.int64)
        for j in range(1, len(self.centres)):
            sides = (self.normals[best, j] * points).sum(axis=1) - self.thresholds[best, j]
            best[(sides > 0).astype(bool)] = j
        gaps = points - self.centres[best]
        return best, (gaps * gaps).sum(axis=1)


def _limbs(values: list[int]) -> Iterator[list[int]]:
    """The values in pieces of LIMB bits, lowest first; the last piece has the sign."""
    while any(not -MOST <= v <= MOST for v in values):
        yield [v & ((1 << LIMB) - 1) for v in values]
        values = [v >> LIMB for v in values]
    yield values


def _sums(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, list[int]]:
    """Exact component sums and, last, the number of the vectors nearest to each centroid."""
    names = [f"s{i}" for i in range(dim + 1)]

    def run(batches: Iterator[pa.RecordBatch]):
        tests = Bisectors(centroids)
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _whole(batch.column("v"), dim, scale)
            best, _ = tests.nearest(points)
            for c in np.unique(best).tolist():
                own = points[best == c]
                line = np.array([*own.sum(axis=0).tolist(), len(own)], object)
                totals[c] = totals[c] + line if c in totals else line
        rows = [(c, n, *piece) for c, line in totals.items() for n, piece in enumerate(_limbs(line.tolist()))]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                                              *(pa.array(c, pa.int64()) for c in columns[2:])], names=["cluster", "limb", *names])

    partial = vectors.select("v").mapInArrow(run, "cluster int, limb int, " + ", ".join(f"{n} long" for n in names))
    totals: dict[int, list[int]] = {}
    for r in partial.groupBy("cluster", "limb").agg(*[F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names]).collect():
        line = totals.setdefault(r.cluster, [0] * (dim + 1))
        for i, n in enumerate(names):
            line[i] += int(r[n]) << (LIMB * r.limb)
    return totals


def _starts(vectors: DataFrame, clusters: int, seed: str, dim: int, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest digests; those without an id only where others lack."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), F.col("v").cast("string")).limit(clusters).select("v").collect()
    return _whole(pa.array([r.v for r in rows], pa.list_(pa.float64())), dim, scale).tolist() if rows else []


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED,
            dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of the rows of (vec_id, embedding), and the final centroids.

    Vectors with another number of components, or with null or non-finite ones, are left out.
    Centroids start as the ``clusters`` vectors of smallest digest of ``seed:vec_id`` (all, if
    there are fewer); rows that tie, repeated ids for instance, follow their values. A null
    vec_id takes part, but as a start only after all others. Repeated rows are points of their
    own. A squared distance beyond 64 bits is null. Other columns are ignored; without a usable
    vector there are no centroids and no rows.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = cut(rows.filter((F.size(v) == dim) & F.coalesce(finite, F.lit(False)))
                  .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))
    centres = _starts(vectors, clusters, seed, dim, scale)
    for _ in range(rounds if centres else 0):
        for c, line in _sums(vectors, centres, dim, scale).items():
            centres[c] = [total // line[-1] for total in line[:-1]]

    def run(batches: Iterator[pa.RecordBatch]):
        tests = Bisectors(centres) if centres else None
        for batch in batches:
            if batch.num_rows:
                best, far = tests.nearest(_whole(batch.column("v"), dim, scale))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(
                    [d if d <= MOST else None for d in far.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), centres


def with_inertia(found: DataFrame, centres: list[list[int]]) -> DataFrame:
    """The clustered rows with the inertia of their cluster and of all, and the digest of the centroid.

    Sums beyond 64 bits, or of a distance beyond them, are null. One row a centroid reaches the driver.
    """
    found = cut(found)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s"),
                                        (F.count("distance") == F.count(F.lit(1))).alias("whole")).collect()
    own = {r.cluster: int(r.s) if r.whole else MOST + 1 for r in sums}
    fits = lambda total: total if total <= MOST else None
    every = fits(sum(own.values()))
    lines = [(i, fits(own[i]), every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for i, c in enumerate(centres) if i in own]
    known = found.sparkSession.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
