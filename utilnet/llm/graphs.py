"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Different vectors are dealt out by digest to shards of about ``SHARD``; equal vectors are one
node with the smallest ids of its rows. Each shard builds its graph on its own and hands it back
as flat neighbour arrays, one row a node, so that a written graph outlives the task that made it.
Queries meet the shards in tiles of one shard and at most ``QUERIES`` query vectors: a graph is
walked from its top level down in single precision, what the walk ends with is scored again in
double precision on the original vectors, and Spark merges the best of all shards.

Every vector is indexed. Tiles are bounded whatever the number of vectors or queries, and their
number is that of shards times that of blocks of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.session import written as cut

SHARD = 2_500  # different vectors in a shard, about
QUERIES = 4_000  # different query vectors in a tile, about
LINKS = 14  # neighbours of a node on upper levels; twice as many on the lowest
BUILD_WIDTH = 56  # nodes that a walk keeps while a graph is built
WIDTH = 72  # and while it is searched
NODE = "dim int, shard int, node string, at int, height int, links array<int>, ids array<long>, v array<double>"
FOUND = "query string, node string, ids array<long>, score double"


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which loses nothing, so that squares stay in range; and their lengths."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -exponent[:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Graph:
    """Flat neighbour arrays: ``2 * links`` places a node on the lowest level, ``links`` on each above; -1 is free."""

    def __init__(self, units: np.ndarray, heights: np.ndarray, links: int = LINKS):
        self.x, self.heights, self.links = units, heights, links
        self.low = np.full((len(units), 2 * links), -1, np.int32)
        self.first = np.concatenate(([0], np.cumsum(heights)))  # of a node's rows in the upper array
        self.up = np.full((int(self.first[-1]), links), -1, np.int32)
        self.top = int(np.argmax(heights)) if len(heights) else -1

    def row(self, node: int, level: int) -> np.ndarray:
        return self.low[node] if level == 0 else self.up[self.first[node] + level - 1]

    def walk(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest (similarity, node) that a best-first walk on one level meets."""
        seen = np.zeros(len(self.x), bool)
        seen[[n for _, n in entries]] = True
        open_ = [(-s, n) for s, n in entries]
        best = list(entries)
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            s, node = heapq.heappop(open_)
            if len(best) >= width and -s < best[0][0]:
                break
            near = self.row(node, level)
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for s, n in zip((self.x[near] @ q).tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                else:
                    continue
                heapq.heappush(open_, (-s, n))
        return best

    def _apart(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the node than to each other first, the nearest of the rest after them."""
        found = sorted(found, key=lambda e: (-e[0], e[1]))
        if len(found) <= most:
            return [n for _, n in found]
        nodes = [n for _, n in found]
        between = self.x[nodes] @ self.x[nodes].T
        blocked = np.full(len(nodes), -np.inf)
        kept, rest = [], []
        for k, (s, n) in enumerate(found):
            if blocked[k] < s:
                kept.append(n)
                if len(kept) == most:
                    return kept
                np.maximum(blocked, between[k], out=blocked)
            else:
                rest.append(n)
        return kept + rest[:most - len(kept)]

    def _join(self, node: int, level: int, found: list[tuple[float, int]]) -> None:
        most = self.links if level else 2 * self.links
        chosen = self._apart([e for e in found if e[1] != node], self.links)
        self.row(node, level)[:len(chosen)] = chosen
        for n in chosen:
            row = self.row(n, level)
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
                continue
            near = np.append(row, node)
            kept = self._apart(list(zip((self.x[near] @ self.x[n]).tolist(), near.tolist())), most)
            row[:] = -1
            row[:len(kept)] = kept

    def build(self, width: int = BUILD_WIDTH) -> Graph:
        """Insert every node in order; the entry is the first of the highest nodes so far."""
        top = -1
        for node, height in enumerate(self.heights.tolist()):
            if top >= 0:
                q = self.x[node]
                found = [(float(self.x[top] @ q), top)]
                for level in range(int(self.heights[top]), -1, -1):
                    found = self.walk(q, found, width if level <= height else 1, level)
                    if level <= height:
                        self._join(node, level, found)
            if top < 0 or height > self.heights[top]:
                top = node
        return self

    def search(self, q: np.ndarray, width: int = WIDTH) -> list[int]:
        """The nodes that a walk from the top keeps on the lowest level."""
        found = [(float(self.x[self.top] @ q), self.top)]
        for level in range(int(self.heights[self.top]), -1, -1):
            found = self.walk(q, found, 1 if level else width, level)
        return [n for _, n in found]


def _heights(nodes: list[str], links: int) -> np.ndarray:
    """Levels above the lowest, drawn from the nodes' digests: a rebuilt graph is the same graph."""
    draws = np.array([(int(n[-12:], 16) + 1) / 2.0 ** 48 for n in nodes])
    return np.minimum(-np.log(draws) / np.log(links), 12).astype(np.int32)


def _build(table: pa.Table) -> pa.Table:
    """The graph of a shard, one row a node: its place, height and neighbour arrays, lowest level first."""
    table = table.sort_by("node")
    dim, nodes = table.column("dim")[0].as_py(), table.column("node").to_pylist()
    x, length = _units(_matrix(table.column("v"), dim))
    graph = Graph((x / length[:, None]).astype(np.float32), _heights(nodes, LINKS)).build()
    links = [np.concatenate((graph.low[k], graph.up[graph.first[k]:graph.first[k + 1]].ravel())) for k in range(len(nodes))]
    return table.append_column("at", pa.array(range(len(nodes)), pa.int32())).append_column(
        "height", pa.array(graph.heights, pa.int32())).append_column(
        "links", pa.array(links, pa.list_(pa.int32()))).select(["dim", "shard", "node", "at", "height", "links", "ids", "v"])


def _load(table: pa.Table, x: np.ndarray, length: np.ndarray) -> Graph:
    flat = table.column("links").combine_chunks().flatten().to_numpy()
    heights = table.column("height").to_numpy()
    graph = Graph((x / length[:, None]).astype(np.float32), heights)
    ends = np.cumsum(2 * LINKS + LINKS * heights.astype(np.int64))
    for k, end in enumerate(ends.tolist()):
        begin = end - 2 * LINKS - LINKS * int(heights[k])
        graph.low[k] = flat[begin:begin + 2 * LINKS]
        graph.up[graph.first[k]:graph.first[k + 1]] = flat[begin + 2 * LINKS:end].reshape(-1, LINKS)
    return graph


def _search(shard: pa.Table, queries: pa.Table, most: int, width: int) -> pa.Table:
    """The ``most`` best nodes of one shard for each query vector of one block."""
    schema = pa.schema([("query", pa.string()), ("node", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not shard.num_rows or not queries.num_rows:
        return schema.empty_table()
    shard = shard.sort_by("at")
    dim = shard.column("dim")[0].as_py()
    x, length = _units(_matrix(shard.column("v"), dim))
    graph = _load(shard, x, length)
    q, far = _units(_matrix(queries.column("v"), dim))
    units = (q / far[:, None]).astype(np.float32)
    nodes, ids, names = shard.column("node").to_pylist(), shard.column("ids").to_pylist(), queries.column("node").to_pylist()
    out = []
    for k, name in enumerate(names):
        near = np.array(graph.search(units[k], width))
        scores = (x[near] * q[k]).sum(axis=1) / (length[near] * far[k])
        # What ties with the last place is kept too: ids, known only after the merge, decide.
        last = np.sort(scores)[-min(most, len(near))]
        out += [(name, nodes[n], ids[n], s) for n, s in zip(near.tolist(), scores.tolist()) if s >= last]
    columns = list(zip(*out))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _usable(column) -> F.Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _rows(rows: DataFrame) -> DataFrame:
    """The different (vec_id, vector) pairs of usable rows, with the digest and length of the vector."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zero
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(_usable(F.col("v")))
            .withColumn("node", F.sha2(F.col("v").cast("string").cast("binary"), 256)).withColumn("dim", F.size("v"))
            .dropDuplicates(["vec_id", "node"]))


def index(rows: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """Graphs of all different vectors of (vec_id, embedding) rows: one row a node, with its k + 1 smallest ids."""
    base = _rows(rows)
    first = W.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last())
    few = base.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
    # Nulls are no list members: a node with a place left over keeps room for an id that is null.
    nodes = cut(few.groupBy("node", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"),
                                               F.max(F.col("vec_id").isNull()).alias("none"), F.any_value("v").alias("v"))
                .withColumn("ids", F.when(F.col("none"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids"))))
    shards = cut(nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")))
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    # Small in bytes, long in work: a task for each shard, which no merging of small partitions undoes.
    tasks = int(shards.agg(F.sum("shards")).first()[0] or 1)
    return cut(dealt.select("dim", "shard", "node", "ids", "v").repartition(tasks, "dim", "shard")
               .groupBy("dim", "shard").applyInArrow(_build, NODE))


def search(graph: DataFrame, queries: DataFrame, k: int, block: int = QUERIES, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each different (vec_id, embedding) of ``queries``.

    Nearness is the cosine in double precision, ties go to the smaller id (null last). The
    query's own row, the one of its id and vector, is no candidate; other rows of its id are.
    Rows whose vector is null or zero, or holds null or non-finite components, take no part on
    either side, vectors of another length are no candidates, and a repeated (vec_id, vector)
    counts once. Queries without an id are ignored.
    """
    asked = cut(_rows(queries).filter("vec_id IS NOT NULL"))
    names = asked.groupBy("node", "dim").agg(F.any_value("v").alias("v"))
    blocks = cut(names.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    shards = cut(graph.select("dim", "shard").distinct())
    tasks = int(shards.join(blocks, "dim").agg(F.sum("blocks")).first()[0] or 1)
    dealt = (names.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .join(shards, "dim").select("dim", "shard", "block", "node", "v"))
    sides = (graph.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("dim", "shard", "block", "node", "at", "height", "links", "ids", "v"))
    most = k + 1

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        return _search(shard, block, most, width)

    tile = ["dim", "shard", "block"]
    found = sides.repartition(tasks, *tile).groupBy(*tile).cogroup(dealt.repartition(tasks, *tile).groupBy(*tile)).applyInArrow(run, FOUND)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("node")]
    best = (found.withColumn("vec_id", F.explode("ids"))
            .withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)
            .select(F.col("query"), F.col("node").alias("other"), "vec_id", "score"))
    pairs = (asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(best, "query")
             .filter(~((F.col("query") == F.col("other")) & F.col("vec_id").eqNullSafe(F.col("query_id")))))
    order[-1] = F.col("other")
    return (pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query").orderBy(*order)))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index all rows and search them; see ``search`` for what counts as a row and a candidate."""
    return search(index(rows, k), queries, k)
