"""Prefix trie of conversations from sorted neighbours.

A turn is a digest of its role and text, a conversation a path of digests. Different paths are
sorted over the whole cluster, and neighbours know the length of their common prefix. Union-find
takes the edges between neighbours in descending depth: what it merges at a depth becomes a
branching node there, and the unary nodes above it follow up to the next merge. Each block of a
sorted partition builds its forest alone. Nodes on the way to the block's first or last path may
go on in the block next to it: they stay open and are contracted to what they hold besides their
open children. Contracted forests of neighbouring blocks are merged by the same procedure, in
rounds of ``FAN`` partitions, until all nodes are closed.

Paths are cut into segments of ``SEGMENT`` turns, so that no row grows with the longest
conversation: segments below a shared node form tries of their own, folded from the deepest up.
Turns behind the last shared segment belong to one conversation and need no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.operators.kernels import running
from utilnet.session import written as cut

SEGMENT = 256  # turns of a path that are sorted at once
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20  # paths of a forest
FAN = 32  # partitions whose contracted forests are merged in one task
PACK = 256  # ids in a piece of a list of ids
KEY = 16  # bytes of a turn's digest
NODE, OPEN, LINK = 0, 1, 2
ITEM = [("g", pa.binary()), ("path", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("low", pa.int64()),
        ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]
ROW = pa.schema([("kind", pa.int32()), *ITEM, ("ord", pa.int64()), ("edge", pa.int32()), ("depth", pa.int32()),
                 ("parent_low", pa.int64()), ("parent_id", pa.binary()), ("node_id", pa.binary())])
ROW_SQL = ("kind int, g binary, path binary, words array<int>, n long, low long, kids long, leaves long, saved long, ends string, "
           "ord long, edge int, depth int, parent_low long, parent_id binary, node_id binary")
NOTHING = hashlib.sha256(b"").hexdigest()


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): the turns of each conversation in order, null turns first.

    A null role or text is empty. Equal turn numbers follow the digest of role and text, and
    repeated rows are turns of their own. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(digest, 1, 2 * KEY)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"))
    return running(turns, ["conv_id"], ["turn", "key"], row_number="pos").select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "key", "words")


def shared_starts(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each conversation c rebuilt behind the start of conversation c - c % group: its turns, and all ids.

    The first h turns, h = crc32 of the decimal c modulo ``most + 1``, come from there (all it
    has, if fewer; none, if it is absent) and replace as many or more of the conversation's own.
    """
    turns = cut(turns)
    donor = (F.col("conv_id") - F.col("conv_id") % group).alias("donor")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    heads = turns.filter((F.col("pos") <= most) & (F.col("conv_id") % group == 0)).select(
        F.col("conv_id").alias("donor"), "pos", "key", "words")
    heights = heads.groupBy("donor").agg(F.max("pos").alias("height"))
    convs = turns.select("conv_id").distinct()
    lent = convs.select("conv_id", donor, h).join(heads, "donor").filter("pos <= h").select("conv_id", "pos", "key", "words")
    own = (turns.select("*", donor, h).filter("pos > h").join(heights, "donor", "left")
           .withColumn("pos", F.expr("pos - h + least(h, coalesce(height, 0))")).select("conv_id", "pos", "key", "words"))
    return lent.unionByName(own), convs


def _prefix(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        half = (low + high + 1) // 2
        if a[:half * KEY] == b[:half * KEY]:
            low = half
        else:
            high = half - 1
    return low


class Forest:
    """The trie over sorted different items, some of them contracted nodes of other forests.

    An item brings the members, children, leaves and saved words that its node holds besides
    what the other items below it bring. ``first`` and ``last`` are the items at the borders, -1
    if nothing lies beyond them.
    """

    def __init__(self, items: list[list], first: int, last: int, order: int, late: bool):
        self.items, self.first, self.last, self.order, self.late = items, first, last, order, late
        self.up = list(range(len(items)))
        self.top = [len(it[1]) // KEY for it in items]
        self.low_end = list(range(len(items)))
        self.high_end = list(range(len(items)))
        self.held = [list(it[3:9]) for it in items]  # n, low, kids, leaves, saved, ends of the top node
        self.waiting: list[list[int]] = [[] for _ in items]  # emitted children of the top node
        self.out: list[list] = []

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def _open(self, k: int) -> bool:
        return any(0 <= end and self.low_end[k] <= end <= self.high_end[k] for end in (self.first, self.last))

    def _finish(self, k: int) -> None:
        """Hand out the top node of a component, whole or contracted."""
        depth, (n, low, kids, leaves, saved, ends) = self.top[k], self.held[k]
        g, path, words, *_ = self.items[self.low_end[k]]
        prefix = path[:depth * KEY]
        if self._open(k):
            if n:
                edge = sum(bit for bit, end in ((1, self.first), (2, self.last)) if 0 <= end and self.low_end[k] <= end <= self.high_end[k]
                           and len(self.items[end][1]) == depth * KEY)
                name = hashlib.sha256(g + prefix).digest()
                for row in self.waiting[k]:
                    self.out[row][-2] = name
                self.out.append([OPEN, g, prefix, words[:depth], n, low, kids, leaves, saved, ends, self.order, edge, depth, None, None, None])
            self.held[k] = [0, None, 0, 0, 0, None]
            self.waiting[k] = []
            return
        leaves = leaves if kids else 1
        if depth:
            saved += (n - 1) * words[depth - 1]
        for row in self.waiting[k]:
            self.out[row][-3] = low
        name = hashlib.sha256(g + prefix).digest() if self.late else None
        self.waiting[k] = [len(self.out)]
        self.out.append([NODE if depth or not g else LINK, g, None, None, n, low, kids, leaves, saved, ends, None, None, depth, None, None, name])
        self.held[k] = [n, low, 1, leaves, saved, None]

    def _raise(self, k: int, depth: int) -> None:
        while self.top[k] > depth:
            if not self.held[k][0]:
                self.top[k] = depth  # an open node that holds nothing besides its open children
                return
            self._finish(k)
            self.top[k] -= 1

    def _merge(self, a: int, b: int) -> None:
        if len(self.waiting[a]) < len(self.waiting[b]):
            self.waiting[a], self.waiting[b] = self.waiting[b], self.waiting[a]
        self.waiting[a] += self.waiting[b]
        self.waiting[b] = []
        x, y = self.held[a], self.held[b]
        lows = [v for v in (x[1], y[1]) if v is not None]
        self.held[a] = [x[0] + y[0], min(lows, default=None), x[2] + y[2], x[3] + y[3], x[4] + y[4], x[5] or y[5]]
        self.up[b] = a
        self.high_end[a] = self.high_end[b]

    def rows(self) -> list[list]:
        items = self.items
        shared = np.array([_prefix(a[1], b[1]) if a[0] == b[0] else -1 for a, b in zip(items, items[1:])], np.int64)
        for e in np.argsort(-shared, kind="stable").tolist():
            depth = int(shared[e])
            if depth < 0:
                break
            a, b = self.find(e), self.find(e + 1)
            self._raise(a, depth)
            self._raise(b, depth)
            self._merge(a, b)
        for k in range(len(items)):
            if self.up[k] == k:
                self._raise(k, 0)
                if self.held[k][0]:
                    self._finish(k)
        return self.out


def _table(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW)], schema=ROW)


def _pieces(rows: list[list], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), most):
        yield _table(rows[at:at + most])


def _blocks(batches: Iterator[pa.RecordBatch], items: int, size: int) -> Iterator[pa.RecordBatch]:
    """The forests of the blocks of one sorted partition."""
    part, number, held, weight = TaskContext.get().partitionId(), 0, [], 0

    def forest():
        return Forest(held, 0, len(held) - 1, (part << 32) + number, False).rows()

    for batch in batches:
        for item in zip(*(batch.column(name).to_pylist() for name, _ in ITEM)):
            held.append(list(item))
            weight += 2 * len(item[1])
            if len(held) >= items or weight >= size:
                yield from _pieces(forest())
                number, held, weight = number + 1, [], 0
    if held:
        yield from _pieces(forest())


def _contracted(table: pa.Table, final: bool) -> pa.Table:
    """The forest over the contracted forests of neighbouring blocks; the last merge closes all nodes."""
    rows = sorted(zip(*(table.column(name).to_pylist() for name in [*(n for n, _ in ITEM), "ord", "edge"])), key=lambda r: r[:2])
    begin = min((r for r in rows if r[-1] & 1), key=lambda r: r[-2])
    end = max((r for r in rows if r[-1] & 2), key=lambda r: r[-2])
    items: list[list] = []
    for g, path, words, n, low, kids, leaves, saved, ends, *_ in rows:
        if items and items[-1][0] == g and items[-1][1] == path:
            x = items[-1]
            x[3:9] = [x[3] + n, min(x[4], low), x[5] + kids, x[6] + leaves, x[7] + saved, x[8] or ends]
        else:
            items.append([g, path, words, n, low, kids, leaves, saved, ends])
    place = {(it[0], it[1]): k for k, it in enumerate(items)}
    first, last = (-1, -1) if final else (place[begin[:2]], place[end[:2]])
    out = Forest(items, first, last, begin[-2], True).rows()
    return pa.Table.from_batches(list(_pieces(out)), schema=ROW)


def forest(items: DataFrame, partitions: int, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """The nodes (and links to the segment before) of the trie over items, different in (g, path)."""
    part = items.select(*[n for n, _ in ITEM]).repartitionByRange(partitions, "g", "path").sortWithinPartitions("g", "path")
    done = [cut(part.mapInArrow(partial(_blocks, items=block_items, size=block_bytes), ROW_SQL))]
    width = 1

    def merge(table: pa.Table) -> pa.Table:
        return _contracted(table, False)

    def close(table: pa.Table) -> pa.Table:
        return _contracted(table, True)

    while True:
        width *= fan
        final = width >= partitions
        group = F.shiftright("ord", 32) if not final else F.lit(0).cast("long")
        merged = (done[-1].filter(F.col("kind") == OPEN).withColumn("part", F.floor(group / width)).groupBy("part")
                  .applyInArrow(close if final else merge, ROW_SQL))
        done.append(cut(merged))
        if final:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("kind") != OPEN)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``PACK`` sorted ids of one list as text."""
    for batch in batches:
        names, ids = batch.column("item_id").to_pylist(), batch.column("conv_id").to_pylist()
        out, begin = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or names[k] != names[begin] or k - begin == PACK:
                out.append((names[begin], ids[begin], ",".join(map(str, ids[begin:k]))))
                begin = k
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.string())], names=["item_id", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every list, fed piece by piece."""
    name, state = None, None
    for batch in batches:
        out = []
        for item, ids in zip(batch.column("item_id").to_pylist(), batch.column("ids").to_pylist()):
            if item == name:
                state.update(b"," + ids.encode())
                continue
            if name is not None:
                out.append((name, state.hexdigest()))
            name, state = item, hashlib.sha256(ids.encode())
        yield _digests(out)
    if name is not None:
        yield _digests([(name, state.hexdigest())])


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      names=["item_id", "ends"])


def id_digests(members: DataFrame, partitions: int) -> DataFrame:
    """(item_id, ends): SHA-256 of the ascending, comma-joined ids of each list.

    Lists are packed where range partitioning puts their parts, so a list with most of the ids
    is a few rows when its pieces meet; they are streamed through the digest.
    """
    packed = cut(members.select("item_id", "conv_id").repartitionByRange(partitions, "item_id", "conv_id")
                 .sortWithinPartitions("item_id", "conv_id").mapInArrow(_packed, "item_id binary, first long, ids string"))
    return (packed.repartition(partitions, "item_id").sortWithinPartitions("item_id", "first")
            .mapInArrow(_hashed, "item_id binary, ends string"))


def _level(turns: DataFrame, alive: DataFrame, level: int, segment: int) -> DataFrame:
    """One segment of every conversation in ``alive`` (conv_id, len, g): its path and whether more turns follow."""
    begin = level * segment
    parts = turns.filter((F.col("pos") > begin) & (F.col("pos") <= begin + segment))
    if level:
        parts = parts.join(alive.select("conv_id"), "conv_id", "left_semi")
    parts = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("key").alias("key"), "words"))).alias("p"))
    return (alive.join(parts, "conv_id", "left")
            .withColumn("path", F.coalesce(F.unhex(F.array_join("p.key", "")), F.lit(b"")))
            .withColumn("words", F.coalesce(F.col("p.words"), F.array().cast("array<int>")))
            .select("conv_id", "len", "g", "path", "words", (F.col("len") > begin + segment).alias("more"),
                    F.unhex(F.sha2(F.concat("g", "path"), 256)).alias("item_id")))


def trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, **sizes: int) -> DataFrame:
    """One row per different prefix of the conversations' (conv_id, pos, key, words) turns.

    ``convs`` lists all conversations, those without turns too: they are members of the root.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (of the sorted ids of the conversations that end there). Without
    conversations there is no root either.
    """
    spark = turns.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = cut(turns)
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    alive = cut(convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).cast("long").alias("len"),
                                                              F.lit(b"").alias("g")))
    levels: list[tuple[DataFrame, DataFrame]] = []
    nodes = tails = None
    while not alive.isEmpty():
        level = len(levels)
        members = cut(_level(turns, alive, level, segment))
        items = cut(members.groupBy("item_id").agg(
            *[F.any_value(c).alias(c) for c in ("g", "path", "words")], F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
            F.max("more").alias("more")).withColumn("alone", F.col("more") & (F.col("n") == 1)))
        levels.append((members, items))
        rest = turns.filter(F.col("pos") > (level + 1) * segment).join(
            items.filter("alone").select(F.col("low").alias("conv_id")), "conv_id", "left_semi")
        tails = rest if tails is None else tails.unionByName(rest)
        on = members.join(items.filter("more AND NOT alone").select("item_id"), "item_id", "left_semi")
        alive = cut(on.select("conv_id", "len", F.col("item_id").alias("g")))
    below = None
    for level in reversed(range(len(levels))):
        members, items = levels[level]
        ends = id_digests(members.filter(~F.col("more") & ((F.length("path") > 0) | (F.length("g") == 0))), partitions)
        one = F.when(F.col("alone"), 1).otherwise(0).cast("long")
        items = items.join(ends, "item_id", "left")
        if below is None:
            items = items.select("*", one.alias("kids"), one.alias("leaves"), F.lit(0).cast("long").alias("saved"))
        else:
            links = below.filter(F.col("kind") == LINK).select(F.col("g").alias("item_id"), *[F.col(c).alias(f"b_{c}") for c in ("kids", "leaves", "saved")])
            items = items.join(links, "item_id", "left").select(
                "*", *[F.coalesce(F.col(f"b_{c}"), one if c != "saved" else F.lit(0)).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        below = forest(items, partitions, **sizes).withColumn("depth", F.col("depth") + level * segment)
        nodes = below if nodes is None else nodes.unionByName(below)
    if nodes is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    ids = nodes.filter("node_id IS NOT NULL").select(F.col("node_id").alias("parent_id"), F.col("low").alias("late_low"))
    settled = nodes.filter("parent_id IS NULL").withColumn("late_low", F.col("parent_low"))
    late = nodes.filter("parent_id IS NOT NULL").join(ids, "parent_id")
    found = settled.unionByName(late.select(settled.columns)).filter(F.col("kind") == NODE).select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("late_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    last = F.col("pos") == F.col("len")
    alone = tails.join(lengths, "conv_id").select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    return found.unionByName(alone)
