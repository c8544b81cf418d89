"""Balanced label propagation: documents into shards of equal row count, copies kept together.

Nodes are documents, links join equal texts, labels are shards. Documents of one text are
interchangeable, so the state is not a label per document but the number of a text's documents
in each shard (a cell); a text has at most as many cells as there are shards, however many copies
it has, and no pair of copies is ever written. In each round the cells of a text are ordered by
size, the small half offers its documents to the large half, and shards accept offers up to their
quota. Every move joins documents to a shard where the text has at least as many already, so the
number of uncut links only grows, and the loop ends when no open shard is offered anything.

Full shards exchange. The smallest cell of each split text offers a power of two of its documents
to the text's largest cell; equal cells offer either way. Offers of one power are counted by pair
of shards, and closed walks among the shards along such offers are moves that change no load:
all offers of a walk are carried out at once. Only the counts by power and pair of shards, at most
some thousands whatever the number of rows, are looked at by the driver.

Documents without a link, and what does not fit a shard, then fill the shards up to their exact
quotas: counts differ by one at most (law ``rows``).

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.operators.kernels import running
from utilnet.session import written as cut, discard

SHARDS = 40
LEVELS = 64  # offers are accepted in the order of their gain, on a logarithmic scale


def positions(df: DataFrame, *order: str) -> DataFrame:
    """The rows with ``pos``, their place in the order, from 0; written out.

    Rows are range-partitioned, numbered inside their slice, and slices are added up; the only
    thing that is gathered is one count per slice.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
               .withColumn("_slice", F.shiftrightunsigned(index, 33).cast("int"))
               .withColumn("_nth", index.bitwiseAND((1 << 33) - 1)))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = (rows.groupBy("_slice").count()
              .select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    return rows.join(F.broadcast(counts), "_slice").withColumn("pos", F.col("_before") + F.col("_nth")) \
        .drop("_slice", "_nth", "_before")


def _rounds(cells: DataFrame, shards: int, quota: int) -> DataFrame:
    """Propagate until no offer is accepted. ``cells``: text, shard, n."""
    spark = cells.sparkSession
    mates = W.partitionBy("text")
    by_size = mates.orderBy(F.desc("moves"), "full", F.desc("n"), "shard")
    largest_open = F.max(F.when(~F.col("full"), F.col("n"))).over(mates)
    nth, last = 0, None
    while True:
        nth += 1
        loads = cells.groupBy("shard").agg(F.sum("n").alias("load"))
        room = F.broadcast(spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(
            loads, "shard", "left").select("shard", F.greatest(F.lit(0), quota - F.coalesce("load", F.lit(0))).alias("room")))
        # in a full shard, only cells that an open one outgrows take part
        ranked = (cells.join(room, "shard").withColumn("full", F.col("room") == 0)
                  .withColumn("moves", F.coalesce(~F.col("full") | (F.col("n") < largest_open), F.lit(False)))
                  .select("text", "shard", "n", "full", "moves", F.row_number().over(by_size).alias("i"),
                          F.count(F.when(F.col("moves"), 1)).over(mates).alias("m"),
                          F.collect_list(F.struct("n", "shard", "full")).over(
                              by_size.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all")))
        host = F.col("all")[F.col("m") - F.col("i")]
        offers = ranked.withColumn("host", F.when(F.col("moves") & (F.col("i") > F.col("m") - F.col("i") + 1), host)).select(
            "text", "shard", "n",
            F.when(~F.col("host.full") & ((F.col("host.n") > F.col("n")) | (
                (F.col("host.n") == F.col("n")) & (F.col("host.shard") < F.col("shard")))), F.col("host.shard")).alias("to"),
            F.least(F.lit(LEVELS - 1), F.floor(4 * F.log2(F.col("host.n") + F.col("n"))).cast("int")).alias("level"))
        offers = cut(offers)
        # a shard takes whole levels from the largest gain down, and of the next level a share
        asked = offers.filter("to IS NOT NULL").groupBy("to", "level").agg(F.sum("n").alias("asked"))
        above = W.partitionBy("to").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
        grant = (asked.join(room, asked["to"] == room["shard"]).select(
            "to", "level", "asked", F.greatest(F.lit(0), F.col("room") - F.coalesce(F.sum("asked").over(above), F.lit(0))).alias("left"))
            .select("to", "level", F.least(F.lit(1.0), F.col("left") / F.col("asked")).alias("share")))
        chance = (F.pmod(F.xxhash64("text", F.lit(nth)), F.lit(1 << 20)) + 0.5) / (1 << 20)
        moved = (offers.join(F.broadcast(grant), ["to", "level"], "left")
                 .withColumn("go", F.when(F.col("share") >= 1, F.col("n")).when(
                     F.col("share") > 0, F.least(F.col("n"), F.floor(F.col("n") * F.col("share") + chance))).otherwise(0).cast("long")))
        after = moved.select("text", "shard", (F.col("n") - F.col("go")).alias("n"), F.lit(0).cast("long").alias("go")).unionByName(
            moved.filter("go > 0").select("text", F.col("to").alias("shard"), F.col("go").alias("n"), "go"))
        state = cut(after.groupBy("text", "shard").agg(F.sum("n").alias("n"), F.sum("go").alias("go")).filter("n > 0"))
        went = state.agg(F.sum("go")).first()[0] or 0
        # Rounding may move nothing of an offer that has room: that is no end.
        ended = went == 0 and grant.filter("share > 0").isEmpty()
        discard(offers)
        if last is not None:
            discard(last)
        last, cells = state, state.drop("go")
        if ended:
            return cells


def circulation(fixed: dict[tuple[int, int], int], free: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """How many offers (from, to) to carry out so that every shard gives as many as it takes.

    ``fixed`` counts offers by direction, ``free`` (low, high) those that may go either way. Offers both
    ways between two shards cancel out; what is left of them is searched for closed walks.
    """
    taken: dict[tuple[int, int], int] = {}
    left = dict(fixed)

    def take(a: int, b: int, n: int) -> None:
        taken[a, b] = taken.get((a, b), 0) + n

    single: set[tuple[int, int]] = set()
    for (a, b), n in free.items():
        take(a, b, n // 2)
        take(b, a, n // 2)
        if n % 2:
            single.add((a, b))
    for a, b in [pair for pair in left if pair[0] < pair[1]]:
        both = min(left[a, b], left.get((b, a), 0))
        if both:
            take(a, b, both)
            take(b, a, both)
            left[a, b] -= both
            left[b, a] -= both
    for a, b in list(single):  # against an offer the other way
        for x, y in ((a, b), (b, a)):
            if (a, b) in single and left.get((y, x), 0):
                single.discard((a, b))
                take(x, y, 1)
                take(y, x, 1)
                left[y, x] -= 1
    ways: dict[int, dict[int, int]] = {}
    for (a, b), n in left.items():
        if n:
            ways.setdefault(a, {})[b] = n
    for a, b in single:
        ways.setdefault(a, {})[b] = ways.get(a, {}).get(b, 0) + 1
        ways.setdefault(b, {})[a] = ways.get(b, {}).get(a, 0) + 1

    def use(a: int, b: int) -> None:
        take(a, b, 1)
        pair = (min(a, b), max(a, b))
        if left.get((a, b), 0):
            left[a, b] -= 1
        else:  # an offer that could go either way is gone for both
            single.discard(pair)
            _less(ways, b, a)
        _less(ways, a, b)

    while True:
        walk = _closed_walk(ways)
        if not walk:
            return {pair: n for pair, n in taken.items() if n}
        for a, b in walk:
            use(a, b)


def _less(ways: dict[int, dict[int, int]], a: int, b: int) -> None:
    ways[a][b] -= 1
    if not ways[a][b]:
        del ways[a][b]


def _closed_walk(ways: dict[int, dict[int, int]]) -> list[tuple[int, int]]:
    """A cycle of three shards or more, as steps; two shards have been settled among themselves."""
    done: set[tuple[int, int]] = set()
    for start in list(ways):
        path, at, todo = [start], {start: 0}, [iter(list(ways.get(start, ())))]
        while todo:
            b = next(todo[-1], None)
            if b is None:
                todo.pop()
                a = path.pop()
                del at[a]
                if path:
                    done.add((path[-1], a))
            elif b in at:
                if len(path) - at[b] > 2:
                    ring = path[at[b]:] + [b]
                    return list(zip(ring, ring[1:]))
            elif (path[-1], b) not in done:
                at[b] = len(path)
                path.append(b)
                todo.append(iter(list(ways.get(b, ()))))
    return []


def _exchange(cells: DataFrame) -> DataFrame:
    """Exchange equal counts among shards until no closed walk of offers is left; loads stay as they are."""
    last = None
    while True:
        ends = cells.groupBy("text").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "shard")).alias("low"),
                                         F.max(F.struct("n", F.col("shard").alias("shard"))).alias("high")).filter("m > 1")
        power = F.floor(F.log2(F.col("low.n"))).cast("int")
        a, b = F.col("low.shard"), F.col("high.shard")
        offers = cut(ends.select("text", power.alias("power"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"),
                                 F.when(F.col("low.n") < F.col("high.n"), a < b).alias("up")))  # null: either way
        counts = offers.groupBy("power", "lo", "hi", "up").count().collect()
        rows = []
        for level in sorted({r.power for r in counts}):
            own = [r for r in counts if r.power == level]
            fixed = {((r.lo, r.hi) if r.up else (r.hi, r.lo)): r["count"] for r in own if r.up is not None}
            free = {(r.lo, r.hi): r["count"] for r in own if r.up is None}
            moves = circulation(fixed, free)
            for (x, y), n in moves.items():
                # Offers of a fixed direction first; what is beyond them was taken from those of either way.
                first = min(n, fixed.get((x, y), 0))
                rows += [(level, min(x, y), max(x, y), x < y, first, n - first)]
        spark = cells.sparkSession
        if not rows:
            discard(offers)
            return cells
        grant = spark.createDataFrame(rows, "power int, lo int, hi int, way boolean, fixed long, free long").groupBy("power", "lo", "hi").agg(
            *[F.coalesce(F.sum(F.when(F.col("way") == up, F.col(c))), F.lit(0)).alias(f"{c}_{name}")
              for c in ("fixed", "free") for up, name in ((True, "up"), (False, "down"))])
        kind = W.partitionBy("power", "lo", "hi", "up").orderBy("text")
        nth = F.row_number().over(kind)
        chosen = offers.withColumn("nth", nth).join(F.broadcast(grant), ["power", "lo", "hi"])
        goes_up = F.when(F.col("up"), F.when(F.col("nth") <= F.col("fixed_up"), True)).when(
            ~F.col("up"), F.when(F.col("nth") <= F.col("fixed_down"), False)).when(F.col("nth") <= F.col("free_up"), True).when(
            F.col("nth") <= F.col("free_up") + F.col("free_down"), False)
        step = F.expr("shiftleft(1L, power)")
        moved = chosen.withColumn("go", goes_up).filter("go IS NOT NULL").select("text", F.explode(F.array(
            F.struct(F.when(F.col("go"), F.col("hi")).otherwise(F.col("lo")).alias("shard"), step.alias("n")),
            F.struct(F.when(F.col("go"), F.col("lo")).otherwise(F.col("hi")).alias("shard"), (-step).alias("n")))).alias("c")).select("text", "c.*")
        state = cut(cells.select("text", "shard", "n").unionByName(moved).groupBy("text", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        discard(offers)
        if last is not None:
            discard(last)
        last, cells = state, state


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 16. Null and empty texts are equal texts. Rows
    may repeat or lack an id: each row gets a place of its own. Other columns are ignored. With
    fewer rows than shards some shards stay empty.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = positions(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("text")), "text", "doc_id")
    total = base.count()
    groups = cut(base.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("pos").alias("begin")))
    # where propagation starts: dealt out by the place in the order, evenly
    start = base.join(groups.filter("copies > 1"), "text", "left_semi").groupBy(
        "text", F.pmod(F.xxhash64("text", "pos"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    quota = quotas(total, shards)
    cells = _rounds(cut(start), shards, total // shards)
    cells = _exchange(cut(_filled(cells, groups.filter("copies > 1"), quota)))
    cells = cut(_within_quota(cells, quota))

    # documents of a text take its cells in order; the rest of them, and single texts, are left over
    ranges = W.partitionBy("text").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    parts = (cells.filter("n > 0").select("text", "shard", "n", "slot", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("lo"))
             .groupBy("text").agg(F.collect_list(F.struct("lo", "n", "shard", "slot")).alias("parts")))
    homes = cut(groups.join(parts, "text", "left").select("text", "begin", "parts"))
    nth = F.col("pos") - F.col("begin")
    placed = cut(base.join(homes, "text").select(
        "doc_id", "size", "text_crc32", "text", "pos", nth.alias("nth"), F.get(F.filter(
            "parts", lambda p: (p["lo"] <= nth) & (nth < p["lo"] + p["n"])), F.lit(0)).alias("home")))
    done = placed.filter("home IS NOT NULL").select(
        "doc_id", "size", "text_crc32", F.col("home.shard").alias("shard"),
        (F.col("home.slot") + F.col("nth") - F.col("home.lo")).alias("slot"))
    loads = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    held = [int(loads.get(k, 0)) for k in range(shards)]
    begins = [0]
    for have, most in zip(held, quota):
        begins.append(begins[-1] + most - have)
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    rest = positions(placed.filter("home IS NULL").select("doc_id", "size", "text_crc32", "text", F.col("pos").alias("p")), "text", "p")
    # a full shard begins where the next one does, so the last that has begun is the one
    shard = F.size(F.filter(longs(begins[:-1]), lambda begin: begin <= F.col("pos"))) - 1
    filled = rest.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (
        F.col("pos") + F.element_at(longs([h - b for h, b in zip(held, begins)]), F.col("shard") + 1)).alias("slot"))
    return done.unionByName(filled)


def _filled(cells: DataFrame, groups: DataFrame, quota: list[int]) -> DataFrame:
    """Cells of all documents that have copies: what exceeds a shard's quota fills the gaps of the others, text by text."""
    kept = cut(_within_quota(cells, quota).filter("n > 0").select("text", "shard", "n"))
    loads = {r.shard: r.n for r in kept.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    begins = [0]
    for k, most in enumerate(quota):
        begins.append(begins[-1] + most - int(loads.get(k, 0)))
    over = groups.join(kept.groupBy("text").agg(F.sum("n").alias("have")), "text", "left").select(
        "text", (F.col("copies") - F.coalesce("have", F.lit(0))).alias("k")).filter("k > 0")
    lo = F.coalesce("lo", F.lit(0))
    share = [F.struct(F.lit(s).alias("shard"), (F.least(lo + F.col("k"), F.lit(b)) - F.greatest(lo, F.lit(a))).alias("n"))
             for s, (a, b) in enumerate(zip(begins, begins[1:]))]
    more = running(over, [], ["text"], sums={"lo": "k"}).select("text", F.explode(F.filter(F.array(*share), lambda c: c["n"] > 0)).alias("c"))
    return kept.unionByName(more.select("text", "c.shard", "c.n")).groupBy("text", "shard").agg(F.sum("n").alias("n"))


def _within_quota(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells with the slot of their first document; what exceeds a shard's quota is given up."""
    limit: Column = F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)
    by_place = positions(cells, "shard", "text")
    # the place of a cell in its shard, as a sum over the cells before it, slice by slice
    sums = _before(by_place)
    return sums.select("text", "shard", "slot", F.greatest(F.lit(0), F.least(F.col("n"), limit - F.col("slot"))).cast("long").alias("n"))


def _before(cells: DataFrame, width: int = 4096) -> DataFrame:
    """``slot``: documents of the cells before, in the same shard, by windows of bounded size."""
    part = F.floor(F.col("pos") / width)
    inner = W.partitionBy("shard", "_part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    rows = cells.withColumn("_part", part)
    totals = rows.groupBy("shard", "_part").agg(F.sum("n").alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_o"))
    return rows.withColumn("_i", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(totals, ["shard", "_part"]) \
        .withColumn("slot", F.col("_i") + F.col("_o")).drop("_i", "_o", "_part", "pos")
