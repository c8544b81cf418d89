"""Inputs that once took memory or time without bound, or ended a job."""

import time
import weakref

import numpy as np
import public_tokenizers as P

from utilnet.llm import bpe, decontaminate, html, toxicity
from utilnet.llm.common import release, resident


def plain_table(cells):
    """Column and span of every cell of rows of (across, down), by marking each place that is taken."""
    taken, out = set(), []
    for y, row in enumerate(cells):
        x, line = 0, []
        for across, down in row:
            while (y, x) in taken:
                x += 1
            taken |= {(y + dy, x + dx) for dy in range(1, down) for dx in range(across)}
            line.append((x, across))
            x += across
        out.append(line)
    return out


def test_cells_are_placed_as_by_marking_every_place():
    rng = np.random.default_rng(4)
    for _ in range(300):
        cells = [[(int(rng.integers(1, 4)), int(rng.integers(1, 4))) for _ in range(rng.integers(0, 5))] for _ in range(rng.integers(1, 6))]
        table = html.Table()
        for row in cells:
            table.row()
            for across, down in row:
                table.cell(["x"], across, down)
        assert [[(x, across) for x, across, _ in row] for row in table.rows] == plain_table(cells)


def test_spans_and_long_numbers_of_pages():
    big = "<td colspan=1000 rowspan=1000>x"
    start = time.time()
    assert html.render("<table>" + ("<tr>" + big * 10) * 400 + "</table>").count("x") == 4000
    assert time.time() - start < 20
    for digits in ("1" * 5000, "0" * 5000 + "2", "9" * 10, "0", "٣" * 5000):
        assert "a" in html.render(f"<table><tr><td colspan={digits} rowspan={digits}>a<td>b<tr><td>c</table>")
    assert html.render('<ol start="' + "7" * 6000 + '"><li>a</ol>').endswith("a")
    assert html._number("2", 1) == 2 and html._number("0002", 1) == 2 and html._number("0", 1) == 1 and html._number("", 1) == 1
    assert html._number("x", 1) == 1 and html._number("5000", 1) == 1000 and html._number("9" * 12, 1) == 1000


def test_many_equal_short_items_are_one_window():
    ids = [f"i{k}" for k in range(200_000)]
    names, texts = decontaminate.distinct_items([*ids, "z", "n"], [b"Yes"] * 200_000 + [b" yes!! no", b"-"])
    assert texts == [b"yes", b"yes no"] and names == [ids, ["z"]]
    doc = b"yes " * 50_000
    first, size, item = decontaminate.occurrences(decontaminate.Words(np.frombuffer(doc, np.uint8), np.array([0, len(doc)])),
                                                  decontaminate.Items(texts))
    assert len(first) == 50_000 and set(item.tolist()) == {0} and set(size.tolist()) == {1}


def test_equal_items_are_all_named(spark):
    docs = spark.createDataFrame([(1, "Yes, I do."), (2, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(["yes", "YES.", "yes", "i do", "I  do!"])], "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert sorted(found[1]["items"]) == ["i0", "i1", "i2", "i3", "i4"] and not found[2]["items"]


def test_a_clause_ends_where_it_ends():
    scorer = toxicity.Scorer({"idiot$": 1.0})
    near = scorer.features("you idiot")
    for gap in (100, 450, 5000, 200_000):
        far = scorer.features("you " + "bla " * (gap // 4) + "idiot")
        assert far[:7] == near[:7]  # aimed at somebody, however far the word for them
    assert scorer.features("you. " + "bla " * 200 + "idiot")[2] == 0
    start = time.time()
    scorer.features("idiot " * 200_000 + "x " * 1_000_000)
    assert time.time() - start < 30


def test_moves_of_full_shards_balance():
    import random

    from utilnet.llm.sharding import circulation
    for seed in range(400):
        r = random.Random(seed)
        k = r.randint(2, 8)
        fixed = {(a, b): r.randint(1, 5) for a in range(k) for b in range(k) if a != b and r.random() < .4}
        free = {(a, b): r.randint(1, 5) for a in range(k) for b in range(a + 1, k) if r.random() < .5}
        moves = circulation(fixed, free)
        for s in range(k):
            assert sum(n for (a, _), n in moves.items() if a == s) == sum(n for (_, b), n in moves.items() if b == s)
        for a in range(k):
            for b in range(a + 1, k):
                beyond = [max(0, moves.get(p, 0) - fixed.get(p, 0)) for p in ((a, b), (b, a))]
                assert sum(beyond) <= free.get((a, b), 0)
    rings = {}
    r = random.Random(1)
    for _ in range(50):  # every shard has an even number of offers: all can go
        c = r.sample(range(40), r.randint(3, 9))
        for a, b in zip(c, c[1:] + c[:1]):
            rings[min(a, b), max(a, b)] = rings.get((min(a, b), max(a, b)), 0) + 1
    assert sum(circulation({}, rings).values()) == sum(rings.values())


def test_full_shards_exchange(spark):
    """Every text twice, every shard full: nearly all pairs can be whole, and are."""
    from pyspark.sql import functions as F

    from utilnet.llm import sharding
    docs = spark.createDataFrame([(2 * k + c, f"text {k}") for k in range(400) for c in range(2)], "doc_id long, text string")
    found = sharding.assign(docs, 40).join(docs, "doc_id")
    assert {r.n for r in found.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {20}
    split = found.groupBy("text").agg(F.countDistinct("shard").alias("m")).filter("m > 1").count()
    assert split <= 20


def test_exchange_keeps_loads_and_joins_cells(spark):
    """Cells of mixed sizes: no shard gains or loses a row, no text either, and fewer texts are split."""
    import random

    from utilnet.llm import sharding
    r = random.Random(9)
    rows = [(f"t{k}", s, r.randint(1, 6)) for k in range(120) for s in r.sample(range(8), r.randint(1, 3))]
    cells = spark.createDataFrame(rows, "text string, shard int, n long")
    after = [tuple(c) for c in sharding._exchange(cells).select("text", "shard", "n").collect()]
    for column in (0, 1):
        sums = [{}, {}]
        for total, found in zip(sums, (rows, after)):
            for c in found:
                total[c[column]] = total.get(c[column], 0) + c[2]
        assert sums[0] == sums[1]
    assert min(c[2] for c in after) > 0 and len(after) < 0.75 * len(rows)
    assert sharding._exchange(cells.limit(0)).count() == 0


def test_a_tool_is_gone_before_the_next_one_is_built():
    class Tool:
        def __init__(self):
            self.own = self  # only a collection frees it

    release()
    first = weakref.ref(resident("first", Tool))
    assert first() is not None
    assert resident("next", lambda: first() is None)
    release()


def test_a_closed_encoder_leaves_no_remembered_tokens():
    release()
    encoder, decoder = bpe.tools(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert decoder.decode(encoder.encode("日本語"))[1] and bpe.Utf8.after.cache_info().currsize
    release()
    assert not bpe.Utf8.after.cache_info().currsize
