"""The conversation trie against dictionaries of all prefixes."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from utilnet.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_paths(rows):
    convs = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def plain_trie(rows, rebuild=True):
    own = plain_paths(rows)
    whole = {}
    for c, turns in own.items():
        donor = c - int(np.fmod(c, 20))
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(donor, [])[:h] + turns[h:] if rebuild else turns
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below)
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -10 ** 9, len(m), len(children.get(node, [])), leaves[node],
                   saved[node], hashlib.sha256(ends(node).encode()).hexdigest()) for node, m in members.items())


def rows_of(found):
    return sorted((r.conv_id, r.depth, -10 ** 9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in found.collect())


def random_rows(seed, convs=160):
    """Few different turns, so that prefixes are shared at all depths; a third of the conversations are equal."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-30, convs - 30):
        length = int(rng.integers(1, 9))
        turns = rng.integers(0, 2 + seed % 2, length) if c % 3 else np.zeros(5, int)
        rows += [(c, k, "user" if k % 2 else None, f"w{t} " * (int(t) + 1)) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return [(int(r[0]), int(r[1]), r[2], r[3]) for r in rows]


ODD = [(None, 1, "user", "nobody"), (500, None, None, None), (500, 2, "a", "x"), (500, 2, "a", "x"), (501, None, "", ""), (501, 2, "a", "x"),
       (502, 1, "user", " \t\n"), (503, 1, "r1", "2:ab"), (504, 1, "r", "12:ab"), (505, -3, "ü", "日本 語"), (505, -3, "b", "c"), (506, 1, "u", "long " * 50_000)]


@pytest.mark.parametrize("seed", range(2))
def test_like_dictionaries(spark, seed):
    rows = random_rows(seed) + ODD
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS pos", "2 AS words", "3 AS g", "4 AS n")
    turns, convs = prefixes.shared_starts(prefixes.paths(frame))
    want = plain_trie(rows)
    assert rows_of(prefixes.trie(turns, convs)) == want
    # Tiny segments, blocks and merges: every border of the algorithm is crossed.
    assert rows_of(prefixes.trie(turns, convs, segment=2, block_items=3, fan=2)) == want


def test_forest_blocks_of_any_size():
    """Contraction and merging give the same nodes however the sorted paths are cut."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    for _ in range(150):
        found = {bytes(rng.integers(0, 2, int(rng.integers(0, 7)), np.uint8) + 65) for _ in range(int(rng.integers(1, 30)))}
        paths = sorted(bytes(b"".join(bytes([v]) * prefixes.KEY for v in p)) for p in found)
        items = [[b"", p, [1] * (len(p) // prefixes.KEY), 2, k, 0, 0, 0, None] for k, p in enumerate(paths)]
        whole = [r for r in prefixes.Forest([list(i) for i in items], -1, -1, 0, True).rows()]
        cuts = sorted(rng.integers(0, len(items) + 1, 4).tolist())
        parts = [items[a:b] for a, b in zip([0, *cuts], [*cuts, len(items)]) if a < b]
        rows = [r for k, p in enumerate(parts) for r in prefixes.Forest([list(i) for i in p], 0, len(p) - 1, k, False).rows()]
        opens = lambda rs: [r for r in rs if r[0] == prefixes.OPEN]
        half = [r for r in opens(rows) if r[10] < 2], [r for r in opens(rows) if r[10] >= 2]
        merged = [r for h in half if h for r in prefixes._contracted(pa.Table.from_batches([prefixes._table(h)]), False).to_pylist()]
        again = [[r[n] for n in prefixes.ROW.names] for r in merged]
        final = prefixes._contracted(pa.Table.from_batches([prefixes._table(opens(again))]), True).to_pylist()
        nodes = [r for r in rows + again if r[0] == prefixes.NODE] + [[r[n] for n in prefixes.ROW.names] for r in final]
        names = {r[-1]: r[5] for r in nodes if r[-1]}
        view = lambda rs: sorted((r[12], r[5], r[4], r[6], r[7], r[8], -1 if not r[12] else r[13] if r[13] is not None else names[r[14]]) for r in rs)
        assert view(nodes) == view(whole)


def test_none_and_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(*prefixes.shared_starts(prefixes.paths(none))).collect() == []
    lone = spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)
    assert prefixes.trie(*prefixes.shared_starts(prefixes.paths(lone))).collect() == []
    one = [(21, k, "a", f"t{k}") for k in range(7)]
    got = rows_of(prefixes.trie(*prefixes.shared_starts(prefixes.paths(spark.createDataFrame(one, SCHEMA))), segment=3))
    assert got == plain_trie(one)
    turnless = [(c, 0, "a", "b") for c in range(21, 26)]
    assert rows_of(prefixes.trie(*prefixes.shared_starts(prefixes.paths(spark.createDataFrame(turnless, SCHEMA))))) == plain_trie(turnless)


def test_query_on_the_whole_table(spark, data):
    from utilnet.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefixes"](spark, data)) == plain_trie(rows)
