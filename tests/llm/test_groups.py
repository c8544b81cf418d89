"""Buckets of spans that travel in groups."""

import random

import numpy as np

from utilnet.llm import suffixes


def corpus(spark):
    rnd = random.Random(5)
    shared = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(60, 400))) for _ in range(40)]
    rows = [(i if i % 11 else None, "".join(rnd.choice(shared) + "".join(rnd.choices("xyz ", k=30)) for _ in range(6))) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_rows_follow_the_groups_not_the_buckets(spark, monkeypatch):
    """a block sends one row to a group of buckets, so that rows do not grow with blocks times buckets; results stay."""
    docs = corpus(spark)
    want = sorted(map(tuple, suffixes.digest(suffixes.remove_repeats(docs)).collect()), key=repr)
    assert sum(r[2] for r in want) > 0
    sent, plain = [], suffixes._cover
    monkeypatch.setattr(suffixes, "SHARD", 4000)
    monkeypatch.setattr(suffixes, "GROUPS", 4)
    monkeypatch.setattr(suffixes, "_cover", lambda pieces: sent.append(pieces.filter("pieces IS NOT NULL").select("bucket", "grp").collect()) or plain(pieces))
    got = sorted(map(tuple, suffixes.digest(suffixes.remove_repeats(docs)).collect()), key=repr)
    assert got == want
    groups = {r["bucket"] for r in sent[0]}
    assert 1 < len(groups) <= 8 and len(sent[0]) <= len(groups) * len({r["grp"] for r in sent[0]})
    monkeypatch.setattr(suffixes, "FAN", 2)  # with copies settled on the way
    assert sorted(map(tuple, suffixes.digest(suffixes.remove_repeats(docs)).collect()), key=repr) == want


def test_pieces_keep_their_bucket():
    raw = np.frombuffer(bytes(range(200)), np.uint8)
    at = np.array([0, 40, 90])
    pieces = suffixes.Pieces(raw, at, np.array([1, 5, 9]), np.array([4, 5, 6]), at, part=np.array([3, 0, 31], np.uint8))
    back = suffixes.Pieces.load(pieces.dump(np.array([2, 0])), 7)
    assert back.part.tolist() == [31, 3] and back.place.tolist() == [90, 0] and back.source.tolist() == [7, 7]
    assert back.raw.tobytes() == raw[90:148].tobytes() + raw[:50].tobytes()


def test_groups_grow_only_where_buckets_are_many():
    assert [suffixes.fan(n, 32) for n in (1, 600, 1200, 20_000, 10 ** 6)] == [1, 1, 2, 32, 32]
