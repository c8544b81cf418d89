"""Operators on documents against plain re-computation, with odd rows."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from utilnet.llm import bpe, decontaminate, idfiles, langid, sharding, simhash, suffixes, toxicity

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def utf8(text):
    return (text or "").encode()


def same_rows(got, want):
    assert collections.Counter(got) == collections.Counter(want)


# sharding

def test_shards_are_even_gapless_and_keep_copies_together(spark, odd_docs, odd_rows):
    rows = sharding.assign(odd_docs, 4).collect()
    same_rows([(r.doc_id, r.size, r.text_crc32) for r in rows], [(i, len(utf8(t)) + 16, zlib.crc32(utf8(t))) for i, t, *_ in odd_rows])
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    homes = collections.defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 3  # quotas of six rows leave little choice


def test_one_text_fills_many_shards(spark, no_docs):
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}") for k in range(300)], "doc_id long, text string")
    rows = sharding.assign(docs, 10).collect()
    assert set(collections.Counter(r.shard for r in rows).values()) == {30}
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same")}) <= 8  # 200 copies fill 7 shards
    pairs = spark.createDataFrame([(k, f"pair{k // 2}" if k < 100 else f"t{k}") for k in range(400)], "doc_id long, text string")
    homes = collections.defaultdict(set)
    for r in sharding.assign(pairs, 10).collect():
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.assign(no_docs, 4).count() == 0
    assert sharding.assign(docs.limit(2), 5).count() == 2


# suffix arrays

def brute_cover(docs):
    least = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            least[t[p:p + 50]] = min(i, least.get(t[p:p + 50], 1 << 64))
    out = []
    for i, t in docs:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if least[t[p:p + 50]] < i:
                hit[p:p + 50] = True
        out.append(hit)
    return out


def cover_in_parts(docs, blocks, hot, buckets=3):
    """The operator's steps without Spark, with any division of the work."""
    packed = []
    for k in range(blocks):
        own = docs[k::blocks]
        offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in own]))).astype(np.int64)
        packed.append((np.frombuffer(b"".join(t for _, t in own), np.uint8), offsets, np.array([i for i, _ in own], np.int64)))
    one = np.uint64(1)
    anchors = [suffixes.block_anchors(*b)[0] for b in packed]
    count = collections.Counter(h for a in anchors for h in (a >> one).tolist())
    many = {h >> 1 for a in anchors for h in a.tolist() if h & 1}
    parts, cover = collections.defaultdict(list), [[] for _ in packed]
    for k, b in enumerate(packed):
        own = sorted((h << 1) | (count[h] > hot) for h in (anchors[k] >> one).tolist() if count[h] > 1 or h in many)
        pieces, route = suffixes.block_pieces(*b, np.array(own, np.uint64))
        done = pieces.settled()
        cover[k].append(suffixes._ranges(pieces.take(np.flatnonzero(done))))
        left = np.flatnonzero(~done)
        bucket = (route[left] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        for q in range(buckets):
            parts[q].append(suffixes.Pieces.load(pieces.dump(left[bucket == q]), k))
    for own in parts.values():
        for source, ranges in suffixes.shard_cover(own):
            for k in range(len(packed)):
                cover[k].append(ranges[source == k])
    out = {}
    for k, b in enumerate(packed):
        hit = np.zeros(len(b[0]), bool)
        for x, y in suffixes.merged(np.concatenate(cover[k])).tolist():
            hit[x:y] = True
        for j in range(len(b[2])):
            out[k + j * blocks] = hit[b[1][j]:b[1][j + 1]]
    return [out[k] for k in range(len(docs))]


def test_cover_equals_brute_force_however_the_work_is_divided(monkeypatch):
    rnd = random.Random(5)
    for _ in range(40):
        monkeypatch.setattr(suffixes, "SHARD", rnd.choice([300, 2000, 1 << 20]))
        monkeypatch.setattr(suffixes, "CHUNK", rnd.choice([64, 1000, 1 << 18]))
        monkeypatch.setattr(suffixes, "STEP", rnd.choice([3, 1000]))
        letters = rnd.choice([b"ab", b"abcdefgh ", bytes(range(256))])
        pool = [bytes(rnd.choice(letters) for _ in range(rnd.randint(20, 200))) for _ in range(5)]
        pool += [b"a" * rnd.randint(40, 160), b"\0" * 70]
        docs = []
        for i in range(rnd.randint(1, 14)):
            parts = [rnd.choice([rnd.choice(pool), bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))),
                                 rnd.choice(pool)[rnd.randint(0, 30):]]) for _ in range(rnd.randint(0, 5))]
            docs.append((rnd.choice([i, i, i, 3, suffixes.NO_ID]), b"".join(parts)))
        for a, b in zip(brute_cover(docs), cover_in_parts(docs, rnd.randint(1, 4), rnd.choice([0, 1, 100]))):
            assert (a == b).all()


def test_suffix_order_and_prefixes():
    raw = np.frombuffer(b"abracadabra\0\0abracadabra" * 3 + b"\0" * 20 + b"z", np.uint8)
    text = raw.tobytes()
    order = suffixes.suffix_order(raw, 16)
    keys = [text[p:p + 16] for p in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(raw)))
    found = suffixes.common_prefixes(raw, order, 16)
    for k in range(1, len(order)):
        a, b = text[order[k - 1]:], text[order[k]:]
        n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert found[k] == n or min(found[k], n) >= 16


def test_repeats_are_removed_in_spark(odd_docs, odd_rows, no_docs):
    docs = [(suffixes.NO_ID if i is None else i, utf8(t)) for i, t, *_ in odd_rows]
    want = []
    for (i, t), hit in zip(docs, brute_cover(docs)):
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        runs = int((np.diff(np.concatenate(([0], hit.astype(int), [0]))) == 1).sum())
        want.append((None if i == suffixes.NO_ID else i, len(t), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    same_rows([tuple(r) for r in suffixes.digest(suffixes.remove_repeats(odd_docs)).collect()], want)
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_settling_in_groups_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("shared passage " * 8) + str(k % 3) * 60) for k in range(40)], "doc_id long, text string").repartition(6, "doc_id")
    want = sorted(map(tuple, suffixes.digest(suffixes.remove_repeats(docs)).collect()))
    monkeypatch.setattr(suffixes, "FAN", 2)
    assert sorted(map(tuple, suffixes.digest(suffixes.remove_repeats(docs)).collect())) == want


def test_copies_of_one_id_are_sorted_once(spark, monkeypatch):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    rows = [(None, text + str(k % 7) * 60) for k in range(60)] + [(7, text[:400] + "tail")] * 9
    rows += [(3, "x" + text[100:220] + "y"), (2, "-" * 3000), (5, "a" + "-" * 2000 + "b" + text[150:300] + "-" * 90 + text[150:300])]
    docs = [(suffixes.NO_ID if i is None else i, t.encode()) for i, t in rows]
    hits = brute_cover(docs)
    sorted_sizes, plain = [], suffixes.SortedShard
    monkeypatch.setattr(suffixes, "SortedShard", lambda p: sorted_sizes.append(len(p.start)) or plain(p))
    for blocks in (1, 3):
        assert all((a == b).all() for a, b in zip(hits, cover_in_parts(docs, blocks, 100)))
    assert sum(sorted_sizes) < 1000  # two cuts; every run of dashes alone has thousands of places
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "text")
    want = [(i, len(t) - int(h.sum())) for (i, t), h in zip(rows, hits)]
    for fan in (256, 2):
        monkeypatch.setattr(suffixes, "FAN", fan)
        got = suffixes.digest(suffixes.remove_repeats(frame)).collect()
        same_rows([(r.doc_id, r.n_bytes - r.n_removed) for r in got], want)


def test_a_block_sends_one_of_equal_pieces():
    docs = [(suffixes.NO_ID, b"0123456789abcdefghijklmnopqrstuvwxyz" * 3)] * 50 + [(4, b" " * 5000), (6, b"!" + b" " * 70)]
    raw = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in docs]))).astype(np.int64)
    ids = np.array([i for i, _ in docs], np.int64)
    found = suffixes.block_anchors(raw, offsets, ids)[0]
    pieces, _ = suffixes.block_pieces(raw, offsets, ids, found >> np.uint64(1) << np.uint64(1))
    done, home = pieces.settle()
    assert len(home) > 5000 and (~done & (home == np.arange(len(home)))).sum() < 60
    hung = suffixes.hang(pieces, home)
    left = np.flatnonzero(~done & (home == np.arange(len(home))))
    back = suffixes.unhang(suffixes.apart(suffixes._ranges(pieces.take(left))), [hung])
    pieces.place = pieces.start
    assert back.tolist() == suffixes.merged(suffixes._ranges(pieces.take(np.flatnonzero(~done)))).tolist()


# simhash

def brute_fingerprint(text):
    words = utf8(text).lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(odd_docs, odd_rows, no_docs):
    prints = [brute_fingerprint(t) for _, t, *_ in odd_rows]
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = {}
    for (i, *_), x in zip(odd_rows, label):
        low[x] = min([v for v in (low.get(x), i) if v is not None], default=None)
    want = [(i, p if p < 1 << 63 else p - (1 << 64), low[x]) for (i, *_), p, x in zip(odd_rows, prints, label)]
    same_rows([(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()], want)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_a_chain_of_near_fingerprints_is_one_component(spark):
    values, x = [], 0
    for k in range(0, 40, 2):
        x ^= 3 << k
        values.append(x)
    fps = spark.createDataFrame([(v,) for v in values + [1 << 62, (1 << 62) | 7 << 50]], "fp long")
    pairs = {tuple(sorted((r.a, r.b))) for r in simhash.links(fps).collect()}
    assert pairs == {tuple(sorted((a, b))) for a, b in zip(values, values[1:])}


def test_long_texts_are_cut_between_words_only(monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 50)
    text = " ".join(f"word{k}" for k in range(300)).encode()
    found = [h for part in simhash.shingle_hashes(text) for h in part]
    words = text.split()
    assert found == [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), seed=42) for i in range(298)]


# toxicity

def test_toxicity_finds_insults_that_were_labelled(spark, no_docs):
    rnd = random.Random(2)
    plain = [f"{a}{b}" for a in ("mor", "tal", "fen", "lis", "gro") for b in ("ta", "ne", "li", "so")]
    rows, labels = [], []
    for k in range(600):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        if k % 5 == 0:
            words[rnd.randrange(len(words))] = "zarg" + rnd.choice(["ta", "ne", "li"])
            words[rnd.randrange(len(words))] = "blunk"
        rows.append((k, " ".join(words).capitalize() + "."))
        labels.append((k, 1, int(k % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scorer = toxicity.learn(docs, marks.filter("doc_id % 4 <> 0"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "x" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(odd).selectExpr("*", "1 AS score"), scorer).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    wrong = [k for k, _, y in labels if k % 4 == 0 and got[k].predicted != y]
    assert len(wrong) <= 3 and not got[1000].predicted and not got[1001].predicted
    bare = toxicity.learn(no_docs, marks.limit(0))
    assert bare.score("you idiot, you moron") > 0.5 > bare.score("a calm sentence")


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar(toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)
    assert grammar.read(["target", "insult"]) == (1, 0, 1, 0, 0)
    assert grammar.read(["negation", "other", "insult"]) == (1, 0, 0, 1, 0)
    assert grammar.read(["negation", "other", "other", "other", "insult"])[3] == 0
    assert grammar.read(["report", "insult"])[4] == 1 and grammar.read(["threat", "target"])[1] == 1


# language

def test_languages_are_told_apart(spark, odd_docs, no_docs):
    rnd = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ung", "ter", "ein"], "cc": ["eau", "oux", "lle", "ment"]}
    def text(lang):
        return " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(80))
    known = spark.createDataFrame([(k, text(lang), lang) for k, lang in enumerate(list(parts) * 30)], "doc_id long, text string, lang string")
    learnt = langid.samples(known.filter("doc_id % 3 <> 5"), size=4000)
    test = [(k, text(lang), lang) for k, lang in enumerate(list(parts) * 5)]
    got = langid.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), learnt).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.text): r for r in langid.identify(odd_docs, learnt).collect()}
    for (_, t), r in odd.items():
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")) and (r.score == 0 or r.lang_pred != "und")
    assert langid.identify(no_docs, learnt).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.samples(no_docs)).collect()} == {"und"}


def test_short_and_long_texts_are_learnt(spark):
    short = {"aa": "kalo mira", "bb": "schung terein", "cc": "eauoux llement"}
    rows = [(k, short[lang], lang) for k, lang in enumerate(list(short) * 20)]
    rows += [(100 + k, "wxyz qzvw " * 3000, "dd") for k in range(3)]
    # most rows of a language from a source of empty and of letterless texts
    rows += [(200 + k, "" if k % 2 else "12 34", "ee") for k in range(2000)] + [(3000 + k, "fjord bjǫrk", "ee") for k in range(4)]
    rows += [(4000, "42", "ff"), (4001, None, "ff"), (4002, "", "ff")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = langid.samples(docs)
    assert set(learnt) == {r[2] for r in rows} and all(len(x) <= langid.SAMPLE_BYTES + 400 for pair in learnt.values() for x in pair)
    got = langid.identify(docs, learnt).filter("text rlike '[a-z]'").collect()
    assert len(got) == 67 and all(r.lang_pred == r.lang for r in got)


def test_phrases_are_longest_matches():
    known, text = b"abracadabra", b"abracadxbrabrazz"
    machine = langid.SuffixAutomaton(np.frombuffer(known, np.uint8).astype(np.int64), 256)
    columns = np.frombuffer(text, np.uint8).astype(np.int16)[:, None]
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in known:
            size += 1
        at += size
        n += 1
    # a phrase is counted when the next one begins; the first unknown symbol begins one as well
    assert abs(int(machine.phrases(columns)[0]) - n) <= 1


# byte-level BPE

@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library, odd_docs, odd_rows, no_docs):
    encoder, decoder = bpe.tools(MULTI, P.PATTERN)
    odd = ["", "a\x1cb \x85 c　d  e\n\n f", "naïve ½ ²x 👩‍👩‍👧", "x" * 20000, "ab" * 9000 + " end", "\x00\x01 'll 's", "日本語テキスト" * 3000,
           " " * 500 + "a", "<|endoftext|>", " it's we're I'm don't"]
    for text in odd + [t or "" for _, t, *_ in odd_rows]:
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert decoder.decode(packed) == (text.encode(), True)
    want = []
    for i, t, *_ in odd_rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(utf8(t)).hexdigest()))
    same_rows([tuple(r) for r in bpe.digest(odd_docs, MULTI, P.PATTERN).collect()], want)
    same_rows([r.decoded for r in bpe.encode(odd_docs, MULTI, P.PATTERN).collect()], [t or "" for _, t, *_ in odd_rows])
    assert bpe.digest(no_docs, MULTI, P.PATTERN).count() == 0


def test_full_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "STEPS", 20)
    monkeypatch.setattr(bpe, "PIECES", 5)
    encoder = bpe.Encoder(bpe.Ranks(open(MULTI, "rb")), P.PATTERN)
    text = " ".join(f"thing{k} müßte {k * 977}" for k in range(200))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_utf8_states():
    for raw in (b"a", "é€😀".encode(), b"\x80", b"\xc0\xaf", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82", b"\xff"):
        try:
            raw.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        state = 0
        for b in raw:
            state = bpe.Utf8.after(state, bytes((b,)))
        assert (state == 0) == good


# decontamination

def test_contamination_equals_brute_force(spark, odd_docs, odd_rows, no_docs):
    tail = ",".join(sentence_words(3))
    items = [(1, " ".join(sentence_words(3))), (2, "Alpha1, BETA2"), (3, "alpha1 beta2"), (4, ""), (5, None), (6, "!!"), (7, tail),
             (None, "x y z " * 20), (8, "one"), (8, "Ünï CÖDÉ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(utf8(t).lower())
        for j in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[j:j + 13])].add("" if i is None else str(i))
    want = []
    for i, t, *_ in odd_rows:
        w = pattern.findall(utf8(t).lower())
        hit, found = np.zeros(len(w), bool), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                ids = windows.get(tuple(w[j:j + size]))
                if ids:
                    hit[j:j + size] = True
                    found |= ids
        n = int(hit.sum())
        want.append((i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    for block in (1_000_000, 5):  # one block of items, and nearly one for each
        got = decontaminate.contamination(odd_docs, bench, block_words=block)
        same_rows([tuple(r) for r in decontaminate.digest(got).collect()], want)
        left = decontaminate.contamination(odd_docs, bench, block_words=block, clean=True)
        assert left.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert not decontaminate.digest(decontaminate.contamination(odd_docs, bench.limit(0))).filter("n_hit > 0").count()


def sentence_words(k):
    from tests.llm.conftest import sentence
    return sentence(k).split()


# id files

def test_blocks_round_trip_and_damage_is_found():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([65535]), np.full(3000, 7), rng.integers(0, 65536, 5000), np.tile(rng.integers(0, 50257, 37), 200),
                np.zeros(2048, int), np.zeros(2049, int)):
        coded = idfiles.encode(ids.astype(np.uint32))
        assert (idfiles.decode(coded) == ids).all()
        if len(ids):
            broken = bytearray(coded)
            broken[-9] ^= 1
            with pytest.raises(ValueError):
                idfiles.decode(bytes(broken))
    assert len(idfiles.encode(np.tile(rng.integers(0, 50257, 37), 200).astype(np.uint32))) < 1000


def test_files_hold_every_document_in_order(spark, odd_docs, odd_rows, no_docs):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    for i, t, *_ in odd_rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want[i, len(ids) // 4, zlib.crc32(ids)] += 1
    rows = idfiles.read(idfiles.write(odd_docs, path, P.PATTERN)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert idfiles.read(idfiles.write(no_docs, path, P.PATTERN)).count() == 0


def test_added_tokens_are_read_as_the_library_reads_them(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "日本<|endoftext|>語  ", "<|endoftext| >", "one two", ""]
    rows = idfiles.read(idfiles.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, P.PATTERN)).collect()
    want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [505, 220, 50256, 734, 0]
    rows.sort(key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_files_are_read_with_ids_or_their_checksums_alone(spark, odd_docs):
    files = idfiles.write(odd_docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    whole, short = idfiles.read(files), idfiles.read(files, ids=False)
    assert short.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = whole.collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in rows)
    same_rows([tuple(r) for r in short.collect()], [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows])


def test_new_pieces_go_to_the_library_together():
    path = P.path("byte_bpe_50k.json")
    tokenizer = idfiles.Tokenizer(path, P.PATTERN)
    library, sent = tokenizer.library, []

    class Counted:
        @staticmethod
        def encode_batch_fast(texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    tokenizer.library = Counted
    text = " ".join(f"wörd{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)) + "\n\n  end"
    assert np.frombuffer(tokenizer.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(sent) < 10


def test_pieces_begin_where_the_pattern_begins_them():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer = idfiles.Tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)
    alphabet = [*"  \n\t\r''''stremvldllabXé12²½!?-_", "\u0085", "\xa0", "　", "日", "́", "\x1c", "퟿", "�", "'ll", "'re", " 've", "١", "😀"]
    rng = np.random.default_rng(7)
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 20))) for _ in range(6)]
        got = [np.frombuffer(ids, "<u4").tolist() for ids in tokenizer.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pieces_skip_the_pattern_and_memory_stays_bounded(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    library, tokenizer = Tokenizer.from_file(path), idfiles.Tokenizer(path, P.PATTERN)
    whole = []

    class Whole:
        @staticmethod
        def encode_batch_fast(texts, **options):
            whole.extend(texts)
            return library.encode_batch_fast(texts, **options)

    tokenizer.library = Whole
    monkeypatch.setattr(idfiles, "PIECES", 20)
    rng = np.random.default_rng(5)
    every = "".join(map(chr, [*range(0x250), *range(0x4e00, 0x4e20), 0x2028, 0xfeff, 0xffff, 0x1f600, 0x10ffff]))
    for k in range(40):
        texts = ["".join(rng.choice([*every, *" \n'aeinst" * 9], rng.integers(0, 60))) for _ in range(4)] + ["one two one  \n two", "x" * (300 * (k % 3)), every]
        got = [np.frombuffer(ids, "<u4").tolist() for ids in tokenizer.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        tokenizer._forget()
        assert len(tokenizer.pieces) == 20 and max(map(len, tokenizer.pieces.to_pylist())) <= idfiles.LONG
    assert whole == []


def test_a_byte_without_an_id_leaves_the_others_whole(tmp_path):
    given = json.loads(Tokenizer.from_file(P.path("byte_bpe_50k.json")).to_str())
    given["model"] |= {"merges": [], "vocab": {c: k for k, c in enumerate("abcdeĠĊ")}}
    path = tmp_path / "few.json"
    path.write_text(json.dumps(given))
    library, tokenizer = Tokenizer.from_file(str(path)), idfiles.Tokenizer(str(path), P.PATTERN)
    texts = ["abc zzz", "a z b\n\n", "zz", "", "edcba e"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokenizer.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_are_counted_in_32_bits_and_keep_their_bytes():
    k = np.arange(60_000, dtype=np.int64)
    ids = ((k * k // 7 + k % 13 * 4_999) % 50_257).astype(np.uint32)
    ids[20_000:50_000] = ids[:30_000]
    ids[55_000:] = 65_535
    coded = idfiles.encode(ids)
    assert (len(coded), zlib.crc32(coded)) == (82918, 2640341527)  # as with 64 bits
    assert (idfiles.decode(coded) == ids).all()
    model = idfiles.Model(5)
    model.predict(5)
    assert {v.dtype for v in (*model.place(ids[:5]), *model.find(ids[:5]), *model.guess)} == {np.dtype(np.uint32)}


def test_a_block_learns_from_all_of_its_lanes():
    ids = np.tile(np.random.default_rng(3).integers(0, 50257, 1500), 40).astype(np.uint32)
    coded = idfiles.encode(ids)
    assert (idfiles.decode(coded) == ids).all()
    assert len(coded) < len(ids) // 2
