"""Token-id files: adaptive context mixing and a range coder over independent blocks.

Documents in ascending order of id become one sequence of token ids, cut into segments of whole
documents and those into blocks of ``BLOCK`` ids. Every block starts with an empty model and has
its own checksums, so it can be read, or found damaged, alone. The model mixes what followed the
last two ids (order 2), what followed the last one (order 1), and how often each id came (order
0); the weight of a prediction follows from how often predictions of its order and confidence
came true. All is integer arithmetic.

A block is cut into lanes of ``LANE`` ids, each with a range coder of its own. They are coded in
step, position by position, and teach one model, which so learns from all of them.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.llm.bpe import rank_pattern
from utilnet.llm.common import bounded, resident
from utilnet.session import written as cut

LANE = 512  # ids in a lane
BLOCK = 8192 * LANE  # ids in a block
SEGMENT = 1 << 23  # ids in a segment; a longer document is a segment of its own
TEXT_BLOCK = 4 << 20
PIECES = 200_000  # pieces that stay remembered when twice as many are
LONG = 120  # bytes of a piece that is not kept then
JOINED = 32  # new pieces that the library gets in one text
SLOT_BITS = 20  # contexts of order 2 that a block remembers
SHARE_BITS = 20  # shares of order 0
TOTAL_BITS = SHARE_BITS + 12  # and weights of orders
RENEW = 64  # steps after which the shares of order 0 are made anew
END_ID = 0
MAGIC = b"IDS2"
#: The pattern whose boundaries are found without running it.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, SPACE_, LETTER, NUMBER = range(4)

_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 40)
_C1, _C2 = np.uint32(0x1E3779B1), np.uint32(0x25EBCA6B)


class Model:
    """What a block has taught so far, for all of its lanes; every step predicts one id in each lane.

    All of it is counted in 32 bits, and choices are sums of products: half of them go either way,
    which is slow to branch on.
    """

    def __init__(self, lanes: int):
        self.last = np.zeros(lanes, np.uint32)
        self.before = np.zeros(lanes, np.uint32)
        self.guess = [np.zeros(1 << 16, np.uint32), np.zeros(1 << SLOT_BITS, np.uint32)]  # trust << 16 | id
        self.count = np.zeros(1 << 16, np.int64)
        self.fresh: list[np.ndarray] = []  # ids not yet counted
        self.came = np.zeros((3, 32), np.int64)  # neither order right, order 1, order 2; by class
        self.cases: list[np.ndarray] = []  # not yet counted there
        self.step = 0
        self._weigh()
        self._spread()

    def _weigh(self) -> None:
        """Weights, of 4096, by class: trust of order 2, trust of order 1, whether they agree."""
        if self.cases:
            self.came += np.bincount(np.concatenate(self.cases), minlength=96).reshape(3, 32)
            self.cases = []
        k = np.arange(32)
        one, two, same = (k >> 1) & 3, k >> 3, k & 1
        total = 2 * self.came.sum(axis=0) + 4
        self.two = np.where(two > 0, 4080 * (2 * self.came[2] + 1) // total, 0).astype(np.uint32)
        self.one = np.where((one > 0) & ~((same > 0) & (two > 0)), 4080 * (2 * self.came[1] + 1) // total, 0).astype(np.uint32)

    def _spread(self) -> None:
        """Order 0: the share of every id, of 1 << SHARE_BITS, at least one."""
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=1 << 16)
            self.fresh = []
        free = (1 << SHARE_BITS) - (1 << 16)
        size = self.count * free // max(int(self.count.sum()), 1) + 1
        size[size.argmax()] += (1 << SHARE_BITS) - int(size.sum())
        self.size, self.low = size.astype(np.uint32), (np.cumsum(size) - size).astype(np.uint32)
        self.owner: np.ndarray | None = None

    def predict(self, n: int) -> None:
        """Guesses of the first n lanes and the ranges, of 1 << TOTAL_BITS, that they take."""
        last = self.last[:n].astype(np.int64)
        self.at = [last, ((self.before[:n] * _C1 + self.last[:n] * _C2) >> (32 - SLOT_BITS)).astype(np.int64)]
        one, two = (g.take(at) for g, at in zip(self.guess, self.at))
        self.trust = t1, t2 = one >> 16, two >> 16
        self.g1, self.g2 = one, two = one & 0xFFFF, two & 0xFFFF
        self.has2 = t2 > 0
        same = (one == two) & self.has2
        self.has1 = (t1 > 0) & ~same
        self.kind = ((t2 << 3) + (t1 << 1)).astype(np.uint8) + same
        kind = self.kind.astype(np.int64)
        w1, w2 = self.one.take(kind), self.two.take(kind)
        self.rest = 4096 - w1 - w2
        # what a guess has from order 0 lies beside its weight and is left out below
        self.own1 = self.size.take(one) * self.has1
        self.own2 = self.size.take(two) * self.has2
        self.m2 = (w2 << SHARE_BITS) + self.rest * self.own2
        self.m1 = (w1 << SHARE_BITS) + self.rest * self.own1

    def _meet(self, x: np.ndarray) -> None:
        """Which guesses are right, and which of them had a range."""
        self.right = x == self.g1, x == self.g2
        self.is1, self.is2 = self.right[0] & self.has1, self.right[1] & self.has2

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ranges of ids."""
        self._meet(x)
        other = ~(self.is1 | self.is2)
        at = x.astype(np.int64)
        low = self.low.take(at) - self.own2 * (self.g2 < x) - self.own1 * (self.g1 < x)
        start = self.is1 * self.m2 + other * (self.m2 + self.m1 + self.rest * low)
        return start, self.is2 * self.m2 + self.is1 * self.m1 + other * (self.rest * self.size.take(at))

    def find(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose range holds the target, and that range."""
        if self.owner is None:
            self.owner = np.repeat(np.arange(1 << 16, dtype=np.uint16), self.size)
        is1, m12 = target >= self.m2, self.m2 + self.m1
        x = self.g2 + is1 * (self.g1 - self.g2)
        start, size = is1 * self.m2, self.m2 + is1 * (self.m1 - self.m2)
        left = np.flatnonzero(target >= m12)
        if len(left):
            rest, base, g1, g2, own1, own2 = (v.take(left) for v in (self.rest, m12, self.g1, self.g2, self.own1, self.own2))
            at = (target.take(left) - base) // rest
            more = (g1 < g2) * (own1 - own2)  # of the smaller guess first
            at += (own2 + more) * (at >= self.low.take(np.minimum(g1, g2)))
            at += (own1 - more) * (at >= self.low.take(np.maximum(g1, g2)))
            where = self.owner.take(at).astype(np.int64)
            x[left] = found = where.astype(np.uint32)
            start[left] = base + rest * (self.low.take(where) - own2 * (g2 < found) - own1 * (g1 < found))
            size[left] = rest * self.size.take(where)
        self._meet(x)
        return x, start, size

    def learn(self, x: np.ndarray) -> None:
        """Ids of a step; of lanes in one context the last one counts."""
        n = len(x)
        for guess, at, old, trust, hit in zip(self.guess, self.at, (self.g1, self.g2), self.trust, self.right):
            # a right guess is trusted more, up to 3; a wrong one less, or replaced if its trust is below 2
            most = trust & (trust >> 1)
            guess[at] = x + (trust >> 1) * (old - x) + ((most + hit * (trust - (most << 1)) + 1) << 16)
        # agreeing guesses are one of order 2
        self.cases.append(self.kind + (self.is2.view(np.uint8) << 6) + (self.is1.view(np.uint8) << 5))
        self.before[:n] = self.last[:n]
        self.last[:n] = x
        self.fresh.append(x)
        self.step += 1
        if self.step < 8 or not self.step % 8:
            self._weigh()
        if self.step % RENEW == 0 or (self.step < RENEW and self.step & (self.step - 1) == 0):
            self._spread()


def _renew(low: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes whose leading 16 bits are settled, again and again; their ranges are widened after use."""
    end = low + size
    settled = (low ^ end) < _TOP
    live = np.flatnonzero(settled | (size < _BOT))
    settled = settled.take(live)
    while len(live):
        tight = live[~settled]
        if len(tight):
            size[tight] = (~low[tight] + _U(1)) & (_BOT - _U(1))
        yield live
        a, b = low.take(live) << _U(16), size.take(live) << _U(16)
        low[live], size[live] = a, b
        settled = (a ^ (a + b)) < _TOP
        more = np.flatnonzero(settled | (b < _BOT))
        live, settled = live.take(more), settled.take(more)


def _encode_block(ids: np.ndarray) -> bytes:
    lanes = -(-len(ids) // LANE)
    table = np.zeros(lanes * LANE, np.uint32)
    table[:len(ids)] = ids
    table = np.ascontiguousarray(table.reshape(lanes, LANE).T)
    tail = len(ids) - (lanes - 1) * LANE
    model = Model(lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    owners, words = [], []  # of the words in the order of steps
    for t in range(min(LANE, len(ids))):
        n = lanes if t < tail else lanes - 1
        model.predict(n)
        x = table[t, :n]
        start, own = model.place(x)
        step = size[:n] >> _U(TOTAL_BITS)
        low[:n] += step * start
        np.multiply(step, own, out=size[:n])
        for live in _renew(low[:n], size[:n]):
            owners.append(live.astype(np.uint16))
            words.append((low.take(live) >> _U(48)).astype("<u2"))
        model.learn(x)
    for k in (48, 32, 16, 0):
        owners.append(np.arange(lanes, dtype=np.uint16))
        words.append((low >> _U(k)).astype("<u2"))
    owner = np.concatenate(owners)
    body = np.bincount(owner, minlength=lanes).astype("<u2").tobytes()
    body += np.concatenate(words).take(np.argsort(owner, kind="stable")).tobytes()
    return struct.pack("<IIII", len(ids), len(body), zlib.crc32(ids.astype("<u4")), zlib.crc32(body)) + body


def _decode_block(n_ids: int, body: bytes) -> np.ndarray:
    lanes = -(-n_ids // LANE)
    length = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    feed = np.concatenate([np.frombuffer(body, "<u2", offset=2 * lanes), np.zeros(8, "<u2")])
    used = np.cumsum(length) - length
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _U(16)) | feed.take(used)
        used += 1
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    model = Model(lanes)
    table = np.zeros((LANE, lanes), "<u4")
    tail = n_ids - (lanes - 1) * LANE
    for t in range(min(LANE, n_ids)):
        n = lanes if t < tail else lanes - 1
        model.predict(n)
        step = size[:n] >> _U(TOTAL_BITS)
        target = np.minimum((code[:n] - low[:n]) // step, _U((1 << TOTAL_BITS) - 1)).astype(np.uint32)
        x, start, own = model.find(target)
        low[:n] += step * start
        np.multiply(step, own, out=size[:n])
        for live in _renew(low[:n], size[:n]):
            at = used.take(live)
            code[live] = (code.take(live) << _U(16)) | feed.take(at)
            used[live] = at + 1
        model.learn(x)
        table[t, :n] = x
    return table.T.reshape(-1)[:n_ids]


def encode(ids: np.ndarray) -> bytes:
    """A segment of ids (below 65536) as coded, checksummed blocks."""
    blocks = [_encode_block(ids[k:k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    return b"".join([MAGIC, struct.pack("<I", len(blocks)), *blocks])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; a damaged block raises ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not an id segment")
    at, out = 8, []
    for k in range(struct.unpack_from("<I", data, 4)[0]):
        n, length, ids_crc, body_crc = struct.unpack_from("<IIII", data, at)
        body = data[at + 16:at + 16 + length]
        if len(body) != length or zlib.crc32(body) != body_crc:
            raise ValueError(f"block {k} is damaged")
        ids = _decode_block(n, body)
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError(f"block {k} decodes wrongly")
        out.append(ids)
        at += 16 + length
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class Tokenizer:
    """Whole texts to packed ids: the library encodes every piece that its own pattern splits off.

    Pieces are encoded independently by such a tokenizer, so those met before are remembered, in
    arrays, and the library is given the new ones of a block, many in a text, by a tokenizer that
    has its model and parts them where they were joined. The pattern's boundaries are found for
    all texts of a block at once. A text that holds the string of an added token goes to the
    library whole; one with characters beyond 16 bits is split by the pattern itself.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit
        self.library = Library.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.split = regex.compile(rank_pattern(pattern)).findall
        self.wide = re.compile("[^\x00-\ud7ff\ue000-\uffff]").search
        self.kinds = np.full(1 << 16, OTHER, np.uint8) if pattern == GPT2 else None
        if self.kinds is not None:
            plane = "".join(map(chr, range(1 << 16)))
            for kind, name in ((SPACE_, rf"\p{{White_Space}}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
                self.kinds[[ord(c) for c in regex.findall(name, plane)]] = kind
        given, self.joint = self.library.pre_tokenizer, None
        if self.kinds is not None and self.library.normalizer is None and isinstance(given, ByteLevel) and given.use_regex and not given.add_prefix_space:
            # the model of such a library sees a letter for each byte, none of them a line feed
            self.joint = Library(self.library.model)
            self.joint.pre_tokenizer = CharDelimiterSplit("\n")
            self.letters = _byte_letters()
            vocabulary = self.joint.get_vocab()
            self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of an id
            self.length[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.round = 0
        self._keep(pa.array([], pa.large_binary()), *(np.zeros(0, t) for t in ("<u4", np.int64, np.int32)))

    def _cuts(self, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts that end at ``ends``; the pattern's alternatives, one by one."""
        kind = self.kinds.take(units)
        first = np.zeros(len(units) + 1, bool)
        first[0] = True
        first[ends] = True
        turn = first[:-1].copy()
        turn[1:] |= kind[1:] != kind[:-1]  # a run of one kind begins
        space = kind == SPACE_
        cut = turn.copy()
        # the last white space before something else is a piece of its own, a blank one goes with what follows
        final = np.flatnonzero(space[:-1] & turn[1:] & ~first[1:-1])
        cut[final] = True
        cut[final[units[final] == 32] + 1] = False
        # contractions: an apostrophe that begins a piece, and what of the letters after it belongs to it
        mark = np.flatnonzero((units == 39) & cut)
        for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
            fits = mark[mark + len(tail) < len(units)]
            for k, letter in enumerate(tail, 1):
                fits = fits[(units[fits + k] == ord(letter)) & ~first[fits + k]]
            cut[fits + 1] = False
            after = fits + len(tail) + 1
            after = after[after < len(units)]
            # letters go on as a new piece; anything else begins one already, or is a blank of one
            cut[after[kind[after] == LETTER]] = True
        return np.flatnonzero(cut)

    def _keep(self, pieces: pa.Array, flat: np.ndarray, size: np.ndarray, used: np.ndarray) -> None:
        """The memory: distinct pieces, their ids one after the other, how many, and the last block with them."""
        self.pieces, self.flat, self.size, self.used = pieces, flat, size, used
        self.begin = np.cumsum(size) - size

    def _forget(self) -> None:
        """Keep the pieces that were used last, of those that are not long."""
        short = np.flatnonzero(np.diff(_offsets(self.pieces)) <= LONG)
        kept = short[np.sort(np.argsort(self.used[short], kind="stable")[-PIECES:])]
        size = self.size[kept]
        self._keep(self.pieces.take(pa.array(kept)), self.flat.take(_runs(self.begin[kept], size)), size, self.used[kept])

    def _look(self, pieces: list[pa.Array]) -> np.ndarray:
        """Where pieces are in the memory; it learns the new ones."""
        self.round += 1
        if len(self.pieces) > 2 * PIECES or self.pieces.nbytes > 8 * TEXT_BLOCK:
            self._forget()
        n = len(self.pieces)
        coded = pa.chunked_array([self.pieces, *pieces]).dictionary_encode().chunks[-len(pieces):]
        every = coded[-1].dictionary
        which = np.concatenate([c.indices.to_numpy() for c in coded])
        flat, size = self._learn(every.slice(n)) if len(every) > n else (self.flat[:0], self.size[:0])
        self._keep(every, np.concatenate([self.flat, flat]), np.concatenate([self.size, size]),
                   np.concatenate([self.used, np.zeros(len(size), np.int32)]))
        self.used[which] = self.round
        return which

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        at = _offsets(pieces)
        if self.joint is not None:
            letters = self.letters.take(np.frombuffer(pieces.buffers()[2], np.uint8)[at[0]:at[-1]])
            text = np.insert(letters, at[1:-1] - at[0], ord("\n")).tobytes().decode("utf-16-le")
            begin = (at - at[0] + np.arange(len(at)))[[*range(0, len(pieces), JOINED), len(pieces)]].tolist()
            texts, found = [text[a:b - 1] for a, b in zip(begin, begin[1:])], []
            for k in range(0, len(texts), 8):
                found += [np.array(e.ids, "<u4") for e in self.joint.encode_batch_fast(texts[k:k + 8], add_special_tokens=False)]
            flat = np.concatenate(found)
            done = np.append(0, np.cumsum(self.length.take(flat)))
            ends = np.searchsorted(done, at - at[0])
            if done[-1] == at[-1] - at[0] and (done[ends] == at - at[0]).all():
                return flat, np.diff(ends)
        # a byte without an id, or another kind of library: every piece by itself
        found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces.to_pylist()], add_special_tokens=False)]
        return np.array([i for f in found for i in f], "<u4"), np.array([len(f) for f in found], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        plain, rest, whole = [], [], []
        for k, t in enumerate(texts):
            (whole if self.added(t) else rest if self.kinds is None or self.wide(t) else plain).append(k)
        for k, found in zip(whole, self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)):
            out[k] = array("I", found.ids).tobytes()
        pieces, stops = [], np.zeros(len(plain) + 1, np.int64)  # pieces up to the end of a text
        text = "".join([texts[k] for k in plain])
        if text:
            units, raw = np.frombuffer(text.encode("utf-16-le"), "<u2"), text.encode()
            ends = np.cumsum([len(texts[k]) for k in plain])
            cuts = np.append(self._cuts(units, ends), len(units))
            stops = np.append(0, np.searchsorted(cuts, ends))
            if len(raw) > len(units):  # from 16-bit units to bytes
                width = np.uint8(1) + (units >= 0x80) + (units >= 0x800)
                cuts = np.append(0, np.cumsum(np.add.reduceat(width, cuts[:-1], dtype=np.int64)))
            pieces.append(pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]))
        if rest:
            found = [self.split(texts[k]) for k in rest]
            stops = np.append(stops, stops[-1] + np.cumsum(list(map(len, found))))
            pieces.append(pa.array([p.encode() for f in found for p in f], pa.large_binary()))
        if not stops[-1]:
            return out
        which = self._look(pieces)
        n = self.size.take(which)
        ids = self.flat.take(_runs(self.begin.take(which), n))
        ends = np.append(0, np.cumsum(n))[stops].tolist()
        for k, a, b in zip(plain + rest, ends, ends[1:]):
            out[k] = ids[a:b].tobytes()
        return out


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte: itself if it is printable, or the next one from 256 on."""
    seen = np.zeros(256, bool)
    for first, last in ("!~", "\u00a1\u00ac", "\u00ae\u00ff"):
        seen[ord(first):ord(last) + 1] = True
    return np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype("<u2")


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def write(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Write the id files of (doc_id, text) in the shared folder and return their segments.

    (part, nth) orders the segments; ``docs`` holds the ids and lengths of a segment's documents,
    ``body`` its coded blocks. Rows without a doc_id come first, rows of one id follow each other
    in the order of a hash of their text. A null or empty text is its end id alone.
    """
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(slices, *order).sortWithinPartitions(*order)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        tokenizer, part, nth = resident(("ids", path, pattern), lambda: Tokenizer(path, pattern)), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def segment():
            ids = np.frombuffer(b"".join(held), "<u4")
            index = pa.record_batch([pa.array(names, pa.int64()), pa.array([len(h) // 4 for h in held], pa.int64())], ["doc_id", "n"])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                "docs": pa.array([_ipc(index)], pa.binary()), "body": pa.array([encode(ids)], pa.binary())})

        for batch in bounded(batches, "text", TEXT_BLOCK):
            coded = tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])
            for name, ids in zip(batch.column("doc_id").to_pylist(), coded):
                if held and size + len(ids) > 4 * SEGMENT:  # four bytes an id
                    yield segment()
                    held, names, size, nth = [], [], 0, nth + 1
                held.append(ids + end)
                names.append(name)
                size += len(ids) + 4
        if held:
            yield segment()

    return cut(rows.mapInArrow(run, "part int, nth int, n_ids long, docs binary, body binary"))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read(segments: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document, from the files; without ``ids`` the others.

    ``start`` counts the ids of all documents before it; only one number for each part of the
    files is ever in one place.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    starts = segments.select("part", "nth", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("own")).join(
        parts, "part").select("part", "nth", (F.col("own") + F.col("skip")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                found = decode(batch.column("body")[k].as_py())
                with pa.ipc.open_stream(batch.column("docs")[k].as_py()) as source:
                    index = source.read_next_batch()
                n = index.column("n").to_numpy()
                ends = np.cumsum(n)
                for a in range(0, len(n), 2000):
                    pairs = list(zip((ends - n)[a:a + 2000].tolist(), ends[a:a + 2000].tolist()))
                    rows = {
                        "doc_id": index.column("doc_id").slice(a, 2000),
                        "part": pa.array([batch.column("part")[k].as_py()] * len(pairs), pa.int32()),
                        "nth": pa.array([batch.column("nth")[k].as_py()] * len(pairs), pa.int32()),
                        "at": pa.array([x for x, _ in pairs], pa.int64()), "n_tokens": pa.array(n[a:a + 2000], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(found[x:y]) for x, y in pairs], pa.int64())}
                    if ids:
                        rows["ids"] = pa.array([found[x:y].tobytes() for x, y in pairs], pa.binary())
                    yield pa.RecordBatch.from_pydict(rows)

    rows = segments.select("part", "nth", "docs", "body").mapInArrow(
        run, "doc_id long, part int, nth int, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    return rows.join(starts, ["part", "nth"]).select(
        "doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", *["ids"] * ids, "ids_crc32")
