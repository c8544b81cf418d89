"""Exact removal of repeated byte spans across documents with suffix arrays.

A byte of a document is removed if it lies in a span of ``SPAN`` bytes that also starts in a
document of smaller id. The work is divided so that equal spans meet and nothing else moves far:

1. Documents are packed into blocks of bounded size. Every span has an anchor, its smallest
   ``GRAM``-byte hash; each block sends the distinct anchors of its spans, as packed hashes.
2. Only anchors that occur in more than one document come back. The spans around them are cut
   out as pieces (runs of overlapping spans of one anchor) and sent to shards by anchor. Copies
   of a piece inside a block are settled there. The spans of an anchor that occurs in very many
   blocks go to shards one by one by the hash of the whole span, so that no shard grows with a
   frequent passage. Of pieces equal in bytes and document a block sends one; what is covered
   of it is covered in the others, which the block finds again when the ranges come back.
3. Each shard sorts the suffixes of its pieces (Larsson-Sadakane refinement: ranks of the first
   h bytes order the first 2h), computes common prefixes of neighbours (Kasai's carry: a suffix
   shares at least one byte less than the suffix before it in the text), and so groups equal spans
   and finds the smallest document of each. A bucket that holds more than one shard's bytes is
   several shards, whose sorted spans are merged by binary search in one another.
4. The covered ranges go back to the blocks, which write what is kept.

Refinement stops once the first ``SPAN`` bytes are ordered; longer prefixes cannot change which
spans are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.llm.common import bounded, mix, release, text_views, trim
from utilnet.session import written as cut

SPAN = 50
GRAM = 20
BLOCK = 4 << 20  # bytes of text in a block; a longer text is a block of its own
CHUNK = 1 << 18  # spans looked at together
STEP = 10_000  # pieces compared together
BUCKET_TEXT = 8 << 20  # bytes of text for each bucket of anchors
SHARD = 1 << 20  # bytes of pieces in a suffix array
HOT = 20_000  # surroundings of an anchor beyond which its spans are dealt out one by one
FAN = 256  # blocks whose copies of a piece are settled together
GROUPS = 512  # groups of buckets up to which a bucket travels alone
ANCHOR_FAN, PIECE_FAN = 4, 32  # buckets of anchors, of pieces, in a group at most
NO_ID = np.iinfo(np.int64).max  # stands for a null id: never smaller than another
HOLDS = 1 << 62  # added to the place of a piece that stands for others of its block

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return _U(pow(int(_BASE), n, 1 << 64))


def _pack(values: np.ndarray) -> bytes:
    """A sorted array as compressed byte planes of its differences."""
    steps = np.diff(values, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


class Runs:
    """Runs of overlapping spans that share an anchor, in one chunk of a block."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, first: int, last: int):
        """Spans that start in [first, last) of the block; none crosses the end of a document."""
        seg = raw[first:last + SPAN - 1]
        h1 = seg.astype(np.uint64) + _U(1)
        h2 = h1[:-1] * _BASE + h1[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        self.h2, self.h16 = h2, h16
        value = mix(h16[:len(seg) - GRAM + 1] * _power(4) + h4[16:16 + len(seg) - GRAM + 1])
        # smallest hash of the span; among equal ones the leftmost
        low = _U(0xFFFFFFFF)
        least = (value & ~low) | np.arange(len(value), dtype=np.uint64)
        width, reach = 1, SPAN - GRAM + 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[:width - reach], least[reach - width:])
        n = last - first
        anchor = (least & low).astype(np.int64)[:n]
        bad = np.zeros(n + 1, np.int32)
        ends = offsets[1:-1]
        ends = ends[(ends > first) & (ends < last + SPAN - 1)] - first
        np.add.at(bad, np.clip(ends - SPAN + 1, 0, n), 1)
        np.add.at(bad, np.clip(ends, 0, n), -1)
        whole = np.cumsum(bad[:n]) == 0
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
        end = np.ones(n, bool)
        end[:-1] = new[1:] | ~whole[1:]
        start = np.flatnonzero(new & whole)
        self.start = start + first
        self.count = np.flatnonzero(end & whole) + 1 - start
        self.hash = value[anchor[start]] >> _U(8)
        # tells apart the surroundings of one anchor: first and last bytes of the run, and its length
        self.around = value[start] * _BASE + value[start + self.count + SPAN - 1 - GRAM] + self.count.astype(np.uint64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = first

    def span_hash(self, start: np.ndarray) -> np.ndarray:
        p = start - self.first
        h, step = self.h16, _power(16)
        return mix(((h[p] * step + h[p + 16]) * step + h[p + 32]) * _power(2) + self.h2[p + 48])


def runs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[Runs]:
    n = len(raw) - SPAN + 1
    for first in range(0, n, CHUNK):
        yield Runs(raw, offsets, first, min(n, first + CHUNK))


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def block_anchors(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchors of a block, doubled, plus one if more than one id has them; and the
    number of different surroundings of each."""
    parts = [(r.hash, r.around, ids[r.doc]) for r in runs(raw, offsets)]
    if not parts or not sum(len(p[0]) for p in parts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, around, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((around, h))
    h, around, d = h[order], around[order], d[order]
    at = _starts(h)
    many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    new = np.ones(len(h), np.int64)
    new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
    return (h[at] << _U(1)) | many.astype(np.uint64), np.add.reduceat(new, at)


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint8)
    at = np.ones(ends[-1], np.int64)
    some = np.flatnonzero(size)
    start, ends, size = start[some], ends[some], size[some]
    at[0] = start[0]
    at[ends[:-1]] = start[1:] - (start[:-1] + size[:-1]) + 1
    return raw[np.cumsum(at)]


class Pieces:
    """Pieces of text: ``start`` in ``raw``, ``count`` spans each, document id, place of origin, and bucket in the group."""

    def __init__(self, raw, start, count, doc, place, source=None, part=None):
        self.raw, self.start, self.count, self.doc, self.place = raw, start, count, doc, place
        self.source = np.zeros(len(start), np.int64) if source is None else source
        self.part = np.zeros(len(start), np.uint8) if part is None else part

    @property
    def size(self) -> np.ndarray:
        return self.count + SPAN - 1

    def take(self, index: np.ndarray) -> "Pieces":
        return Pieces(self.raw, self.start[index], self.count[index], self.doc[index], self.place[index], self.source[index], self.part[index])

    def compact(self) -> "Pieces":
        size = self.size
        return Pieces(_gather(self.raw, self.start, size), np.cumsum(size) - size, self.count, self.doc, self.place, self.source, self.part)

    def settled(self) -> np.ndarray:
        """Pieces equal, byte by byte, to a piece of a smaller document: wholly covered."""
        return self.settle()[0]

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``settled`` finds; and for each piece the first one of equal bytes and document,
        which is covered where this one is (the piece itself, if there is none before it)."""
        home = np.arange(len(self.start))
        if not len(self.start):
            return np.zeros(0, bool), home
        size = self.size
        weight = mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64))
        key = np.empty(len(size), np.uint64)
        for k in range(0, len(size), STEP):
            n = size[k:k + STEP]
            data = _gather(self.raw, self.start[k:k + STEP], n)
            at = np.cumsum(n) - n
            inner = np.arange(len(data)) - np.repeat(at, n)
            # a position-weighted sum brings equal pieces together; equality is tested below
            key[k:k + STEP] = np.add.reduceat(weight[inner] * (data + _U(1)), at) + n.astype(np.uint64)
        order = np.lexsort((self.doc, key))
        heads = _starts(key[order])
        head = np.repeat(order[heads], np.diff(heads, append=len(order)))
        later = np.flatnonzero((self.doc[order] > self.doc[head]) & (size[order] == size[head]))
        out = np.zeros(len(self.start), bool)
        out[order[later]] = self._equal(order[later], head[later])
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (self.doc[order[1:]] != self.doc[order[:-1]])
        heads = np.flatnonzero(new)
        head = np.repeat(order[heads], np.diff(heads, append=len(order)))
        again = np.flatnonzero(~new & ~out[order] & ~out[head] & (size[order] == size[head]))
        same = again[self._equal(order[again], head[again])]
        home[order[same]] = head[same]
        return out, home

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, of equal sizes, have the same bytes."""
        size, out = self.size, np.zeros(len(a), bool)
        for k in range(0, len(a), STEP):
            x, y = a[k:k + STEP], b[k:k + STEP]
            same = _gather(self.raw, self.start[x], size[x]) == _gather(self.raw, self.start[y], size[y])
            out[k:k + STEP] = np.logical_and.reduceat(same, np.cumsum(size[x]) - size[x])
        return out

    def dump(self, index: np.ndarray) -> bytes:
        p = self.take(index)
        head = np.array([len(index)], np.int64).tobytes()
        head += p.count.astype(np.int32).tobytes() + p.doc.astype(np.int64).tobytes() + p.place.astype(np.int64).tobytes() + p.part.tobytes()
        size = p.size
        zip_ = zstandard.ZstdCompressor(level=3).compressobj(size=len(head) + int(size.sum()))
        out = [zip_.compress(head)]
        for k in range(0, len(size), STEP):
            out.append(zip_.compress(_gather(p.raw, p.start[k:k + STEP], size[k:k + STEP]).tobytes()))
        return b"".join([*out, zip_.flush()])

    @staticmethod
    def load(data: bytes, source: int) -> "Pieces":
        body = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        count = np.frombuffer(body, np.int32, n, 8).astype(np.int64)
        doc = np.frombuffer(body, np.int64, n, 8 + 4 * n)
        place = np.frombuffer(body, np.int64, n, 8 + 12 * n)
        part = np.frombuffer(body, np.uint8, n, 8 + 20 * n)
        raw = np.frombuffer(body, np.uint8, -1, 8 + 21 * n)
        size = count + SPAN - 1
        return Pieces(raw, np.cumsum(size) - size, count, doc, place, np.full(n, source), part)

    @staticmethod
    def joined(parts: list["Pieces"]) -> "Pieces":
        lengths = np.array([len(p.raw) for p in parts])
        shift = np.cumsum(lengths) - lengths
        return Pieces(np.concatenate([p.raw for p in parts]),
                      np.concatenate([p.start + s for p, s in zip(parts, shift)]),
                      *(np.concatenate([getattr(p, k) for p in parts]) for k in ("count", "doc", "place", "source", "part")))


def suffix_order(raw: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` bytes at least.

    Larsson-Sadakane: the rank of a suffix by its first h bytes is the place where its group
    begins; a group is refined by the ranks of the suffixes h bytes on, and groups of one are
    left alone.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").reshape(-1).astype(np.uint64)
    order = np.argsort(key)
    heads = _starts(key[order])
    rank = np.empty(n + 1, np.int64)
    sizes = np.diff(heads, append=n)
    rank[order] = np.repeat(heads, sizes)
    rank[n] = -1
    # A suffix that ends inside its first 8 bytes may tie with zero bytes; it sorts before them
    # in the next round, since nothing ranks below the end.
    del key
    h = 8
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while h < depth and len(open_):
        at = order[open_]
        group = rank[at]
        ahead = rank[np.minimum(at + h, n)]
        combined = group * (n + 2) + ahead + 1
        inner = np.argsort(combined, kind="stable")
        order[open_] = at[inner]
        combined = combined[inner]
        first = _starts(combined)
        size = np.diff(first, append=len(combined))
        rank[order[open_]] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in the order and the one before it.

    ``order`` may leave suffixes out. Lengths below ``depth`` are exact, others are ``depth`` at
    least. Kasai's observation, over whole arrays: where the neighbour of suffix p is one on from
    the neighbour of p - 1, the prefix is one shorter than that of p - 1. The other suffixes are
    compared with their neighbour, eight bytes at a time and ``depth`` plus some at most, and so
    is every suffix whose carried length could have fallen below ``depth`` by that limit alone.
    """
    n, limit = len(raw), -(-depth // 8) * 8 + 16
    if not len(order):
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
    p = np.flatnonzero(carried)
    carried[p] = raw[p - 1] == raw[before[p] - 1]
    place = np.arange(n, dtype=np.int32)
    steps = place - np.maximum.accumulate(np.where(carried, 0, place))
    carried &= steps % (limit - depth + 1) != 0
    length = np.zeros(n, np.int32)
    words = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, 8)).view("<u8").reshape(-1)
    live = np.flatnonzero((before >= 0) & ~carried)
    for done in range(0, limit, 8):
        a, b = live + done, before[live] + done
        inside = np.maximum(a, b) < n
        if not inside.all():
            length[live[~inside]] = done
            live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        stop = np.flatnonzero(differ)
        bit = differ[stop] & (~differ[stop] + _U(1))  # the lowest bit that differs
        length[live[stop]] = done + (np.frexp(bit.astype(np.float64))[1] - 1) // 8
        live = live[differ == 0]
    length[live] = limit
    first = np.maximum.accumulate(np.where(carried, 0, place))
    length = np.maximum(length[first] - (place - first), 0)
    return np.minimum(length[order], np.minimum(n - order, n - before[order]))


class SortedShard:
    """Suffix array of pieces: equal spans side by side, each group with its smallest document."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        n = len(pieces.raw)
        owner = np.repeat(np.arange(len(pieces.start), dtype=np.int32), pieces.size)
        inner = np.arange(n, dtype=np.int32) - pieces.start[owner].astype(np.int32)
        begins = inner < pieces.count[owner]  # suffixes that start a span of a piece
        del inner
        order = suffix_order(pieces.raw, SPAN)
        self.at = order[begins[order]]
        group = np.cumsum(common_prefixes(pieces.raw, self.at, SPAN) < SPAN)
        self.head = _starts(group)
        self.owner = owner[self.at]
        self.least = np.minimum.reduceat(pieces.doc[self.owner], self.head) if len(self.head) else np.zeros(0, np.int64)
        padded = np.concatenate((pieces.raw, np.zeros(SPAN + 8, np.uint8)))
        self.words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").reshape(-1)

    def key(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of the spans at some places; of the last, what belongs to the span."""
        word = self.words[at + 8 * k].astype(np.uint64)
        spare = 8 * max(0, 8 * (k + 1) - SPAN)
        return word >> _U(spare)

    def merge(self, other: "SortedShard") -> None:
        """Find the spans of the other shard here by binary search; both take the smaller document."""
        want = other.at[other.head]
        low, high = np.zeros(len(want), np.int64), np.full(len(want), len(self.head))
        places = self.at[self.head]
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            less = self._less(places[mid], other, want[live])
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
        found = np.flatnonzero(low < len(places))
        same = np.ones(len(found), bool)
        for k in range(-(-SPAN // 8)):
            same &= self.key(places[low[found]], k) == other.key(want[found], k)
        mine, theirs = low[found[same]], found[same]
        least = np.minimum(self.least[mine], other.least[theirs])
        self.least[mine], other.least[theirs] = least, least

    def _less(self, mine: np.ndarray, other: "SortedShard", theirs: np.ndarray) -> np.ndarray:
        less = np.zeros(len(mine), bool)
        open_ = np.arange(len(mine))
        for k in range(-(-SPAN // 8)):
            a, b = self.key(mine[open_], k), other.key(theirs[open_], k)
            less[open_] = a < b
            open_ = open_[a == b]
        return less

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """(source, range) of the covered bytes, in places of origin."""
        least = np.repeat(self.least, np.diff(self.head, append=len(self.at)))
        hit = self.pieces.doc[self.owner] > least
        at, owner = self.at[hit], self.owner[hit]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(at))
        place = self.pieces.place[owner[first]] + at[first] - self.pieces.start[owner[first]]
        return self.pieces.source[owner[first]], np.stack([place, place + n + SPAN - 1], 1)


def _ranges(pieces: Pieces) -> np.ndarray:
    return np.stack([pieces.place, pieces.place + pieces.size], 1)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted maximal ranges."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), bool)
    new[1:] = ranges[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([ranges[first, 0], reach[np.concatenate((first[1:] - 1, [len(ranges) - 1]))]], 1)


def apart(ranges: np.ndarray) -> np.ndarray:
    """Maximal ranges, but those of pieces that stand for others each alone."""
    holds = ranges[:, 0] >= HOLDS
    return np.concatenate((merged(ranges[~holds]), ranges[holds]))


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n numbers."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def hang(pieces: Pieces, home: np.ndarray) -> bytes:
    """Mark the pieces that others of their block stand behind; (place, spans, other place) of these."""
    other = np.flatnonzero(home != np.arange(len(home)))
    on = home[other]
    rows = np.stack([pieces.place[on], pieces.count[on], pieces.place[other]]).astype(np.int64)
    pieces.place = pieces.place.copy()
    pieces.place[np.unique(on)] += HOLDS
    return zstandard.ZstdCompressor(level=3).compress(rows.tobytes())


def unhang(ranges: np.ndarray, hung: list[bytes]) -> np.ndarray:
    """All covered ranges of a block: those that came back, and the same in the pieces behind."""
    holds = ranges[:, 0] >= HOLDS
    own = ranges[holds] - HOLDS
    own = own[np.argsort(own[:, 0], kind="stable")]
    out = [ranges[~holds], own]
    for data in hung if len(own) else ():
        place, count, other = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(3, -1)
        first = np.searchsorted(own[:, 0], place)
        n = np.searchsorted(own[:, 0], place + count) - first
        out.append(own[_each(first, n)] + np.repeat(other - place, n)[:, None])
    return merged(np.concatenate(out))


def group_cover(parts: list[Pieces]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Covered ranges of all pieces of a group of buckets: no span is in two buckets."""
    whole = Pieces.joined(parts)
    order = np.argsort(whole.part, kind="stable")
    for index in np.split(order, _starts(whole.part[order])[1:]):
        yield from shard_cover([whole.take(index)])


def shard_cover(parts: list[Pieces]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Covered ranges of all pieces of a bucket."""
    whole = parts[0] if len(parts) == 1 else Pieces.joined(parts)
    done, home = whole.settle()
    covered = whole.take(np.flatnonzero(done))
    yield covered.source, _ranges(covered)
    # of pieces equal in bytes and document one is sorted, for all of them
    open_ = np.flatnonzero(~done)
    open_ = open_[np.argsort(home[open_], kind="stable")]
    begin = _starts(home[open_])
    members = np.diff(begin, append=len(open_))
    rest = whole.take(home[open_[begin]])
    rest.source = np.arange(len(begin))
    edges = np.flatnonzero(np.diff(np.cumsum(rest.size) // SHARD, prepend=0)) if len(rest.start) else []
    shards = [SortedShard(rest.take(index).compact()) for index in np.split(np.arange(len(rest.start)), edges) if len(index)]
    for i, one in enumerate(shards):
        for other in shards[i + 1:]:
            one.merge(other)
    for one in shards:
        which, ranges = one.covered()
        n = members[which]
        every = open_[_each(begin[which], n)]
        yield whole.source[every], np.repeat(ranges - rest.place[which][:, None], n, axis=0) + whole.place[every][:, None]


def pack_blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks: name, bytes of text, compressed texts, and the other columns."""
    def run(batches: Iterator[pa.RecordBatch]):
        release()
        task, nth = TaskContext.get().partitionId(), 0
        for part in bounded(batches, "text", BLOCK):
            raw, offsets = text_views(part.column("text"))
            rest = part.drop_columns(["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_batch(rest)
            zip_ = zstandard.ZstdCompressor(level=3).compress
            yield pa.RecordBatch.from_pydict({
                "grp": [f"{task}-{nth}"], "size": [len(raw)],
                "body": [zip_(raw.tobytes())], "offsets": [zip_(offsets.tobytes())],
                "rest": [zip_(sink.getvalue().to_pybytes())]})
            nth += 1

    return docs.mapInArrow(run, "grp string, size long, body binary, offsets binary, rest binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor().decompress
    raw = np.frombuffer(unzip(row["body"]), np.uint8)
    offsets = np.frombuffer(unzip(row["offsets"]), np.int64)
    with pa.ipc.open_stream(unzip(row["rest"])) as source:
        rest = source.read_next_batch()
    return raw, offsets, rest


def _ids(rest: pa.RecordBatch) -> np.ndarray:
    return rest.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
    trim()


def fan(buckets: int, most: int) -> int:
    """Buckets that travel together. Each block has rows for all groups, so with one bucket in a group
    the rows, and what each of them costs, would grow with the square of the input."""
    return min(most, max(1, buckets // GROUPS))


def _ids_hash(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:4], "big")


def _anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            raw, offsets, rest = _open(row)
            found, weight = block_anchors(raw, offsets, _ids(rest))
            weight = np.minimum(weight, HOT + 1).astype(np.uint16)
            zip_ = zstandard.ZstdCompressor(level=1).compress
            bucket = ((found >> _U(25)) * _U(buckets) >> _U(32)).astype(np.int64)
            at = _starts(bucket)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[at], pa.int32()), "grp": [row["grp"]] * len(at),
                "anchors": [_pack(found[a:b]) for a, b in zip(at, [*at[1:], len(found)])],
                "weights": [zip_(weight[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(found)])]},
                schema=pa.schema([("bucket", pa.int32()), ("grp", pa.string()), ("anchors", pa.binary()), ("weights", pa.binary())]))

    return blocks.mapInArrow(run, "bucket int, grp string, anchors binary, weights binary")


def _shared(anchors: DataFrame) -> DataFrame:
    """For each block the anchors that more than one document has, doubled, plus one if hot."""
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in table.column("anchors").to_pylist()]
        sizes = [len(p) for p in parts]
        every = np.concatenate(parts)
        weight = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint16) for x in table.column("weights").to_pylist()])
        order = np.argsort(every >> _U(1), kind="stable")
        h = every[order] >> _U(1)
        at = _starts(h)
        count = np.diff(at, append=len(h))
        many = np.bitwise_or.reduceat(every[order] & _U(1), at) > 0
        state = np.where((count > 1) | many, 1 + (np.add.reduceat(weight[order], at, dtype=np.int64) > HOT), 0)
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(state, count)
        grps, found, n = [], [], []
        at = 0
        for grp, size, part in zip(table.column("grp").to_pylist(), sizes, parts):
            mine = back[at:at + size]
            at += size
            keep = mine > 0
            if keep.any():
                grps.append(grp)
                found.append(_pack((part[keep] >> _U(1) << _U(1)) | (mine[keep] - 1).astype(np.uint64)))
                n.append(int(keep.sum()))
        return pa.table({"grp": pa.array(grps, pa.string()), "found": pa.array(found, pa.binary()), "n": pa.array(n, pa.int64())})

    return anchors.groupBy("bucket").applyInArrow(run, "grp string, found binary, n long")


def block_pieces(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, found: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """Pieces around the shared anchors ``found``, and the hash that routes each."""
    known, hot = found >> _U(1), (found & _U(1)) > 0
    parts = []
    for r in runs(raw, offsets):
        at = np.minimum(np.searchsorted(known, r.hash), max(len(known) - 1, 0))
        shared = known[at] == r.hash if len(known) else np.zeros(len(r.hash), bool)
        single = shared & hot[at] if len(known) else shared
        keep = np.flatnonzero(shared & ~single)
        parts.append((r.start[keep], r.count[keep], r.doc[keep], mix(r.hash[keep])))
        lone = np.flatnonzero(single)
        if len(lone):
            n = r.count[lone]
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(r.start[lone], n)
            parts.append((start, np.ones(len(start), np.int64), np.repeat(r.doc[lone], n), r.span_hash(start)))
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    start, count, doc, route = (np.concatenate([p[k] for p in parts]) for k in range(4))
    return Pieces(raw, start, count, ids[doc], start), route


def _pieces(blocks: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    wide = fan(buckets, PIECE_FAN)
    groups = -(-buckets // wide)

    def run(batches):
        for row in _rows(batches):
            raw, offsets, rest = _open(row)
            found = np.sort(np.concatenate([_unpack(x) for x in row["found"]]))
            pieces, route = block_pieces(raw, offsets, _ids(rest), found)
            done, home = pieces.settle()
            ranges = merged(_ranges(pieces.take(np.flatnonzero(done))))
            hung = hang(pieces, home)
            left = np.flatnonzero(~done & (home == np.arange(len(home))))
            bucket = (route[left] >> _U(32)) * _U(buckets) >> _U(32)
            left, bucket = left[np.argsort(bucket, kind="stable")], np.sort(bucket)
            pieces.part[left] = bucket % _U(wide)
            bucket //= _U(wide)
            at = _starts(bucket)
            dumps = [pieces.dump(index) for index in np.split(left, at[1:])] if len(left) else []
            yield pa.RecordBatch.from_pydict({
                "bucket": [*bucket[at].astype(np.int32).tolist(), int(_ids_hash(row["grp"]) % groups)], "grp": [row["grp"]] * (len(dumps) + 1),
                "pieces": [*dumps, None], "ranges": [None] * len(dumps) + [ranges.astype(np.int64).tobytes()],
                "hung": [None] * len(dumps) + [hung]},
                schema=PIECES)

    back = shared.groupBy("grp").agg(F.collect_list("found").alias("found"))
    return blocks.join(back, "grp").mapInArrow(run, "bucket int, grp string, pieces binary, ranges binary, hung binary")


PIECES = pa.schema([("bucket", pa.int32()), ("grp", pa.string()), ("pieces", pa.binary()), ("ranges", pa.binary()),
                    ("hung", pa.binary())])


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows of ranges that are known already, and rows of pieces."""
    known = pc.is_valid(table.column("ranges"))
    return table.filter(known).cast(PIECES), table.filter(pc.invert(known))


def _settle(pieces: DataFrame, salts: int) -> DataFrame:
    """Settle copies of a piece in groups of blocks, so that few of each are left for the shard."""
    def run(table: pa.Table) -> pa.Table:
        ready, table = _split(table)
        if not table.num_rows:
            return ready
        grps = table.column("grp").to_pylist()
        whole = Pieces.joined([Pieces.load(x, k) for k, x in enumerate(table.column("pieces").to_pylist())])
        done = whole.settled()
        bucket, out = int(table.column("bucket")[0].as_py()), []
        for k, grp in enumerate(grps):
            mine = whole.source == k
            left, gone = np.flatnonzero(mine & ~done), np.flatnonzero(mine & done)
            if len(left):
                out.append((bucket, grp, whole.dump(left), None, None))
            if len(gone):
                out.append((bucket, grp, None, apart(_ranges(whole.take(gone))).astype(np.int64).tobytes(), None))
        return pa.concat_tables([ready, pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)])

    salt = F.pmod(F.xxhash64("grp"), F.lit(salts))
    return pieces.groupBy("bucket", salt).applyInArrow(run, "bucket int, grp string, pieces binary, ranges binary, hung binary")


def _cover(pieces: DataFrame) -> DataFrame:
    """Ranges covered across blocks, for each block."""
    def run(table: pa.Table) -> pa.Table:
        ready, table = _split(table)
        ready = ready.select(["grp", "ranges", "hung"])
        if not table.num_rows:
            return ready
        grps = table.column("grp").to_pylist()
        parts = [Pieces.load(x, k) for k, x in enumerate(table.column("pieces").to_pylist())]
        del table
        found = [*group_cover(parts)]
        source, ranges = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(source, kind="stable")
        at = _starts(source[order])
        each = [apart(ranges[mine]) for mine in np.split(order, at[1:])] if len(order) else []
        own = pa.table({"grp": pa.array([grps[k] for k in source[order[at]]], pa.string()),
                        "ranges": pa.array([r.astype(np.int64).tobytes() for r in each], pa.binary()),
                        "hung": pa.nulls(len(each), pa.binary())})
        del parts
        trim()
        return pa.concat_tables([ready, own])

    return pieces.groupBy("bucket").applyInArrow(run, "grp string, ranges binary, hung binary")


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, with n_bytes, spans and kept.

    ``spans`` lists the maximal removed byte ranges [from, to) of the document, ``kept`` is what
    remains. Null texts are empty; texts under ``SPAN`` bytes are kept whole. A null doc_id is
    never smaller than another, so such rows lose what numbered rows have and keep what they
    share among themselves; so do rows that repeat one id. Columns of the three new names are
    replaced. With ``as_text`` the result has the columns of ``docs``, and text is what remains;
    a cut may split a character of several bytes, of which nothing is left then.
    """
    base = docs.drop("n_bytes", "spans", "kept")
    blocks = cut(pack_blocks(base))
    total, count = blocks.agg(F.sum("size"), F.count("grp")).first()
    total = total or 0
    buckets = max(1, int(total // BUCKET_TEXT))
    shared = cut(_shared(_anchors(blocks, -(-buckets // fan(buckets, ANCHOR_FAN)))))
    anchors = shared.agg(F.sum("n")).first()[0] or 0
    pieces = _pieces(blocks, shared, max(1, int(anchors * 100 // SHARD)))
    while count > FAN:
        count = -(-count // FAN)
        pieces = _settle(pieces, count)
    ranges = _cover(pieces).groupBy("grp").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("hung").alias("hung"))
    kept_columns = [c for c in base.columns if c != "text"]
    out = base.select(*kept_columns, F.lit(0).cast("long").alias("n_bytes"),
                      F.lit(None).cast("array<struct<first: long, last: long>>").alias("spans"),
                      F.lit(None).cast("binary").alias("kept"))

    if as_text:
        out = base.select(*kept_columns, F.lit("").alias("text"))

    def run(batches):
        for row in _rows(batches):
            raw, offsets, rest = _open(row)
            found = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in row["ranges"] or ()]
            found = unhang(np.concatenate(found), row["hung"] or []) if found else np.zeros((0, 2), np.int64)
            # neighbouring documents may both be covered up to their common edge
            first = np.searchsorted(found[:, 1], offsets[:-1], "right")
            last = np.searchsorted(found[:, 0], offsets[1:], "left")
            whole = raw.tobytes()
            spans, kept = [], []
            for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist()):
                cuts = [(max(x, a) - a, min(y, b) - a) for x, y in found[i:j].tolist()] if b > a else []
                edges = [0, *(e for c in cuts for e in c), b - a]
                spans.append([{"first": x, "last": y} for x, y in cuts])
                kept.append(b"".join(whole[a + x:a + y] for x, y in zip(edges[::2], edges[1::2])))
            if as_text:
                texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in kept_columns), texts], names=[*kept_columns, "text"])
                continue
            yield pa.RecordBatch.from_arrays(
                [rest.column(c) for c in kept_columns] + [
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array(kept, pa.binary())], names=[*kept_columns, "n_bytes", "spans", "kept"])

    return blocks.join(ranges, "grp", "left").mapInArrow(run, out.schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 from ``remove_repeats``'s rows."""
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
