"""Benchmark decontamination by winnowing.

Training and test texts are reduced to fingerprints: the smallest k-gram hash of every run of
consecutive k-grams. With k = 8 and 6 k-grams to a run, every shared span of 13 words has a
common fingerprint. A match of fingerprints is only a candidate; it is extended to the whole
window and compared word by word before it counts. Items shorter than a window are one window
of their own length; since the winnowing guarantee does not reach them, they are sought by the
hash of the whole item.

Benchmark items are taken in blocks of bounded size (``BLOCK_WORDS``), each a broadcast of at
most that many words, and the documents pass over one block after the other; any number of
items is handled the same way.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.llm.common import bounded, mix, release, text_views, trim
from utilnet.session import written as cut

WINDOW = 13
GRAM = 8
BLOCK_WORDS = 1_000_000
TEXT_BLOCK = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of texts in lower case
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse, kept for the next block of text."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((PRIME, INVERSE)):
            grown = np.full(n + 1, base)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers


class Words:
    """The words of a run of texts: hashes, text of each word, and byte extents for comparison."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = _FOLD[raw]
        inside = _WORD[self.raw]
        edge = np.ones(len(raw) + 1, bool)
        edge[:-1][inside] = False
        first = inside.copy()
        first[1:] &= edge[:-2]
        cut_at = offsets[:-1][offsets[:-1] < len(raw)]
        first[cut_at] = inside[cut_at]
        last = inside.copy()
        last[:-1] &= edge[1:-1]
        ends_at = offsets[1:][offsets[1:] > 0] - 1
        last[ends_at] = inside[ends_at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.owner = np.searchsorted(offsets, self.start, "right") - 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of every word, from one prefix sum over the bytes."""
        n = len(self.raw)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, back = powers(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.raw * power[:n], out=prefix[1:])
        value = (prefix[self.end] - prefix[self.start]) * back[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words from each word on; not valid across a text's end."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * PRIME + self.hash[j:j + n]
        return mix(out), self.owner[:n] == self.owner[k - 1:k - 1 + n]

    def same(self, i: np.ndarray, other: "Words", j: np.ndarray) -> np.ndarray:
        """Whether word i of this equals word j of the other, byte by byte."""
        size = self.end[i] - self.start[i]
        equal = size == other.end[j] - other.start[j]
        at = np.flatnonzero(equal)
        step = 0
        while len(at):
            a, b = self.start[i[at]] + step, other.start[j[at]] + step
            differ = self.raw[a] != other.raw[b]
            equal[at[differ]] = False
            at = at[~differ]
            step += 1
            at = at[size[at] > step]
        return equal


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the k-grams that are the smallest of some run of ``window - k + 1``, all hashes)."""
    value, _ = words.grams(k)
    run = window - k + 1
    n = len(value) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), value
    # order by the upper half of the hash, leftmost first on ties: the same choice in every text
    shift = np.uint64(32)
    packed = (value >> shift << shift) | np.arange(len(value), dtype=np.uint64)
    least = packed[:n].copy()
    for j in range(1, run):
        np.minimum(least, packed[j:j + n], out=least)
    whole = words.owner[:n] == words.owner[window - 1:window - 1 + n]
    low = (np.uint64(1) << shift) - np.uint64(1)
    kept = np.zeros(len(value), bool)
    kept[(least[whole] & low).astype(np.int64)] = True
    return np.flatnonzero(kept), value


class Items:
    """Fingerprints of a block of benchmark items."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.window, self.gram = window, gram
        self.words = w = Words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        at, value = winnow(w, gram, window)
        counts = np.diff(w.bounds)
        order = np.argsort(value[at], kind="stable")
        self.at, self.value = at[order], value[at][order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, window):
            first = w.bounds[:-1][counts == size]
            if len(first):
                h = w.grams(size)[0][first]
                order = np.argsort(h, kind="stable")
                self.short[size] = (first[order], h[order])


def distinct_items(ids: list[str], texts: list[bytes]) -> tuple[list[list[str]], list[bytes]]:
    """Items of the same words as one: (ids of each, its words joined by spaces); those without words have no window."""
    groups: dict[bytes, list[str]] = {}
    for name, text in zip(ids, texts):
        groups.setdefault(b" ".join(_WORDS.findall(text.lower())), []).append(name)
    groups.pop(b"", None)
    return list(groups.values()), list(groups)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, index) with lo <= index < hi."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def occurrences(doc: Words, items: Items, step: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word in the document block, size, item) of every occurrence of a window, exact."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    w = items.words
    marks, value = winnow(doc, items.gram, items.window)
    lo = np.searchsorted(items.value, value[marks], "left") if len(marks) else marks
    hi = np.searchsorted(items.value, value[marks], "right") if len(marks) else marks
    found = np.flatnonzero(hi > lo)
    marks, lo, hi = marks[found], lo[found], hi[found]
    weight = np.cumsum(hi - lo)
    at = 0
    while at < len(marks):  # a frequent k-gram has many places: compare them in bounded steps
        end = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + step, "right")))
        row, index = _spread(lo[at:end], hi[at:end])
        d, i = marks[at:end][row], items.at[index]
        at = end
        keep = np.ones(len(d), bool)
        for j in range(items.gram):
            sel = np.flatnonzero(keep)
            keep[sel] = doc.same(d[sel] + j, w, i[sel] + j)
        d, i = d[keep], i[keep]
        left, right = np.zeros(len(d), np.int64), np.full(len(d), items.gram)
        for side, grown in ((-1, left), (1, right)):
            live = np.arange(len(d))
            while len(live):  # extend by a word at a time, a window at most
                p = d[live] + (grown[live] if side > 0 else -grown[live] - 1)
                q = i[live] + (grown[live] if side > 0 else -grown[live] - 1)
                ok = (p >= 0) & (q >= 0) & (p < len(doc.hash)) & (q < len(w.hash)) & (grown[live] < items.window)
                live, p, q = live[ok], p[ok], q[ok]
                ok = ((doc.owner[p] == doc.owner[d[live]]) & (w.owner[q] == w.owner[i[live]])
                      & (doc.hash[p] == w.hash[q]))
                live, p, q = live[ok], p[ok], q[ok]
                live = live[doc.same(p, w, q)]
                grown[live] += 1
        span = left + right
        good = span >= items.window
        out.append((d[good] - left[good], span[good], w.owner[i[good]]))
    for size, (first, h) in items.short.items():
        value, valid = doc.grams(size)
        if not len(value):
            continue
        lo, hi = np.searchsorted(h, value, "left"), np.searchsorted(h, value, "right")
        at_doc = np.flatnonzero((hi > lo) & valid)
        row, index = _spread(lo[at_doc], hi[at_doc])
        d, i = at_doc[row], first[index]
        for j in range(size):
            ok = doc.same(d + j, w, i + j)
            d, i = d[ok], i[ok]
        out.append((d, np.full(len(d), size), w.owner[i]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(3))


def _merge_hits(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Maximal runs [from, to) of hit words."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], (first + size)[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return np.stack([a[starts], reach[np.concatenate((starts[1:] - 1, [len(a) - 1]))]], 1)


def hit_words(packed: bytes | None) -> int:
    values = struct.unpack(f"<{len(packed) // 8}q", packed) if packed else ()
    return sum(values[1::2]) - sum(values[::2])


def contaminated(n_hit: int, n_words: int) -> bool:
    """A twentieth of the words or more is hit, and one at least."""
    return n_hit > 0 and 20 * n_hit >= n_words


def _pass(docs: DataFrame, ids: list[str], texts: list[bytes], window: int, gram: int, clean: bool) -> DataFrame:
    """Add one benchmark block's hits: word runs (packed pairs) and ids of the items that occur.

    With ``clean``, documents that are contaminated by then are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast((ids, texts))
    names = docs.columns
    schema = docs.schema

    def run(batches):
        release()
        ids, texts = distinct_items(*held.value)
        items = Items(texts, window, gram)
        for batch in bounded(batches, "text", TEXT_BLOCK):
            raw, offsets = text_views(batch.column("text"))
            doc = Words(raw, offsets)
            first, size, item = occurrences(doc, items)
            owner = doc.owner[first] if len(first) else first
            order = np.argsort(owner, kind="stable")
            first, size, item, owner = first[order], size[order], item[order], owner[order]
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for r in np.unique(owner).tolist():
                a, b = cuts[r], cuts[r + 1]
                f, s = first[a:b] - doc.bounds[r], size[a:b]
                before = np.frombuffer(old_hits[r] or b"", np.int64).reshape(-1, 2)
                f = np.concatenate((before[:, 0], f))
                s = np.concatenate((before[:, 1] - before[:, 0], s))
                old_hits[r] = _merge_hits(f, s).tobytes()
                old_items[r] = sorted({*(old_items[r] or []), *(name for k in np.unique(item[a:b]).tolist() for name in ids[k])})
            columns = {n: batch.column(n) for n in names}
            columns["n_words"] = pa.array(np.diff(doc.bounds), pa.int64())
            columns["hits"] = pa.array(old_hits, pa.binary())
            columns["items"] = pa.array(old_items, pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
            if clean:
                pairs = zip(old_hits, columns["n_words"].to_pylist())
                out = out.filter(pa.array([not contaminated(hit_words(h), n) for h, n in pairs], pa.bool_()))
            yield out
        trim()

    return docs.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, limit: int):
    """Items in blocks of at most ``limit`` words (one longer item is a block of its own)."""
    ids: list[str] = []
    texts: list[bytes] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    for row in rows.filter("text IS NOT NULL").orderBy("id", "text").toLocalIterator():
        text = row.text.encode()
        size = len(text) // 2 + 1
        if ids and held + size > limit:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.id if row.id is not None else "")
        texts.append(text)
        held += size
    yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  block_words: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """The columns of ``docs`` with n_words, hits (packed runs of hit words) and items (ids that occur).

    A null text has no words; an item without words has no window; a null item id reads as the
    empty string, and rows of one id count as one item. Every document row gets a row, repeated
    rows too; with ``clean`` those that are not contaminated get one. Columns named n_words, hits or items are replaced.
    """
    out = docs.drop("n_words", "hits", "items").select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"),
        F.lit(None).cast("array<string>").alias("items"))
    for k, (ids, texts) in enumerate(_blocks(benchmark, block_words)):
        # what is contaminated by some of the items stays so, whatever the others add
        out = _pass(cut(out) if k else out, ids, texts, window, gram, clean)
    return out


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from ``contamination``'s rows."""
    def run(batches):
        for batch in batches:
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            n_hit = [hit_words(h) for h in hits]
            n_words = batch.column("n_words").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": n_words, "n_hit": n_hit,
                "n_items": [len(i or ()) for i in items],
                "items_sha256": [hashlib.sha256(",".join(i or ()).encode()).hexdigest() for i in items],
                "contaminated": [contaminated(n, w) for n, w in zip(n_hit, n_words)]},
                schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                                  ("n_items", pa.int64()), ("items_sha256", pa.string()),
                                  ("contaminated", pa.bool_())]))
    return found.select(F.col("doc_id").cast("long"), "n_words", "hits", "items").mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
