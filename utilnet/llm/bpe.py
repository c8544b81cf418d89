"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

The last token of the encoding of a prefix depends only on the last tokens of shorter prefixes:
of the vocabulary entries that end the prefix, exactly one follows the encoding of what is left
without a merge across the seam. The transducer reads bytes, keeps the last tokens of those
prefixes that a longer entry could still reach back to, and emits a token as soon as every such
path runs through it: the lookahead is bounded by the longest entry that can still complete. Its
states and steps are made when first needed and remembered; the memory has a fixed size and is
emptied when full, which changes nothing but speed.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilnet.llm.common import bounded, resident, trim

STEPS = 300_000  # remembered transducer steps
TEXT_BLOCK = 4 << 20  # bytes of text coded together
PIECES = 300_000  # remembered pieces, and as many of the generation before
SPACE = r"\p{White_Space}"
LATIN = re.compile("[\x00-\u024f]*\\Z").match


def rank_pattern(pattern: str) -> str:
    """The splitting pattern with \\s as the Unicode property, as rank-file libraries read it."""
    return pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", SPACE)


def latin_pattern(pattern: str) -> str:
    """The same pattern for texts below U+0250, with the classes spelled out: twice as fast."""
    white = r"\t-\r \x85\xa0"
    spelled = pattern.replace(r"\S", f"[^{white}]").replace(r"[^\s", f"[^{white}").replace(r"\s", f"[{white}]")
    for name, members in ((r"\p{L}", "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"),
                          (r"\p{N}", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be")):
        # inside a negated class only the members are added
        spelled = re.sub(r"\[\^[^\]]*\]", lambda m: m.group().replace(name, members), spelled)
        spelled = spelled.replace(name, f"[{members}]")
    return spelled


class Ranks:
    """A rank file: token bytes by id, and merges by rank."""

    def __init__(self, lines: Iterator[bytes]):
        self.rank: dict[bytes, int] = {}
        for line in lines:
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.tokens = {r: t for t, r in self.rank.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first: the rule that the transducer has to agree with."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]


class State(dict):
    """A transducer state; its steps {byte: (next state, token that ends the prefix)} fill on demand.

    ``seen`` is the longest suffix of what was read that begins an entry, ``last`` the last token
    of the prefix before each of its bytes and after the last one.
    """

    __slots__ = ("seen", "last", "machine")

    def __init__(self, machine: "Transducer", seen: bytes, last: tuple[int, ...]):
        super().__init__()
        self.machine, self.seen, self.last = machine, seen, last

    def __missing__(self, byte: int) -> tuple["State", int]:
        step = self[byte] = self.machine.step(self.seen + bytes((byte,)), self.last)
        return step


class Transducer:
    """Bytes of one piece in, tokens out."""

    def __init__(self, ranks: Ranks):
        self.rank = ranks.rank
        self.merge = ranks.merge
        self.tokens = ranks.tokens
        self.size = {r: len(t) for r, t in ranks.tokens.items()}
        self.prefixes = {t[:i] for t in ranks.rank for i in range(1, len(t) + 1)} | {b""}
        self.ends: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; they are made again when needed."""
        for state in getattr(self, "states", {}).values():
            state.clear()  # states point at each other; this frees them without a collector
        self.states: dict[tuple[bytes, tuple[int, ...]], State] = {}
        self.made = 0
        self.start = State(self, b"", (-1,))

    def _reaches_itself(self, token: int) -> bool:
        if token not in self.own:
            self.own[token] = self.merge(self.tokens[token]) == [token]
        return self.own[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether right can stand after left: no merge joins their bytes differently."""
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > STEPS:
                self.fits.clear()
            self.fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return self.fits[key]

    def _ending(self, seen: bytes) -> tuple[tuple[int, int], ...]:
        """(token, length) of the entries that end ``seen``, longest first."""
        if seen not in self.ends:
            if len(self.ends) > STEPS // 2:
                self.ends.clear()
            self.ends[seen] = tuple((self.rank[seen[i:]], len(seen) - i) for i in range(len(seen))
                                    if seen[i:] in self.rank and self._reaches_itself(self.rank[seen[i:]]))
        return self.ends[seen]

    def step(self, seen: bytes, last: tuple[int, ...]) -> tuple[State, int]:
        """The state after ``seen`` and the token that ends the prefix read so far."""
        for token, length in self._ending(seen):
            before = last[len(last) - length]
            if before < 0 or self._fits(before, token):
                break
        else:
            raise ValueError("the rank file lacks a single byte")
        last = last + (token,)
        while seen not in self.prefixes:
            seen = seen[1:]
        key = (seen, last[len(last) - len(seen) - 1:])
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(self, *key)
        self.made += 1
        return state, token

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece. A piece that is an entry is that entry.

        The last token after each byte is kept until all live paths agree on what lies before:
        a token that begins at or before every reachable position is final.
        """
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if self.made > STEPS:
            self.forget()
        state, ends = self.start, []
        out: list[int] = []
        size = self.size
        if len(piece) <= 4096:
            for byte in piece:
                state, token = state[byte]
                ends.append(token)
            at = len(ends)
            while at > 0:
                token = ends[at - 1]
                out.append(token)
                at -= size[token]
            out.reverse()
            return out
        done = 0  # bytes emitted
        for i, byte in enumerate(piece):
            state, token = state[byte]
            ends.append(token)
            if len(ends) > 8192:  # long pieces: emit what can no longer change
                path, at = [], i + 1
                reach = i + 1 - len(state.seen)
                while at > done:
                    path.append((at, ends[at - done - 1]))
                    at -= size[path[-1][1]]
                final = self._settled(ends, done, i + 1, reach)
                for at, t in reversed(path):
                    if at <= final:
                        out.append(t)
                if final > done:
                    ends = ends[final - done:]
                    done = final
        tail, at = [], len(ends)
        while at > 0:
            t = ends[at - 1]
            tail.append(t)
            at -= size[t]
        out.extend(reversed(tail))
        return out

    def _settled(self, ends: list[int], done: int, now: int, reach: int) -> int:
        """The last position that the paths of all prefixes from ``reach`` to ``now`` go through."""
        common: set[int] | None = None
        for at in range(max(reach, done + 1), now + 1):
            path = {done}
            while at > done:
                path.add(at)
                at -= self.size[ends[at - done - 1]]
            common = path if common is None else common & path
        return max(common) if common else done


class Encoder:
    """Whole texts to little-endian ids: split by the pattern, each piece through the transducer."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.machine = Transducer(ranks)
        self.split = regex.compile(rank_pattern(pattern)).findall
        self.latin = re.compile(latin_pattern(pattern)).findall
        machine = self.machine

        class Memory(dict):
            """Ids of pieces met of late; a missing one is encoded. Two generations, each bounded."""

            older: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                if len(self) >= PIECES:
                    self.older = dict(self)
                    self.clear()
                ids = self.older.get(piece)
                if ids is None:
                    ids = array("I", machine.encode(piece.encode())).tobytes()
                if len(piece) < 60:
                    self[piece] = ids
                return ids

        self.memory = Memory()

    def encode(self, text: str) -> bytes:
        split = self.latin if LATIN(text) else self.split
        return b"".join(map(self.memory.__getitem__, split(text)))


class Utf8:
    """Incremental UTF-8: says which bytes form whole characters; follows the standard's ranges."""

    #: For each state, the allowed range of the next byte and the state after it.
    NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2),
            4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}

    @classmethod
    def lead(cls, b: int) -> int:
        """The state after a first byte; -1 if no character begins so."""
        if b < 0x80:
            return 0
        if 0xC2 <= b <= 0xDF:
            return 1
        if 0xE0 <= b <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(b, 2)
        if 0xF0 <= b <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(b, 3)
        return -1

    @classmethod
    @functools.lru_cache(maxsize=1 << 20)
    def after(cls, state: int, token: bytes) -> int:
        """The state after a token's bytes; -1 once they are not UTF-8."""
        for b in token:
            if state < 0:
                return -1
            if state == 0:
                state = cls.lead(b)
            else:
                low, high, ahead = cls.NEXT[state]
                state = ahead if low <= b <= high else -1
        return state


class Decoder:
    """Ids to bytes, token by token, with the UTF-8 state carried over."""

    def __init__(self, ranks: Ranks):
        self.tokens = ranks.tokens
        # Most tokens begin and end between characters; only the others move the state.
        self.moves = np.zeros(max(ranks.tokens, default=0) + 1, bool)
        self.moves[[i for i, t in ranks.tokens.items() if Utf8.after(0, t) != 0]] = True

    def decode(self, ids: bytes) -> tuple[bytes, bool]:
        """The bytes and whether they are whole UTF-8 text."""
        numbers = np.frombuffer(ids, "<u4")
        tokens = self.tokens
        state, last = 0, -1
        for at in np.flatnonzero(self.moves[numbers]).tolist():
            if state and at != last + 1:
                break  # a whole token inside a character
            state, last = Utf8.after(state, tokens[int(numbers[at])]), at
            if state < 0:
                break
        whole = state == 0
        return b"".join(map(tokens.__getitem__, numbers.tolist())), whole


class Tools:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = Ranks(lines)
        self.encoder, self.decoder = Encoder(ranks, pattern), Decoder(ranks)
        # The states are many small containers without garbage among them; a collector that
        # walks them again and again would take a third of the time.
        gc.collect()
        gc.freeze()
        gc.set_threshold(1_000_000, 50, 1000)

    def close(self) -> None:
        self.encoder.memory.clear()
        self.encoder.memory.older = {}
        self.encoder.machine.forget()
        Utf8.after.cache_clear()
        gc.unfreeze()
        gc.set_threshold(700, 10, 10)


def tools(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a rank file, built once in each worker."""
    kept = resident(("bpe", path, pattern), lambda: Tools(path, pattern))
    return kept.encoder, kept.decoder


def _coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    """(rows, packed ids, decoded bytes) in bounded blocks of whole texts."""
    encoder, decoder = tools(path, pattern)
    for batch in bounded(batches, "text", TEXT_BLOCK):
        ids, texts = [], []
        for value in batch.column("text"):
            packed = encoder.encode(value.as_py() or "")
            back, whole = decoder.decode(packed)
            if not whole:
                raise ValueError("decoded bytes are not UTF-8")
            ids.append(packed)
            texts.append(back)
        yield batch, ids, texts
    trim()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(the columns of ``docs`` without text, ids, decoded): packed ids and the decoded text.

    ``ids`` holds little-endian unsigned 32-bit integers. Null and empty texts have no ids and
    decode to the empty text. Columns named ids or decoded are replaced. ``path`` names a rank
    file that every executor has.
    """
    base = docs.drop("ids", "decoded")
    kept = [c for c in base.columns if c != "text"]
    out = base.select(*kept, F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("string").alias("decoded"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, ids, texts in _coded(batches, path, pattern):
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*kept, "ids", "decoded"])

    return base.mapInArrow(run, out.schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, coded and decoded as in ``encode``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, ids, texts in _coded(batches, path, pattern):
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
