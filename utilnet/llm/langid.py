"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language recognises every substring of that text. A
document is parsed greedily into the longest phrases that each automaton knows; the language
that needs the fewest phrases, relative to what its own held-back text needs, wins.

The automata are fitted on a bounded sample: ``SAMPLE_BYTES`` of text per language, taken from
labelled documents in the order of a hash of their id, and as much again to measure the usual
phrase length. Whole texts are scored: a text is cut into segments of ``SEGMENT`` bytes (each
begins a new phrase) that are parsed side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.llm.common import bounded, resident, trim

SAMPLE_DOCS = 400
SAMPLE_BYTES = 40_000
ENOUGH = 2000  # held-back bytes that measure a language's usual phrase alone
SEGMENT = 512
TEXT_BLOCK = 2 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class SuffixAutomaton:
    """Dense transition table over the symbols of ``alphabet``; state 1 is the start, 0 a dead end."""

    def __init__(self, symbols: np.ndarray, width: int):
        limit = 2 * len(symbols) + 2
        table = np.zeros((limit, width), np.int32)
        link, length = [0] * limit, [0] * limit
        rows = table  # rows are copied whole when a state is cloned
        count, last = 1, 1
        for s in symbols.tolist():
            count += 1
            cur = count
            length[cur] = length[last] + 1
            p = last
            while p and not rows[p, s]:
                rows[p, s] = cur
                p = link[p]
            if not p:
                link[cur] = 1
            else:
                q = int(rows[p, s])
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    count += 1
                    clone = count
                    length[clone] = length[p] + 1
                    rows[clone] = rows[q]
                    link[clone] = link[q]
                    link[q] = link[cur] = clone
                    while p and rows[p, s] == q:
                        rows[p, s] = clone
                        p = link[p]
            last = cur
        self.table = np.ascontiguousarray(table[:count + 1])

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases begun in each segment; ``columns`` is (step, segment), negative past its end."""
        width = self.table.shape[1]
        flat = self.table.reshape(-1)
        first = self.table[1]
        n = np.zeros(columns.shape[1], np.int64)
        state = np.zeros(columns.shape[1], np.int64)
        for row in columns:
            live = row >= 0
            sym = np.where(live, row, 0)
            ahead = flat[state * width + sym]
            stuck = (ahead == 0) & live
            n += stuck
            state = np.where(stuck, first[sym], ahead)
            # a symbol unknown even at the start is a phrase of its own; state 0 has no way on
        return n


class Model:
    """One automaton per language over a shared alphabet of lower-case UTF-8 bytes."""

    def __init__(self, samples: dict[str, tuple[str, str]]):
        known = {k: (a.lower().encode(), b.lower().encode()) for k, (a, b) in sorted(samples.items())}
        used = np.unique(np.frombuffer(b"".join(a for a, _ in known.values()), np.uint8))
        self.code = np.zeros(256, np.int16)  # 0: not in any sample
        self.code[used] = np.arange(1, len(used) + 1)
        self.names = list(known)
        width = len(used) + 1
        self.automata = [SuffixAutomaton(self.code[np.frombuffer(a, np.uint8)], width) for a, _ in known.values()]
        held = np.array([len(b) for _, b in known.values()])
        own = np.array([self._count(m, [b])[0] if b else 0 for m, (_, b) in zip(self.automata, known.values())])
        # little text tells little of a usual phrase; what is missing counts as the languages' common one
        common = max(own.sum(), 1) / max(held.sum(), 1)
        short = np.maximum(ENOUGH - held, 0)
        self.usual = (np.maximum(own, held > 0) + common * short) / (held + short)

    def _segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        size = np.array([len(t) for t in texts], np.int64)
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(size) - size, parts) + nth * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(size, parts) - nth * SEGMENT)
        columns = np.full((SEGMENT, len(owner)), -1, np.int16)
        steps = np.arange(SEGMENT)
        for at in range(0, len(owner), 512):
            s, n = start[at:at + 512], length[at:at + 512]
            place = np.minimum(s[None, :] + steps[:, None], max(len(raw) - 1, 0))
            columns[:, at:at + 512] = np.where(steps[:, None] < n[None, :], raw[place], -1)
        return columns, owner

    def _count(self, machine: SuffixAutomaton, texts: list[bytes]) -> np.ndarray:
        columns, owner = self._segments(texts)
        return np.bincount(owner, machine.phrases(columns), len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: how far the runner-up is behind) of each text."""
        lettered = [bool(t and _LETTER.search(t)) for t in texts]
        coded = [t.lower().encode() if ok else b"" for t, ok in zip(texts, lettered)]
        columns, owner = self._segments(coded)
        cost = np.stack([np.bincount(owner, m.phrases(columns), len(texts)) for m in self.automata], 1)
        cost = cost / self.usual[None, :]
        order = np.argsort(cost, axis=1, kind="stable")
        best = order[:, 0]
        rows = np.arange(len(texts))
        if len(self.names) > 1:
            low, next_low = cost[rows, best], cost[rows, order[:, 1]]
            score = np.where(next_low > 0, 1 - low / np.where(next_low > 0, next_low, 1), 0.0)
        else:
            score = np.ones(len(texts))
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)]
        return names, np.where(lettered, np.clip(score, 0, 1), 0.0)


def samples(train: DataFrame, docs_per_lang: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, tuple[str, str]]:
    """Bounded learning text per language: from at most ``docs_per_lang`` documents each.

    Rows are taken in the order of a hash of the id and dealt out in turn to the automaton's
    sample and the measuring sample, a passage of each, until each holds ``size`` characters.
    Texts of any length count, those without a letter only where a language has too few others;
    every language with a text that is not empty is learnt.
    """
    part = max(200, size // 40)  # a fortieth of the sample from each document, so that no odd text can fill it
    order = ["bare", "o"]
    known = train.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0").select(
        "lang", (~F.col("text").rlike(r"\p{L}")).alias("bare"), F.xxhash64("doc_id").alias("o"), F.substring("text", 1, part).alias("text"))
    # first the ids alone, so that texts are fetched for the chosen documents only
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    last = (known.select("lang", *order).withColumn("nth", rank).filter(F.col("nth") <= docs_per_lang)
            .groupBy("lang").agg(F.max(F.struct(*order)).alias("last")).collect())
    out = {}
    for lang, (bare, o) in sorted((r.lang, r.last) for r in last):
        own = known.filter((F.col("lang") == lang) & (F.struct(*order) <= F.struct(F.lit(bare), F.lit(o))))
        taken = own.orderBy(*order, "text").limit(docs_per_lang).collect()
        halves: tuple[list[str], list[str]] = ([], [])
        held = [0, 0]
        for k, row in enumerate(taken):
            room = size - held[k % 2]
            if room > 0:
                halves[k % 2].append(row.text[:room])
                held[k % 2] += len(halves[k % 2][-1])
        out[lang] = ("\n".join(halves[0]), "\n".join(halves[1]))
    return out


def identify(docs: DataFrame, found: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score.

    A null text, or one without a letter, is ``und`` with score 0; so is everything if there was
    nothing to learn from. Only ``text`` is looked at. Columns of those two names are replaced.
    """
    base = docs.drop("lang_pred", "score")
    names = base.columns
    out = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not found:
        return base.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(found)
    key = hashlib.md5(repr(sorted(found.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]):
        model = resident(key, lambda: Model(held.value))  # built once in each worker
        for batch in bounded(batches, "text", TEXT_BLOCK):
            langs, score = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(langs, pa.string()), pa.array(score)],
                names=[*names, "lang_pred", "score"])
        trim()

    return out.mapInArrow(run, out.schema)
