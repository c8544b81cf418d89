"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes: insults and threats by learnt and listed patterns (a whole word, or
the beginning of one), targets, negations and verbs of reported speech by lists. Small
transducers over the classes each turn one aspect of a clause into a label (is something
insulted, is someone addressed, does a negation reach the insult, is it somebody else's speech),
and their composition, made state by state when first needed, reads a clause once. Scores rest
on matched clauses; a logistic model over their weighted sums turns them into a probability.

Patterns and model are fitted on a bounded sample: at most ``SAMPLE`` labelled rows, taken in
the order of a hash of their id. A pattern is taken if toxic documents of the sample have it so
much oftener than others that chance does not explain it over all patterns tried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled rows that are learnt from
CANDIDATES = 5_000  # patterns looked at, best first
SHORTEST, LONGEST = 3, 10  # letters of a word's beginning
END = "$"  # marks a whole word
_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = ".!?;:\n"
_BREAK = re.compile(f"[{_BREAKS}]")

#: Fixed word lists of the grammar.
INSULTS = "idiot moron scum loser worthless pathetic stupid trash disgusting".split()
THREATS = "kill hurt destroy murder strangle töten umbringen tuer frapper matar destruir".split()
TARGETS = "you your he she they him her them du sie er ihr tu vous il elle ils tú usted él ella ellos".split()
NEGATIONS = "not never no nobody nicht nie kein keine pas jamais non nunca ni".split()
REPORTS = "said says called wrote claimed quoted sagte nannte schrieb dit appelle écrit dijo llamó escribió".split()


class Transducer:
    """States over word classes: (state, class) to next state; other classes keep the state."""

    def __init__(self, steps: dict[tuple[int, str], int], final: dict[int, float]):
        self.steps, self.final = steps, final

    def next(self, state: int, word: str) -> int:
        return self.steps.get((state, word), self.steps.get((state, "*"), state))


#: Whether a clause insults, threatens somebody, addresses somebody, denies, or reports. A
#: negation reaches three words on; a threat counts once it has a target.
INSULT = Transducer({(0, "insult"): 1}, {1: 1.0})
THREAT = Transducer({(0, "threat"): 1, (1, "target"): 2, (0, "target"): 3, (3, "threat"): 2}, {2: 1.0})
TARGET = Transducer({(0, "target"): 1}, {1: 1.0})
NEGATION = Transducer({(0, "negation"): 1, (1, "insult"): 9, (1, "*"): 2, (2, "insult"): 9, (2, "*"): 3,
                       (3, "insult"): 9, (3, "*"): 0}, {9: 1.0})
REPORT = Transducer({(0, "report"): 1, (1, "insult"): 2, (0, "insult"): 3, (3, "report"): 2}, {2: 1.0})


class Grammar:
    """The composition of transducers: one state for all of them, steps made when first needed."""

    def __init__(self, *machines: Transducer):
        self.machines = machines
        self.steps: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}

    def read(self, words: Iterator[str]) -> tuple[float, ...]:
        state = (0,) * len(self.machines)
        for word in words:
            key = (state, word)
            if key not in self.steps:
                self.steps[key] = tuple(m.next(s, word) for m, s in zip(self.machines, state))
            state = self.steps[key]
        return tuple(m.final.get(s, 0.0) for m, s in zip(self.machines, state))


def word_patterns(word: str) -> list[str]:
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + END]


class Lexicon:
    """Word classes; insults and threats carry weights and are sought in whole texts at once."""

    def __init__(self, patterns: dict[str, float]):
        self.weights = {w + END: 1.0 for w in INSULTS} | patterns
        self.threats = {w + END: 1.0 for w in THREATS}
        self.lists = {**dict.fromkeys(TARGETS, "target"), **dict.fromkeys(NEGATIONS, "negation"),
                      **dict.fromkeys(REPORTS, "report")}
        self.search = ahocorasick.Automaton()
        for p in {*self.weights, *self.threats}:
            self.search.add_word(p.removesuffix(END), len(p.removesuffix(END)))
        self.search.make_automaton()

    def of(self, word: str) -> tuple[str, float]:
        found = [self.weights[p] for p in word_patterns(word) if p in self.weights]
        if found:
            return "insult", max(found)
        if word + END in self.threats:
            return "threat", 1.0
        return self.lists.get(word, "other"), 0.0


FEATURES = 8


class Scorer:
    def __init__(self, patterns: dict[str, float], model: list[float] | None = None):
        self.lexicon = Lexicon(patterns)
        self.grammar = Grammar(INSULT, THREAT, TARGET, NEGATION, REPORT)
        self.model = model

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Clauses that hold the beginning of a listed pattern at the beginning of a word."""
        done = -1
        for end, size in self.lexicon.search.iter(text):
            at = end - size + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue
            # From break to break, however far they are: what lies before has been looked at once.
            low = max(done, 0)
            begin = max(low, *(text.rfind(b, low, at) + 1 for b in _BREAKS))
            stop = _BREAK.search(text, at)
            done = stop.start() if stop else len(text)
            yield begin, done

    def read(self, text: str, begin: int, end: int) -> tuple[float, int, tuple]:
        """(weight of the insults, their number, what the grammar finds) of one clause, word by word."""
        found = [0.0, 0]

        def classes() -> Iterator[str]:
            for m in _WORD.finditer(text, begin, end):
                c, x = self.lexicon.of(m[0])
                if c == "insult":
                    found[0] += x
                    found[1] += 1
                yield c

        facts = self.grammar.read(classes())
        return found[0], found[1], facts

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        total = plain = aimed = denied = told = threats = 0.0
        hits = 0
        for begin, end in self.clauses(text):
            weight, insults, (insult, threat, target, negation, report) = self.read(text, begin, end)
            if not insult and not threat:
                continue
            hits += insults
            total += weight
            threats += threat
            aimed += weight * target
            denied += weight * negation
            told += weight * report
            plain += weight * (1 - max(negation, report))
        size = math.log1p(len(text) / 100)
        return [math.log1p(x) for x in (total, plain, aimed, denied, told, threats, hits)] + [total / (1 + size)]

    def score(self, text: str | None) -> float:
        x = self.features(text)
        if self.model is None:  # nothing was labelled: listed insults alone
            return 1 - math.exp(-math.expm1(x[1]) - math.expm1(x[5]))
        z = self.model[0] + sum(a * b for a, b in zip(self.model[1:], x))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def choose_patterns(rows: list[tuple[str, int, int]], toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Patterns with weights from (pattern, toxic documents, other documents) counts.

    The strongest first; one that begins or continues a chosen pattern is taken only for what
    it adds to it.
    """
    bar = 2 * math.log(max(tried, 2))

    def strength(a: float, b: float) -> float:
        """Log-likelihood ratio that toxic documents have the pattern oftener."""
        if a <= 0 or a * clean <= b * toxic:
            return 0.0
        share, n = toxic / (toxic + clean), a + b
        return 2 * (a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b > 0 else 0.0))

    chosen: dict[str, tuple[int, int]] = {}
    order = sorted(rows, key=lambda r: (-strength(r[1], r[2]), -len(r[0]), r[0]))
    for pattern, a, b in order:
        inside = [v for p, v in chosen.items() if pattern.startswith(p)]
        if inside:
            continue
        below = [v for p, v in chosen.items() if p.startswith(pattern)]
        rest = strength(a - max((v[0] for v in below), default=0), b - max((v[1] for v in below), default=0))
        if rest > bar and a >= 3 and a > 4 * b:
            chosen[pattern] = (a, b)
    return {p: min(1.0, math.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))) / 5) for p, (a, b) in chosen.items()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Intercept and weights by Newton's method; no weight may be negative enough to explode."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Patterns and model from at most ``sample`` labelled documents; labels are 0 or 1.

    A document with several labels counts once for each. Without a toxic and a clean document
    the listed patterns remain.
    """
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long"), "toxic")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    known = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        totals = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {p for w in set(_WORD.findall(text.lower())) for p in word_patterns(w)}
                counts[y].update(words)
                totals[y] += 1
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield emit(counts)
                counts = (Counter(), Counter())
        yield emit(counts)
        yield pa.RecordBatch.from_pydict({"pattern": [""], "toxic": pa.array([totals[1]], pa.int64()), "clean": pa.array([totals[0]], pa.int64())})

    def emit(counts):
        names = list(counts[0] | counts[1])
        return pa.RecordBatch.from_pydict({
            "pattern": pa.array(names, pa.string()), "toxic": pa.array([counts[1][n] for n in names], pa.int64()),
            "clean": pa.array([counts[0][n] for n in names], pa.int64())})

    counted = (known.select("text", "toxic").mapInArrow(count, "pattern string, toxic long, clean long")
               .groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .filter("pattern = '' OR toxic + clean >= 3"))
    gain = F.when(F.col("pattern") == "", F.lit(1e18)).otherwise(F.col("toxic") * F.log2((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)))
    tried = F.count(F.lit(1)).alias("tried")
    rows = counted.filter("pattern = '' OR toxic > clean").orderBy(gain.desc(), F.length("pattern").desc(), "pattern").limit(CANDIDATES).collect()
    totals = next(((r.toxic, r.clean) for r in rows if r.pattern == ""), (0, 0))
    if not totals[0] or not totals[1]:
        return Scorer({})
    n = counted.agg(tried).first().tried
    patterns = choose_patterns([(r.pattern, r.toxic, r.clean) for r in rows if r.pattern], *totals, n)

    def measure(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(patterns)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "y": batch.column("toxic").cast(pa.int64()),
                "x": pa.array([scorer.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))})

    seen = known.select("text", "toxic").mapInArrow(measure, "y long, x array<double>").collect()
    x = np.array([r.x for r in seen])
    return Scorer(patterns, fit_logistic(x, np.array([r.y for r in seen], float)))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The columns of ``docs`` but text, with score (0 to 1) and predicted (1 from one half up).

    Null and empty texts get the score of a text without matched clauses. Columns of the new
    names are replaced.
    """
    base = docs.drop("score", "predicted")
    names = [c for c in base.columns if c != "text"]
    patterns = {p: w for p, w in scorer.lexicon.weights.items()}
    model = scorer.model
    out = base.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]):
        own = Scorer(patterns, model)
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, pa.float64()),
                 pa.array([int(s >= 0.5) for s in found], pa.int32())], names=[*names, "score", "predicted"])

    return base.mapInArrow(run, out.schema)
