"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a value within one bit of both. Every
distinct fingerprint therefore emits itself and its 64 one-bit variants; rows that meet on a
variant are within two bits of each other. At most 65 distinct fingerprints can meet on one
variant, so no group grows with the data, and linking neighbours in a sorted group keeps the
whole group together without emitting its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.llm.common import doc_texts, release, trim
from utilnet.operators.kernels import components
from utilnet.session import written as cut

SEED = 42
FLUSH = 200_000  # shingles unpacked at once
LONG = 4 << 20  # bytes of a text that are split into words at once
SPACES = b" \t\n\r\x0b\x0c"


def _pieces(text: bytes, size: int = LONG) -> Iterator[bytes]:
    """Cut a very long text at white space, so that its words need not be held at once."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def shingle_hashes(text: bytes, words: int = 3) -> Iterator[list[int]]:
    """XXH64 of every run of ``words`` words of a text, repeats included, in lists."""
    held: list[bytes] = []
    seen = 0
    for piece in _pieces(text.lower()):
        found = held + piece.split()
        seen += len(found) - len(held)
        if len(found) >= words:
            line = b" ".join(found)
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            starts = np.concatenate(([0], gaps[:len(found) - words] + 1)).tolist()
            ends = np.concatenate((gaps[words - 1:], [len(line)])).tolist()
            yield [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)]
        held = found[-(words - 1):] if words > 1 else []
    if 0 < seen < words:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)]


def fingerprints(batch: pa.RecordBatch, words: int = 3) -> np.ndarray:
    """One signed 64-bit fingerprint per row: the bits set in over half of its shingle hashes."""
    ones = np.zeros((batch.num_rows, 64), np.int64)
    totals = np.zeros(batch.num_rows, np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    begins: list[int] = []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
            np.add.at(ones, owners, sums)
            hashes.clear(), owners.clear(), begins.clear()

    for i, text in enumerate(doc_texts(batch)):
        for found in shingle_hashes(text, words):
            for at in range(0, len(found), FLUSH):
                part = found[at:at + FLUSH]
                owners.append(i)
                begins.append(len(hashes))
                hashes += part
                totals[i] += len(part)
                if len(hashes) >= FLUSH:
                    flush()
    flush()
    packed = np.packbits((2 * ones > totals[:, None]).astype(np.uint8), axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1).astype(np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, words: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ``carry``, fp) for every document. Texts without words, null ones too, get zero."""
    rows = docs.select(F.col("doc_id").cast("long"), *carry, "text")
    names = ["doc_id", *carry]

    def run(batches):
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fingerprints(batch, words))],
                                             names=[*names, "fp"])
        trim()

    return rows.mapInArrow(run, rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that hold together all distinct fingerprints (column ``fp``) within two bits."""
    ball = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    met = W.partitionBy("variant").orderBy("fp")
    return (fps.select("fp", ball.alias("variant"))
            .select(F.col("fp").alias("b"), F.lag("fp").over(met).alias("a"))
            .filter("a IS NOT NULL AND bit_count(a ^ b) BETWEEN 1 AND 2").select("a", "b").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ``carry``, fp, component_id, label): documents whose fingerprints are linked, directly or not.

    ``component_id`` is the smallest doc_id of the component, ``label`` its smallest fingerprint.
    Documents of equal fingerprint are one node, so a group of copies is never paired. Texts
    without words share the fingerprint zero and are linked by it like any other. A null doc_id
    takes part but is never the smallest; repeated doc_ids are repeated rows of the result.
    Columns that are not carried are ignored.
    """
    fps = cut(with_fingerprints(docs, words, carry))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = cut(links(nodes))
    linked = found.select(F.col("a").alias("fp")).union(found.select("b")).distinct()
    labels = components(linked, found, [], "fp")
    low = (labels.join(nodes, "fp").groupBy("label").agg(F.min("rep").alias("component_id")))
    of_fp = cut(nodes.join(labels.join(low, "label"), "fp", "left")
                .select("fp", F.coalesce("component_id", "rep").alias("component_id"),
                        F.coalesce("label", "fp").alias("label")))
    return fps.join(of_fp, "fp").select("doc_id", *carry, "fp", "component_id", "label")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
