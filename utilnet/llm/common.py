"""Arrow helpers shared by the operators: bounded blocks of whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


_resident: dict[object, object] = {}


def resident(key: object, build: Callable[[], object]) -> object:
    """The tool of a key, kept for the next tasks of this worker until another one is built."""
    if key not in _resident:
        release()
        _resident[key] = build()
    return _resident[key]


def release() -> None:
    """Drop the tool that is kept and hand free memory back: workers outlive their tasks."""
    while _resident:
        tool = _resident.popitem()[1]
        if hasattr(tool, "close"):
            tool.close()
        del tool  # a name would keep the tool alive beyond the collection
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only some C libraries have it
        pass


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts hold about ``limit`` bytes.

    A single text above the limit is a run of its own; rows are never dropped or split.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_views(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def doc_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text, empty for a null."""
    raw, offsets = text_views(batch.column(column))
    whole, ends = raw.tobytes(), offsets.tolist()
    for a, b in zip(ends, ends[1:]):
        yield whole[a:b]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order is as good as random."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
