"""Arrow batches of texts as numpy buffers: UTF-8 bytes end to end, with the offsets of the documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that the numpy code holds at once; a longer document makes a piece of its own.
PIECE_BYTES = 1 << 18
#: Bytes of an Arrow batch between the JVM and Python, at most, if a query is left to choose.
BATCH_BYTES = 4 << 20
# The system's allocator gives memory back when a batch is done; pooling allocators keep it for as long as a worker lives.
pa.set_memory_pool(pa.system_memory_pool())


def bound_batches(spark) -> None:
    """Keep Arrow batches of long texts small, so that a worker's memory does not follow the rows of a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(min(BATCH_BYTES, int(re.sub(r"\D", "", spark.conf.get(name)) or BATCH_BYTES))))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    """Start of each value in the data buffer, and the end of the last; null values are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.buffers()[1] is None:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column without a copy; a null value counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    ends = offsets(column)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true in ``inside``; a run never crosses a document's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[1:-1][ends[1:-1] < n]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] |= inside[cuts]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and xor-shift, twice)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= ODD
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[int, np.ndarray] = {}
_BASE = 0x5851F42D4C957F2D


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; kept for the next call."""
    held = _POWERS.get(base)
    if held is None or len(held) <= n:
        out = np.full(max(n + 1, 1 << 16), base, np.uint64)
        out[0] = 1
        held = np.multiply.accumulate(out)
        if n < 1 << 18:
            _POWERS[base] = held
    return held[: n + 1]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(_BASE, -1, 1 << 64))


class Spans:
    """Hashes of any spans of a sequence of words in constant time each: sums of scrambled words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(words * powers(n)[:n], out=self.sums[1:])
        self.back = inverse_powers(n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * ODD)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z."""
    return _FOLD[data]


def lower_bytes(text: str) -> bytes:
    """UTF-8 of the text in lower case, byte for byte in place: a letter whose lower case has another length stays."""
    out = text.lower().encode()
    if len(out) == len(text.encode()) and len(text) == len(text.lower()):
        return out
    return "".join(low if len(low.encode()) == len(c.encode()) else c for c in text for low in (c.lower(),)).encode()


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`flat`, in lower case; offsets are those of the texts as they are."""
    data, ends = flat(column)
    if not len(data) or data.max() < 128:
        return fold(data), ends
    raw = [b"" if t is None else lower_bytes(t) for t in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), ends


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters, digits and non-ASCII bytes; the rest separates tokens."""
    return runs(_TOKEN[data], ends)


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
