"""Arrow batches of vectors as numpy matrices.

A vector takes part if it is not null and each component is a finite number; shorter vectors count as padded with zeros
to the length of the table's longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers below this, and lengths up to 8,192, have exact inner products in 64 bits.
LARGEST = 1 << 25
#: Products and sums below this are exact in double precision.
EXACT = 1 << 53


def longest(vectors: DataFrame, column: str = "embedding") -> int:
    """The greatest length of a vector: one number from one aggregation."""
    return vectors.agg(F.max(F.size(F.col(f"`{column}`")))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, ok): the rows of a list column in double precision, padded with zeros, and whether each takes part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes nan
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = ~np.asarray(pc.is_null(column)) & (np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0)
    if len(sizes) and sizes.min() == width == sizes.max():
        return values.reshape(-1, width), ok
    out = np.zeros((len(sizes), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, ok


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes, little-endian."""
    if not rows.shape[1]:
        return pa.array([b""] * len(rows), pa.binary())
    data = np.ascontiguousarray(rows).astype(rows.dtype.newbyteorder("<"), copy=False)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * (rows.itemsize * rows.shape[1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """The matrix of :func:`packed` rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not width or not len(column):
        return np.zeros((len(column), width), kind)
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, _start(column)).reshape(-1, width)


def _start(column: pa.Array) -> int:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return int(np.frombuffer(column.buffers()[1], kind)[column.offset])


def quantised(vectors: DataFrame, scale: int, width: int, keep: list[str], column: str = "embedding") -> DataFrame:
    """``keep`` columns and ``q``: floor(scale * x) of each component of the vectors that take part, as int32 bytes.

    A component of 2^25 / scale or more fails the job with a message: its products would not be exact.
    """
    src = vectors.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("array<double>").alias("__v"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("q", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = matrix(batch.column("__v"), width)
            own = np.floor(rows[ok] * scale)
            if own.size and np.abs(own).max() >= LARGEST:
                raise ValueError(f"a component times {scale} is beyond the exact range of {LARGEST}")
            good = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*[good.column(c) for c in keep], packed(own.astype(np.int32))], [*keep, "q"])

    return src.mapInArrow(run, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact, as int64; in double precision where that is exact too."""
    top = (int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]) if a.size and b.size else 0
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_per(group: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first ``k`` places of each run of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    run = np.repeat(starts, np.diff(np.append(starts, len(group))))
    return np.arange(len(group)) - run < k
