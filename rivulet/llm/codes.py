"""Vector code compression: product quantisation by Lloyd rounds with Exponion search, in exact integers.

Each component becomes floor(1024 x); a vector is cut into consecutive parts, each coded by the nearest entry of its
position's codebook. The search of a part starts at its entry of the round before: with D its distance to that entry, an
entry that is as near or nearer lies within 2 D of the entry (triangle inequality), so only that stretch of the entry's
list of neighbours, sorted by distance, is scanned. All distances are squared integers, ties go to the lower index.

A round writes each row's codes beside it, and sums parts by entry within each task; one row for each task, position and
entry is shuffled, so copies of one vector meet pre-aggregated. Codebooks (entries x length of a vector) are what the driver holds.

Defined results: null vectors and those with null or non-finite components are dropped; shorter vectors are padded with
zeros to the longest, and that to a multiple of the number of parts, for the codebooks too; equal vectors have equal codes
whatever their ids; rows that share a vec_id are rows each, the first codebooks take them by their components; null ids
come last there; null labels are one label; an empty table gives an empty result; other columns are not read. A component of
2^15 or more in magnitude fails the job with a message, as its sums would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize, release
from .vectors import longest, packed, products, quantised, unpacked

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Labels whose sums are broadcast, at most (some 100 bytes each); more are joined by a shuffle.
NAMED = 100_000


class Books:
    """The codebooks (parts, entries, width) and each entry's neighbours by (squared distance, index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.lengths = (entries * entries).sum(2)
        apart = np.stack([_squares(e, n, e, n) for e, n in zip(entries, self.lengths)]) if len(entries) else np.zeros((0, 0, 0), np.int64)
        self.near = np.argsort(apart, axis=2, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 2)

    def nearest(self, part: int, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``, from the entries ``start``."""
        entries, lengths = self.entries[part], self.lengths[part]
        own = (x.astype(np.int64) ** 2).sum(1)
        best, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        order = np.argsort(start, kind="stable")
        ends = np.searchsorted(start[order], np.arange(len(entries) + 1))
        for e in np.flatnonzero(np.diff(ends)):
            rows = order[ends[e] : ends[e + 1]]
            begun = ((x[rows] - entries[e]) ** 2).sum(1)
            # Within twice the distance to the start: 4 D^2 in squares; what lies beyond is farther than the start.
            inside = np.searchsorted(self.apart[part, e], 4 * begun, "right")
            by = np.argsort(inside, kind="stable")
            for at in range(0, len(by), 64):
                some = rows[by[at : at + 64]]
                near = self.near[part, e, : inside[by[at : at + 64][-1]]]
                d = _squares(x[some], own[some], entries[near], lengths[near])
                low = d.min(1)
                best[some] = np.where(d == low[:, None], near, len(entries)).min(1)
                far[some] = low
        return best, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squares(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    return aa[:, None] + bb[None, :] - 2 * products(a, b)


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> Books:
    """The parts of the rows of the smallest ids: a few of each task, then of each group of tasks, then of all."""
    order = [F.col("vec_id").asc_nulls_last(), "q"]
    few = rows.select("vec_id", "q", (F.spark_partition_id() % entries).alias("salt"))
    few = few.withColumn("no", F.row_number().over(Window.partitionBy("salt").orderBy(*order))).filter(F.col("no") <= entries)
    found = few.orderBy(*order).limit(entries).select("q").toArrow()
    own = unpacked(found.column("q"), np.int32, parts * width).astype(np.int64)
    return Books(own.reshape(-1, parts, width).transpose(1, 0, 2))


def assigned(rows: DataFrame, books: Books, parts: int, width: int) -> DataFrame:
    """``rows`` with the ``code`` (a byte a part) of the nearest entries, searched from the code they have, and ``error``."""
    names = [f.name for f in rows.schema.fields if f.name not in ("code", "error")]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(books)  # entries x length of a vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = unpacked(batch.column("q"), np.int32, parts * width).astype(np.int64).reshape(-1, parts, width)
            code, error = unpacked(batch.column("code"), np.uint8, parts).copy(), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], far = books.nearest(p, np.ascontiguousarray(x[:, p]), code[:, p])
                error += far
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], packed(code), pa.array(error)], [*names, "code", "error"])

    return rows.mapInArrow(run, schema)


def moved(rows: DataFrame, books: Books, parts: int, width: int) -> Books:
    """The books with each used entry at floor(sum / count) of its parts."""
    entries = books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = unpacked(batch.column("q"), np.int32, parts * width).astype(np.int64).reshape(-1, width)
            at = (unpacked(batch.column("code"), np.uint8, parts) + np.arange(parts) * entries).ravel()
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            if len(used):
                sums[used] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), lists], ["at", "n", "sums"])

    by_task = rows.select("q", "code").mapInArrow(run, "at int, n long, sums array<long>")
    total = by_task.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    found = total.toArrow()  # a row an entry
    out = books.entries.reshape(parts * entries, width).copy()
    if width:
        at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
        out[at] = np.stack([found.column(f"s{i}").to_numpy() for i in range(width)], axis=1) // n[:, None]
    return Books(out.reshape(parts, entries, width))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(vec_id, label, q, code, error of each vector that takes part, written; the codebooks after ``rounds`` rounds)."""
    width = -(-max(1, longest(vectors)) // parts)
    rows = quantised(vectors, scale, parts * width, ["vec_id", "label"])
    rows = materialize(rows.withColumn("code", F.lit(bytes(parts))), "codes-parts")
    books = first_books(rows, parts, entries, width)
    for _ in range(rounds):
        coded, past = materialize(assigned(rows, books, parts, width), "codes-round"), rows
        books, rows = moved(coded, books, parts, width), coded
        release(past)
    coded = materialize(assigned(rows, books, parts, width), "codes-last")
    release(rows)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: its label's sum of errors, null labels together."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels").withColumnRenamed("label", "__label")
    if sums.count() <= NAMED:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every vector that takes part."""
    coded, books = compress(vectors)
    out = with_label_error(coded)
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
