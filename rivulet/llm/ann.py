"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table rotates unit vectors by fast Hadamard pseudo-rotations (three rounds of random signs and a transform) and hashes
each to its nearest signed axis. A query probes the buckets of a table in falling order of its own coordinate on their axes.
Two passes: the first probes a few buckets a table; its k-th best cosine c is a lower limit for all that is still missing, so
the second probes, for each query, as many buckets as find a vector of cosine c with the wanted probability. How often the
bucket of such a vector is among the first p of a query is measured once a dimension on random pairs. So where neighbours are
near, a few buckets are enough; where they are hardly nearer than chance, most of the table is searched, and a query
with fewer than k candidates searches all of it.

Equal vectors are one item with its smallest ids. A bucket is dealt in blocks of bounded size to the blocks of queries that
probe it: a query set against its candidates, of which only those leave a task that may be among a query's best.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors count as padded with zeros; rows that share a query's id are not its candidates, a repeated row is found
once; ties go to the smaller id; a query with fewer candidates has them all; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, release
from .vectors import first_per, longest, matrix, packed, unpacked

K, TABLES, PROBES, RECALL, SEED = 5, 4, 4, 0.96, 11
#: Vectors and queries of a block, at most in the mean; queries whose cosines with 1,024 vectors are in memory at once.
BLOCK, QUERIES, STEP = 32_768, 32_768, 2_048
#: Differences of cosines that rounding may make; what is this near is compared again by one fixed order of sums.
SLACK = 1e-9


@lru_cache(maxsize=8)
def signs(width: int, tables: int, seed: int) -> np.ndarray:
    """(tables, 3, size) random signs; size is the power of two that holds ``width``."""
    size = 1 << max(1, (width - 1).bit_length())
    return np.random.default_rng(seed).integers(0, 2, (tables, 3, size)) * 2.0 - 1


def rotated(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The rows of ``x`` (padded with zeros) after three rounds of signs and a Hadamard transform; lengths are kept."""
    size = own.shape[1]
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for sign in own:
        y *= sign
        step = 1
        while step < size:
            y = y.reshape(len(x), -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
            step *= 2
        y = y.reshape(len(x), size) / np.sqrt(size)
    return y


def axes(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: its number, plus the dimension where the sign is minus; ties to the smaller."""
    both = np.concatenate([y, -y], axis=1)
    return both.argmax(1)


def probe_order(y: np.ndarray, probes: int) -> np.ndarray:
    """The first ``probes`` signed axes of each row by falling coordinate."""
    return np.argsort(-np.concatenate([y, -y], axis=1), axis=1, kind="stable")[:, :probes]


@lru_cache(maxsize=8)
def chances(width: int, seed: int = SEED, pairs: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, share): how often the bucket of a vector of that cosine is among the first 1, 2, ... buckets of a query."""
    rng, own = np.random.default_rng(seed + 1), signs(width, 1, seed + 2)[0]
    cosines = np.round(np.arange(-0.2, 1.0, 0.05), 2)
    share = []
    for c in cosines:
        q = unit(rng.standard_normal((pairs, width)))
        z = rng.standard_normal((pairs, width))
        z -= (z * q).sum(1, keepdims=True) * q
        x = c * q + np.sqrt(1 - c * c) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        y = rotated(q, own)
        both = np.concatenate([y, -y], axis=1)
        place = (both > np.take_along_axis(both, axes(rotated(x, own))[:, None], 1)).sum(1)
        share.append(np.cumsum(np.bincount(place, minlength=both.shape[1])) / pairs)
    return cosines, np.array(share)


def probes_needed(width: int, tables: int, cosine: np.ndarray, recall: float) -> np.ndarray:
    """Buckets a table that find a vector of at least this cosine with probability ``recall``; all where there is none (nan)."""
    known, share = chances(width)
    found = 1 - (1 - share) ** tables
    enough = np.where((found >= recall).any(1), (found >= recall).argmax(1) + 1, share.shape[1])
    step = np.searchsorted(known, np.nan_to_num(cosine, nan=-1.0), "right") - 1  # the next smaller known cosine
    return np.where(step < 0, share.shape[1], enough[np.maximum(step, 0)])


def vector_rows(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and v (its numbers, 64-bit) of the rows that take part, each once; written."""
    src = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = matrix(batch.column("e"), width)
            ok &= (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), packed(x[ok] + 0.0)], ["vec_id", "v"])

    return materialize(src.mapInArrow(run, "vec_id long, v binary").distinct(), "ann-rows")


def hashed_items(rows: DataFrame, width: int, k: int, tables: int, seed: int) -> DataFrame:
    """item, v, ids (its k + 1 smallest) and buckets (one a table) of each distinct vector; written."""
    few = rows.withColumn("no", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("no") <= k + 1)  # cut in each task first
    own = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(unpacked(batch.column("v"), np.float64, width))
            codes = np.stack([axes(rotated(x, own)) for own in signs(width, tables, seed)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), lists], ["v", "ids", "buckets"])

    made = own.mapInArrow(run, "v binary, ids array<long>, buckets array<int>")
    return materialize(made.withColumn("item", F.monotonically_increasing_id()), "ann-items")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def probes_of(queries: DataFrame, width: int, tables: int, seed: int) -> DataFrame:
    """item, v, need and a row (table, bucket) for each bucket from place ``begin`` to ``end`` of each table's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(unpacked(batch.column("v"), np.float64, width))
            begin, end = batch.column("begin").to_numpy().astype(np.int64), batch.column("end").to_numpy().astype(np.int64)
            n = end - begin
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            row = np.repeat(np.arange(len(x)), n)
            own = signs(width, tables, seed)
            buckets = np.stack([probe_order(rotated(x, s), 2 * s.shape[1])[row, place] for s in own], axis=1).astype(np.int32)  # all probes x tables
            lists = pa.ListArray.from_arrays(pa.array((np.append(0, np.cumsum(n)) * tables).astype(np.int32)), pa.array((buckets * tables + np.arange(tables, dtype=np.int32)).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("v"), batch.column("need"), lists], ["item", "v", "need", "cells"])

    return queries.mapInArrow(run, "item long, v binary, need double, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def near_in(a: pa.Table, b: pa.Table, width: int, k: int) -> pa.Table:
    """(item, score, found, ids): of a block of queries and a block of a bucket, each query's k + 1 best items."""
    if a.num_rows > STEP:
        return pa.concat_tables([near_in(a.slice(at, STEP), b, width, k) for at in range(0, a.num_rows, STEP)])
    q, x = unpacked(a.column("v"), np.float64, width), unpacked(b.column("v"), np.float64, width)
    q_len, x_len = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    qu, xu, need = q / q_len[:, None], x / x_len[:, None], a.column("need").to_numpy().copy()
    low = np.array([i[0] for i in b.column("ids").to_pylist()], np.int64)
    who, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for begin in range(0, len(x) if len(q) else 0, 1024):
        s = qu @ xu[begin : begin + 1024].T
        if s.shape[1] > k:
            need = np.maximum(need, -np.partition(-s, k, axis=1)[:, k])
        i, j = np.nonzero(s >= need[:, None] - SLACK)
        j += begin
        exact = [(q[i[p : p + 65536]] * x[j[p : p + 65536]]).sum(1) / (q_len[i[p : p + 65536]] * x_len[j[p : p + 65536]]) for p in range(0, len(i), 65536)]
        who, at, score = np.concatenate([who, i]), np.concatenate([at, j]), np.concatenate([score, *exact])
        order = np.lexsort((low[at], -score, who))
        order = order[first_per(who[order], k + 1)]
        who, at, score = who[order], at[order], score[order]
        count = np.bincount(who, minlength=len(q))
        full = count == k + 1
        need[full] = np.maximum(need[full], score[np.cumsum(count)[full] - 1])
    return pa.table({"item": a.column("item").take(pa.array(who)), "score": pa.array(score), "found": b.column("item").take(pa.array(at)), "ids": b.column("ids").take(pa.array(at))})


def probed(queries: DataFrame, items: DataFrame, width: int, k: int, tables: int, seed: int, tag: str) -> DataFrame:
    """(item, score, found, ids), written: what queries (item, v, need, begin, end) find in the buckets of those places."""
    rows = probes_of(queries, width, tables, seed)
    cells = items.select("item", "v", "ids", F.posexplode("buckets").alias("t", "bucket")).withColumn("cell", (F.col("bucket") * tables + F.col("t")).cast("int")).drop("t", "bucket")
    # Sizes of buckets on both sides: tables x 2 x size rows at most, whatever the number of vectors.
    blocks = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = materialize(blocks(cells, BLOCK, "blocks").join(blocks(rows, QUERIES, "parts"), "cell"), "ann-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
    left = rows.join(F.broadcast(sizes), "cell").withColumn("part", own("parts")).withColumn("block", every("blocks"))
    again = sizes.select(*[F.col(c).alias(c) for c in sizes.columns])  # columns of its own, as both sides meet below
    right = cells.join(F.broadcast(again), "cell").withColumn("block", own("blocks")).withColumn("part", every("parts"))
    by = ["cell", "block", "part"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: near_in(a, b, width, k), "item long, score double, found long, ids array<long>")
    return materialize(met, tag)


def _best(found: DataFrame, k: int) -> DataFrame:
    """item and best: its k + 1 nearest rows (score, id, found), nearest first. An item has few rows here: k + 1 a block."""
    rows = found.dropDuplicates(["item", "found"]).select("item", "score", "found", F.explode("ids").alias("id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id", "found")
    top = rows.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= k + 1)
    return top.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("no", "score", "id", "found"))).alias("best"))


def search(vectors: DataFrame, query: Column, k: int = K, tables: int = TABLES, probes: int = PROBES, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row (vec_id, embedding) that fulfils ``query``."""
    width = max(1, longest(vectors))
    rows = vector_rows(vectors, width)
    items = hashed_items(rows, width, k, tables, seed)
    asked = materialize(rows.filter(query).join(items.select("v", "item"), "v").select(F.col("vec_id").alias("query_id"), "item", "v"), "ann-queries")
    release(rows)
    buckets = 2 * signs(width, 1, seed).shape[2]
    once = asked.dropDuplicates(["item"]).select("item", "v")
    first = probed(once.select("*", F.lit(-2.0).alias("need"), F.lit(0).alias("begin"), F.lit(min(probes, buckets)).alias("end")), items, width, k, tables, seed, "ann-first")
    kth = F.when(F.size("best") > k, F.get("best", F.lit(k))["score"]).alias("kth")
    limits = once.join(_best(first, k).select("item", kth), "item", "left")

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            end = np.minimum(probes_needed(width, tables, cosine, recall), buckets)
            own = [batch.column("item"), batch.column("v"), pa.array(np.nan_to_num(cosine, nan=-2.0)), pa.array(np.full(len(end), min(probes, buckets), np.int32)), pa.array(end.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(own, ["item", "v", "need", "begin", "end"])

    wider = limits.mapInArrow(more, "item long, v binary, need double, begin int, end int").filter("end > begin")
    second = probed(materialize(wider, "ann-wider"), items, width, k, tables, seed, "ann-second")
    best = _best(first.unionByName(second), k)
    own = asked.drop("v").join(best, "item").withColumn("near", F.filter("best", lambda b: (b["id"] != F.col("query_id")) | (b["found"] != F.col("item"))))
    out = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
