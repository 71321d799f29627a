"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within radius / 2 bits of each. Every distinct
fingerprint is sent once to each part of the variant space that its ball of half the radius reaches; there its variants
in that part are listed, those listed by more than one fingerprint are collisions, and colliding fingerprints, verified
bit by bit, are linked. As all that collide at a variant lie within the radius of each other, a chain through them keeps
every link between components, so no group is expanded into its pairs.

Defined results: a null text has no words and fingerprint zero, as has an empty one; equal texts share a fingerprint
whatever their number, and only distinct fingerprints are compared; repeated rows are answered each; a null doc_id takes
part with its text and never names a component unless all ids of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .graph import components
from .store import materialize

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Leading bits that name a part of the variant space; variants listed at once in a task.
PART_BITS, LISTED = 8, 1 << 21
#: Fingerprints of a part beyond which it is split.
CROWD = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of ASCII-lower-cased words (white space is blank and bytes 9 to 13): a bit is 1 if set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        h = np.array([digest(flat[s:e], seed) for s, e in zip(starts[at:to], ends[at + last : to + last])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([fingerprint((x or "").encode(), shingle) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, most: int) -> list[list[int]]:
    """By weight 0 to ``most``: all words of ``bits`` bits with so many ones."""
    return [[sum(1 << i for i in c) for c in combinations(range(bits), k)] for k in range(most + 1)]


def collisions(part: int, fps: np.ndarray, half: int, part_bits: int = PART_BITS) -> np.ndarray:
    """Linked pairs (m, 2) of places in ``fps`` that have a common variant in this part; a spanning forest of them.

    Of those that list one variant each is paired with the one before it: all are within 2 * half bits of each other,
    so whatever lists a variant is then linked.
    The part's variants are listed in blocks by their next bits, so that memory stays bounded whatever the part holds.
    """
    low, n = BITS - part_bits, len(fps)
    spent = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(part))
    block_bits = 0
    while block_bits < 16 and n * sum(map(len, masks(low, half))) >> block_bits > LISTED:
        block_bits += 1
    rest = low - block_bits
    low_masks = [np.array(m, np.uint64) for m in masks(rest, half)]
    links, waiting = np.zeros((0, 2), np.int64), []
    for block in range(1 << block_bits):
        head = np.uint64((part << block_bits) | block) << np.uint64(rest)
        used = spent + (np.bitwise_count(((fps >> np.uint64(rest)) ^ np.uint64(block)) & np.uint64((1 << block_bits) - 1)) if block_bits else 0)
        values, owners = [], []
        for k in range(half + 1):
            own = np.flatnonzero(used <= half - k)
            if len(own):
                tail = fps[own] & np.uint64((1 << rest) - 1)
                values.append(((tail[:, None] ^ low_masks[k][None, :]) | head).ravel())
                owners.append(np.repeat(own.astype(np.int32), len(low_masks[k])))
        if not values:
            continue
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        if len(same):
            a, b = owner[same].astype(np.int64), owner[same + 1].astype(np.int64)
            key = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
            pairs = np.stack([key // n, key % n], 1)
            waiting.append(pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * half])
        if sum(map(len, waiting)) > LISTED // 4:
            links, waiting = forest(n, np.concatenate([links, *waiting])), []
    return forest(n, np.concatenate([links, *waiting]))


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Of ``pairs`` between ``n`` nodes, fewer than n that connect all that they connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def extended(sent: DataFrame, bits: int, more: int, half: int) -> DataFrame:
    """(part, fp, spent) of parts of ``bits`` leading bits, sent on to parts of ``more`` bits more that the ball reaches."""
    flips = F.array(*[F.lit(m).cast("long") for k in masks(more, half) for m in k])
    own = F.shiftrightunsigned("fp", BITS - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    reached = F.explode(F.filter(flips, lambda m: F.bit_count(m) + F.col("spent") <= half)).alias("flip")
    moved = sent.select("part", "fp", "spent", reached)
    return moved.select(F.shiftleft("part", more).bitwiseOR(own.bitwiseXOR(F.col("flip"))).alias("part"), "fp", (F.col("spent") + F.bit_count("flip")).alias("spent"))


def links(distinct: DataFrame, radius: int = RADIUS, part_bits: int = PART_BITS, crowd: int = CROWD, step: int = 4) -> DataFrame:
    """(a, b): verified links between distinct fingerprints (column fp) that connect all within ``radius`` bits.

    ``part_bits`` should be chosen for a few 100,000 fingerprints in a part (see ``bits_for``). A part that holds more
    than ``crowd``, as a dense region of the fingerprints does, is split by ``step`` further leading bits, and again,
    until none does: no region is one task's.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")

    def listed(bits: int):
        def run(table: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            fps = np.sort(table.column("fp").to_numpy().view(np.uint64))
            found = fps[collisions(table.column("part")[0].as_py(), fps, half, bits)].view(np.int64)
            return pa.table({"a": found[:, 0], "b": found[:, 1]})

        return run

    sent = extended(distinct.select(F.lit(0).cast("long").alias("part"), "fp", F.lit(0).alias("spent")), 0, part_bits, half)
    bits, out = part_bits, None
    while True:
        dense = sent.groupBy("part").count().filter(F.col("count") > crowd).select("part")
        last = bits + step > BITS - step or dense.isEmpty()
        ready = sent if last else sent.join(dense, "part", "left_anti")
        found = ready.select("part", "fp").groupBy("part").applyInArrow(listed(bits), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        sent = materialize(extended(sent.join(dense, "part", "left_semi"), bits, step, half), "simhash-dense")
        bits += step


def bits_for(n: int) -> int:
    """Leading bits so that a part holds some 120,000 fingerprints: each goes to 1 + b + b (b - 1) / 2 of 2^b parts."""
    return next((b for b in range(6, 40) if n * (1 + b + b * (b - 1) // 2) / (1 << b) <= 120_000), 40)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id that links reach."""
    fps = materialize(fingerprints(docs, shingle), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = materialize(components(links(classes.select("fp"), radius, bits_for(classes.count())), "simhash-links"), "simhash-roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("__fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
