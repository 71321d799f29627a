"""Hard-negative mining: exact searches over vectors in buckets of falling norm.

Rows are sorted by norm into ranges of bounded size, and within a range into buckets. By Cauchy-Schwarz a row's score with
an anchor is at most the product of their norms, so an anchor is sent only to ranges, and within them compared only
with buckets, whose longest vector can still reach what the anchor needs: its running k-th best score and, for negatives, the
lower limit of a window. The range of the longest vectors comes first; the k-th scores it gives bound what the others get.
An anchor thus meets ranges, never a label's or a bucket's pairs as rows; a cell of a range and a block of anchors is a task's
unit of bounded size, and only rows that entered an anchor's best list leave it.

Defined results: rows without an id, a label or a vector, or with null or non-finite components, take no part; shorter
vectors count as padded with zeros; rows that share the anchor's id are itself and never its partners; other repeated rows
each take a place; ties go to the smaller id; an anchor without a partner of its label, or a positive without a negative in
its window, has no row; an empty table gives an empty result; other columns are not read.
A component of 2^17 or more in magnitude fails the job with a message, as its products would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, release
from .vectors import first_per, longest, products, quantised, unpacked

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Least and most rows of a range and anchors of a block: between them a 64th of the table, an 8th of the anchors. Each row goes
#: once to each block and each anchor once to each range, so larger ones are sent less often.
RANGE, BLOCK = (1_024, 65_536), (1_024, 65_536)
#: Rows of a bucket, and anchors whose scores with it are in memory at once.
BUCKET, STEP = 512, 1_024


def _dealt(n: int, parts: int, bounds: tuple[int, int]) -> int:
    """Into how many parts ``n`` rows go: ``parts`` at least, within the bounds of a part's size."""
    return max(1, -(-n // min(bounds[1], max(bounds[0], n // parts))))


def rows_by_norm(vectors: DataFrame, scale: int, width: int) -> DataFrame:
    """id, label (as text), q, norm and range of the rows that take part, written: the longest vectors in the first range."""
    own = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    own = own.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "embedding")
    q = quantised(own, scale, width, ["id", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("q"), np.int32, width).astype(np.int64)
            norm = np.sqrt((x * x).sum(1).astype(np.float64)) * (1 + 1e-12)  # never below the true one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], ["id", "label", "q", "norm"])

    made = materialize(q.mapInArrow(run, "id long, label string, q binary, norm double"), "negatives-rows")
    ranges = _dealt(made.count(), 64, RANGE)
    sorted_rows = made.repartitionByRange(ranges, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    out = materialize(sorted_rows.withColumn("range", F.spark_partition_id()), "negatives-ranges")
    release(made)
    return out


def _cells(anchors: DataFrame, rows: DataFrame, tops: list[tuple[int, float]], blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by (range, block): each anchor in the ranges that can reach what it needs, each row once a block."""
    lengths = np.array([-x for _, x in tops])  # rising
    names, numbers = [f.name for f in anchors.schema.fields], np.array([i for i, _ in tops], np.int32)
    shared = anchors.sparkSession.sparkContext.broadcast((lengths, numbers))  # two numbers a range

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, numbers = shared.value
        for batch in batches:
            need, norm = batch.column("need").to_numpy(), batch.column("norm").to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(need <= 0, -np.inf, need / norm)  # a longer vector's norm reaches it
            last = np.searchsorted(lengths, -least, "right")
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(last)).astype(np.int32)), pa.array(numbers[np.arange(last.sum()) - np.repeat(np.cumsum(last) - last, last)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "ranges"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    left = anchors.mapInArrow(reach, f"{ddl}, ranges array<int>").withColumn("range", F.explode("ranges")).drop("ranges")
    left = left.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int"))
    right = rows.filter(F.col("range").between(tops[0][0], tops[-1][0]))  # ranges are numbered by falling norm
    return left, right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _scan(anchors: pa.Table, rows: pa.Table, width: int, slots: int, k: int, wanted) -> pa.Table:
    """(no, slot, id, score): each anchor's k best of the rows in each of its ``slots``, bucket by bucket of falling norm.

    ``wanted(slot, scores, same_label)`` is the mask of pairs that may enter a slot; ``need`` is what the k-th best was before.
    """
    if anchors.num_rows > STEP:
        return pa.concat_tables([_scan(anchors.slice(at, STEP), rows, width, slots, k, wanted) for at in range(0, anchors.num_rows, STEP)])
    rows = rows.take(np.lexsort((rows.column("id").to_numpy(), -rows.column("norm").to_numpy())))
    a, b = unpacked(anchors.column("q"), np.int32, width), unpacked(rows.column("q"), np.int32, width)
    ids, norms, own, own_norm = rows.column("id").to_numpy(), rows.column("norm").to_numpy(), anchors.column("id").to_numpy(), anchors.column("norm").to_numpy()
    _, labels = np.unique(np.concatenate([anchors.column("label").to_numpy(zero_copy_only=False), rows.column("label").to_numpy(zero_copy_only=False)]).astype(str), return_inverse=True)
    own_label, label = labels[: len(a)], labels[len(a) :]
    need = np.array(anchors.column("needs").to_pylist(), np.float64).reshape(-1, slots)  # grows as better rows are found
    held = [np.zeros((3, 0), np.int64) for _ in range(slots)]  # anchor, score, id
    for at in range(0, len(ids), BUCKET):
        live = np.flatnonzero(own_norm * norms[at] >= need.min(1))
        if not len(live):
            break  # no later bucket is longer
        scores = products(a[live], b[at : at + BUCKET])
        other = own[live][:, None] != ids[None, at : at + BUCKET]
        same = own_label[live][:, None] == label[None, at : at + BUCKET]
        for s in range(slots):
            i, j = np.nonzero(wanted(anchors, live, s, scores, same) & other & (scores >= need[live, s][:, None]))
            if not len(i):
                continue
            who, score, who_id = np.concatenate([held[s], np.stack([live[i], scores[i, j], ids[at + j]])], axis=1)
            order = np.lexsort((who_id, -score, who))
            order = order[first_per(who[order], k)]
            held[s] = np.stack([who[order], score[order], who_id[order]])
            count = np.bincount(who[order], minlength=len(a))
            last = np.cumsum(count) - 1
            full = count == k
            need[full, s] = np.maximum(need[full, s], held[s][1][last[full]])
    no = anchors.column("no").to_numpy()
    who, score, who_id = np.concatenate(held, axis=1)
    slot = np.repeat(np.arange(slots), [h.shape[1] for h in held])
    return pa.table({"no": pa.array(no[who], pa.int64()), "slot": pa.array(slot, pa.int32()), "id": pa.array(who_id, pa.int64()), "score": pa.array(score, pa.int64())})


def _best(found: DataFrame, k: int, tag: str) -> DataFrame:
    """(no, slot, rank from 1, id, score), written: the k best of each anchor and slot."""
    order = Window.partitionBy("no", "slot").orderBy(F.desc("score"), "id")
    return materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), tag)


def search(anchors: DataFrame, rows: DataFrame, width: int, slots: int, k: int, wanted) -> DataFrame:
    """The k best rows of each anchor (no, id, label, q, norm, needs: a lower limit for each slot) in each slot, written."""
    tops = [(r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max("norm").alias("top")).orderBy(F.desc("top"), "range").collect()]  # a row a range
    blocks = _dealt(anchors.count(), 8, BLOCK)

    def scanned(anchors: DataFrame, tops: list) -> DataFrame:
        left, right = _cells(anchors.withColumn("need", F.array_min("needs")), rows, tops, blocks)
        both = left.groupBy("range", "block").cogroup(right.groupBy("range", "block"))
        return both.applyInArrow(lambda a, b: _scan(a, b, width, slots, k, wanted), "no long, slot int, id long, score long")

    first = _best(scanned(anchors, tops[:1]), k, "negatives-first") if tops else None
    if len(tops) < 2:
        return first
    slot = lambda s: F.coalesce(F.max(F.when((F.col("slot") == s) & (F.col("rank") == k), F.col("score").cast("double"))), F.lit(float("-inf")))
    kth = first.groupBy("no").agg(F.array(*[slot(s) for s in range(slots)]).alias("kth"))
    closer = anchors.join(kth, "no", "left").withColumn("needs", F.when(F.col("kth").isNull(), F.col("needs")).otherwise(F.zip_with("needs", "kth", lambda x, y: F.greatest(x, y)))).drop("kth")
    rest = scanned(closer, tops[1:])
    out = _best(first.select("no", "slot", "id", "score").unionByName(rest), k, "negatives-best")
    release(first)
    return out


def _same_label(anchors, live, slot, scores, same):
    return same


def _in_window(anchors, live, slot, scores, same):
    """Other labels' rows of a score at or below the window's upper limit; the lower one is in ``needs``."""
    high = np.array(anchors.column("highs").to_pylist(), np.float64)[live, slot]
    return ~same & (scores <= high[:, None])


def hard_negatives(
    vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (vec_id, label, embedding).

    ``anchor`` is a condition on vec_id. An anchor's positives are its best rows of the same label; a positive's negatives are
    the best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    width = max(1, longest(vectors))
    rows = rows_by_norm(vectors, scale, width)
    anchors = rows.withColumnRenamed("id", "vec_id").filter(anchor).withColumnRenamed("vec_id", "id").drop("range")
    anchors = materialize(anchors.dropDuplicates(["id", "label", "q"]).withColumn("no", F.monotonically_increasing_id()), "negatives-anchors")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if anchors.isEmpty():
        return vectors.sparkSession.createDataFrame([], empty)
    near = search(anchors.withColumn("needs", F.array(F.lit(float("-inf")))), rows, width, 1, positives, _same_label)
    by = near.select("no", F.struct("rank", "id", "score").alias("p")).groupBy("no").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # ``positives`` at most
    windows = materialize(_windows(anchors.join(by, "no"), low, high, positives), "negatives-windows")
    found = search(windows.drop("ps"), rows, width, positives, negatives, _in_window)
    named = found.join(windows.select("no", F.col("id").alias("anchor_id"), "ps"), "no").withColumn("p", F.get("ps", F.col("slot")))
    return named.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def _windows(anchors: DataFrame, low: int, high: int, positives: int) -> DataFrame:
    """``needs`` and ``highs``: ceil(low * score / 100) and floor(high * score / 100) of each positive, in whole numbers.

    Where a window is empty, or there is no such positive, nothing enters.
    """
    score, percent = lambda s: F.get("ps", s)["score"], F.lit(100)
    up = lambda x: ((x + F.pmod(-x, percent)) / 100).cast("double")
    down = lambda x: ((x - F.pmod(x, percent)) / 100).cast("double")
    places = F.sequence(F.lit(0), F.lit(positives - 1))
    needs = F.transform(places, lambda s: F.coalesce(up(score(s) * low), F.lit(float("inf"))))
    highs = F.transform(places, lambda s: F.coalesce(down(score(s) * high), F.lit(float("-inf"))))
    return anchors.withColumn("needs", needs).withColumn("highs", highs)
