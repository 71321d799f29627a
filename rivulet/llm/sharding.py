"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffled order; a row's fractional rank is (2 rank + 1) / (2 rows of its
source). Sorting all rows by fractional rank interleaves the sources in proportion, and cutting that order into runs of
equal length gives shards whose mixture is the table's.

Defined results: a null source is a source of its own; a null doc_id sorts first; equal rows take adjacent ranks in
either order; a null text has size 8 and the checksum of nothing; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

SHARDS, SEED = 24, "mixture-1"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, frac, position, shard and slot of every row. Shards' counts differ by one at most."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")).alias("draw"),
    )
    within, sizes = ranked(rows, ["draw", "doc_id", "text_crc32"], "source", "rank", "shard-sources")
    sized = within.alias("w").join(sizes.alias("s"), F.col("w.source").eqNullSafe(F.col("s.__group")))
    mixed = sized.select("doc_id", "source", "size", "text_crc32", "draw", ((2 * F.col("rank") + 1) / (2 * F.col("__size"))).alias("frac"))
    placed, total = ranked(mixed, ["frac", "source", "draw", "doc_id", "text_crc32"], None, "position", "shard-order")
    found = total.first()
    n = F.lit(found["__size"] if found else 1)  # one number
    cut = placed.withColumn("__n", n).withColumn("shard", F.expr(f"position * {shards} div __n"))
    first = F.expr(f"(shard * __n + {shards - 1}) div {shards}")  # the smallest position of the shard
    return cut.select("doc_id", "source", "size", "text_crc32", "frac", "position", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).cast("long").alias("slot"))
