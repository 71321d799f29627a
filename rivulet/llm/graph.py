"""Connected components of a large graph by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: any ordered type): root is the smallest node that it reaches.

    Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond") until nothing
    changes; the number of rounds grows with the logarithm of the longest chain. A star's neighbours are never
    gathered: each round is a minimum by node, which is pre-aggregated, and a join that AQE splits where it is skewed.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), tag)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large, past = materialize(large, tag), now
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").distinct(), tag)
        release(past, large)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
