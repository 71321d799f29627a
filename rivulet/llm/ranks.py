"""Row numbers over a whole table, or within groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def ranked(df: DataFrame, order: list[str], group: str | None = None, name: str = "rank", tag: str = "ranked") -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``name``: the 0-based position within ``group``, or in the table, ordered by ``order``; sizes by group).

    Rows are range-partitioned by (group, order), so a hot group spans many tasks; a row's position is its place in its
    partition plus the rows of its group in earlier partitions. Those counts are one row for each partition and group
    that meet, at most partitions + groups. Ordering columns must be named ``order``; rows equal in all of them may
    come in either order, which is then settled once by writing the numbered table.
    """
    keys = [*([group] if group else []), *order]
    numbered = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), tag)
    part: Column = F.shiftright("__at", 33)
    by = [F.col(group).alias("__group")] if group else [F.lit(0).alias("__group")]
    counts = numbered.groupBy(part.alias("__part"), *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sizes = counts.groupBy("__group").agg(F.sum("__n").alias("__size"))
    left = numbered.withColumn("__part", part).withColumn("__group", by[0])
    joined = left.alias("l").join(counts.alias("r"), (F.col("l.__part") == F.col("r.__part")) & F.col("l.__group").eqNullSafe(F.col("r.__group")))
    out = joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("r.__before") + F.col("l.__at") - F.col("r.__first")).alias(name))
    return out, sizes
