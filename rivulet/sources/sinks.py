"""Writers: append, upsert by period, insert-ignore, counters, retirement, CSV and JSON."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import latest


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("event_date",)) -> None:
    """Append to a partitioned table. Rows of a partition value are brought together, split by size where there are many."""
    df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def append_once(df: DataFrame, path: str, batch: str, partition_by: tuple[str, ...] = ("event_date",)) -> None:
    """Append under the name of a batch (the partition column ``write_batch``): the same batch written again replaces itself."""
    own = df.withColumn("write_batch", F.lit(batch)).hint("rebalance", *partition_by)
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by, "write_batch").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert(df: DataFrame, path: str, keys: list[str], periods: tuple[str, ...] = ("grain", "period_key")) -> None:
    """Replace rows of equal keys and keep the others, rewriting the touched periods only.

    The new content of those periods is written beside the table before it replaces them, as a table can't be
    overwritten while it is read.
    """
    spark = df.sparkSession
    new = latest(df.withColumn("__at", F.lit(1)), keys, ["__at"])
    if exists(spark, path):
        old = spark.read.schema(df.schema).parquet(path).join(df.select(*periods).distinct(), list(periods), "left_semi").withColumn("__at", F.lit(0))
        new = latest(old.unionByName(new), keys, ["__at"])
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    columns = [c for c in df.columns if c not in periods] + list(periods)
    new.select(*columns).write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*periods).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key does not exist yet, one a key."""
    return latest(new.withColumn("__n", F.lit(0)), keys, ["__n"]).drop("__n").join(existing.select(*keys), keys, "left_anti")


def added(existing: DataFrame, new: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters with the new amounts added."""
    return existing.select(*keys, *counters).unionByName(new.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def merged(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update by key: new rows win."""
    return latest(existing.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1))), keys, ["__at"]).drop("__at")


def retired(df: DataFrame, dimensions: dict[str, list[str]], within: Column) -> DataFrame:
    """The table without rows of retired dimension values inside a scope."""
    gone = reduce(lambda a, b: a | b, [F.lower(c).isin(*[v.lower() for v in values]) for c, values in dimensions.items()])
    return df.filter(~(within & F.coalesce(gone, F.lit(False))))


def csv(df: DataFrame, path: str) -> None:
    """CSV with a head; a cell with a comma, quote or line break is quoted, quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(path)


def json(df: DataFrame, path: str, masked: tuple[str, ...] = (), mask: str = "[redacted]") -> None:
    df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mask)) for c in masked}).write.mode("overwrite").json(path)


def migrate(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns (type, default) that are missing are added; applying it again changes nothing."""
    return df.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in df.columns})
