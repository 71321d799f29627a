"""Tables for point lookups: folders by a hash of the key, each sorted by it, with Bloom filters.

A lookup of some keys reads their folders only; within a file, row groups whose least and greatest key or Bloom filter
exclude the keys are passed over. So its work follows the number of keys, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "lookup_bucket"
#: Keys of a lookup, at most; more are a join.
KEYS = 10_000


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write(df: DataFrame, path: str, key: str, buckets: int = 256, row_group: int = 16 << 20) -> None:
    """Choose ``buckets`` for files of some 100 MB. A bucket with very many rows is several tasks' and files'."""
    own = df.withColumn(BUCKET, _bucket(F.col(key), buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key)
    out = own.write.mode("overwrite").partitionBy(BUCKET).option("parquet.block.size", row_group)
    out.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, keys: list, buckets: int = 256) -> DataFrame:
    """The rows of some keys (null finds nothing); ``buckets`` as written."""
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) > KEYS:
        raise ValueError(f"more than {KEYS} keys: join with the table instead")
    table = spark.read.parquet(path)
    if not wanted:
        return table.limit(0).drop(BUCKET)
    asked = spark.createDataFrame([(k,) for k in wanted], [key]).select(F.col(key).cast(table.schema[key].dataType).alias(key))
    folders = [r[0] for r in asked.select(_bucket(F.col(key), buckets)).distinct().collect()]
    return table.filter(F.col(BUCKET).isin(folders) & F.col(key).isin(wanted)).drop(BUCKET)
