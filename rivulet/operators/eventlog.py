"""The durable event log: ordered reads, validation of sequences and replays, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import latest


def read_after(log: DataFrame, aggregate: str, after: int = -1, limit: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Events of an aggregate after an exclusive cursor, in order; one more than the limit is read, and ``has_more`` tells of it."""
    own = log.filter((F.col("aggregate_id") == aggregate) & (F.col("seq") > after))
    if types is not None:
        own = own.filter(F.col("type").isin(*types))
    if limit is None:
        return own.orderBy("seq").withColumn("has_more", F.lit(False))
    more = own.orderBy("seq").limit(limit + 1)
    return more.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit).orderBy("seq").limit(limit)  # limit + 1 rows


def incoming(log: DataFrame, batch: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Classify a batch of replayed events against the log.

    ``verdict``: replay (same id, type and data at that number, in the log or before in the batch: nothing to do),
    divergent (something else is there), foreign (the aggregate has another owner), gap (it would not follow the last
    number) or append.
    """
    known = log.select("aggregate_id", "seq", F.struct("id", "type", "data").alias("__old"))
    heads = log.groupBy("aggregate_id").agg(F.max("seq").alias("__head"))
    own = batch.join(known, ["aggregate_id", "seq"], "left").join(heads, "aggregate_id", "left").withColumn("__head", F.coalesce("__head", F.lit(-1)))
    # Of events of the batch at one number the first counts; an equal one after it is a replay, another one diverges.
    place = Window.partitionBy("aggregate_id", "seq").orderBy("id", "type", "data")
    mine = F.struct("id", "type", "data")
    own = own.withColumn("__first", F.first(mine).over(place)).withColumn("__no", F.row_number().over(place))
    own = own.withColumn("__old", F.coalesce("__old", F.when(F.col("__no") > 1, F.col("__first"))))
    order = Window.partitionBy("aggregate_id").orderBy("seq", "__no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = (F.col("seq") > F.col("__head")) & (F.col("__no") == 1)
    expected = F.col("__head") + F.sum(fresh.cast("int")).over(order)
    out = F.when(F.col("__old") == F.struct("id", "type", "data"), "replay").when(F.col("__old").isNotNull(), "divergent").when(F.col("seq") != expected, "gap").otherwise("append")
    if owners is not None:
        mine = owners.select("aggregate_id", F.col("owner_id").alias("__owner"))
        own = own.join(mine, "aggregate_id", "left")
        out = F.when(F.col("__owner").isNotNull() & ~F.col("__owner").eqNullSafe(F.col("owner_id")), "foreign").otherwise(out)
    return own.withColumn("verdict", out).drop("__old", "__head", "__owner", "__first", "__no")


def append(log: DataFrame, batch: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """The log with a batch; raises if any event is divergent, foreign or leaves a gap (the whole batch is refused)."""
    checked = incoming(log, batch, owners)
    bad = F.col("verdict").isin("divergent", "foreign", "gap")
    guarded = checked.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("refused event "), F.col("id"), F.lit(": "), F.col("verdict")))).otherwise(F.col("id")))
    return log.unionByName(guarded.filter((F.col("verdict") == "append") | bad).select(*log.columns))


def project(log: DataFrame, key: str, deletes: list[str], fields: dict[str, Column]) -> DataFrame:
    """Fold events into rows: each field takes its last non-null value by sequence number; keys whose last event is a deletion go."""
    last = log.groupBy(key).agg(F.max_by("type", "seq").alias("__last"), F.max("seq").alias("seq"), *[F.max_by(c, F.when(c.isNotNull(), F.col("seq"))).alias(n) for n, c in fields.items()])
    return last.filter(~F.col("__last").isin(*deletes)).drop("__last")


def snapshot_and_log(snapshot: DataFrame, log: DataFrame, keys: list[str], at: str = "seq") -> DataFrame:
    """A snapshot brought up to date with the newer rows of a log."""
    return latest(snapshot.unionByName(log.select(*snapshot.columns)), keys, [at])


def compacted(log: DataFrame, keys: list[str], at: str = "seq") -> DataFrame:
    """A log with one row for each key, its last."""
    return latest(log, keys, [at])
