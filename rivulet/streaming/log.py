"""The event log as a stream: events are judged by keyed state, and what is new is folded into rows.

Both need the RocksDB state store or a table beside the stream; neither keeps a key's history in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import by_value
from ..sources import sinks


class Judge(StatefulProcessor):
    """State of an aggregate: its last number, its owner, and a digest of each event by its number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long")
        self.owner = handle.getValueState("owner", "owner string")
        self.seen = handle.getMapState("seen", "seq long", "digest string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        head = self.head.get()[0] if self.head.exists() else -1
        owner = self.owner.get()[0] if self.owner.exists() else None
        own = pd.concat(list(rows)).sort_values(["seq", "id", "digest"])
        verdicts = []
        for seq, digest, by in zip(own["seq"].tolist(), own["digest"].tolist(), own["owner_id"].tolist()):
            if owner is not None and by != owner:
                verdicts.append("foreign")
                continue
            if self.seen.containsKey((seq,)):
                verdicts.append("replay" if self.seen.getValue((seq,))[0] == digest else "divergent")
            elif seq != head + 1:
                verdicts.append("gap")
            else:
                head = seq
                self.seen.updateValue((seq,), (digest,))
                verdicts.append("append")
            if owner is None and by is not None and verdicts[-1] in ("append", "replay"):
                owner = by  # who is the first to bring an event with a name owns the aggregate
        if head >= 0:
            self.head.update((head,))
        if owner is not None:
            self.owner.update((owner,))
        yield own.assign(verdict=verdicts)[["aggregate_id", "seq", "id", "type", "data", "verdict"]]

    def close(self) -> None:
        pass


def judged(stream: DataFrame) -> DataFrame:
    """Events (aggregate_id, seq, id, type, data, and owner_id if there is one) with their verdict, against all that the stream has appended before.

    ``verdict``: foreign (the aggregate is another owner's: the first that came with an event of it), append (it follows the last number), replay (same id, type and data at that number: nothing to do),
    divergent (something else is there) or gap (nothing is recorded, so the event may come again in its turn). Of events
    of a batch at one number the first by id counts. The state holds a digest for each number of the log.
    """
    owner = F.col("owner_id").cast("string") if "owner_id" in stream.columns else F.lit(None).cast("string")
    own = stream.select("aggregate_id", owner.alias("owner_id"), F.col("seq").cast("long").alias("seq"), "id", "type", "data").withColumn("digest", F.sha2(F.to_json(F.struct("id", "type", "data")), 256))
    return own.groupBy("aggregate_id").transformWithStateInPandas(Judge(), "aggregate_id string, seq long, id string, type string, data string, verdict string", "Append", "None")


def folded(events: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, last, each field): structs of a number (``at``) and a value, the last type and each field's last value that is not null."""
    best = lambda c: F.max(F.when(c.isNotNull(), F.struct(F.col("seq").alias("at"), c.alias("value"))))
    return events.groupBy(key).agg(best(F.col("type")).alias("last"), *[best(c).alias(n) for n, c in fields.items()])


def project(stream: DataFrame, path: str, key: str, fields: dict[str, Column], checkpoint: str, buckets: int = 64, every: str | None = "10 seconds") -> StreamingQuery:
    """Keep a table of folded rows up to date with a stream of events; :func:`projection` reads it.

    A fold keeps the greatest number of each field, so a batch that is tried again, or an event that comes late or twice,
    changes nothing. Rows are spread over buckets by their key; a batch rewrites the buckets that it touches. Keys that
    are deleted stay as rows, so that a replay does not bring them back.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        new = folded(batch, key, fields).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if sinks.exists(spark, path):
            old = spark.read.schema(new.schema).parquet(path).join(new.select("bucket", key), ["bucket", key], "left_semi")
            new = old.select(*new.columns).unionByName(new).groupBy(key, "bucket").agg(*[F.max(c).alias(c) for c in ("last", *fields)])
        sinks.upsert(new, path, [key, "bucket"], ("bucket",))

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def projection(spark: SparkSession, path: str, key: str, deletes: list[str]) -> DataFrame:
    """The rows of a projected table: (key, seq, fields) of keys whose last event is no deletion."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in (key, "last", "bucket")]
    return rows.filter(~F.col("last.value").isin(*deletes)).select(key, F.col("last.at").alias("seq"), *[F.col(f"{n}.value").alias(n) for n in names])


by_value(__name__)
