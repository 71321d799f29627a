"""Queries that run streams over what is there, in parts and over restarts, with the SQL of what they come to."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..session import scratch
from ..sources import sinks
from ..sources.files import table
from ..streaming import keyed, projectors, replay

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for as long as the streams run."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, keyed.ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All there is, appended to a table; each call is a new query on the same checkpoint."""
    out = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()


def _daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of each day."""
    order = Window.partitionBy("aggregate_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("aggregate_id", dates.day_key(F.col("ts")))
    return rows.select("aggregate_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("props").alias("data"))


_DAILY = "l AS (SELECT strftime(ts, '%Y-%m-%d') AS aggregate_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS seq, CAST(event_id AS VARCHAR) AS id, event_type AS type, props AS data FROM events)"


def historical_then_live(spark, sf_dir):
    """Each day's events after its third: two thirds of them history, the rest appended, in part out of turn, while the query is down."""
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "subscribed"), scratch(spark, "checkpoint")
    log = _daily_log(spark, sf_dir)
    third = F.when(F.col("seq") % 100 < 66, 0).when(F.col("seq") % 100 < 90, 2).otherwise(1)
    days = [r[0] for r in log.select("aggregate_id").distinct().collect()]  # what is subscribed to
    for part in (0, 1, 2):
        log.filter(third == part).write.mode("append").parquet(path)
        _drain(replay.subscribe(spark, path, dict.fromkeys(days, 2)), out, checkpoint)
    return spark.read.schema(replay.SCHEMA).parquet(out).drop("data")


HISTORICAL = f"WITH {_DAILY} SELECT aggregate_id, seq, id, type FROM l WHERE seq > 2"


def retracted_usage(spark, sf_dir):
    """Each event type is a message of its user, whose newest tokens count; every other version comes late, errors remove their message."""
    path, out, checkpoint = scratch(spark, "changes"), scratch(spark, "deltas"), scratch(spark, "checkpoint")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 5).cast("string").alias("message_id"), F.row_number().over(order).cast("long").alias("seq"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_type") == "error").alias("removed"),
    )
    with rocks(spark):
        for late in (0, 1):
            rows.filter(F.col("seq") % 2 == late).write.mode("append").parquet(path)
            _drain(keyed.retracted(spark.readStream.schema(rows.schema).parquet(path)), out, checkpoint)
    return spark.read.parquet(out).groupBy("session_id").agg(F.sum("delta").alias("tokens"))


RETRACTED = """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id % 5 AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(props->>'$.k' AS BIGINT) END AS tokens FROM events),
n AS (SELECT session_id, arg_max(coalesce(tokens, 0), seq) AS tokens FROM r GROUP BY session_id, message_id) SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM n GROUP BY 1
"""


def expired_counters(spark, sf_dir):
    """Events by type and day, counted by state that ends with the day; one event of a later day makes the watermark pass the last."""
    path, out, checkpoint = scratch(spark, "requests"), scratch(spark, "counts"), scratch(spark, "checkpoint")
    rows = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).select(F.lit(None).cast("string").alias("event_type"), "ts")
    with rocks(spark):
        for part in (rows, end):
            part.write.mode("append").parquet(path)
            _drain(keyed.expiring_counts(spark.readStream.schema(rows.schema).parquet(path), "event_type", "ts", "day"), out, checkpoint)
    return spark.read.parquet(out).filter("kind = 'final' AND key IS NOT NULL").select("key", dates.day_key(F.timestamp_millis("start_ms")).alias("day"), "n")


EXPIRED = "SELECT event_type AS key, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL"


def projected_types(spark, sf_dir):
    """Three projectors over one stream; the one of purchases fails on its first batch, and alone does it again."""
    base, path, checkpoint = scratch(spark, "projected"), scratch(spark, "log"), scratch(spark, "checkpoint")
    _daily_log(spark, sf_dir).write.parquet(path)
    broken = [True]

    def fold(name):
        def write(batch: DataFrame, number: int) -> None:
            if name == "purchases" and broken:
                broken.clear()
                raise RuntimeError("not this time")
            sinks.append_once(batch.select(F.lit(name).alias("projector"), "aggregate_id", "seq", "id"), f"{base}/{name}", str(number), ())

        return write

    all_ = projectors.Projectors(f"{base}/progress")
    for name, types in (("all", []), ("purchases", ["purchase"]), ("problems", ["error", "view"])):
        all_.register(name, types, fold(name))
    stream = spark.readStream.schema(replay.SCHEMA).parquet(path)
    for _ in range(2):
        try:
            all_.start(stream, checkpoint).awaitTermination()
        except Exception as error:
            if "not this time" not in str(error):
                raise
    names = [p.name for p in all_.projectors]
    rows = [spark.read.parquet(f"{base}/{n}").select("projector", "aggregate_id", "seq", "id") for n in names]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.groupBy("projector", "aggregate_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


PROJECTED = f"WITH {_DAILY}, p AS (SELECT 'all' AS projector, * FROM l UNION ALL SELECT 'purchases', * FROM l WHERE type = 'purchase' UNION ALL SELECT 'problems', * FROM l WHERE type IN ('error', 'view')) SELECT projector, aggregate_id, count(*) AS n, max(seq) AS last FROM p GROUP BY 1, 2"


QUERIES = {"historical_then_live": (historical_then_live, HISTORICAL), "retracted_usage": (retracted_usage, RETRACTED), "expired_counters": (expired_counters, EXPIRED), "projected_types": (projected_types, PROJECTED)}
