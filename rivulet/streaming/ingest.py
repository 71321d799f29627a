"""Streaming jobs: append to the lake, keep rollups fresh, coalesce writes. The event log's are in :mod:`log`."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import lake, sinks


def append_lake(stream: DataFrame, path: str, errors: str, checkpoint: str, routes: list[str], every: str | None = "60 seconds") -> StreamingQuery:
    """Wire events to the lake, once a minute; what has no route goes to a folder of errors. ``every`` None: all there is, then stop.

    Files carry the checkpoint's and the batch's name, so a batch that is tried again replaces what it wrote.
    """
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        rows = lake.wire_events(batch).persist()
        good, bad = lake.quarantined(rows, routes)
        name = f"{query}-{number}"
        sinks.append_once(good.drop("lake_key"), path, name, ("database", "table", "event_date"))
        bad.write.mode("overwrite").json(f"{errors}/write_batch={name}")
        rows.unpersist()

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def lag_floor(now: datetime, minutes: int = 5) -> datetime:
    """The instant up to which events are taken as complete: some minutes ago, on a whole minute."""
    return (now - timedelta(minutes=minutes)).replace(second=0, microsecond=0)


def incremental_start(now: datetime, back_hours: int = 2) -> datetime:
    """Monday of the ISO week that holds an instant some hours ago: late rows are counted by doing the open week again."""
    at = now - timedelta(hours=back_hours)
    day = datetime(at.year, at.month, at.day, tzinfo=at.tzinfo)
    return day - timedelta(days=day.weekday())


def full_start(now: datetime, data_start: datetime, days: int = 56) -> datetime:
    """Start of a full pass: so many days back, on a day's start, not before the data."""
    at = now - timedelta(days=days)
    return max(data_start, datetime(at.year, at.month, at.day, tzinfo=at.tzinfo))


def is_full(now: datetime, last: datetime | None) -> bool:
    """The first pass of a UTC day is a full one."""
    return last is None or last.astimezone(timezone.utc).date() < now.astimezone(timezone.utc).date()


def refresh(path: str, now: datetime, last: datetime | None, data_start: datetime, compute: Callable[[datetime, datetime], DataFrame], keys: list[str]) -> tuple[datetime, datetime]:
    """One pass of the hourly job: rollups of a period computed again and put in place of those that are there.

    The first pass of a UTC day goes back as far as :func:`full_start`, the others to the open week; both end some minutes
    ago. ``compute`` gives the rows (grain, period_key, the other keys, values) of whole periods from start to end. Late
    events are so counted by doing their periods again, and a pass that is run twice changes nothing. Gives the bounds;
    ``now`` is the next pass's ``last``.
    """
    start, end = full_start(now, data_start) if is_full(now, last) else max(data_start, incremental_start(now)), lag_floor(now)
    sinks.upsert(compute(start, end), path, keys)
    return start, end


def coalesced(stream: DataFrame, keys: list[str], order: str, write: Callable[[DataFrame], None], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Micro-batches reduced to the last row of each key."""
    from ..operators.analytics import latest

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(latest(batch, keys, [order])))
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def once(stream: DataFrame, ident: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Replayed events dropped by id, within the lateness."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([ident])


def with_heartbeat(stream: DataFrame, seconds: int = 15) -> DataFrame:
    """A stream of (type, data) with a row of type "heartbeat" every some seconds."""
    beat = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % seconds == 0)
    return stream.select("type", "data").unionByName(beat.select(F.lit("heartbeat").alias("type"), F.lit(None).cast("string").alias("data")))
