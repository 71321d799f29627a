"""Keyed state of streams: usage that is taken back, counters that expire, buffers with a bound. All need the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import by_value

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retracted(StatefulProcessor):
    """State of a session: the number and tokens of each message's newest version, and their sum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", "message string", "seq long, tokens long")
        self.total = handle.getValueState("total", "tokens long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        delta = 0
        for part in rows:
            part = part.sort_values("seq").drop_duplicates("message_id", keep="last")  # a read of state a message, not a version
            for message, seq, tokens in zip(part["message_id"].tolist(), part["seq"].tolist(), part["tokens"].tolist()):
                before = self.newest.getValue((message,)) or (-1, 0)
                if seq > before[0]:
                    self.newest.updateValue((message,), (seq, tokens))
                    delta += tokens - before[1]
        total = (self.total.get()[0] if self.total.exists() else 0) + delta
        self.total.update((total,))
        yield pd.DataFrame({"session_id": [key[0]], "delta": [delta], "tokens": [total]})

    def close(self) -> None:
        pass


def retracted(stream: DataFrame) -> DataFrame:
    """(session_id, delta, tokens) after each batch of rows (session_id, message_id, seq, tokens, removed).

    A message's newest version by ``seq`` counts, whenever it comes: it takes the older one's tokens back and adds its own; a
    removed message (or null tokens) counts nothing, and an older version that comes later changes nothing. The deltas of
    all batches add up to the sum over the newest versions. The state holds a number a message, removed ones too.
    """
    own = stream.select("session_id", F.col("message_id").cast("string").alias("message_id"), F.col("seq").cast("long").alias("seq"), F.when(F.coalesce("removed", F.lit(False)), 0).otherwise(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    return own.groupBy("session_id").transformWithStateInPandas(Retracted(), "session_id string, delta long, tokens long", "Append", "None")


#: Milliseconds of a counter's interval, and how long it is kept after the interval's end.
KEPT = {"minute": (60_000, 60_000), "two minutes": (60_000, 120_000), "day": (86_400_000, 0)}


class Expiring(StatefulProcessor):
    """State of a key: a count for each open interval, each with a timer of event time that takes it away."""

    def __init__(self, length_ms: int, kept_ms: int, limit: int):
        self.length_ms, self.kept_ms, self.limit = length_ms, kept_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start_ms long", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            for start, n in (part["at_ms"] // self.length_ms * self.length_ms).value_counts().items():
                before = (self.counts.getValue((int(start),)) or (0,))[0]
                if not before:
                    self.handle.registerTimer(int(start) + self.length_ms + self.kept_ms)
                self.counts.updateValue((int(start),), (before + int(n),))
                if before < self.limit <= before + n:
                    out.append((key[0], int(start), before + int(n), "limited"))
        yield _counted(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.length_ms - self.kept_ms
        n = self.counts.getValue((start,))[0]
        self.counts.removeKey((start,))
        yield _counted([(key[0], start, n, "final")])

    def close(self) -> None:
        pass


def _counted(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "start_ms", "n", "kind"])
    return out.astype({"key": "object", "start_ms": "int64", "n": "int64", "kind": "object"})


def expiring_counts(stream: DataFrame, key: str, ts: str, kept: str = "minute", limit: int = 1000, lateness: str = "5 minutes") -> DataFrame:
    """(key, start_ms, n, kind) of requests counted by key and interval.

    ``kind`` is limited, once, in the batch in which the count reaches ``limit``, and final when the watermark passes the
    interval's end and the time it is kept: the count then is that of the interval's batch, and its state is gone.
    """
    own = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    own = own.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_millis(ts).alias("at_ms"))
    return own.groupBy("key").transformWithStateInPandas(Expiring(*KEPT[kept], limit), "key string, start_ms long, n long, kind string", "Append", "EventTime")


class Buffered(StatefulProcessor):
    """State of a subscriber: what it has not taken yet, when it takes next, and whether its buffer has overflown."""

    def __init__(self, capacity: int, every_ms: int):
        self.capacity, self.every_ms = capacity, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id string")
        self.mark = handle.getValueState("mark", "due long, failed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due, failed = self.mark.get() if self.mark.exists() else (-1, False)
        waiting, out, timer = [x[0] for x in self.waiting.get()] if self.waiting.exists() else [], [], due
        for part in rows:
            for at, event in sorted(zip(part["at_ms"].tolist(), part["event_id"].tolist())):
                if 0 <= due <= at:  # the timer was due before this event
                    out += [(key[0], e, "delivered") for e in waiting]
                    waiting, due = [], -1
                if failed:
                    continue
                if len(waiting) == self.capacity:
                    failed = True
                    out.append((key[0], event, "overflow"))
                    continue
                waiting.append(event)
                if due < 0:
                    due = at + self.every_ms
        self._keep(waiting, due, failed, timer)
        yield pd.DataFrame(out, columns=["subscriber", "event_id", "outcome"], dtype="object")

    def _keep(self, waiting: list[str], due: int, failed: bool, timer: int) -> None:
        if waiting:
            self.waiting.put([(e,) for e in waiting])
        else:
            self.waiting.clear()
        self.mark.update((due, failed))
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due, failed = self.mark.get()
        waiting = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.mark.update((-1, failed))
        yield pd.DataFrame([(key[0], e, "delivered") for e in waiting], columns=["subscriber", "event_id", "outcome"], dtype="object")

    def close(self) -> None:
        pass


def bounded_buffers(stream: DataFrame, capacity: int = 256, every_ms: int = 1000, lateness: str = "1 minute") -> DataFrame:
    """(subscriber, event_id, outcome) of rows (subscriber, event_id, ts) offered to subscribers with a buffer each.

    A subscriber takes all that waits ``every_ms`` of event time after the first of it came. An event that finds the buffer
    full is the subscriber's ``overflow``: it gets what is in the buffer and nothing after, other subscribers are not touched.
    """
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    own = own.select(F.col("subscriber").cast("string").alias("subscriber"), F.col("event_id").cast("string").alias("event_id"), "ts", F.unix_millis("ts").alias("at_ms"))
    return own.groupBy("subscriber").transformWithStateInPandas(Buffered(capacity, every_ms), "subscriber string, event_id string, outcome string", "Append", "EventTime")


by_value(__name__)
