"""Windowed counters and alerts, on a batch and on a stream alike; for :func:`day_over_day` and :func:`on_change` of batches there are :func:`day_over_day_stream` and :func:`changes`."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import numbers
from ..session import by_value


def _marked(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Event time as a timestamp; on a stream, state older than the lateness is dropped."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return own.withWatermark(ts, lateness) if events.isStreaming else own


def tumbling(events: DataFrame, ts: str, keys: list[str], length: str, measures: dict[str, Column], lateness: str = "5 minutes") -> DataFrame:
    own = _marked(events, ts, lateness).groupBy(F.window(ts, length).alias("w"), *keys).agg(*[v.alias(k) for k, v in measures.items()])
    return own.select(F.col("w.start").alias("window_start"), *keys, *measures)


def sliding(events: DataFrame, ts: str, keys: list[str], length: str, every: str, measures: dict[str, Column], lateness: str = "5 minutes") -> DataFrame:
    own = _marked(events, ts, lateness).groupBy(F.window(ts, length, every).alias("w"), *keys).agg(*[v.alias(k) for k, v in measures.items()])
    return own.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *measures)


def gated(counts: DataFrame, failed: str, total: str, least: int, threshold: float) -> DataFrame:
    """``ratio`` (0 under the least sample) and ``triggered``."""
    return counts.withColumn("ratio", numbers.gated_ratio(F.col(failed), F.col(total), least)).withColumn("triggered", F.col("ratio") >= threshold)


def day_over_day(counts: DataFrame, value: str, keys: list[str], percent: float = 50.0) -> DataFrame:
    """Each window beside the one a day earlier; ``triggered`` if it fell by the percentage or more. For batches."""
    before = counts.select((F.col("window_start") + F.expr("INTERVAL 1 DAY")).alias("window_start"), *keys, F.col(value).alias("before"))
    joined = counts.join(before, ["window_start", *keys])
    drop = F.when(F.col("before") > 0, (F.col("before") - F.col(value)) / F.col("before") * 100)
    return joined.withColumn("drop_percent", drop).withColumn("triggered", F.coalesce(drop >= percent, F.lit(False)))


DAY_MS = 86_400_000


class DayBefore(StatefulProcessor):
    """State of a key: the values of its windows of the last day or so, by their start."""

    def __init__(self, percent: float, kept_ms: int):
        self.percent, self.kept_ms = percent, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "start_ms long", "value double")
        self.newest = handle.getValueState("newest", "start_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out, newest = [], self.newest.get()[0] if self.newest.exists() else -1
        for part in rows:
            for start, value in zip(part["start_ms"].tolist(), part["value"].tolist()):
                self.values.updateValue((start,), (value,))
                newest = max(newest, start)
                out += [self._compared(key, at) for at in (start, start + DAY_MS) if self.values.containsKey((at,)) and self.values.containsKey((at - DAY_MS,))]
        self.newest.update((newest,))
        for (start,) in [k for k in self.values.keys() if k[0] < newest - DAY_MS - self.kept_ms]:
            self.values.removeKey((start,))
        yield pd.DataFrame(out, columns=["key", "start_ms", "value", "before", "drop_percent", "triggered"])

    def _compared(self, key: Any, at: int) -> tuple:
        value, before = self.values.getValue((at,))[0], self.values.getValue((at - DAY_MS,))[0]
        drop = (before - value) / before * 100 if before > 0 else None
        return key[0], at, value, before, drop, drop is not None and drop >= self.percent

    def close(self) -> None:
        pass


def day_over_day_stream(counts: DataFrame, value: str, key: Column, percent: float = 50.0, kept_ms: int = 3_600_000) -> DataFrame:
    """(key, start_ms, value, before, drop_percent, triggered) of a stream's windows (window_start, ...), as :func:`day_over_day` of a batch.

    A window is compared when both it and the one a day earlier have come, in either order; windows that are more than a day
    and ``kept_ms`` older than the key's newest are forgotten. Needs the RocksDB state store.
    """
    own = counts.select(key.cast("string").alias("key"), F.unix_millis("window_start").alias("start_ms"), F.col(value).cast("double").alias("value"))
    return own.groupBy("key").transformWithStateInPandas(DayBefore(percent, kept_ms), "key string, start_ms long, value double, before double, drop_percent double, triggered boolean", "Append", "None")


def on_change(states: DataFrame, keys: list[str], order: str, state: str = "triggered") -> DataFrame:
    """Rows at which a state differs from the one before; the first only if it is triggered."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(order))
    return states.withColumn("__before", F.coalesce(before, F.lit(False))).filter(F.col(state) != F.col("__before")).drop("__before")


class Changes(StatefulProcessor):
    """State of a key: whether it was triggered at its last window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "triggered boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.before.get()[0] if self.before.exists() else False
        own = pd.concat(list(rows)).sort_values("at")
        last = [before, *own["triggered"].tolist()]
        self.before.update((last[-1],))
        yield own[[a != b for a, b in zip(last, last[1:])]][["key", "at", "triggered"]]

    def close(self) -> None:
        pass


def changes(states: DataFrame, key: Column, at: str, state: str = "triggered") -> DataFrame:
    """(key, at, triggered) of a stream at which a key's state differs from the one before, as :func:`on_change` of a batch.

    Windows must come in order, as those of a watermark in append mode do. Needs the RocksDB state store.
    """
    own = states.select(key.cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.coalesce(state, F.lit(False)).alias("triggered"))
    return own.groupBy("key").transformWithStateInPandas(Changes(), "key string, at timestamp, triggered boolean", "Append", "None")


def qualified(rows: DataFrame, goal: float) -> DataFrame:
    """Requests that say something about speed (more than ten tokens, some time between first and last byte), classified by a goal in tokens a second."""
    span = F.col("timestamp_last_byte") - F.col("timestamp_first_byte")
    return rows.filter((F.col("tokens_output") > 10) & (span > 0)).withColumn("qualifies", F.col("tokens_output") / span * 1000 >= goal)


def day_limit(counts: DataFrame, used: str, lifetime: str, limit: int) -> DataFrame:
    """A day's limit doubles while the lifetime count is below seven times the limit."""
    allowed = F.when(F.col(lifetime) < 7 * limit, 2 * limit).otherwise(limit)
    return counts.withColumn("allowed", allowed).withColumn("limited", F.col(used) >= allowed)


by_value(__name__)
