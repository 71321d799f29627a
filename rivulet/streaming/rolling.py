"""Per-key rolling usage: a window that opens with the first use after it lapsed, as a stateful processor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import by_value


class RollingUsage(StatefulProcessor):
    """State of a key: usage of the open window (micro-cents) and when it was last updated (milliseconds).

    A use later than the window's length after the last update starts from zero, as the window has lapsed. Rows of a
    batch are taken in order of time. State expires once no use has come for the length and ``grace_ms``, by the clock of
    the machines: the grace is for a stream that falls behind, whose uses are closer together than they arrive.
    """

    def __init__(self, window_ms: int, limit: int, grace_ms: int = 86_400_000):
        self.window_ms, self.limit, self.kept_ms = window_ms, limit, window_ms + grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("usage", "usage long, updated long", self.kept_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        usage, updated = self.state.get() if self.state.exists() else (0, None)
        for t, amount in sorted(x for part in rows for x in zip(part["ts_ms"].tolist(), part["amount"].tolist())):
            usage = amount if updated is None or updated < t - self.window_ms else usage + amount
            updated = t if updated is None else max(t, updated)
        self.state.update((usage, updated))
        yield pd.DataFrame({"key": [key[0]], "usage": [usage], "updated": [updated], "limited": [usage >= self.limit]})

    def close(self) -> None:
        pass


def rolling_usage(stream: DataFrame, hours: int, limit: int) -> DataFrame:
    """(key, usage, updated, limited) after each batch, of rows (key, ts_ms, amount). Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(RollingUsage(hours * 3_600_000, limit), "key string, usage long, updated long, limited boolean", "Update", "ProcessingTime")


by_value(__name__)
