"""Durable subscriptions: the history of some aggregates after an exclusive cursor, then what is appended, as one stream.

The log is a folder of Parquet files (aggregate_id, seq, id, type, data) to which writers append. A subscription's offset is a
number for each of its aggregates, kept in the query's checkpoint, so a stop between history and live events, or in the
middle of either, leaves no gap and repeats nothing. An offset moves to the last number without a gap: files that become
visible out of turn wait for those before them. Appends between two batches wake the query once.

A subscription names its aggregates (thousands, not millions: their numbers are the offset); to follow a whole log, stream the
folder itself. Files are opened by pyarrow's file systems (shared mounts, HDFS, object stores), once each for their numbers;
slices of the log are read by the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import by_value, ship

SCHEMA = "aggregate_id string, seq long, id string, type string, data string"
FORMAT = "event_log"


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    store, at = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    names = (f.path for f in found if f.type == fs.FileType.File)
    return store, sorted(n for n in names if n.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in n.removeprefix(at).split("/")))


@dataclass
class Slice(InputPartition):
    """What a task reads: (aggregate, after, up to) of some aggregates, from the files that were there."""

    spans: list[tuple[str, int, int]]
    files: list[str]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.splits = options["path"], int(options.get("splits", 8))
        self.after = {a: int(n) for a, n in json.loads(options["after"]).items()}
        self.heads = dict(self.after)
        self.ahead: dict[str, set[int]] = {a: set() for a in self.after}  # numbers whose predecessors are not there yet
        self.known: set[str] = set()

    def initialOffset(self) -> dict:
        return dict(self.after)

    def latestOffset(self) -> dict:
        store, files = _files(self.path)
        if new := [f for f in files if f not in self.known]:
            own = ds.dataset(new, filesystem=store, format="parquet").to_table(["aggregate_id", "seq"], filter=pc.field("aggregate_id").isin(list(self.after)))
            for a, n in zip(own.column("aggregate_id").to_pylist(), own.column("seq").to_pylist()):
                if n > self.heads[a]:
                    self.ahead[a].add(n)
            for a, waiting in self.ahead.items():
                while self.heads[a] + 1 in waiting:
                    self.heads[a] += 1
                    waiting.discard(self.heads[a])
            self.known.update(new)
        return dict(self.heads)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        files = _files(self.path)[1]
        spans = [(a, int(start.get(a, n)), int(end[a])) for a, n in self.after.items() if int(end[a]) > int(start.get(a, n))]
        return [Slice(spans[i :: self.splits], files) for i in range(min(self.splits, len(spans)))]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        names = ["aggregate_id", "seq", "id", "type", "data"]
        wanted = pc.field("aggregate_id").isin([a for a, _, _ in part.spans]) & (pc.field("seq") > min(n for _, n, _ in part.spans)) & (pc.field("seq") <= max(n for _, _, n in part.spans))
        rows = ds.dataset(part.files, filesystem=store, format="parquet").to_table(names, filter=wanted)
        bounds = pa.table({"aggregate_id": [a for a, _, _ in part.spans], "after": pa.array([n for _, n, _ in part.spans], pa.int64()), "upto": pa.array([n for _, _, n in part.spans], pa.int64())})
        rows = rows.join(bounds, "aggregate_id", join_type="inner")
        rows = rows.filter((pc.field("seq") > pc.field("after")) & (pc.field("seq") <= pc.field("upto"))).select(names)
        rows = rows.sort_by([("aggregate_id", "ascending"), ("seq", "ascending"), ("id", "ascending")])
        # A number that a writer's second attempt has appended again counts once.
        keys = list(zip(rows.column("aggregate_id").to_pylist(), rows.column("seq").to_pylist()))
        rows = rows.filter(pa.array([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))], pa.bool_()))
        kinds = [(n, pa.int64() if n == "seq" else pa.string()) for n in names]
        yield from rows.cast(pa.schema(kinds)).to_batches()

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def subscribe(spark: SparkSession, path: str, after: dict[str, int], splits: int = 8) -> DataFrame:
    """The events of the aggregates in ``after`` with numbers greater than given there (-1: all), in order within an aggregate and batch."""
    ship(spark)
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).option("path", path).option("after", json.dumps(after)).option("splits", splits).load()


def typed(stream: DataFrame, *types: str) -> DataFrame:
    """The events of some types."""
    return stream.filter(stream["type"].isin(*types))


by_value(__name__)
