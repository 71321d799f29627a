"""Registered projectors: one stream of events, routed by type to folds with progress of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .replay import typed

Fold = Callable[[DataFrame, int], None]


class ProjectionError(RuntimeError):
    """Some projectors failed on a batch; the others have it behind them."""


@dataclass
class Projector:
    name: str
    types: tuple[str, ...]
    fold: Fold


class Projectors:
    """Folds by event type. The number of the last batch that a projector has finished is an empty file below ``progress``.

    A batch is read once and given to each projector that has not finished it, restricted to its types (none: all). If one
    fails, the others still get the batch, and the query then stops with a :class:`ProjectionError`; started again on the same
    checkpoint it gets the same batch, and only the failed ones do it again. A driver that dies between a fold and its
    mark repeats that one fold, so a fold should give the same when it is done twice, as an upsert by number does.
    """

    def __init__(self, progress: str):
        self.progress = progress.rstrip("/")
        self.projectors: list[Projector] = []

    def register(self, name: str, types: list[str], fold: Fold) -> None:
        if any(p.name == name for p in self.projectors):
            raise ValueError(f"there is a projector {name} already")
        self.projectors.append(Projector(name, tuple(types), fold))

    def finished(self, spark: SparkSession, name: str) -> int:
        """The last batch that a projector has behind it; -1 if there is none."""
        store, at = self._folder(spark, name)
        return max((int(f.getPath().getName()) for f in store.listStatus(at)), default=-1) if store.exists(at) else -1

    def _folder(self, spark: SparkSession, name: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.progress}/{name}")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _mark(self, spark: SparkSession, name: str, number: int) -> None:
        store, at = self._folder(spark, name)
        store.create(spark._jvm.org.apache.hadoop.fs.Path(at, str(number)), True).close()
        for f in store.listStatus(at):
            if int(f.getPath().getName()) < number:
                store.delete(f.getPath(), False)

    def apply(self, batch: DataFrame, number: int) -> None:
        spark, failed = batch.sparkSession, []
        due = [p for p in self.projectors if self.finished(spark, p.name) < number]
        rows = batch.persist() if len(due) > 1 else batch
        try:
            for p in due:
                try:
                    p.fold(typed(rows, *p.types) if p.types else rows, number)
                    self._mark(spark, p.name, number)
                except Exception as error:  # the others go on; it is raised below
                    failed.append((p.name, error))
        finally:
            if len(due) > 1:
                rows.unpersist()
        if failed:
            raise ProjectionError(f"batch {number}: " + "; ".join(f"{name}: {error}" for name, error in failed)) from failed[0][1]

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """``every`` None: all there is, then stop."""
        out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
