"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a temporary one of this context."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_rivulet_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.sparkContext._rivulet_dir = f"file://{tempfile.mkdtemp(prefix='rivulet-')}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the cluster owns its checkpoint folder
        pass


def materialize(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and outlives lost executors.

    With ``files`` each task writes the rows of several partitions, one after another, for fewer and larger files.
    """
    path = new_path(df.sparkSession, tag)
    (df.coalesce(files) if files else df).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._rivulet_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete written tables from which nothing will be read again."""
    for table in tables:
        _delete(table.sparkSession, table._rivulet_path)
