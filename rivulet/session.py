"""Session factory: one place for the settings that results depend on (UTC, ANSI) and those that plans depend on (AQE)."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings of every session; partition counts are left to the cluster and to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rivulet", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each Spark context, so that their workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_rivulet_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="rivulet-code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "rivulet.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(path))
    context._rivulet_shipped = True


def by_value(module: str) -> None:
    """Send a module's classes to Python workers whole, for those on the driver that run streams and don't get its shipped code."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder that the driver and all executors share: below ``spark.checkpoint.dir``, or, on one machine without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rivulet-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a shared folder and read back: cuts the lineage of an iteration, and outlives lost executors. Deleted when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._rivulet_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete :func:`written` tables from which nothing will be read again."""
    for table in tables:
        _delete(table.sparkSession, table._rivulet_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the cluster owns its folder
        pass


def cut(df: DataFrame) -> DataFrame:
    """One round of an iteration, written, so that the next does not compute it again."""
    return written(df, "round")
