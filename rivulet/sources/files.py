"""File sources: JSON lines, documents, objects by prefix, Markdown tables, HTML scripts, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that are one JSON document each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def objects(spark: SparkSession, root: str, prefix: str = "", after: str | None = None, before: str | None = None, limit: int | None = None) -> DataFrame:
    """(key, content) of stored objects by prefix, in order of their keys; exclusive bounds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    key = F.regexp_replace(F.col("path"), "^.*?" + "\\Q" + base + "\\E/", "")
    own = files.select(key.alias("key"), F.col("content").cast("string").alias("content")).filter(F.col("key").startswith(prefix))
    if after is not None:
        own = own.filter(F.col("key") > after)
    if before is not None:
        own = own.filter(F.col("key") < before)
    own = own.orderBy("key")
    return own if limit is None else own.limit(limit)


def markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table, by position, without its head and rule; cells as texts, with the row's number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^[\s|:-]+$")).select("line_no", cells.alias("c"))
    head = rows.agg(F.min("line_no").alias("h"))
    return rows.crossJoin(F.broadcast(head)).filter("line_no > h").select("line_no", *[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(columns)])  # head: one row


def script_json(pages: DataFrame, html: str, script_id: str, schema: str) -> DataFrame:
    """The JSON in the script element with an id, parsed; null where it is missing or broken."""
    pattern = rf"""(?is)<script[^>]*\bid=["']{script_id}["'][^>]*>(.*?)</script>"""
    return pages.withColumn("data", F.from_json(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")), schema))


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line) of text files."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_default(df: DataFrame, column: str, default) -> DataFrame:
    """A column that an older table may lack."""
    return df if column in df.columns else df.withColumn(column, F.lit(default))
