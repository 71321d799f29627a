"""The event lake: schema, wire format, reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce

# The columns of a lake event, in their order. All are nullable.
_COLUMNS = """
    event_timestamp string,
    event_date string,
    event_type string,
    dataset string,
    cf_continent string,
    cf_country string,
    cf_city string,
    cf_region string,
    cf_latitude double,
    cf_longitude double,
    cf_timezone string,
    duration double,
    request_length long,
    status int,
    ip string,
    is_stream boolean,
    session string,
    request string,
    client string,
    user_agent string,
    model string,
    model_tier string,
    model_variant string,
    source string,
    provider string,
    provider_model string,
    llm_error_code int,
    llm_error_message string,
    error_response string,
    error_type string,
    error_message string,
    error_cause string,
    error_cause2 string,
    api_key string,
    workspace string,
    user_id string,
    is_subscription boolean,
    subscription string,
    response_length long,
    time_to_first_byte long,
    timestamp_first_byte long,
    timestamp_last_byte long,
    tokens_input long,
    tokens_output long,
    tokens_reasoning long,
    tokens_cache_read long,
    tokens_cache_write_5m long,
    tokens_cache_write_1h long,
    cost_input_microcents long,
    cost_output_microcents long,
    cost_cache_read_microcents long,
    cost_cache_write_microcents long,
    cost_total_microcents long,
    cost_input long,
    cost_output long,
    cost_cache_read long,
    cost_cache_write_5m long,
    cost_cache_write_1h long,
    cost_total long
"""
#: Beside them, the network part of the address, which the ingest service adds.
_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
SCHEMA = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in f"{_COLUMNS}, ip_prefix string".split(","))])


def events(spark: SparkSession, path: str) -> DataFrame:
    """The lake's Parquet files; a partition column event_date keeps its text form."""
    return spark.read.schema(SCHEMA).parquet(path)


def typed_fields(rows: DataFrame, fields: str, *keep: str) -> DataFrame:
    """``keep`` and the columns of the schema from a map of texts: loosely typed, a wrong type gives null.

    The texts are taken out first, as a typed expression names its text several times.
    """
    out = []
    for f in SCHEMA.fields:
        raw = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            v = coerce.loose_double(raw)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            v = coerce.loose_long(raw).cast(f.dataType)
        elif isinstance(f.dataType, T.BooleanType):
            v = coerce.loose_boolean(raw)
        else:
            v = raw
        out.append(v.alias(f.name))
    raw = rows.select(*keep, *[F.try_element_at(fields, F.lit(f.name)).alias(f.name) for f in SCHEMA.fields])
    return raw.select(*keep, *out)


def wire_events(batches: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON bodies ``{"events": [...]}``: a row for each, with ``lake_key`` and the typed columns."""
    items = F.from_json(F.get_json_object(column, "$.events"), "array<string>")
    own = batches.select(F.explode(items).alias("e")).select(F.from_json("e", "map<string,string>").alias("m"))
    typed = typed_fields(own.select("m", F.try_element_at("m", F.lit("_datalake_key")).alias("lake_key")), "m", "lake_key")
    return typed.withColumn("ip_prefix", F.coalesce("ip_prefix", coerce.ip_prefix(F.col("ip"))))


def metric_lines(lines: DataFrame, prefix: str = "_metric:", column: str = "value") -> DataFrame:
    """Log lines that carry a metric: the JSON after the prefix as a map of texts. Broken JSON gives no row."""
    own = lines.filter(F.col(column).startswith(prefix))
    return own.select(F.from_json(F.substr(F.col(column), F.lit(len(prefix) + 1)), "map<string,string>", {"mode": "PERMISSIVE"}).alias("fields")).filter("fields is not null")


def scoped(requests: DataFrame, path: str, allowed: dict[str, bool]) -> DataFrame:
    """Requests to allowed paths: exactly, or below them where the value is true."""
    keep = F.lit(False)
    for p, below in allowed.items():
        keep = keep | (F.col(path) == p) | (F.col(path).startswith(p.rstrip("/") + "/") if below else F.lit(False))
    return requests.filter(keep)


def routed(rows: DataFrame, routes: list[str], key: str = "lake_key") -> DataFrame:
    """``database`` and ``table`` of each row's key; any row without a known route refuses the batch."""
    known = F.col(key).rlike(r"^[A-Za-z0-9_]+\.[A-Za-z0-9_]+$") & F.col(key).isin(*routes)
    checked = F.when(known, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no route for "), F.coalesce(key, F.lit("(none)")))))
    return rows.withColumn(key, checked).withColumns({"database": F.split_part(key, F.lit("."), F.lit(1)), "table": F.split_part(key, F.lit("."), F.lit(2))})


def quarantined(rows: DataFrame, routes: list[str], key: str = "lake_key") -> tuple[DataFrame, DataFrame]:
    """(routed rows, the others), for a sink that must not refuse a batch."""
    known = F.coalesce(F.col(key).isin(*routes), F.lit(False))
    return routed(rows.filter(known), routes, key), rows.filter(~known)
