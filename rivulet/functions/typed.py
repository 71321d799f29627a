"""User functions with declared input and output types, as polymorphic table functions.

A function is registered for SQL under a name: ``SELECT * FROM name(TABLE(...))``. Its input is checked when the query is
analysed, before anything runs: the table must have each declared column with the declared type (other columns are passed
over). Each row it returns is checked against the declared output when it is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Types of a JSON Schema as SQL types; what is not told is text.
_JSON_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "null": "void"}


def json_schema_type(schema: dict) -> str:
    """The SQL type of a JSON Schema: objects with properties are structs, arrays arrays, anything else untold is text."""
    kind = schema.get("type")
    if kind == "object" and schema.get("properties"):
        return "struct<" + ", ".join(f"`{k}`: {json_schema_type(v)}" for k, v in schema["properties"].items()) + ">"
    if kind == "array":
        return f"array<{json_schema_type(schema.get('items', {}))}>"
    return _JSON_TYPES.get(kind if isinstance(kind, str) else "", "string")


def json_schema_columns(schema: dict) -> str:
    """The properties of an object's JSON Schema as columns."""
    return ", ".join(f"`{k}` {json_schema_type(v)}" for k, v in schema.get("properties", {}).items())


def register(spark: SparkSession, name: str, inputs: str, outputs: str, run: Callable[[dict], Iterable[dict]], key: tuple[str, ...] = (), start: Callable[[], Callable[[dict], Iterable[dict]]] | None = None) -> None:
    """Register ``run``, which makes rows of ``outputs`` from a row of ``inputs`` (both in SQL's column syntax).

    With ``key`` the rows of a key come to one call of ``start`` after another, whose result takes the place of ``run``
    and may keep something between them (a state of bounded size: a key's rows are not gathered, but pass by).
    """
    wanted, given = T._parse_datatype_string(inputs), T._parse_datatype_string(outputs)
    spark.udtf.register(name, _table_function(name, wanted, given, run, tuple(key), start))


def _table_function(name: str, wanted: T.StructType, given: T.StructType, run, key: tuple[str, ...], start):
    from pyspark.sql.functions import AnalyzeResult, PartitioningColumn, udtf

    class Function:
        @staticmethod
        def analyze(table):
            if not table.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(...))")
            found = {f.name: f.dataType for f in table.dataType.fields}
            for f in wanted.fields:
                if f.name not in found:
                    raise ValueError(f"{name} needs a column {f.name} of type {f.dataType.simpleString()}")
                if found[f.name] != f.dataType:
                    raise ValueError(f"{name} needs {f.name} as {f.dataType.simpleString()}, not {found[f.name].simpleString()}")
            return AnalyzeResult(schema=given, partitionBy=[PartitioningColumn(k) for k in key])

        def __init__(self):
            self.run, self.at = (start() if start else run), None

        def eval(self, row):
            if start and key:
                at = tuple(row[k] for k in key)
                if at != self.at:
                    self.run, self.at = start(), at
            for out in self.run({f.name: row[f.name] for f in wanted.fields}):
                extra = out.keys() - {f.name for f in given.fields}
                missing = [f.name for f in given.fields if f.name not in out]
                if extra or missing:
                    raise ValueError(f"{name} gave {sorted(extra)} beyond and lacks {missing} of its declared columns")
                yield tuple(out[f.name] for f in given.fields)

    return udtf(Function)
