"""Pages: limits that tell whether there is more, keyset pages in both directions, opaque cursors."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after(keys: list[tuple[str, bool]], values: list, reverse: bool = False) -> Column:
    """Rows that come after (or before, if ``reverse``) a tuple in an order of (column, descending)."""
    parts, equal = [], F.lit(True)
    for (name, descending), value in zip(keys, values):
        less = descending != reverse
        parts.append(equal & (F.col(name) < F.lit(value) if less else F.col(name) > F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return reduce(lambda a, b: a | b, parts)


def ordered(rows: DataFrame, keys: list[tuple[str, bool]], reverse: bool = False) -> DataFrame:
    return rows.orderBy(*[F.col(k).desc() if d != reverse else F.col(k).asc() for k, d in keys])


def page(rows: DataFrame, keys: list[tuple[str, bool]], limit: int, cursor: list | None = None, back: bool = False) -> DataFrame:
    """A page of ``limit`` rows in display order, with ``has_more``: whether the direction goes on beyond it.

    One row more than the page is read; a top-k sort, so each task keeps limit + 1 rows.
    """
    found = rows.filter(after(keys, cursor, back)) if cursor else rows
    more = ordered(found, keys, back).limit(limit + 1)
    counted = more.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)  # limit + 1 rows
    return ordered(ordered(counted, keys, back).limit(limit), keys)


def encode_cursor(**fields) -> str:
    """URL-safe base64 of JSON."""
    return base64.urlsafe_b64encode(json.dumps(fields, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e


def cursor_column(*names: str) -> Column:
    """The cursor of each row, as a column."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(*names)).cast("binary")), "+/", "-_"), F.lit("="))


def offset_page(rows: DataFrame, keys: list[tuple[str, bool]], page_no: int, size: int) -> DataFrame:
    return ordered(rows, keys).offset(page_no * size).limit(size)
