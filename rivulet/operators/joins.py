"""Joins beyond a plain equi-join: fallback keys, calendars, bands, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_where(left: DataFrame, right: DataFrame, on: Column, where: Column) -> DataFrame:
    """Left join whose filter belongs to the join: a left row without such a match stays."""
    return left.join(right, on & where, "left")


def fallback(left: DataFrame, right: DataFrame, keys: list[Column], right_key: str, value: str, default: Column | None = None, name: str | None = None) -> DataFrame:
    """Look a value up by the first of several keys that has one. The lookup table must have one row a key.

    A left join for each key: small lookup tables are broadcast by size, large ones shuffled, and no row ids are needed,
    which would have to be the same when a lost task is run again.
    """
    out, found = left, []
    for i, k in enumerate(keys):
        look = right.select(F.col(right_key).cast("string").alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(look, k.cast("string") == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__v{i}"))
    if default is not None:
        found.append(default)
    return out.withColumn(name or value, F.coalesce(*found)).drop(*[f"__{x}{i}" for i in range(len(keys)) for x in "kv"])


def calendar(days: DataFrame, start: Column, end: Column, name: str = "day") -> DataFrame:
    """All days from start to end (aggregates over ``days``, one row), as dates."""
    return days.agg(start.cast("date").alias("a"), end.cast("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias(name))


def calendar_fill(facts: DataFrame, day: str, dims: list[str], values: list[str]) -> DataFrame:
    """Every day of the facts' span for every combination of dimensions that occurs; missing values are 0.

    Built from spans, not from a product of tables: each combination gets the array of days and is exploded.
    """
    span = facts.agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    grid = facts.select(*dims).distinct().crossJoin(F.broadcast(span)).select(*dims, F.explode(F.sequence("__a", "__b")).alias(day))  # span: one row
    joined = grid.join(facts, [*dims, day], "left")
    return joined.select(*dims, day, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def band(rows: DataFrame, keys: list[str], value: str, width: int, ident: str) -> DataFrame:
    """Pairs (a < b by id) of a group whose values differ by ``width`` at most.

    Values are put into bins of the width; only equal and neighbouring bins are compared, so no group meets as a whole.
    """
    left = rows.select(*keys, F.col(value).alias("a_value"), F.col(ident).alias("a_id"), F.explode(F.array(*[F.floor(F.col(value) / max(1, width)) + d for d in (-1, 0, 1)])).alias("__bin"))
    right = rows.select(*keys, F.col(value).alias("b_value"), F.col(ident).alias("b_id"), F.floor(F.col(value) / max(1, width)).alias("__bin"))
    return left.join(right, [*keys, "__bin"]).filter((F.col("a_id") < F.col("b_id")) & (F.abs(F.col("a_value") - F.col("b_value")) <= width)).drop("__bin")


def semi_or(left: DataFrame, right: DataFrame, key: str, other: Column) -> DataFrame:
    """Rows whose key is on the right, or that satisfy another predicate."""
    known = right.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    return left.join(known, F.col(key) == F.col("__k"), "left").filter(F.col("__hit").isNotNull() | other).drop("__k", "__hit")


def retained(rows: DataFrame, ident: str, parent: str, kept: Column, recent: Column) -> DataFrame:
    """Parents that are kept; children whose parent is kept, or that are recent."""
    roots = rows.filter(F.col(parent).isNull() & kept)
    ids = roots.select(F.col(ident).alias("__p"))
    children = rows.filter(F.col(parent).isNotNull())
    return roots.unionByName(children.join(ids, F.col(parent) == F.col("__p"), "left_semi")).unionByName(children.filter(recent).join(ids, F.col(parent) == F.col("__p"), "left_anti"))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """UPDATE ... FROM: columns of matching rows take the source's values. ``source`` may itself be any join of tables.

    Of source rows of one key the first in ``order`` (names; by default the columns themselves) counts, whole, so no target
    row is multiplied and no values of two rows are mixed.
    """
    first = F.min_by(F.struct(*columns), F.struct(*(order or columns), *columns)).alias("__new")
    one = source.groupBy(*keys).agg(first)
    own = one.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f"__new.{c}").alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    joined = target.join(own, on, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])
