"""Loose coercion of incoming fields, countries and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose_double(c: Column) -> Column:
    """Numbers and numeric texts; anything else, NaN and infinities give null. An empty text counts as 0."""
    text = F.trim(c.cast("string"))
    v = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def loose_long(c: Column) -> Column:
    """As :func:`loose_double`, rounded half up."""
    return F.floor(loose_double(c) + F.lit(0.5)).cast("long")


def loose_boolean(c: Column) -> Column:
    """Exactly "true" or "false"."""
    text = c.cast("string")
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def country(c: Column) -> Column:
    """Two letters in upper case; anything else is ZZ."""
    return F.when(F.char_length(c) == 2, F.upper(c)).otherwise(F.lit("ZZ"))


def ip_prefix(ip: Column) -> Column:
    """An IPv4 address as /32, an IPv6 address as its /64 network; null for neither."""
    v4 = F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.concat(ip, F.lit("/32")))
    head = F.split_part(ip, F.lit("::"), F.lit(1))
    has_gap = F.instr(ip, "::") > 0
    tail = F.when(has_gap, F.substring_index(ip, "::", -1)).otherwise(F.lit(""))
    groups = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))
    missing = F.lit(8) - F.size(groups(head)) - F.size(groups(tail))
    zeros = F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>"))
    full = F.concat(groups(head), zeros, groups(tail))
    first = F.transform(F.slice(full, 1, 4), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", ""))
    v6 = F.when((F.instr(ip, ":") > 0) & (missing >= 0) & (F.size(full) == 8) & (has_gap | (missing == 0)), F.concat(F.array_join(first, ":"), F.lit("::/64")))
    return F.coalesce(v4, v6)
