"""Dates: period keys, week and anniversary-month bounds, zones. Arguments are UTC timestamps; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_week_id(ts: Column) -> Column:
    """"2026-W53": the year that ISO counts the week to."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def iso_week_number(ts: Column) -> Column:
    """202653."""
    return F.extract(F.lit("YEAROFWEEK"), ts).cast("int") * 100 + F.weekofyear(ts)


def iso_week_start(week: Column) -> Column:
    """The Monday of a number such as 202653: January 4 is always in the first week."""
    first = F.make_date(F.floor(week / 100).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(first, F.weekday(first)), (F.pmod(week, F.lit(100)).cast("int") - 1) * 7)


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts)


def week_end(ts: Column) -> Column:
    return week_start(ts) + F.expr("INTERVAL 7 DAYS")


def _anchor(month: Column, anchor: Column) -> Column:
    """The anchor's day and time in a month (its first day), on the month's last day if it is shorter."""
    day = F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(month)))
    return F.date_add(month, day - 1).cast("timestamp") + (anchor.cast("timestamp") - F.date_trunc("day", anchor).cast("timestamp"))


def month_start(now: Column, anchor: Column) -> Column:
    """Start of the billing month that holds ``now``: the latest anniversary that is not after it."""
    month = F.trunc(now, "month")
    this = _anchor(month, anchor)
    return F.when(this <= now.cast("timestamp"), this).otherwise(_anchor(F.add_months(month, -1), anchor))


def month_end(now: Column, anchor: Column) -> Column:
    month = F.trunc(now, "month")
    this = _anchor(month, anchor)
    return F.when(this <= now.cast("timestamp"), _anchor(F.add_months(month, 1), anchor)).otherwise(this)


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def seconds_to_next_day(ts: Column) -> Column:
    return F.lit(86400) - F.pmod(F.unix_timestamp(ts.cast("timestamp")), F.lit(86400))


def shifted_day(ts: Column, offset: str) -> Column:
    """The calendar day at a fixed offset such as "+05:30"."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), offset), "yyyy-MM-dd")


def zone_offset(ts: Column, zone: str) -> Column:
    """Minutes by which a named zone is ahead of UTC at an instant."""
    return ((F.unix_timestamp(F.from_utc_timestamp(ts.cast("timestamp"), zone)) - F.unix_timestamp(ts.cast("timestamp"))) / 60).cast("int")


def days_of_month(ts: Column) -> Column:
    return F.sequence(F.trunc(ts, "month"), F.last_day(ts))
