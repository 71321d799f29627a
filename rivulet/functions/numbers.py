"""Numbers and money. Money is micro-cents in a long: a cent is 1,000,000."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def half_up(c: Column, places: int = 0) -> Column:
    """Rounded half towards plus infinity: -2.5 gives -2. To no places, longs stay as they are: the half is a decimal, as a double's sum is not exact beyond 2**53."""
    if not places:
        return F.floor(c + F.lit(Decimal("0.5"))).cast("long")
    scale = 10**places
    return F.floor(c * scale + F.lit(0.5)) / scale


def cents_to_micro(c: Column) -> Column:
    return half_up(c * F.lit(MICRO).cast("long"))


def micro_to_cents(c: Column) -> Column:
    return half_up(c / MICRO)


def micro_to_usd(c: Column) -> Column:
    return c / (100 * MICRO)


def micro_or_cents(micro: Column, cents: Column) -> Column:
    """The micro-cent column, or the cent column where that is null."""
    return F.coalesce(micro, cents * F.lit(MICRO).cast("long"))


def ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """A share; null where the whole is not positive."""
    return F.when(whole > 0, half_up(part / whole, places))


def gated_ratio(part: Column, whole: Column, least: int) -> Column:
    """A ratio that is 0 below a minimum sample."""
    return F.when(whole >= least, part / whole).otherwise(F.lit(0.0))


def percent_used(usage: Column, limit: Column) -> Column:
    return F.floor(F.least(F.lit(100.0), usage / limit * 100)).cast("int")


def usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(micro_to_usd(c), 2))


def compact(c: Column) -> Column:
    """1234567 as "1.2M", 1234 as "1.2K"; thousands are not grouped: 999999 as "1000.0K"."""
    tenths = lambda x: F.call_function("format_number", x, F.lit("0.0"))
    return F.when(c >= 1_000_000, F.concat(tenths(c / 1_000_000), F.lit("M"))).when(c >= 1000, F.concat(tenths(c / 1000), F.lit("K"))).otherwise(c.cast("string"))


def processing_fee(cents: Column, percent: float, fixed_cents: int) -> Column:
    """What to add so that the amount stays after a proportional and a fixed fee."""
    return half_up((cents + fixed_cents) / (1 - percent)) - cents


def weighted_mean(value: Column, weight: Column, places: int = 2) -> Column:
    """Aggregate: mean weighted over the rows that have a value, rounded once. The sum is a decimal's, so that it does not depend on the order of rows."""
    return half_up(F.sum((value * weight).cast("decimal(28,8)")).cast("double") / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0)), places)
