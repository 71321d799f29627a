"""Text: suffix rules, ordered matches, slugs, wildcards, similarity."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def or_default(c: Column, default: str = "unknown") -> Column:
    """Empty and null texts become the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def strip_suffixes(c: Column, suffixes: Iterable[str], default: str = "unknown") -> Column:
    """Remove any run of the suffixes from the end; what is left empty is the default."""
    pattern = f"({'|'.join(re.escape(s) for s in suffixes)})+$"
    return or_default(F.regexp_replace(or_default(c, default), pattern, ""), default)


def first_match(c: Column, rules: Iterable[tuple[str, str]], default: str = "unknown") -> Column:
    """The value of the first rule whose key is in the lower-cased text. One CASE, no join."""
    out, text = None, F.lower(c)
    for key, value in rules:
        hit = F.instr(text, key.lower()) > 0
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def slug(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def wildcard_pattern(pattern: str) -> str:
    """A regular expression for ``*`` (anything) and ``?`` (one character)."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def last_rule(c: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """Of ordered wildcard rules the last that matches decides."""
    out = F.lit(default)
    for pattern, value in rules:
        out = F.when(c.rlike(wildcard_pattern(pattern)), F.lit(value)).otherwise(out)
    return out


def hash31(c: Column) -> Column:
    """The 31-multiplier hash of a text's code points modulo 2^32, in base 36: a short name for an expression."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + x, F.lit(1 << 32)))
    return F.lower(F.conv(total.cast("string"), 10, 36))


def hue(c: Column) -> Column:
    """A colour's angle, 0 to 359, that depends on the text alone (a shift hash of its code points)."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    signed = lambda v: F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.pmod(F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: signed(x + a * 31))), F.lit(360)).cast("int")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded half up."""
    return F.floor(F.char_length(c) / 4 + F.lit(0.5)).cast("long")


def truncate(c: Column, n: int, marker: str = "…") -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; two empty texts are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends: two texts that differ by layout alone become equal."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def line_trimmed(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), "\n")


def dedented(c: Column) -> Column:
    """Lines less the indentation that all non-blank lines share."""
    lines = F.split(c, "\n")
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.char_length(x) - F.char_length(F.ltrim(x))))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, F.coalesce(indent, F.lit(0)) + 1)), "\n")


def unescaped(c: Column) -> Column:
    """The escapes of a string literal for line breaks, tabs, quotes and backslashes, resolved."""
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\\\\", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fuzzy_score(query: Column, text: Column) -> Column:
    """Subsequence score in 0 to 1: null if the query's characters don't appear in order; adjacent characters and starts of words count more.

    Of all alignments the best counts: for each character of the query, the best score of an alignment that ends at each
    character of the text follows from those of the character before. For names and paths, as the work grows with the
    square of the text's length.
    """
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    wanted = F.filter(F.split(F.lower(query), ""), lambda c: c != "")
    word = lambda k: F.when((k == 1) | ~F.coalesce(F.get(chars, k - 2).rlike(r"^[\p{L}\p{N}]$"), F.lit(False)), 1.0).otherwise(0.0)
    places = F.sequence(F.lit(0), F.size(chars))  # 0: before the text
    before = lambda best, k: F.greatest(F.array_max(F.slice(best, 1, k)), F.when(k > 1, F.get(best, k - 1) + 1))
    step = lambda best, c: F.transform(places, lambda k: F.when((k > 0) & (F.get(chars, k - 1) == c), 1 + word(k) + before(best, k)))
    start = F.transform(places, lambda k: F.when(k == 0, 0.0))
    last = F.aggregate(wanted, start, step)
    return F.when(F.size(wanted) == 0, F.when(text.isNotNull(), 0.0)).otherwise(F.array_max(last) / (3 * F.size(wanted)))


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.str.normalize("NFC")
