"""Text search: lines that match, fuzzy names, frecency, security patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_score


def grep(texts: DataFrame, ident: str, text: str, pattern: str, width: int = 2000) -> DataFrame:
    """(id, line_no from 1, line) of lines that match; a shown line ends after ``width`` characters. Texts without a match are left out before they are split."""
    lines = texts.filter(F.col(text).rlike(pattern)).select(ident, F.posexplode(F.split(text, "\r?\n")).alias("no", "line"))
    return lines.filter(F.col("line").rlike(pattern)).select(ident, (F.col("no") + 1).alias("line_no"), F.substring("line", 1, width).alias("line"))


def submatches(line: Column, pattern: str, most: int = 100) -> Column:
    """The matching parts of a line, the first ``most``."""
    return F.slice(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), 1, most)


def glob(paths: DataFrame, path: str, patterns: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """Paths that match a glob (``**`` any folders, ``*`` within a name, ``?`` one character), less those below ignored names."""
    own = F.lit(False)
    for p in patterns:
        own = own | F.col(path).rlike(glob_pattern(p))
    out = paths.filter(own)
    for name in ignored:
        out = out.filter(~F.concat(F.lit("/"), F.col(path), F.lit("/")).contains(f"/{name}/"))
    return out


def glob_pattern(pattern: str) -> str:
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def fuzzy_top(names: DataFrame, name: str, query: str, k: int) -> DataFrame:
    """The k best subsequence matches; shorter names first among equals."""
    scored = names.withColumn("score", fuzzy_score(F.lit(query), F.col(name))).filter("score is not null")
    return scored.orderBy(F.col("score").desc(), F.char_length(name), name).limit(k)


def frecency(uses: Column, last: Column, as_of: Column) -> Column:
    """Uses over one plus the days since the last."""
    return uses / (1 + (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 86_400_000_000)


def boosted(score: Column, frecency_: Column, bonus: Column) -> Column:
    """A match's score raised by frecency, doubled with a bonus."""
    return score * (1 + F.coalesce(frecency_, F.lit(0.0))) * F.when(bonus, 2).otherwise(1)


def pattern_hits(texts: DataFrame, ident: str, text: str, rules: dict[str, tuple[str, str | None]], ahead: int = 300) -> DataFrame:
    """(id, rule, line_no, match): the first hit of each rule's pattern in each text, unless its second pattern follows within ``ahead`` characters."""
    entries = []
    for name, (pattern, unless) in rules.items():
        at = F.regexp_instr(text, F.lit(pattern))
        safe = F.substr(F.col(text), at, F.lit(ahead)).rlike(unless) if unless else F.lit(False)
        line = F.char_length(F.substr(F.col(text), F.lit(1), at - 1)) - F.char_length(F.replace(F.substr(F.col(text), F.lit(1), at - 1), F.lit("\n"), F.lit(""))) + 1
        entries.append(F.when((at > 0) & ~safe, F.struct(F.lit(name).alias("rule"), line.alias("line_no"), F.regexp_extract(text, pattern, 0).alias("match"))))
    return texts.select(ident, F.explode(F.array_compact(F.array(*entries))).alias("h")).select(ident, "h.*")


def near_names(names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """(a, b, distance): pairs a < b of distinct names within so many edits.

    Of ``most`` + 1 segments of the shorter name one stands unchanged in the longer, shifted by ``most`` places at most. So
    names are joined on (length, segment's number, segment), a few rows each, and only such pairs are measured.
    """
    own = names.select(F.col(name).alias("n")).filter(F.col("n").isNotNull()).distinct().withColumn("len", F.char_length("n"))
    parts = most + 1
    begin = lambda length, k: F.floor(length * k / parts).cast("int")
    segment = lambda text, length, k, shift: F.substr(text, begin(length, k) + 1 + shift, begin(length, k + 1) - begin(length, k))
    short = own.select(F.col("n").alias("x"), "len", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), segment(F.col("n"), F.col("len"), k, F.lit(0)).alias("part")) for k in range(parts)])).alias("s")).select("x", "len", "s.k", "s.part")
    places = [(gap, k, shift) for gap in range(most + 1) for k in range(parts) for shift in range(-most, most + 1)]
    at = lambda gap, k, shift: F.struct((F.col("len") - gap).alias("len"), F.lit(k).alias("k"), F.when((begin(F.col("len") - gap, k) + shift >= 0) & (F.col("len") >= gap), segment(F.col("n"), F.col("len") - gap, k, F.lit(shift))).alias("part"))
    long = own.select(F.col("n").alias("y"), F.explode(F.array_distinct(F.array(*[at(*p) for p in places]))).alias("s")).select("y", "s.len", "s.k", "s.part").filter("part IS NOT NULL")
    pairs = short.join(long, ["len", "k", "part"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)
