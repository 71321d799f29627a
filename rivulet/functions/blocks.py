"""Blocks of lines compared and found: bit-parallel edit distances over Arrow batches.

Myers' algorithm keeps a row of the distance matrix as two words of as many bits as the shorter text has characters, so a
pair of lines of 30,000 characters takes some 30,000 steps of long integers; equal lines, heads and tails take none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The least similarity of a block's inner lines, and by what share of its lines a block may be longer or shorter.
LEAST_SIMILARITY = 0.65
LINE_SHARE = 0.25


def distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions of characters that make one text the other."""
    if len(a) > len(b):
        a, b = b, a
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(a))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    last, up, down, score = 1 << len(a) - 1, every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        level = ((same & up) + up ^ up) | same
        right_up, right_down = down | every & ~(level | up), up & level
        score += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = right_up << 1 | 1, right_down << 1
        steep = same | down
        up, down = (right_down | ~(steep | right_up)) & every, right_up & steep & every
    return score


def likeness(a: str, b: str) -> float:
    """1 less the distance as a share of the longer text; two empty texts are equal."""
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def _lines(text: str) -> list[str]:
    return [line.strip() for line in text.split("\n")]


@F.pandas_udf(T.DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean similarity of the trimmed lines of two blocks, line by line; lines that one block lacks count 0; null with a null."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        left, right = _lines(x), _lines(y)
        return sum(map(likeness, left, right)) / max(len(left), len(right))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def found_block(content: str, block: str, least: float = LEAST_SIMILARITY) -> tuple[int, int, float] | None:
    """(first line, last line, similarity) of the place of a text that is most like a block of three lines or more.

    A place begins with the block's first line and ends with the next line, two or more below, that equals the block's
    last; it may have a quarter more or fewer lines than the block, or one. The similarity is the mean over the inner lines
    that both have, where two empty lines count nothing; without inner lines it is 1. Of equal places the first counts.
    """
    wanted = block.split("\n")
    if len(wanted) < 3:
        return None
    wanted = [line.strip() for line in (wanted[:-1] if wanted[-1] == "" else wanted)]
    lines, slack = _lines(content), max(1, int(len(wanted) * LINE_SHARE))
    ends = [i for i, line in enumerate(lines) if line == wanted[-1]]
    best, at = None, 0
    for i in (i for i, line in enumerate(lines) if line == wanted[0]):
        while at < len(ends) and ends[at] < i + 2:
            at += 1
        if at == len(ends):
            break
        size = ends[at] - i + 1
        if abs(size - len(wanted)) > slack:
            continue
        inner = min(size, len(wanted)) - 2
        pairs = zip(lines[i + 1 : i + 1 + inner], wanted[1 : 1 + inner])
        score = sum(likeness(x, y) for x, y in pairs if x or y) / inner if inner > 0 else 1.0
        if best is None or score > best[2]:
            best = i, ends[at], score
    return best if best is not None and best[2] >= least else None


@F.pandas_udf(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
def find_block(content: pd.Series, block: pd.Series) -> pd.DataFrame:
    """:func:`found_block` of each row, lines from 0; nulls where nothing is found or either is null."""
    found = [(None if x is None or y is None else found_block(x, y)) or (None, None, None) for x, y in zip(content, block)]
    return pd.DataFrame(found, columns=["start_line", "end_line", "similarity"]).astype({"start_line": "Int32", "end_line": "Int32", "similarity": "float64"})
