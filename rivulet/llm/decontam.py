"""Benchmark decontamination by spaced-seed hashing.

Texts are tokens: runs of ASCII letters, digits and non-ASCII characters, in lower case. A fixed mask selects some of
a span of tokens and ignores the others; tokens selected from benchmark items and from documents are hashed, and equal
hashes are hits, so an overlap with substituted tokens is still hit by a mask that ignores them. Around each hit the
two texts are compared token by token along the hit's diagonal. The ``whole`` rule, which the query and the pipeline use:
any window of ``LEAST`` tokens or more (or the whole of a shorter item) with a share of ``IDENTITY`` of matches is an
overlap, and none is missed. Without ``whole`` only the best-scoring stretch (a match 1, a substitution -``PENALTY``) of
a diagonal is tested, and only if one of ``MASKS`` hits it.

Repeated words make hits in the square of their number. So the hits of a text and an item are counted first, by distinct
seeds; where they outnumber the diagonals of the two, all their diagonals are tested instead, the longest first.

The benchmark is a stated query set: it is read in blocks of ``BLOCK_BYTES``, one after another, and a block's seeds are
the broadcast side of the join of hashes; documents are never shuffled to find hits.

Defined results: null and empty texts, on either side, overlap with nothing. By the ``whole`` rule an item of fewer than
``FEWEST`` tokens is found where all its tokens stand in a row, first place only, but as that may be chance,
:func:`remove_contaminated` drops a document for it only if the document is nothing else; without ``whole`` such items
are not searched. Of overlaps of one document and item with equally many matches that of the smallest diagonal (the
item's place less the document's) is given. A null item_id is an item like any other; repeated rows are answered each;
equal items each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ODD, Spans, lower_bytes, lowered, mix, pieces, tokens
from .store import materialize

#: Fixed masks; 1 selects a token. All have six ones.
MASKS = ("111111", "1101111", "11011011", "1100101101", "10110010011")
LEAST, FEWEST, IDENTITY, PENALTY = 13, 6, 0.75, 2
#: Three tokens in a row, which with ``MASKS`` hits every window that meets the rule: m matches and at most m / 3
#: substitutions leave a run of three, but for eight tokens of the pattern 11011011, which is a mask.
RUN = "111"
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
_SCHEMA = "doc_id long, item_id long, start long, end long, item_start long, item_end long, matches long, length long, identity double"


def token_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each token, and the first token of each text; ``data`` is in lower case."""
    start, stop = tokens(data, ends)
    return Spans(mix(data.astype(np.uint64) + ODD))(start, stop), start, stop, np.searchsorted(start, ends)


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the selected tokens at each place where the mask fits into one text, and the places."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, len(mask) * 31, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ hashes[i : n + i]) * ODD
            h ^= h >> np.uint64(31)
    fits = np.ones(n, bool)
    for k in range(1, len(mask)):
        late = first[1:] - k
        fits[late[(late >= 0) & (late < n)]] = False
    at = np.flatnonzero(fits)
    return h[at], at


@dataclass
class Table:
    """Sorted seeds of one mask: a group for each seed and item that meet, with its places in the items' tokens."""

    places: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    start: np.ndarray
    count: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, first: np.ndarray, mask: str) -> Table:
        h, at = seeds(hashes, first, mask)
        item = np.searchsorted(first, at, "right") - 1
        fit = np.diff(first)[item] >= FEWEST
        h, at, item = h[fit], at[fit], item[fit]
        order = np.lexsort((at, h))
        h, at, item = h[order], at[order], item[order]
        start = grouped(h, item)
        sieve = np.zeros(1 << _FILTER_BITS, bool)
        sieve[h >> np.uint64(64 - _FILTER_BITS)] = True
        return Table(at, h[start], item[start], start, np.diff(np.append(start, len(h))), sieve)

    def joined(self, hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, ...]:
        """The text's places of seeds, and for each of its distinct (text, seed) and each group of that seed: first place and number of places, text, group."""
        h, at = seeds(hashes, first, mask)
        passed = self.sieve[h >> np.uint64(64 - _FILTER_BITS)]
        h, at = h[passed], at[passed]
        text = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, h, text))
        h, at, text = h[order], at[order], text[order]
        start = grouped(text, h)
        count = np.diff(np.append(start, len(h)))
        lo, hi = np.searchsorted(self.seed, h[start], "left"), np.searchsorted(self.seed, h[start], "right")
        n = hi - lo
        own = np.repeat(np.arange(len(start)), n)
        group = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return at, start[own], count[own], text[start][own], group


def grouped(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal sorted keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


@dataclass
class Index:
    """A block of benchmark items: token hashes, a table of seeds for each mask, and the items too short for masks."""

    ids: list[int | None]
    hashes: np.ndarray
    first: np.ndarray
    tables: list[Table]
    whole: bool = False

    @staticmethod
    def of(items: list[tuple[int | None, str]], whole: bool = False) -> Index:
        items = [x for x in items if x[1]]
        raw = [lower_bytes(x[1]) for x in items]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        hashes, _, _, first = token_hashes(np.frombuffer(b"".join(raw), np.uint8), ends)
        return Index([x[0] for x in items], hashes, first, [Table.of(hashes, first, m) for m in ((*MASKS, RUN) if whole else MASKS)], whole)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item, diagonal) of hits, each once, and (text, item) of pairs with more hits than diagonals, which are left out of them.

        The diagonal is the item's place less the text's, in tokens.
        """
        joined = [t.joined(hashes, first, m) for m, t in zip((*MASKS, RUN), self.tables)]
        items = len(self.first)
        pair = np.concatenate([text * items + t.item[group] for t, (_, _, _, text, group) in zip(self.tables, joined)])
        number = np.concatenate([count * t.count[group] for t, (_, _, count, _, group) in zip(self.tables, joined)])
        known, back = np.unique(pair, return_inverse=True)
        total = np.bincount(back, number, len(known))
        text, item = known // items, known % items
        crowded = total > 4 * (np.diff(first)[text] + np.diff(self.first)[item])
        dense = known[crowded]
        found = [np.zeros((0, 3), np.int64)]
        for t, (at, start, count, text, group) in zip(self.tables, joined):
            open_ = ~np.isin(text * items + t.item[group], dense)
            start, count, text, group = start[open_], count[open_], text[open_], group[open_]
            n = count * t.count[group]
            own = np.repeat(np.arange(len(n)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = t.count[group][own]
            mine, place = at[start[own] + k // width], t.places[t.start[group][own] + k % width]
            text, item = text[own], t.item[group][own]
            if self.whole:
                near = self.near(hashes, first, mine, text, place, item)
                mine, place, text, item = mine[near], place[near], text[near], item[near]
            found.append(np.stack([text, item, (place - self.first[item]) - (mine - first[text])], 1))
        return np.unique(np.concatenate(found), axis=0), np.stack([dense // items, dense % items], 1)

    def short(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first place) of the items of fewer than ``FEWEST`` tokens that stand in a text."""
        out = []
        size = np.diff(self.first)
        for n in range(1, FEWEST) if self.whole else ():
            items = np.flatnonzero(size == n)
            if not len(items):
                continue
            own, at = seeds(self.hashes, self.first, "1" * n)
            item = np.searchsorted(self.first, at, "right") - 1
            own, item = own[size[item] == n], item[size[item] == n]
            order = np.argsort(own, kind="stable")
            own, item = own[order], item[order]
            h, at = seeds(hashes, first, "1" * n)
            text = np.searchsorted(first, at, "right") - 1
            lo, hi = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
            some = np.flatnonzero(hi > lo)
            seen = set()
            for k in some.tolist():
                key = int(text[k]), int(h[k])
                if key not in seen:
                    seen.add(key)
                    out += [(key[0], int(i), int(at[k] - first[key[0]])) for i in item[lo[k] : hi[k]]]
        return out

    def near(self, hashes: np.ndarray, first: np.ndarray, mine: np.ndarray, text: np.ndarray, place: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether some window around a hit meets the rule. One of 2 * LEAST tokens or more has a half that meets it, so shorter ones tell."""
        out = np.zeros(len(mine), bool)
        reach = np.arange(2 - 2 * LEAST, 2 * LEAST - 1)
        own = self.first[item + 1] - self.first[item]
        least = np.minimum(LEAST, own)
        for at in range(0, len(mine), 1 << 14):
            cut = slice(at, at + (1 << 14))
            a, b = mine[cut, None] + reach, place[cut, None] + reach
            inside = (a >= first[text[cut], None]) & (a < first[text[cut] + 1, None]) & (b >= self.first[item[cut], None]) & (b < self.first[item[cut] + 1, None])
            same = inside & (hashes[np.clip(a, 0, len(hashes) - 1)] == self.hashes[np.clip(b, 0, len(self.hashes) - 1)])
            # Beyond a text's end nothing counts: more is lost there than all matches make good.
            total = np.pad(np.cumsum(np.where(same, 1, np.where(inside, -3, -200)), axis=1), ((0, 0), (1, 0)))
            low = np.minimum.accumulate(total, axis=1)
            for n in np.unique(least[cut]):
                out[cut] |= (least[cut] == n) & (own[cut] >= FEWEST) & (total[:, n:] >= low[:, :-n]).any(axis=1)
        return out


def window(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first token of the document, tokens, matches) of the window of a diagonal that meets the rule with the most matches, or None."""
    lo, hi = max(0, -diagonal), min(len(doc), len(item) - diagonal)
    least = min(LEAST, len(item))
    if hi - lo < least or len(item) < FEWEST:
        return None
    same = doc[lo:hi] == item[lo + diagonal : hi + diagonal]
    # Three of four match if and only if the sum of 1 for a match and -3 for a substitution is not negative.
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -3))))
    count = np.concatenate(([0], np.cumsum(same)))
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")  # for each end the first start that will do
    end = np.arange(len(total))
    fits = np.flatnonzero(end - start >= least)
    if not len(fits):
        return None
    to = int(fits[np.argmax(count[fits] - count[start[fits]])])
    at = int(start[to])
    while not same[at] and to - at > least:
        at += 1
    return lo + at, to - at, int(count[to] - count[at])


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first token of the document, tokens, matches) of the accepted stretch of a diagonal, or None."""
    lo, hi = max(0, -diagonal), min(len(doc), len(item) - diagonal)
    if hi - lo < FEWEST or len(item) < FEWEST:
        return None
    same = doc[lo:hi] == item[lo + diagonal : hi + diagonal]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])  # of equal stretches the shortest
    length, matches = end - start, int(same[start:end].sum())
    if length < min(LEAST, len(item)) or matches < IDENTITY * length:
        return None
    return lo + start, length, matches


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``limit`` bytes, read one partition after another."""
    own, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        own.append((row.item_id, row.text))
        size += len(row.text.encode())
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


def overlaps(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """The best overlap of each document with each item: byte range in the document, token range in the item, matches, length.

    A benchmark of one block gives one pass over the documents; of more, each block's rows are written before the next.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, waiting = None, None
    for items in blocks(benchmark):
        if waiting is not None:
            part = materialize(_search(own, Index.of(waiting, whole)), "overlaps")
            out = part if out is None else out.unionByName(part)
        waiting = items
    if waiting is None:
        return own.sparkSession.createDataFrame([], _SCHEMA)
    last = _search(own, Index.of(waiting, whole))
    return last if out is None else out.unionByName(last)


def diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """All diagonals of two texts, those with the most tokens on both sides first, then the smallest."""
    d = np.arange(1 - len(doc), len(item))
    size = np.minimum(len(doc), len(item) - d) - np.maximum(0, -d)
    return d[np.lexsort((d, -size))]


def best_overlaps(index: Index, texts: pa.Array) -> list[tuple]:
    """(row, item, start, end, item_start, item_end, matches, length, tokens of the text): the best of each row and item (a place in ``index.ids``)."""
    data, ends = lowered(texts)
    hashes, start, stop, first = token_hashes(data, ends)
    best: dict[tuple[int, int], tuple] = {}
    test = window if index.whole else overlap

    def better(text: int, item: int, diagonal: int) -> None:
        found = test(hashes[first[text] : first[text + 1]], index.hashes[index.first[item] : index.first[item + 1]], diagonal)
        old = best.get((text, item))
        if found and (old is None or (-found[2], diagonal) < (-old[2], old[3])):
            best[text, item] = (*found, diagonal)

    hits, dense = index.hits(hashes, first)
    for text, item, diagonal in hits.tolist():
        better(text, item, diagonal)
    for text, item in dense.tolist():
        own, other = first[text + 1] - first[text], index.first[item + 1] - index.first[item]
        for diagonal in diagonals(hashes[first[text] : first[text + 1]], index.hashes[index.first[item] : index.first[item + 1]]).tolist():
            most, old = min(own, other - diagonal) - max(0, -diagonal), best.get((text, item))
            if most < (old[2] if old else min(LEAST, other)):
                break
            if old is None or most > old[2] or diagonal < old[3]:
                better(text, item, diagonal)
    for text, item, at in index.short(hashes, first):
        n = int(index.first[item + 1] - index.first[item])
        best[text, item] = (at, n, n, -at)
    out = []
    for (text, item), (at, length, matches, diagonal) in sorted(best.items()):
        base = first[text] + at
        out.append((text, item, int(start[base] - ends[text]), int(stop[base + length - 1] - ends[text]), at + diagonal, at + diagonal + length, matches, length, int(first[text + 1] - first[text])))
    return out


def _search(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # a block: bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = best_overlaps(shared.value, batch.column("text"))
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            items = pa.array([shared.value.ids[r[1]] for r in rows], pa.int64())
            cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(2, 8)]
            yield pa.RecordBatch.from_arrays([ids, items, *cols, pa.array([r[6] / r[7] for r in rows], pa.float64())], ["doc_id", "item_id", "start", "end", "item_start", "item_end", "matches", "length", "identity"])

    return docs.mapInArrow(run, _SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` without the rows that overlap with an item; columns and types stay. One pass for each block, written before the next."""
    out, first = docs, True
    for items in blocks(benchmark):
        out, first = out if first else materialize(out, "uncontaminated"), False
        shared = docs.sparkSession.sparkContext.broadcast(Index.of(items, whole))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                hit = np.zeros(batch.num_rows, bool)
                hit[[r[0] for r in best_overlaps(shared.value, batch.column("text")) if r[7] >= FEWEST or r[7] == r[8]]] = True
                kept = batch.filter(pa.array(~hit))
                if kept.num_rows:
                    yield kept

        out = out.mapInArrow(run, docs.schema)
    return out
