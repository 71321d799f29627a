"""Removal of repeated passages by a sparse, range-partitioned suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same
document and an earlier start).

Not every suffix is sorted. Of each window of ``length`` bytes the smallest hash of its ``TOKEN``-byte tokens is the
window's anchor; equal windows have equal anchors at equal places, so suffixes need to be compared only at anchors.
Consecutive windows with one anchor form a run. A suffix at an anchor is ordered by its leading token (a hash), then by
the whole run's content (a second hash, so 128 bits), then by its place in the corpus.

1. Sampled splitters range-partition the suffixes by these leading tokens; a bucket sorts its suffixes by multikey
   quicksort. The suffixes are hashed and written once, so buckets follow their number, whatever the texts are. Equal runs
   stand together: all but the first are repeats, whole. The first of a bucket is compared with the earliest end of a
   bucket that has its run, so that equal runs may cross boundaries, and a hot one may fill many buckets.
2. Where one token leads to different runs (the edges of repeated passages), the first suffix of each run fetches its
   text, and these are range-partitioned and sorted again: now single windows are compared. Groups that touch a
   bucket's boundary are compared across buckets by an aggregation over their windows.
3. The repeated windows, merged, are cut from the documents.

Defined results: a null text counts as empty; a null doc_id counts as the smallest; rows that share a doc_id but not
their text (told apart by 64 bits of it) are compared by start, and equal starts are not earlier; exact repeats of a row
(doc_id and text) are one document, answered each. Other columns pass through :func:`remove_repeats` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import ODD, Spans, flat, long_array, mix, pieces
from .store import materialize, release

LENGTH, TOKEN = 100, 37
#: Suffixes of a bucket, about; second-level suffixes, which carry text.
BUCKET, TEXT_BUCKET = 400_000, 100_000
#: Bytes of text hashed at once: the arrays made of them stay in a core's cache.
CACHED_BYTES = 1 << 16
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_UNITS = "token long, run long, doc long, tag long, place long"


def _words(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at each byte that has eight."""
    n = max(0, len(data) - 7)
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        own = data[r : r + (n - r + 7) // 8 * 8]
        out[r::8] = np.frombuffer(own.tobytes(), "<u8")
    return out


def _token_hash(words: np.ndarray, token: int) -> np.ndarray:
    """A hash of the ``token`` bytes at each place."""
    n = len(words) - token + 8
    h = np.zeros(n, np.uint64)
    for at in [*range(0, token - 8, 8), token - 8]:
        h = mix(h * ODD + words[at : at + n])
    return h


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, token: int = TOKEN) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc (index), anchor, first and last window (from the buffer's start), token and run hash."""
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "anchor", "first", "last")} | {k: np.zeros(0, np.uint64) for k in ("token", "run")}
    if len(data) < length:
        return empty
    words = _words(data)
    value = _token_hash(words, token)
    count = length - token + 1  # tokens of a window
    low, where, width = value, np.arange(len(value), dtype=np.int32 if len(value) < 1 << 31 else np.int64), 1
    while width < count:
        step = min(width, count - width)
        later = low[step:] < low[:-step]
        low = np.where(later, low[step:], low[:-step])
        where = np.where(later, where[step:], where[:-step])
        width += step
    sizes = np.maximum(np.diff(ends) - length + 1, 0)  # windows of each document
    total = int(sizes.sum())
    if not total:
        return empty
    doc = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[:-1], sizes)
    anchor = where[window].astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], total) - 1
    spans = Spans(mix(words))
    first, last = window[start], window[stop]
    return {"doc": doc[start], "anchor": anchor[start], "first": first, "last": last, "token": value[anchor[start]], "run": spans(first, last + length - 7)}


def _place(start: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """An anchor's start (below 2^31), and how far before it the run's last and first windows start; ordered by start."""
    return (start << 6 | near) << 6 | far


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 12, place >> 6 & 63, place & 63


def _owned(docs: DataFrame) -> list:
    """doc, tag and text of a row: ``tag``, a 64-bit hash of the text and of whether the id is null, tells apart texts that share a doc."""
    none = F.col("doc_id").isNull()
    text = F.col("text").cast("string")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit("")), none).alias("tag"), text.alias("text")]


def _units(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([long_array(np.concatenate(c)) for c in zip(*parts)], ["token", "run", "doc", "tag", "place"])


def suffixes(docs: DataFrame, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """The suffixes at anchors: token, run, doc, tag, place. ``docs`` has doc and tag (never null) and text."""
    if not 8 <= token or length - token + 1 > 64:
        raise ValueError("a window may hold 64 tokens of 8 bytes or more")

    def of(batch: pa.RecordBatch) -> list[np.ndarray]:
        data, ends = flat(batch.column("text"))
        found = runs_of(data, ends, length, token)
        ids, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
        doc, anchor = found["doc"], found["anchor"]
        place = _place(anchor - ends[doc], anchor - found["last"], anchor - found["first"])
        return [found["token"], found["run"], ids[doc], tag[doc], place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in pieces(batches, limit=CACHED_BYTES):
            held.append(of(batch))
            rows += len(held[-1][0])
            if rows > 50_000:
                yield _units(held)
                held, rows = [], 0
        if held:
            yield _units(held)

    return docs.select("doc", "tag", "text").mapInArrow(run, _UNITS)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order of keys of several words by multikey quicksort: sort by one word, then only what ties by the next."""
    order = np.argsort(words[0])
    for depth in range(1, len(words)):
        tied = np.ones(len(order), bool)
        for w in words[:depth]:
            tied[1:] &= w[order[1:]] == w[order[:-1]]
        tied[:1] = False
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        own = np.flatnonzero(inside)
        if not len(own):
            break
        group = np.cumsum(~tied[own])
        rows = order[own]
        order[own] = rows[np.lexsort((words[depth][rows], group))]
    return order


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A bucket: all rows of a partition."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


#: Kinds of rows that a bucket gives: a repeated range (lo, hi); the first suffix of a run whose token has other runs;
#: the bucket's first and last suffix.
_REPEAT, _EDGE, _FIRST, _LAST = 0, 1, 2, 3
_FOUND = "kind int, bucket int, token long, run long, doc long, tag long, place long"


def sort_buckets(units: DataFrame, buckets: int) -> DataFrame:
    """Step 1 over the suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        cols = [table.column(c).to_numpy() for c in ("token", "run", "doc", "place")]
        order = multikey_order(cols)
        token, content, doc, place = (c[order] for c in cols)
        tag = table.column("tag").to_numpy()[order]
        n = len(order)
        same_token = np.zeros(n, bool)
        same_token[1:] = token[1:] == token[:-1]
        same_run = np.zeros(n, bool)
        same_run[1:] = same_token[1:] & (content[1:] == content[:-1])
        # An exact repeat of a row stands beside it at the same place: it is no earlier string.
        head = np.maximum.accumulate(np.where(same_run, 0, np.arange(n)))
        repeat = same_run & ((doc != doc[head]) | (place >> 12 != place[head] >> 12))
        group = np.cumsum(~same_token) - 1
        kinds = np.bincount(group, ~same_run)
        edge_group = kinds > 1
        edge_group[[0, -1]] = True  # they may go on in the next bucket
        edge = ~same_run & edge_group[group]
        here = TaskContext.get().partitionId()
        for kind, rows in ((_REPEAT, np.flatnonzero(repeat)), (_EDGE, np.flatnonzero(edge)), (_FIRST, np.array([0])), (_LAST, np.array([n - 1]))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), kind, np.int32)), pa.array(np.full(len(rows), here, np.int32)), *[long_array(c[rows]) for c in (token, content, doc, tag, place)]],
                ["kind", "bucket", "token", "run", "doc", "tag", "place"],
            )

    return units.repartitionByRange(buckets, "token", "run", "doc", "place").mapInArrow(run, _FOUND)


def boundary_repeats(found: DataFrame) -> DataFrame:
    """Rows that start a bucket and go on with a run that ended an earlier one: repeats as well.

    Two rows a bucket, by the run: the earliest end of a bucket that has it is the run's earliest row, or of its text and start.
    """
    start = lambda c: F.shiftright(c, 12)
    ends = found.filter(F.col("kind") == _LAST).groupBy("token", "run").agg(F.min_by(F.struct("doc", start("place").alias("start")), "bucket").alias("e"), F.min("bucket").alias("from"))
    first = found.filter(F.col("kind") == _FIRST).join(ends, ["token", "run"])
    other = (F.col("doc") != F.col("e.doc")) | (start("place") != F.col("e.start"))
    return first.filter((F.col("bucket") > F.col("from")) & other).select("doc", "tag", "place")


def bands(length: int, token: int) -> list[tuple[int, int]]:
    """How far before its anchor a window starts, in three ranges (first, last)."""
    count = length - token + 1
    cuts = [0, count // 4, count * 5 // 8, count]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:]) if a < b]


def with_text(edges: DataFrame, packed: DataFrame, length: int, token: int) -> DataFrame:
    """Step 2: edge suffixes with the bytes that their windows cover. ``packed`` has doc, tag and body (compressed).

    A run is cut where its windows start at most some bytes before the anchor: all windows of such a part hold the same
    bytes around the anchor, far more than a token, and their hash becomes the part's leading token. So the suffixes of a
    frequent token fall apart into groups that agree in most of a window, or have a group of their own.
    """
    wanted = edges.groupBy("doc", "tag").agg(F.collect_set("place").alias("place"))
    joined = packed.select("doc", "tag", "body").join(wanted, ["doc", "tag"]).select("doc", "tag", "body", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in pieces(batches, "body", 1 << 17):
            texts = [unpack(x) for x in batch.column("body").to_pylist()]
            base = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
            buffer = b"".join(texts)
            spans = Spans(mix(_words(np.frombuffer(buffer, np.uint8))))
            places = batch.column("place")
            own = np.repeat(np.arange(len(texts)), np.diff(offsets_of(places)))
            place = places.flatten().to_numpy()
            start, near, far = _unplace(place)
            doc, tag = (batch.column(c).to_numpy()[own] for c in ("doc", "tag"))
            for number, (first, last) in enumerate(bands(length, token)):
                lo, hi = np.maximum(near, first), np.minimum(far, last)
                some = np.flatnonzero(lo <= hi)
                at = base[own[some]] + start[some]
                key = mix(spans(at - first, at + length - last - 7) + np.uint64(number))
                bodies = [buffer[a:b] for a, b in zip((at - hi[some]).tolist(), (at - lo[some] + length).tolist())]
                yield pa.RecordBatch.from_arrays([long_array(key), long_array(doc[some]), long_array(tag[some]), long_array(_place(start[some], lo[some], hi[some])), pa.array(bodies, pa.binary())], ["token", "doc", "tag", "place", "body"])

    return joined.mapInArrow(run, "token long, doc long, tag long, place long, body binary")


def offsets_of(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


_WINDOWS = "doc long, tag long, lo long, hi long, w1 long, w2 long"


def sort_windows(edges: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """Edge suffixes of one leading token compared window by window.

    Gives repeated ranges (w1 and w2 null), and the windows (lo: start, two hashes) of the groups that touch a bucket's boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        table = table.combine_chunks()
        cols = [table.column(c).to_numpy() for c in ("token", "doc", "place")]
        order = multikey_order(cols)
        token = cols[0][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = token[1:] != token[:-1]
        group = np.cumsum(fresh) - 1
        outer = (group == 0) | (group == group[-1])
        sizes = np.bincount(group)
        for touching, rows in ((True, order[outer]), (False, order[~outer & (sizes[group] > 1)])):
            step = 4_000
            done = 0
            groups = np.cumsum(np.diff(cols[0][rows], prepend=cols[0][rows][:1]) != 0)
            while done < len(rows):
                to = min(len(rows), done + step)
                if not touching:  # a group stays whole
                    to = int(np.searchsorted(groups, groups[to - 1], side="right"))
                yield _windows(table, cols, rows[done:to], groups[done:to], length, touching)
                done = to

    return edges.repartitionByRange(buckets, "token", "doc", "place").mapInArrow(run, _WINDOWS)


def _windows(table: pa.Table, cols: list[np.ndarray], rows: np.ndarray, group: np.ndarray, length: int, touching: bool) -> pa.RecordBatch:
    data, ends = flat(table.column("body").take(pa.array(rows)).combine_chunks() if table.column("body").num_chunks else pa.array([], pa.binary()))
    doc, place, tag = cols[1][rows], cols[2][rows], table.column("tag").to_numpy()[rows]
    start, near, far = _unplace(place)
    sizes = far - near + 1
    own = np.repeat(np.arange(len(rows)), sizes)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = _words(data)
    at = ends[own] + step
    w1 = Spans(mix(words))(at, at + length - 7)
    lo = start[own] - far[own] + step
    order = np.lexsort((lo, doc[own], w1, group[own]))
    g, w, d, s, o = group[own][order], w1[order], doc[own][order], lo[order], own[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    hit = same & ((d != d[head]) | (s != s[head]))
    open_ = order[~same] if touching else order[:0]  # only the first of each content here can be the first of all
    w2 = Spans(mix(words ^ ODD))(at[open_], at[open_] + length - 7)
    o, s = o[hit], s[hit]
    order = np.lexsort((s, o))
    o, s = o[order], s[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o))[: len(first)] - 1
    none = pa.nulls(len(first), pa.int64())
    join = lambda a, b: pa.array(np.concatenate((a, b)))
    return pa.RecordBatch.from_arrays(
        [
            join(doc[o[first]], doc[own[open_]]), join(tag[o[first]], tag[own[open_]]), join(s[first], lo[open_]), join(s[last] + length, lo[open_] + length),
            *[pa.concat_arrays([none, long_array(w)]) for w in (w1[open_], w2)],
        ],
        ["doc", "tag", "lo", "hi", "w1", "w2"],
    )


def across_buckets(windows: DataFrame) -> DataFrame:
    """Windows of groups that touch boundaries: all but the earliest of each content are repeats."""
    open_ = windows.filter(F.col("w1").isNotNull())
    first = open_.groupBy("w1", "w2").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return open_.join(first, ["w1", "w2"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("lo") != F.col("first.lo"))).select("doc", "tag", "lo", "hi")


def pack(docs: DataFrame) -> DataFrame:
    """doc, tag and compressed body of the texts, so that a shuffle of them is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches):
            body = pa.array([press((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), body], ["doc", "tag", "body"])

    return docs.select("doc", "tag", "text").mapInArrow(run, "doc long, tag long, body binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """doc, tag and the repeated byte ranges (lo, hi) of each text that has any; ranges of a text may overlap."""
    own = docs.select(*_owned(docs)).fillna("", "text")
    units = materialize(suffixes(own, length, token), "suffix-units")  # hashed once: splitters and buckets come from what is written
    buckets = max(1, -(-units.count() // BUCKET))
    found = materialize(sort_buckets(units, buckets), "suffix-buckets", -(-buckets // 3))
    release(units)
    edges = found.filter(F.col("kind") == _EDGE)
    n = edges.count()
    windows = materialize(sort_windows(with_text(edges, pack(own), length, token), max(1, -(-n // TEXT_BUCKET)), length), "suffix-windows")
    whole = found.filter(F.col("kind") == _REPEAT).select("doc", "tag", "place").unionByName(boundary_repeats(found))
    start = F.shiftright("place", 12)
    whole = whole.select("doc", "tag", (start - F.col("place").bitwiseAND(63)).alias("lo"), (start - F.shiftright("place", 6).bitwiseAND(63) + length).alias("hi"))
    ranges = whole.unionByName(windows.filter(F.col("w1").isNull()).select("doc", "tag", "lo", "hi")).unionByName(across_buckets(windows))
    return ranges.select("doc", "tag", F.shiftleft("lo", 31).bitwiseOR(F.col("hi")).alias("range"))


def merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of packed ranges (lo << 31 | hi)."""
    ranges = np.sort(ranges)
    lo, hi = ranges >> 31, np.maximum.accumulate(ranges & ((1 << 31) - 1))
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """All columns of ``docs`` and a struct ``repeats``: n_bytes, removed (ranges) and kept (the bytes that stay)."""
    ranges = repeated_ranges(docs, length, token).groupBy("doc", "tag").agg(F.collect_list("range").alias("ranges"))
    names = [c for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"), *_owned(docs))
    kind = held.schema["rest"].dataType

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            body = pa.array([None if t is None else z(t.encode()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("doc"), batch.column("tag"), body], ["rest", "doc", "tag", "body"])

    packed = held.mapInArrow(press, T.StructType([T.StructField("rest", kind), T.StructField("doc", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("body", T.BinaryType())]))
    joined = packed.join(ranges, ["doc", "tag"], "left").select("rest", "body", "ranges")
    result = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in pieces(batches, "body", 1 << 19):
            sizes, gone, kept = [], [], []
            for k, body in enumerate(batch.column("body").to_pylist()):
                text = b"" if body is None else unpack(body)
                own = batch.column("ranges")[k]
                cut = merged(own.values.to_numpy()) if own.is_valid and len(own.values) else []
                edges = [0, *[x for span in cut for x in span], len(text)]
                sizes.append(len(text))
                gone.append([list(x) for x in cut])
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            repeats = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["n_bytes", "removed", "kept"])
            missing = pa.array([x is None for x in batch.column("body").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), repeats, missing], ["rest", "repeats", "no_text"])

    return joined.mapInArrow(apply, T.StructType([T.StructField("rest", kind), T.StructField("repeats", result), T.StructField("no_text", T.BooleanType())]))


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`remove_repeats`."""
    removed = F.aggregate("repeats.removed", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return cut.select(F.col("rest.doc_id").alias("doc_id"), F.col("repeats.n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("repeats.removed").cast("long").alias("n_spans"), F.sha2("repeats.kept", 256).alias("kept_sha256"))


def cleaned(cut: DataFrame, columns: list[str]) -> DataFrame:
    """The documents again, text without repeats; a character of which a byte was cut goes. Untouched texts stay as they were."""
    text = F.when(F.col("no_text"), F.lit(None).cast("string")).otherwise(valid_utf8("repeats.kept"))
    return cut.select(*[text.alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns])


def valid_utf8(column: str):
    """Decode, dropping what is not UTF-8 (Spark puts U+FFFD for it, which is dropped unless the bytes held it)."""
    made = F.make_valid_utf8(F.col(column).cast("string"))
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string")).otherwise(F.replace(made, F.lit("�"), F.lit("")))
