"""Near copies: texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more.

1. SimHash fingerprints of the sets go through the ball hashing of :mod:`simhash`; each link that it gives is verified by
   the two whole sets. This finds most copies, and whole families of them, at one comparison a text.
2. A radius that ball hashing can list misses pairs near the threshold (a similarity of 0.8 is some 10 of 64 bits), so
   what is left is found exactly, by a join of set prefixes: two sets of similarity 0.8 have a member in the first fifth
   of both, in any order; shingles of many texts come last. Pairs of a key of few texts are rows, told from chance by small
   sketches and then by the whole sets; larger families are compared in blocks, where what is connected is passed over.

Words are runs of bytes other than blank and 9 to 13, A-Z in lower case; a text of fewer than five words is one shingle.

Defined results: null and empty texts are one text; equal texts (by 128 bits) are copies; a null doc_id stays only if its
group has no other; of rows that share doc_id and text the one whose columns' JSON comes first stays; other columns,
whatever their names, pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import ODD, Spans, flat, fold, long_array, mix, pieces, runs
from .graph import components
from .simhash import RADIUS, bits_for, links
from .store import materialize, release

SHINGLE = 5
#: Shingles that are known to be frequent and so come last, at most: the most frequent ones. An order only, nothing is left out by it.
FREQUENT = 1_000_000
#: Texts of a key up to which its pairs are rows; texts and bytes of a block of a larger family.
FEW, BLOCK, BLOCK_BYTES = 32, 512, 4 << 20
#: Texts whose names (some 100 bytes each) are broadcast to look their rows up, at most; more are joined by a shuffle.
NAMED = 50_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's set of shingles, sorted, end to end. A text without words has the empty shingle."""
    data, ends = flat(texts)
    start, stop = runs(~_BLANK[data], ends)
    words = Spans(mix(fold(data).astype(np.uint64) + ODD))(start, stop)
    first = np.searchsorted(start, ends)
    n = np.maximum(np.diff(first) - SHINGLE + 1, 1)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    hashes = Spans(words)(at, np.minimum(at + SHINGLE, first[1:][text]))
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(n))))).astype(np.int64)


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if set in over half of its hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, ends[:-1], axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > np.diff(ends)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def prefixes(hashes: np.ndarray, ends: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, ends): the first fifth, and one, of each set in the order of (rank, hash).

    Sets of similarity 0.8 have 4/5 of either in common. If their prefixes had nothing in common, the one that ends first
    would have n // 5 + 1 members that the other set lacks. ``rank`` of the ``frequent`` (sorted) hashes puts them last,
    so that few unrelated texts meet.
    """
    size = np.diff(ends)
    text = np.repeat(np.arange(len(size)), size)
    late = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        late = np.where(frequent[at] == hashes, rank[at], 0)
    order = np.lexsort((hashes, late, text))
    place = np.arange(len(hashes)) - np.repeat(ends[:-1], size)
    first = place < np.repeat(size // 5 + 1, size)
    return hashes[order][first], np.concatenate(([0], np.cumsum(size // 5 + 1)))


def similar(common, a, b):
    """Whether sets of ``a`` and ``b`` members with ``common`` of them in both have a similarity of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _digest(text):
    return F.unhex(F.md5(text))


def frequent_shingles(texts: DataFrame, few: int = FEW, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys of more than ``few`` texts, sorted, and the numbers of their texts: ``most`` of them at most, the more frequent ones.

    The least number of texts that counts comes from a histogram of these numbers (16 steps an octave), so nothing is sorted.
    """
    counts = texts.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") > few)
    counts = materialize(counts.withColumn("step", F.floor(F.log2("count") * 16).cast("int")), "copies-frequent")
    steps, least = sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True), None  # some hundreds
    for step, n in steps:
        most -= n
        if most < 0:
            break
        least = step
    found = counts.filter(F.col("step") >= (least if least is not None else 1 << 20)).select("key", "count").toArrow()
    release(counts)
    hashes = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("count").to_numpy()[order]


def sketched(docs: DataFrame, shared) -> DataFrame:
    """doc_id, digest, n (members of the set), fp and keys (its prefix) of every whole text. ``shared``: the frequent keys, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, ends = shingle_sets(batch.column("text"))
            keys, key_ends = prefixes(hashes, ends, *shared.value)
            lists = pa.ListArray.from_arrays(pa.array(key_ends.astype(np.int32)), long_array(keys))
            cols = [batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(ends).astype(np.int32)), long_array(fingerprints(hashes, ends)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "n", "fp", "keys"])

    own = _texts(docs).select("doc_id", "text", _digest("text").alias("digest"))
    return own.mapInArrow(run, "doc_id long, digest binary, n int, fp long, keys array<long>")


def texts_in_order(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # FREQUENT members at most
    made = sketched(docs, shared)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("low")
    own = made.groupBy("digest").agg(low, *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    texts = materialize(own.withColumn("id", F.monotonically_increasing_id()), "copies-texts")
    shared.unpersist()
    return texts


def distinct_texts(docs: DataFrame, few: int = FEW) -> DataFrame:
    """A row a distinct text: id (a number), digest, low (its smallest doc_id and whether that is null), n, fp and keys.

    Where keys in the order of their hashes are those of many texts, as a passage's are that many texts share, the
    prefixes are made again with these keys last.
    """
    none = np.zeros(0, np.int64)
    texts = texts_in_order(docs, none.view(np.uint64), none)
    frequent, rank = frequent_shingles(texts, few)
    if len(frequent):
        release(texts)
        texts = texts_in_order(docs, frequent, rank)
    return texts


def proposals(texts: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that SimHash links: of equal fingerprints, or of fingerprints within the radius."""
    fps = materialize(texts.groupBy("fp").agg(F.min("id").alias("first")), "copies-fingerprints")
    near = links(fps.select("fp"), RADIUS, bits_for(fps.count()))
    side = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id"))
    near = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    equal = texts.select("fp", "id").join(fps, "fp").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return near.unionByName(equal)


def repeated_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of rows that share both with another row."""
    own = _texts(docs).select("doc_id", _digest("text").alias("digest"))
    return materialize(own.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "digest"), "copies-repeated")


def _marked(names: DataFrame, repeated: DataFrame) -> DataFrame:
    """``names`` (doc_id, digest, ...) with ``many``: whether more than one row has both."""
    again = repeated.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    return names.join(again, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left").withColumn("many", F.col("d").isNotNull()).drop("i", "d")


def set_table(docs: DataFrame, texts: DataFrame, wanted: DataFrame, repeated: DataFrame, kind: type) -> DataFrame:
    """(id, own), written, of each of the ``wanted`` texts (id): its whole set (uint64), or 2 bytes of each member (uint16), sorted."""
    named = texts.select("id", "digest", F.col("low.doc_id").alias("doc_id")).join(wanted, "id", "left_semi")
    named = materialize(_marked(named, repeated), "copies-names").withColumnsRenamed({"doc_id": "low", "digest": "key"})
    if named.count() <= NAMED:
        named = F.broadcast(named)
    # One of the rows of a text is enough: one that has its smallest doc_id.
    own = _texts(docs).join(named, (_digest("text") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("low")))
    own = own.filter("not many").select("id", "text").unionByName(own.filter("many").select("id", "text").dropDuplicates(["id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, ends = shingle_sets(batch.column("text"))
            sets = [hashes[a:b] if kind is np.uint64 else sketch(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "own"])

    return materialize(own.mapInArrow(run, "id long, own binary"), "copies-sets")


def sketch(own: np.ndarray) -> np.ndarray:
    """The leading 16 bits of each member of a sorted set."""
    return (own >> np.uint64(48)).astype(np.uint16)


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Members of two sorted lists in common; of sketches, at least as many as of their sets."""
    return len(x) + len(y) - len(_either(x, y))


def _either(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each value as often as the list that has it more often."""
    number = lambda v: (v.astype(np.uint64) << np.uint64(32)) | (np.arange(len(v)) - np.searchsorted(v, v)).astype(np.uint64)
    return np.union1d(number(x), number(y)) if x.dtype == np.uint16 else np.union1d(x, y)


def verified(pairs: DataFrame, sets: DataFrame, kind: type) -> DataFrame:
    """The pairs (a, b: a written table) that are similar by their sets (uint64), or may be by their sketches (uint16); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name: [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
            good = [bool(similar(in_common(x, y), len(x), len(y))) for x, y in zip(read("x"), read("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Each side gets its sets by itself, so that only sets of pairs are shuffled, and few pairs are sent to the sets.
    first, second = (pairs.join(sets.select(F.col("id").alias(k), F.col("own").alias(v)), k) for k, v in (("a", "x"), ("b", "y")))
    return materialize(first.join(second, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "copies-verified")


def linked(ids: np.ndarray, sets: list[np.ndarray], keys: list[np.ndarray], probe: np.ndarray, both: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pairs (m, 2) of places of a probe and another text whose sets are similar: with what ``group`` connects, a forest that
    connects all such pairs that have a key in common.

    ``probe`` tells the copies of texts that are there to be probes; of two texts that are probes (``both``) the larger
    id's asks. Only pairs that are connected already are passed over.
    """
    size = np.array([len(x) for x in sets])
    base = np.flatnonzero(~probe)
    where = np.concatenate([np.full(len(keys[i]), i) for i in base]) if len(base) else np.zeros(0, np.int64)
    shared = np.concatenate([keys[i] for i in base]) if len(base) else np.zeros(0, np.int64)
    order = np.argsort(shared, kind="stable")
    shared, where = shared[order], where[order]
    group, out = group.copy(), []
    for i in np.flatnonzero(probe):
        lo, hi = np.searchsorted(shared, keys[i], "left"), np.searchsorted(shared, keys[i], "right")
        near = np.unique(np.concatenate([where[x:y] for x, y in zip(lo, hi)]))
        near = near[(group[near] != group[i]) & (~both[near] | (ids[near] < ids[i])) & similar(np.minimum(size[near], size[i]), size[near], size[i])]
        if not len(near):
            continue
        other = np.concatenate([sets[j] for j in near])
        at = np.minimum(np.searchsorted(sets[i], other), size[i] - 1)
        common = np.add.reduceat((sets[i][at] == other).astype(np.int64), np.concatenate(([0], np.cumsum(size[near])[:-1])))
        for j in near[similar(common, size[near], size[i])]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


def admissible(hot: DataFrame) -> DataFrame:
    """Of the texts (key, id, n, i: the key's place in the prefix) of each key those that it can be the first common key of
    with another, and ``probe``: whether as the shorter one, or one of equal sizes.

    If it is the first, the two have at most it and what comes after it in common. Of a text of n members with the key
    at place i a partner may thus have (5 n - 9 i) / 4 members at most. Texts of one template, whose own words come first
    in their order, are no partners of one another by this, however many they are.
    """
    most = F.floor((5 * F.col("n") - 9 * F.col("i")) / 4)
    tier = lambda n: F.floor(F.log(n.cast("double")) / 0.1).cast("int")  # noqa: E731  a tenth more members each
    hot = hot.withColumn("probe", most >= F.col("n")).withColumn("tier", tier(F.col("n")))
    met = hot.filter("probe").select("key", F.explode(F.sequence("tier", tier(most))).alias("tier")).distinct()
    return hot.join(met, ["key", "tier"], "left_semi").select("key", "id", "n", "probe")


def families(hot: DataFrame) -> DataFrame:
    """(bucket, id, n, probe, keys) of the texts (id, n, probe, key) of keys that many share.

    They meet in the key's bucket: the least such key of any text that has the key. So texts with many keys in common
    meet a few times, not once a key.
    """
    least = hot.groupBy("id").agg(F.min("key").alias("least"))
    buckets = hot.join(least, "id").groupBy("key").agg(F.min("least").alias("bucket"))
    return hot.join(buckets, "key").groupBy("bucket", "id").agg(F.first("n").alias("n"), F.max("probe").alias("probe"), F.collect_list("key").alias("keys"))


def compared(met: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(a, b): links within the families (bucket, id, n, probe, keys, root): blocks of all texts with blocks of probes, a task each."""
    blocks = lambda some: F.greatest(F.ceil(F.count_if(some) / block), F.ceil(F.sum(F.when(some, F.col("n"))) * 8 / BLOCK_BYTES)).cast("long")
    sizes = met.groupBy("bucket").agg(blocks(F.lit(True)).alias("blocks"), blocks(F.col("probe")).alias("probes"), (F.min("root") != F.max("root")).alias("open"))
    met = met.join(sizes.filter("open and probes > 0").select("bucket", "blocks", "probes"), "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = materialize(met.join(sets, "id"), "copies-open")
    names = ["id", "root", "keys", "own", F.col("probe").alias("both")]
    base = met.select("bucket", own("blocks").alias("i"), every("probes").alias("j"), F.lit(False).alias("probe"), *names)
    probes = met.filter("probe").select("bucket", every("blocks").alias("i"), own("probes").alias("j"), F.lit(True).alias("probe"), *names)

    def run(table: pa.Table) -> pa.Table:
        found = np.zeros((0, 2), np.int64)
        if table.num_rows > 1:
            table = table.sort_by([("probe", "ascending"), ("id", "ascending")])
            ids, group = table.column("id").to_numpy(), table.column("root").to_numpy()
            probe, both = (table.column(c).to_numpy() for c in ("probe", "both"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]
            keys = [np.array(k, np.int64) for k in table.column("keys").to_pylist()]
            found = ids[linked(ids, sets, keys, probe, both, group)]
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return base.unionByName(probes).groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def candidates(cold: DataFrame) -> DataFrame:
    """(a, b) of texts (key, id, n, i: the key's place in the prefix) with a key in common that may be the first of them.

    If it is, the sets have at most it and what comes after it in common, which must be enough for the similarity.
    """
    other = cold.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    pairs = cold.select("key", F.col("id").alias("a"), "n", "i").join(other, "key")
    return pairs.filter("a < b and 9 * least(n - i, m - j) >= 4 * (n + m)").select("a", "b").distinct()


def copy_links(docs: DataFrame, texts: DataFrame, repeated: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(a, b): links between ids of texts of similarity 0.8 or more, which connect all such pairs."""
    own = texts.select("id", "n", F.posexplode("keys").alias("i", "key"))
    shared = materialize(own.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "copies-keys")
    own = materialize(own.join(shared, "key"), "copies-shared")
    pairs = materialize(candidates(own.filter(F.col("texts") <= few)).unionByName(proposals(texts)).distinct(), "copies-pairs")
    met = materialize(families(admissible(own.filter(F.col("texts") > few).select("key", "id", "n", "i"))), "copies-met")
    release(shared, own)
    ends = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id")))
    sketches = set_table(docs, texts, ends(pairs).distinct(), repeated, np.uint16)
    likely = verified(pairs, sketches, np.uint16)
    release(sketches, pairs)
    sets = set_table(docs, texts, ends(likely).unionByName(met.select("id")).distinct(), repeated, np.uint64)
    found = verified(likely, sets, np.uint64)
    if not met.isEmpty():
        roots = materialize(components(found, "copies-groups"), "copies-groups").select(F.col("node").alias("id"), "root")
        met = met.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        found = materialize(found.unionByName(compared(met, sets, block)), "copies-links")
    release(sets)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of copies: the smallest doc_id's.

    Groups are the components of :func:`copy_links` between distinct texts. Ids are grouped, not texts: the documents
    are joined once with the ids that stay.
    """
    texts, repeated = distinct_texts(docs), repeated_rows(docs)
    roots = materialize(components(copy_links(docs, texts, repeated), "copies-links"), "copies-roots")
    rooted = texts.select("id", "digest", "low").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    best = F.min(F.struct("low", "digest")).alias("k")
    kept = rooted.groupBy(F.coalesce("root", "id").alias("root")).agg(best).select(F.col("k.low.doc_id").alias("doc_id"), F.col("k.digest").alias("digest"))
    kept = materialize(_marked(kept, repeated), "copies-kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    digest = _digest(F.coalesce(F.col("__row.text").cast("string"), F.lit("")))

    def stay(kept: DataFrame) -> DataFrame:
        kept = kept.select(F.struct("doc_id", "digest").alias("__kept"))
        return own.join(kept, F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__kept.doc_id")) & (digest == F.col("__kept.digest")))

    order = Window.partitionBy("__kept.doc_id", "__kept.digest").orderBy(F.to_json("__row"))
    repeated = stay(kept.filter("many")).withColumn("__no", F.row_number().over(order)).filter("__no = 1")
    return stay(kept.filter("not many")).select("__row.*").unionByName(repeated.select("__row.*"))
