"""Vector codes, hard negatives and approximate neighbours against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import ann, codes, negatives, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, score double"


def made(n, width, seed=3, labels=4):
    """Clusters, copies, repeated rows and ids, ties, nulls, and vectors that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    point = lambda: [float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centres)]
    rows = [(i, point(), rng.choice([*range(labels), None])) for i in range(n)]
    same = point()
    rows += [(1000 + i, same, i % 3) for i in range(n // 3)]  # a third are copies
    rows += rows[:3] + [(5, point(), 1), (2000, None, 1), (2001, [float("nan")] * width, 1), (2002, [float("inf")] * width, 1), (2003, [None, *same[1:]], 1), (2100, [0.0] * width, 1), (2101, same[: width - 3], 2), (2102, [], 3), (None, point(), 1), (2200, [2 * x for x in same], 2)]
    return [(*r, "x", 0.5) for r in rows]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(v, width):
    return [*v, *[0.0] * (width - len(v))]


@pytest.fixture(scope="module")
def rows():
    return made(120, 8)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_codes(rows, parts, entries, rounds, scale=1024):
    width = -(-max(len(r[1]) for r in rows if r[1] is not None) // parts) * parts
    kept = [(r[0], r[2], [math.floor(scale * x) for x in padded(r[1], width)]) for r in rows if usable(r[1])]
    w = width // parts
    cut = lambda q: [q[p * w : p * w + w] for p in range(parts)]
    little = lambda q: np.array(q, "<i4").tobytes()
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, little(r[2])))[:entries]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        used = {}
        for _, _, q in kept:
            for p, v in enumerate(cut(q)):
                used.setdefault((p, nearest(v, p)[1]), []).append(v)
        for (p, e), vs in used.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    out = []
    for i, label, q in kept:
        near = [nearest(v, p) for p, v in enumerate(cut(q))]
        out.append((i, label, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near)))
    by = {}
    for _, label, _, e in out:
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by[label], digest) for i, label, c, e in out), key=str)


def test_codes(frame, rows, monkeypatch):
    monkeypatch.setattr(codes, "NAMED", 2)  # labels by a join
    coded, books = codes.compress(frame, entries=16)
    got = codes.with_label_error(coded).collect()
    assert sorted(((r.vec_id, r.code.hex(), r.error, r.label_error, books.digest()) for r in got), key=str) == brute_codes(rows, 4, 16, 4)


def test_codes_with_more_entries_than_vectors(frame, rows):
    got = codes.digests(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_codes(rows, 4, 256, 4)


def test_search_is_exact_from_any_start():
    rng = np.random.default_rng(1)
    books = codes.Books(rng.integers(-9, 9, (1, 40, 3)))  # many ties
    x = rng.integers(-12, 12, (500, 3))
    d = ((x[:, None] - books.entries[0][None]) ** 2).sum(2)
    for start in (np.zeros(500, np.int64), rng.integers(0, 40, 500)):
        entry, far = books.nearest(0, x, start)
        assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()


def test_no_vectors(nothing):
    assert codes.digests(nothing).collect() == []
    assert negatives.hard_negatives(nothing.select("vec_id", "label", "embedding"), F.col("vec_id") % 10 == 0).collect() == []
    assert ann.search(nothing, F.col("vec_id") % 10 == 0).collect() == []


def test_too_large_a_component(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exact range"):
        codes.digests(frame).collect()


def brute_negatives(rows, every, scale=256):
    width = max(len(r[1]) for r in rows if r[1] is not None)
    kept = [(r[0], r[2], [math.floor(scale * x) for x in padded(r[1], width)]) for r in rows if usable(r[1]) and r[0] is not None and r[2] is not None]
    out = set()
    for a, label, q in {(r[0], r[1], tuple(r[2])) for r in kept if r[0] % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, r[2])), r[0], r[1]) for r in kept if r[0] != a)
        for s, i, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out |= {(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize(("span", "block", "step"), [(4096, 2048, 1024), (50, 7, 3)])
def test_negatives(frame, rows, monkeypatch, span, block, step):
    monkeypatch.setattr(negatives, "RANGE", (span, span))
    monkeypatch.setattr(negatives, "BLOCK", (block, block))
    monkeypatch.setattr(negatives, "STEP", step)
    monkeypatch.setattr(negatives, "BUCKET", 16)
    found = negatives.hard_negatives(frame.select("vec_id", "label", "embedding"), F.col("vec_id") % 10 == 0)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute_negatives(rows, 10) and got


def test_buckets_are_pruned(spark):
    """Short vectors that no anchor needs are not sent to it."""
    rows = negatives.rows_by_norm(spark.createDataFrame([(i, i % 2, [10.0 if i < 20 else 0.01, 0.0]) for i in range(60)], "vec_id long, label int, embedding array<double>"), 256, 2)
    anchors = rows.filter("id = 0").drop("range").withColumn("no", F.lit(0).cast("long")).withColumn("need", F.lit(100.0))
    tops = [(0, 2560.0), (1, 2.0), (2, 0.01)]
    left, _ = negatives._cells(anchors, rows, tops, 1)
    assert [r["range"] for r in left.collect()] == [0, 1]


def brute_near(rows, every, k=5):
    width = max(len(r[1]) for r in rows if r[1] is not None)
    kept = {(r[0], tuple(padded(r[1], width))) for r in rows if usable(r[1]) and any(r[1]) and r[0] is not None}
    norm = lambda v: math.sqrt(math.fsum(x * x for x in v))
    out = {}
    for i, v in kept:
        if i % every == 0:
            near = sorted((-round(math.fsum(x * y for x, y in zip(v, w)) / (norm(v) * norm(w)), 12), j) for j, w in kept if (j, w) != (i, v))
            out[i, v] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours_of_clusters(frame, rows):
    want = brute_near(rows, 10)
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 12))
    assert set(got) == {i for i, _ in want}
    hits = total = 0
    for (i, _), near in want.items():
        assert sorted(got[i]) == list(range(1, len(near) + 1))
        hits += sum((j, s) in got[i].values() for j, s in near)
        total += len(near)
    assert hits >= 0.9 * total


def test_few_candidates_are_all_found(spark):
    rng = random.Random(2)
    rows = [(i * 10, [rng.gauss(0, 1) for _ in range(20)], 0, "", 0.0) for i in range(4)] + [(1, [0.0] * 20, 0, "", 0.0)]
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()}
    exact = brute_near([(i, [float(np.float32(x)) for x in v], *_) for i, v, *_ in rows], 10)
    assert got == {(i, n, j) for (i, _), near in exact.items() for n, (j, _) in enumerate(near, 1)}
    assert len(got) == 12


def test_blocks_of_a_bucket(frame, monkeypatch):
    whole = {tuple(r) for r in ann.search(frame, F.col("vec_id") % 10 == 0).collect()}
    monkeypatch.setattr(ann, "BLOCK", 5)
    monkeypatch.setattr(ann, "QUERIES", 4)
    monkeypatch.setattr(ann, "STEP", 2)
    assert {tuple(r) for r in ann.search(frame, F.col("vec_id") % 10 == 0).collect()} == whole


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    """Isotropic vectors, the hardest case: neighbours hardly nearer than chance."""
    table = queries.table(spark, folder, "embeddings").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = queries.op13_cross_polytope(spark, folder).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits.append(len(found[ids[q]] & set(ids[np.argsort(-s)[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_rotations_keep_lengths_and_calibrate():
    x = np.random.default_rng(0).standard_normal((50, 20))
    y = ann.rotated(x, ann.signs(20, 1, 5)[0])
    assert np.allclose((y * y).sum(1), (x * x).sum(1))
    cosines, share = ann.chances(20)
    assert (np.diff(share[:, 4]) > -0.03).all() and share[-1, 0] > 0.5 and (share[:, -1] == 1).all()
    assert ann.probes_needed(20, 4, np.array([np.nan, 0.95]), 0.96).tolist()[0] == share.shape[1]


def test_packing():
    x = np.arange(12, dtype=np.int32).reshape(4, 3)
    column = vectors.packed(x)
    assert (vectors.unpacked(column, np.int32, 3) == x).all() and (vectors.unpacked(column.slice(1, 2), np.int32, 3) == x[1:3]).all()
    assert vectors.unpacked(vectors.packed(np.zeros((2, 0), np.int32)), np.int32, 0).shape == (2, 0)
    big = np.array([[1 << 24, -(1 << 24)]])
    assert vectors.products(big, big).tolist() == [[1 << 49]]
    huge = np.array([[1 << 27] * 4])
    assert vectors.products(huge, huge).tolist() == [[1 << 56]]
