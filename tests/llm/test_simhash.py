import random

import numpy as np
import xxhash

from rivulet.llm import simhash


def brute_fp(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and find(i) != find(j):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_brute(docs, docs_rows):
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components([r[:2] for r in docs_rows])


def test_matches_spark_xxhash(spark):
    text = "four words make one"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] == np.array([brute_fp(text)], np.uint64).view(np.int64)[0]


def classes(n, pairs):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for i in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << i
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for bits in (6, 9):
        pairs = [(r.a, r.b) for r in simhash.links(frame, 4, bits).collect()]
        place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        edges = np.array([(place[a], place[b]) for a, b in pairs])
        assert near[edges[:, 0], edges[:, 1]].all()
        assert classes(len(fps), np.argwhere(near)) == classes(len(fps), edges)


def test_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 50, np.uint64) ^ np.uint64(k) for k in (0, 3, 7 << 40, 1)]))
    fps = fps[(fps >> np.uint64(58)) < 4]
    one = simhash.collisions(1, fps, 2, 6)
    monkeypatch.setattr(simhash, "LISTED", 500)
    assert np.array_equal(one, simhash.collisions(1, fps, 2, 6))


def test_empty_and_clashing(spark, docs, no_docs):
    from pyspark.sql import functions as F

    assert simhash.near_duplicates(no_docs).collect() == []
    odd = docs.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("root", F.lit(2))
    assert simhash.near_duplicates(odd).count() == docs.count()


def test_dense_regions_are_split_and_lose_nothing(spark):
    """8,000 fingerprints around one centre: parts beyond ``crowd`` are split, and links connect the same classes."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 8000:
        x = centre
        for i in rng.sample(range(64), rng.randint(3, 9)):
            x ^= 1 << i
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = [(r.a, r.b) for r in simhash.links(frame, 4, 6, crowd=1500).collect()]
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    edges = np.array([(place[a], place[b]) for a, b in pairs])
    assert (np.bitwise_count(fps[edges[:, 0]] ^ fps[edges[:, 1]]) <= 4).all()
    near = np.concatenate([np.argwhere(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 4) + [i, 0] for i in range(0, len(fps), 500)])
    assert classes(len(fps), near[near[:, 0] > near[:, 1]]) == classes(len(fps), edges)
