import random

import pyarrow as pa

from rivulet.llm import copies
from tests.llm.test_simhash import classes


def jaccard(a, b):
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").encode().lower().split())
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_keep_one(docs, docs_rows, no_docs):
    """Of equal texts one row stays, the smallest id's; whatever goes has a relative of some similarity; each family of relatives keeps one."""
    from pyspark.sql import functions as F

    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns
    got = [((r.doc_id is None, r.doc_id or 0), r.text or "") for r in kept.collect()]
    texts = sorted({r[1] or "" for r in docs_rows})
    low = {t: min((r[0] is None, r[0] or 0) for r in docs_rows if (r[1] or "") == t) for t in texts}
    assert len(set(got)) == len(got) and all(low[t] == i for i, t in got)
    related = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.3]
    family = dict(zip(texts, classes(len(texts), related)))
    stay = {t for _, t in got}
    assert {family[t] for t in stay} == set(family.values())
    assert stay < set(texts)
    assert copies.keep_one(no_docs).collect() == []
    assert copies.keep_one(docs.withColumn("id", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("k", F.lit(1))).count() == len(got)


def test_near_copies_are_found_and_others_kept(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    rows, expected = [], 0
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        rows.append(" ".join(base))
        expected += 1
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for k in rng.sample(range(len(copy)), len(copy) // 60):
                copy[k] = rng.choice(words)
            if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
                rows.append(" ".join(copy))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    kept = [r.doc_id for r in copies.keep_one(frame).collect()]
    firsts = [i for i, t in enumerate(rows) if not any(jaccard(t, u) > 0.5 for u in rows[max(0, i - 7) : i])]
    assert set(firsts) <= set(kept) and len(kept) <= expected * 1.03


def edited(rng, words, base, kind, share):
    """A copy of ``base`` that is cut, appended to, or has words inserted: ``share`` of its words."""
    k, new = int(len(base) * share), [rng.choice(words) + "q" for _ in range(int(len(base) * share))]
    if kind == "cut":
        return base[: len(base) - k]
    if kind == "append":
        return base + new
    at = rng.randint(0, len(base))
    return base[:at] + new + base[at:]


def held_against_brute(spark, texts, **how):
    """Links are of similarity 0.8 or more, and connect all such pairs; equal texts are one."""
    texts = list(dict.fromkeys(texts))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = copies.distinct_texts(frame)
    place = {r.id: r.low.doc_id for r in nodes.collect()}
    got = [(place[r.a], place[r.b]) for r in copies.copy_links(frame, nodes, copies.repeated_rows(frame), **how).collect()]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in got)
    assert classes(len(texts), got) == classes(len(texts), near)
    kept = sorted(r.doc_id for r in copies.keep_one(frame).collect())
    assert kept == sorted(set(classes(len(texts), near)))
    return near


def test_cut_appended_and_inserted_copies_are_all_found(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    texts = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((12, 40, 150, 400)))]
        texts.append(" ".join(base))
        for kind in ("cut", "append", "insert"):
            texts.append(" ".join(edited(rng, words, base, kind, rng.uniform(0.02, 0.24))))
    assert len(held_against_brute(spark, texts)) > 80


def test_less_similar_texts_stay(spark):
    """Texts of similarity 0.4 to 0.79 are not copies, and chains of them delete nothing."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    texts = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(300)]
        texts.append(" ".join(base))
        for share in (0.27, 0.35, 0.5, 0.8):
            texts.append(" ".join(edited(rng, words, base, "append", share)))
    assert all(0.4 < jaccard(texts[i], texts[0]) < 0.8 for i in (1, 2, 3, 4))
    near = held_against_brute(spark, texts)
    frame = spark.createDataFrame([(5 * g + k, texts[5 * g + k]) for g in range(30) for k in (0, 1)], "doc_id long, text string")
    assert not any(j % 5 == 0 for _, j in near) and copies.keep_one(frame).count() == 60


def test_crowds_of_one_vocabulary_lose_no_pair(spark):
    """400 texts of one set of words, each with a near copy: whichever texts stand between the two, they are linked."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    opening = [rng.choice(words) for _ in range(12)]
    texts = []
    for _ in range(400):
        own = rng.sample(words, 60)
        texts += [" ".join(opening + own), " ".join(opening + own[1:] + own[:1])]
    near = held_against_brute(spark, texts)
    assert {(2 * k + 1, 2 * k) for k in range(400)} <= set(near)
    assert held_against_brute(spark, texts[:60], block=3, few=2) == [p for p in near if p[0] < 60]


def test_sets_and_fingerprints():
    texts = ["One two  three four five six one two three four five", "", None, "a b", "A\tB", " ", "é x y z w é"]
    hashes, ends = copies.shingle_sets(pa.array(texts))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    for x, a in zip(texts, sets):
        for y, b in zip(texts, sets):
            assert len(a & b) / len(a | b) == jaccard(x, y)
    want = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) for own in sets]
    assert copies.fingerprints(hashes, ends).tolist() == want


def test_simhash_proposes_and_the_join_completes(spark):
    """A family of one substituted word each is linked by SimHash alone; pairs near the threshold come from the join."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    base = [rng.choice(words) for _ in range(2000)]
    texts = [" ".join(base)] + [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 400, 4)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = copies.distinct_texts(frame)
    place = {r.id: r.low.doc_id for r in nodes.collect()}
    proposed = [(place[r.a], place[r.b]) for r in copies.proposals(nodes).collect()]
    assert len(set(classes(len(texts), proposed))) == 1 and len(proposed) < 10 * len(texts)
    held_against_brute(spark, texts)


def test_rows_that_share_id_and_text(spark):
    rows = [(1, "same text of an id", "b"), (1, "same text of an id", "a"), (1, "same text of an id", "a"), (2, "same text of an id", "0"), (None, None, "z"), (None, "", "y"), (1, "another text of this id", "c")]
    kept = copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "same text of an id", "a"), (None, None, "z"), (1, "another text of this id", "c")], key=str)


def test_sketches_drop_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 20_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 64, n - int(len(a) * share), np.uint64)]))
            common = len(np.intersect1d(a, b))
            assert copies.in_common(a, b) == common <= copies.in_common(copies.sketch(a), copies.sketch(b)) <= common + 10 + n * n // 65536
