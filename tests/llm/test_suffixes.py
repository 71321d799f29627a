import hashlib
import random

import numpy as np

from rivulet.llm import suffixes


def brute(rows, length=100):
    """By (doc_id or before all, text): removed flags of each byte."""
    seen, texts = {}, {(i, t or "") for i, t in rows}
    key = lambda i: -(1 << 63) if i is None else i
    starts = [(key(i), s, t.encode()[s : s + length], (i, t)) for i, t in texts for s in range(len(t.encode()) - length + 1)]
    for k, s, w, _ in starts:
        seen[w] = min(seen.get(w, (k, s)), (k, s))
    gone = {d: np.zeros(len(d[1].encode()), bool) for d in texts}
    for k, s, w, d in starts:
        if seen[w] < (k, s):
            gone[d][s : s + length] = True
    out = []
    for i, t in rows:
        raw, mark = np.frombuffer((t or "").encode(), np.uint8), gone[i, t or ""]
        spans = int(np.count_nonzero(mark[1:] & ~mark[:-1])) + int(mark[:1].sum())
        out.append((i, len(raw), int(mark.sum()), spans, hashlib.sha256(raw[~mark].tobytes()).hexdigest()))
    return sorted(out, key=str)


def result(docs, **how):
    return sorted((tuple(r) for r in suffixes.digests(suffixes.remove_repeats(docs, **how)).collect()), key=str)


def test_brute(docs, docs_rows):
    assert result(docs) == brute([r[:2] for r in docs_rows])


def test_other_lengths(docs, docs_rows):
    assert result(docs, length=40, token=12) == brute([r[:2] for r in docs_rows], 40)


def test_small_buckets_cross_boundaries(docs, docs_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 25)
    monkeypatch.setattr(suffixes, "TEXT_BUCKET", 10)
    assert result(docs) == brute([r[:2] for r in docs_rows])


def test_hot_passage_with_various_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    line = " ".join(word() for _ in range(10))  # under 100 bytes: hot tokens, few repeated windows
    rows = [(i, f"{' '.join(word() for _ in range(rng.randint(3, 20)))}{rng.choice('xyz')}{line}{rng.choice('uvw')}{' '.join(rng.choice(('one', 'two')) for _ in range(12))}") for i in range(150)]
    monkeypatch.setattr(suffixes, "TEXT_BUCKET", 40)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_multikey_order():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, k, 500) for k in (3, 2, 50, 4)]
    assert [tuple(w[i] for w in words) for i in suffixes.multikey_order(words)] == sorted(zip(*words))


def test_empty_and_clashing(spark, docs, no_docs):
    from pyspark.sql import functions as F

    assert result(no_docs) == []
    odd = docs
    for c in ("doc", "tag", "body", "ranges", "rest", "token", "place"):
        odd = odd.withColumn(c, F.lit("x"))
    cut = suffixes.remove_repeats(odd)
    assert cut.count() == docs.count()
    assert suffixes.cleaned(cut, odd.columns).columns == odd.columns


def test_cleaned_texts(spark):
    rows = [(1, "é" * 60 + "a"), (2, "b" + "é" * 60), (3, None), (4, "keep � me"), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.cleaned(suffixes.remove_repeats(frame), ["doc_id", "text"]).collect()}
    assert got == {1: got[1], 2: "b", 3: None, 4: "keep � me", 5: ""}


def test_many_texts_without_an_id(spark):
    """5,000 null ids: each text loses its own repeats only; so do texts that share any other id, the smallest long among them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(25))
    rows = [(None, f"{' '.join(word() for _ in range(22))}{' ' + passage if i % 50 == 0 else ''}") for i in range(5000)]
    rows += [(i, t[:110]) for i, (_, t) in zip([7] * 300 + [-(1 << 63)] * 300, rows[1:601])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_a_text_of_one_byte_fills_buckets_of_the_planned_size(spark, monkeypatch):
    """Such a text has an anchor a byte; buckets are planned from the anchors that there are."""
    monkeypatch.setattr(suffixes, "BUCKET", 20_000)
    rows = [(1, "z" * 200_000), (2, "ab" * 300 + "z" * 150), (3, "z" * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.select(*suffixes._owned(docs))
    units = suffixes.suffixes(own)
    n = units.count()
    found = suffixes.sort_buckets(units, -(-n // suffixes.BUCKET))
    assert n > 190_000 and found.select("bucket").distinct().count() >= 8
    got = sorted(tuple(r) for r in suffixes.digests(suffixes.remove_repeats(docs)).collect())
    assert got == sorted(brute(rows))
