import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontam

BENCH = "item_id long, text string"


def tokens(text):
    out, own = [], bytearray()
    for b in (text or "").lower().encode() + b" ":
        if 48 <= b < 58 or 97 <= b < 123 or b >= 128:
            own.append(b)
        elif own:
            out.append(bytes(own))
            own = bytearray()
    return out


def brute(docs, items):
    """Documents and items with a diagonal whose best stretch is an overlap and that holds a hit of some mask."""
    out = {}
    for d, text in docs:
        a = tokens(text)
        for i, item in items:
            b = tokens(item or "")
            best = 0
            for diagonal in range(-len(a), len(b)) if len(b) >= decontam.FEWEST else ():
                lo, hi = max(0, -diagonal), min(len(a), len(b) - diagonal)
                same = [a[k] == b[k + diagonal] for k in range(lo, hi)]
                if not any(all(same[s + j] for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(len(same) - len(m) + 1)):
                    continue
                top, score, start, span = 0, 0, 0, None
                for k, x in enumerate(same):
                    if score <= 0:
                        score, start = 0, k
                    score += 1 if x else -decontam.PENALTY
                    if score > top:
                        top, span = score, (start, k + 1)
                if span:
                    n, m = span[1] - span[0], sum(same[span[0] : span[1]])
                    if n >= min(decontam.LEAST, len(b)) and m >= decontam.IDENTITY * n:
                        best = max(best, m)
            if best:
                out[d, i] = best
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    line = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, line(rng.randint(6, 50))) for i in range(20)] + [(20, line(5)), (21, line(3))]
    docs = []
    for d in range(120):
        text = line(rng.randint(0, 80))
        if d % 3 == 0:
            item = list(items[d % 22][1])
            for k in range(len(item)):
                if rng.random() < 0.12 * (d % 4):
                    item[k] = "zz"
            at = rng.randint(0, len(text))
            text = text[:at] + [w.upper() if d % 2 else w + "," for w in item] + text[at:]
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, " ".join(items[3][1])), (502, " ".join(items[3][1])), (None, " ".join(items[4][1])), (503, " ".join(items[5][1] * 3000))]
    return docs, [(i, " ".join(x)) for i, x in items] + [(30, None), (None, "a b c d e f g h"), (31, " ".join(items[3][1])), (32, "")]


def test_brute(spark, case):
    docs, items = case
    small = [x for x in docs if x[0] != 503]
    frame = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.matches for r in decontam.overlaps(frame, spark.createDataFrame(items, BENCH)).collect()}
    assert got == brute(small, items)


def test_ranges_blocks_and_long_text(spark, case, monkeypatch):
    docs, items = case
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, BENCH)
    one = sorted(decontam.overlaps(frame, bench).collect(), key=str)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert len(list(decontam.blocks(bench, 200))) > 3
    monkeypatch.setattr(decontam.blocks, "__defaults__", (200,))
    assert sorted(decontam.overlaps(frame, bench).collect(), key=str) == one
    texts, known = dict(docs), dict(items)
    for r in one:
        part = texts[r.doc_id].encode()[r.start : r.end].decode() if r.doc_id is not None else known[4]
        assert len(tokens(part)) == r.length == r.item_end - r.item_start
    assert any(r.doc_id == 503 for r in one)
    kept = decontam.remove_contaminated(frame, bench)
    bad = {r.doc_id for r in one}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_case_of_any_letter():
    import pyarrow as pa

    item = "Élan vôtre ñandú über ΑΒΓ Жизнь ça coûte"
    index = decontam.Index.of([(1, item)])
    for text in (item.upper(), item.lower(), "İ " + item.upper()):
        (row,) = decontam.best_overlaps(index, pa.array([text]))
        assert text.encode()[row[2] : row[3]].decode() == text.removeprefix("İ ")


def test_substitutions_up_to_a_fifth_are_found():
    rng = np.random.default_rng(4)
    item = [f"w{k}" for k in rng.integers(0, 5000, 40)]
    index = decontam.Index.of([(1, " ".join(item))])
    import pyarrow as pa

    found = 0
    for _ in range(200):
        own = list(item)
        for k in rng.choice(40, 6, replace=False):
            own[k] = "x"
        found += bool(decontam.best_overlaps(index, pa.array(["some text " + " ".join(own) + " more"])))
    assert found >= 198


def test_empty_and_clashing(spark, docs, no_docs, case):
    bench = spark.createDataFrame(case[1], BENCH)
    assert decontam.overlaps(no_docs, bench).collect() == []
    assert decontam.overlaps(docs, bench.limit(0)).collect() == []
    assert decontam.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
    odd = docs.withColumn("item_id", F.lit("x")).withColumn("start", F.lit(None).cast("int"))
    assert decontam.remove_contaminated(odd, bench.withColumn("doc_id", F.lit(1))).columns == odd.columns


def by_rule(doc, item):
    """Written from the rule: any window of 13 tokens or more (or a whole shorter item) of which 3 of 4 match; all of an item of under 6."""
    if len(item) < 6:
        return any(doc[k : k + len(item)] == item for k in range(len(doc)))
    least = min(13, len(item))
    for diagonal in range(-len(doc), len(item)):
        lo, hi = max(0, -diagonal), min(len(doc), len(item) - diagonal)
        same = [doc[k] == item[k + diagonal] for k in range(lo, hi)]
        if any(4 * sum(same[s:e]) >= 3 * (e - s) for s in range(len(same)) for e in range(s + least, len(same) + 1)):
            return True
    return False


def test_whole_rule_misses_nothing(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    items, docs = [], []
    for n in (6, 7, 8, 9, 11, 12, 13, 13, 15, 16, 18, 20, 26, 40, 5):
        items.append([rng.choice(words) for _ in range(n)])
        for _ in range(12):
            own = list(items[-1])
            for k in rng.sample(range(n), min(n, round(n * rng.choice((0.08, 0.15, 0.2, 0.25, 0.3))))):
                own[k] = "x"
            docs.append([rng.choice(words) for _ in range(rng.randint(0, 9))] + own + [rng.choice(words) for _ in range(rng.randint(0, 9))])
    long = [f"v{k}" for k in range(89)]
    items += [long]
    docs += [["x" if k % 4 == 3 else w for k, w in enumerate(long)], ["x" if k % 4 == 0 else w for k, w in enumerate(long[:16])]]
    docs += [["x" if k % 19 > 12 else w for k, w in enumerate(long)], ["x" if k % 3 == 2 else w for k, w in enumerate(items[2])]]
    expected = {(d, i) for d, a in enumerate(docs) for i, b in enumerate(items) if by_rule(a, b)}
    text = lambda rows: [(k, " ".join(r)) for k, r in enumerate(rows)]
    frame, bench = spark.createDataFrame(text(docs), "doc_id long, text string").repartition(3), spark.createDataFrame(text(items), BENCH)
    rows = decontam.overlaps(frame, bench, True).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected
    for r in rows:
        assert r.length >= min(13, len(items[r.item_id])) and 4 * r.matches >= 3 * r.length
        part = " ".join(docs[r.doc_id]).encode()[r.start : r.end].decode().split()
        assert r.matches == sum(a == b for a, b in zip(part, items[r.item_id][r.item_start : r.item_end], strict=True))
    assert {r.doc_id for r in decontam.remove_contaminated(frame, bench, True).collect()} == set(range(len(docs))) - {d for d, i in expected if len(items[i]) >= 6 or docs[d] == items[i]}
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(frame, bench).collect()} < expected


def best_by_rule(doc, item):
    """(matches, diagonal) of the best window of all diagonals."""
    own = {w: k for k, w in enumerate(sorted(set(doc + item)))}
    a, b = (np.array([own[w] for w in x], np.uint64) for x in (doc, item))
    found = [(w[2], -d) for d in range(1 - len(a), len(b)) if (w := decontam.window(a, b, d))]
    return max(found, default=None)


def test_repeated_words_cost_diagonals_not_pairs():
    import time

    import pyarrow as pa

    rng = random.Random(3)
    item = ["spam"] * 60 + [rng.choice("abc") for _ in range(60)]
    texts = [["spam"] * 300, [rng.choice("abc") for _ in range(300)], ["spam", "a"] * 150, ["x"] * 50 + item[40:100] + ["spam"] * 20]
    index = decontam.Index.of([(1, " ".join(item)), (2, "none of this")], True)
    rows = {r[0]: (r[6], r[2], r[4]) for r in decontam.best_overlaps(index, pa.array([" ".join(t) for t in texts]))}
    for k, t in enumerate(texts):
        want = best_by_rule(t, item)
        assert (k in rows) == (want is not None) and (want is None or rows[k][0] == want[0])
    big = decontam.Index.of([(1, "spam " * 5000)], True)
    began = time.perf_counter()
    (row,) = decontam.best_overlaps(big, pa.array(["spam " * 20_000]))
    assert row[6:8] == (5000, 5000) and row[2] == 75_000 and time.perf_counter() - began < 20


def test_short_items_and_items_without_an_id(spark):
    docs = [(1, "the answer is forty two today"), (2, "Forty, two!"), (3, "two forty"), (4, "yes"), (5, "yes yes")]
    items = [(None, "forty two"), (9, "yes"), (8, "...")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    got = sorted(((r.doc_id, r.item_id, r.start, r.end) for r in decontam.overlaps(frame, bench, True).collect()), key=str)
    assert got == sorted([(1, None, 14, 23), (2, None, 0, 10), (4, 9, 0, 3), (5, 9, 0, 3)], key=str)
    assert sorted(r.doc_id for r in decontam.remove_contaminated(frame, bench, True).collect()) == [1, 3, 5]


def test_recall_by_length_and_substitutions():
    """Every overlap that the rule accepts is found, whatever the places of the substitutions."""
    import pyarrow as pa

    rng = random.Random(21)
    for n, most in ((13, 3), (14, 3), (16, 4), (18, 4), (20, 5), (40, 10)):
        item = [f"t{k}" for k in range(n)]
        index = decontam.Index.of([(1, " ".join(item))], True)
        texts = []
        for _ in range(150):
            own = list(item)
            for k in rng.sample(range(n), rng.randint(0, most)):
                own[k] = "x"
            texts.append(["y"] * rng.randint(0, 3) + own)
        found = {r[0] for r in decontam.best_overlaps(index, pa.array([" ".join(t) for t in texts]))}
        assert found == {k for k, t in enumerate(texts) if by_rule(t, item)}
