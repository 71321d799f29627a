import hashlib
import zlib
from collections import Counter, defaultdict

from rivulet.llm.sharding import interleave


def brute(rows, shards, seed):
    keyed = defaultdict(list)
    for i, text, _, source, _ in rows:
        raw = (text or "").encode()
        draw = hashlib.md5((seed + ("" if i is None else f":{i}")).encode()).hexdigest()
        keyed[source].append((draw, (i is not None, i or 0), zlib.crc32(raw), len(raw) + 8, i))
    flat = []
    for source, own in keyed.items():
        for r, (draw, key, crc, size, i) in enumerate(sorted(own)):
            flat.append(((2 * r + 1) / (2 * len(own)), (source is not None, source or ""), draw, key, crc, size, i))
    flat.sort()
    n = len(flat)
    out = []
    for p, x in enumerate(flat):
        shard = p * shards // n
        out.append((x[6], x[5], x[4], shard, p - -(-shard * n // shards)))
    return sorted(out, key=str)


def test_brute(docs, docs_rows):
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in interleave(docs, 7, "s").collect()]
    assert sorted(got, key=str) == brute(docs_rows, 7, "s")


def test_law_and_mixture(docs, docs_rows):
    rows = interleave(docs, 5).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    share = Counter(r[3] for r in docs_rows)["a"] / len(docs_rows)
    for shard, n in sizes.items():
        assert abs(sum(r.source == "a" for r in rows if r.shard == shard) - share * n) <= 2


def test_more_shards_than_rows_and_empty(spark, docs, no_docs):
    few = interleave(docs.limit(3), 24).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert interleave(no_docs).collect() == []


def test_clashing_names(docs):
    from pyspark.sql import functions as F

    odd = docs
    for c in ("rank", "frac", "shard", "slot", "size", "draw", "position", "__at", "__n"):
        odd = odd.withColumn(c, F.lit("x"))
    assert interleave(odd, 7).count() == docs.count()
