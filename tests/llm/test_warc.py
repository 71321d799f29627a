import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from rivulet.llm import warc

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages_rows():
    rng = random.Random(4)
    rows = [(i, f"http://www.{rng.choice('abc')}.example.com/{rng.choice('xyz')}?b=2&a={rng.randint(0, 2)}", "".join(rng.choice("ab<>é ") for _ in range(rng.randint(0, 3000)))) for i in range(80)]
    big, small, edge = "B" * 1000, "s" * 999, "é" * 500
    rows += [(200, "http://a.example/1", big), (203, "http://a.example/1", big), (201, None, big), (204, "http://a.example/2", small), (205, "http://a.example/2", small)]
    rows += [(206, "http://a.example/e", edge), (207, "http://a.example/e", edge), (208, "http://a.example/n", None), (209, "", ""), (None, "http://n.example/", big), (300, "odd url\r\nX: y é", "x"), (301, "http://a.example/1", "long" * 300_000), (301, "http://a.example/1", "long" * 300_000), (-5, "http://neg.example:8080/P", "\r\n\r\n" * 300)]
    return rows


def brute(rows):
    top = {}
    low = lambda i: (i is not None, i or 0)
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000:
            top[p] = max(top.get(p, low(i)), low(i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in top and low(i) < top[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top[p][1] if again else None))
    return sorted(out, key=str)


def test_brute_and_global_order(spark, pages_rows):
    pages = spark.createDataFrame(pages_rows, SCHEMA).repartition(5)
    archives = warc.write_archives(pages)
    captures = warc.read_archives(archives)
    merged = warc.merge_runs(captures).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in merged), key=str) == brute(pages_rows)
    keys = [warc.order_of(tuple(r)) for r in merged]  # partitions come in order
    assert keys == sorted(keys)
    assert sorted(str(r.url) for r in merged) == sorted(str(u or None) for _, u, _ in pages_rows)
    history = warc.histories(captures).collect()
    for key in {r.urlkey for r in history}:
        own = sorted((r.capture_no, warc.order_of(tuple(r)[:11])) for r in history if r.urlkey == key)
        assert [n for n, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)


def test_offsets_point_to_records(spark, pages_rows):
    archives = warc.write_archives(spark.createDataFrame(pages_rows, SCHEMA).repartition(2))
    where = {r.archive.rsplit("/", 1)[1]: r.archive for r in archives.collect()}
    assert sum(r.records for r in archives.collect()) == len(pages_rows)
    for r in warc.read_archives(archives).collect()[:30]:
        fs, path = warc.files(where[r.archive])
        with fs.open_input_file(path) as f:
            data = gzip.decompress(f.read_at(r.length, r.offset))
        assert warc.capture(data, r.archive, r.offset, r.length)[:8] == tuple(r)[:8]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    lists = [sorted((rng.randint(0, 50), i) for _ in range(rng.randint(0, 40))) for i in range(k)]
    assert list(warc.LoserTree(lists, key=lambda x: x)) == sorted(x for own in lists for x in own)


def test_members_and_damage():
    parts = [gzip.compress(bytes([i]) * (i * 1000)) for i in range(5)]
    got = list(warc.members(io.BytesIO(b"".join(parts)), 100))
    assert [n for _, n, _ in got] == [len(p) for p in parts] and [d for *_, d in got] == [bytes([i]) * (i * 1000) for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(parts[4][:-9])))
    good = warc.record(1, "http://x/", b"abc", None, False, warc.sha1_base32(b"abc"))
    assert warc.capture(good, "a", 0, 1)[4:7] == (3, hashlib.sha1(b"abc").hexdigest(), "response")
    with pytest.raises(ValueError):
        warc.capture(good.replace(b"abc", b"abd"), "a", 0, 1)
    with pytest.raises(ValueError):
        warc.parse_record(good[:-5])


def test_url_keys():
    assert warc.url_key("https://WWW.Shop.Example.com:443/A/b?z=1&a=2") == "com,example,shop)/a/b?a=2&z=1"
    assert warc.url_key(None) == warc.url_key("") == "" and warc.url_key("http://[bad") == "http://[bad"


def test_empty_and_clashing(spark, pages_rows):
    none = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and warc.merge_runs(warc.read_archives(none)).collect() == []
    odd = spark.createDataFrame(pages_rows, SCHEMA)
    for c in ("key", "payload", "shared", "keep", "refers_to", "archive"):
        odd = odd.withColumn(c, F.lit("x"))
    assert warc.read_archives(warc.write_archives(odd)).count() == len(pages_rows)


def test_histories_over_many_ranges(spark, monkeypatch):
    """One URL with a third of the captures spans many ranges; its history is numbered through, as are the others."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i % 17}.example/{i % 5}", f"p{i}") for i in range(600)]
    rows += [(None, "http://hot.example/", "x"), (None, None, "y")]
    captures = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    history = warc.histories(captures).collect()
    assert len(history) == len(rows)
    for key in {r.urlkey for r in history}:
        own = sorted((warc.order_of(tuple(r)[:11]), r.capture_no) for r in history if r.urlkey == key)
        assert [n for _, n in own] == list(range(len(own)))


def test_archives_are_read_by_a_task_each(spark):
    archives = warc.write_archives(spark.createDataFrame([(i, f"http://a.example/{i}", "x" * 2000) for i in range(64)], SCHEMA).repartition(8))
    read = archives.select("archive").repartition(max(1, archives.count()))
    assert read.rdd.getNumPartitions() == archives.count()
