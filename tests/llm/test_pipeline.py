import hashlib

import pytest

import corpus_pipeline
from tests.llm.test_bpe import ENC
from tests.llm.test_suffixes import brute as repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    item = docs.filter("doc_id = 20").first().text
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_in_turn(spark, docs, folder):
    frame, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, folder)
        if name != "tokens":
            assert out.dtypes == docs.dtypes
        frame = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = frame.collect()
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("near_duplicates") <= ids("toxicity") and 101 not in ids("near_duplicates")
    before = [(r.doc_id, r.text) for r in seen["near_duplicates"]]
    want = {(i, n - gone): digest for i, n, gone, _, digest in repeats(before)}
    for r in seen["repeated_passages"]:
        if (r.text or "").isascii():
            assert want[r.doc_id, len(r.text or "")] == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.n_chars == (None if r.text is None else len(r.text))
    if 20 in ids("repeated_passages"):
        assert 20 not in ids("benchmark_leaks")
    assert len(seen["benchmark_leaks"]) >= len(seen["repeated_passages"]) - 4
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in seen["benchmark_leaks"])
    assert sorted(r.decoded_sha256 for r in seen["tokens"]) == texts
    assert sum(r.n_tokens for r in seen["tokens"]) == sum(len(ENC.encode_ordinary(r.text or "")) for r in seen["benchmark_leaks"])


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_empty(spark, no_docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, folder).collect() == []
