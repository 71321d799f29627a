"""The registered queries: columns and types of the contracts, and equality with SQL where there is some."""

import pytest

from rivulet.llm import queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_suffix_array": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_matroska": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    frame = queries.queries()[name](spark, SF)
    want = COLUMNS[name].split(", ")
    assert [" ".join(x) for x in frame.dtypes][: len(want)] == want
    key = frame.columns[0]
    table = "pages" if key == "page_id" else "documents"
    assert frame.select(key).count() == queries.table(spark, SF, table).count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert not differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_leaks_are_found(spark):
    rows = queries.op2_spaced_seeds(spark, SF).collect()
    assert rows and all(r.identity >= 0.75 for r in rows)
