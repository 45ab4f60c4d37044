"""The registered queries over the smallest given tables, and their SQL."""

import os

import pytest

from rulesieve.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")

COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_topk": "query_id rank vec_id score",
    "op3_substrings": "doc_id n_words n_removed kept_sha256",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_matroska": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_sentencepieces": "doc_id n_ids ids_crc32 decoded_sha256 round_trip",
    "op9_quality": "doc_id held_out score predicted",
    "op11_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_infill": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    if name not in ("op2_topk", "op10_packing"):
        assert found.count() == documents
    kinds = dict(found.dtypes)
    longs = "doc_id component_id n_words n_removed n_tokens n_known train_tokens n_bytes payload_bytes tail_crc32 media_bytes n_assign start length ids_crc32 doc_tokens sequence_id offset vec_id query_id n n_a n_b n_groups n_links n_best count_sum n_base first_word last_word prefix_chars middle_chars"
    assert all(kinds[c] == "bigint" for c in longs.split() if c in kinds)


def test_matroska_payloads(spark):
    import hashlib
    import zlib

    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in QUERIES["op6_matroska"](spark, SF_DIR).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["n_bytes"] == len(raw) and r["feature"].endswith(":complete")


def test_registered_by_the_driver_file():
    import __spark_entry__ as driver

    assert {*QUERIES, "pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
