"""The registered queries against their SQL, and the columns that their contracts name."""

from __future__ import annotations

import pytest
from check import compare, duck

from dnslens.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_host_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_shingle_join": "doc_id n_shingles component_id",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_language": "doc_id held_out lang_pred score",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op13_turn_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ok, note
    assert "types" not in note


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns(spark, name):
    assert queries.QUERIES[name](spark, SF).columns == COLUMNS[name].split()
