"""Each registered query over the whole smallest table."""

import os

import pytest

from candor.llm import queries, store

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_nnls_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_ring_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_tree_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_line_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_tar_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op6_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_orc_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_lbl_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op10_crf_langid": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_queries_cover_all_documents(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    want = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert set(ids) == set(want) and (name == "op1_nnls_packing" or len(ids) == len(want))


def test_settling_needs_nothing(spark):
    store.settle(spark)


def test_tables_between_steps_can_be_discarded(spark):
    t = store.written(spark.range(5), "some")
    assert t.count() == 5
    store.discard(t, spark.range(1))
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(t._stored)
