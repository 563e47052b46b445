"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from nlimorph.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
COLUMNS = {
    "op1": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6": ["doc_id", "n_hits", "license_id", "dice", "license_ids"],
    "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op13": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF)
    want = COLUMNS[name.split("_")[0]]
    assert got.columns[: len(want)] == want
    table = {"op11": "embeddings", "op12": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert got.count() == n * (16 if name[:4] == "op11" else 1) if name[:4] != "op9_" else got.select("doc_id").distinct().count() == n


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        after = docs.count()
        assert docs.columns == columns
        assert before * 0.5 < after <= before
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == before


def test_pipeline_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (None, "word " * 30, "en", "s", None)], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.materialize(stage(spark, rows, SF), name)
        rows.count()
