"""The registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.llm import bpe, digests, langid, licenses, packing, quality_model, quality_rules, simhash, substrings, token_counts, vector_codes, warc, whitening
from nlimorph.llm._shared import discard, fold_of, scratch_dir

SEQUENCE_TOKENS = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.over_limit(counts, SEQUENCE_TOKENS)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_improbable_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(_table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc.doc_id", "m.*", "kept", "llr")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(_table(spark, sf_dir, "documents"), digests=True)
    return cleaned.select("doc.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = fold_of("doc_id", 4)
    model = langid.train(docs, fold != 2)
    return langid.predict(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=SEQUENCE_TOKENS)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, fold = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold_of("doc_id", 3)
    model = quality_model.train(docs, labels, fold != 1)
    return quality_model.score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    path = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(pages, path, row_key=["_file", "_at"])
    read = warc.page_digests(spark, path, pages.schema["page_id"].dataType.simpleString())
    discard(spark, path)  # the digests are written
    return read


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_simhash_near_dedup, op3_improbable_digests, op4_quality_rules, op5_substring_dedup, op6_license_scan, op7_bpe_round_trip, op8_language_id, op9_retrieval_packing, op10_quality_classifier, op11_embedding_whitening, op12_warc_archives, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": substrings.remove_repeats_sql(), "op6_license_scan": licenses.scan_sql(), "op12_warc_archives": warc.page_digests_sql(), "op13_vector_codes": vector_codes.compress_sql()}
