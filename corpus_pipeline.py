"""A corpus pipeline: language, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet
in the shared scratch folder and gives it to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.llm import langid, packing, quality_rules, simhash, substrings
from nlimorph.llm._shared import fold_of, materialize

LEAST_LANGUAGE_SCORE = 0.5


def _whole(docs: DataFrame) -> Column:
    """All columns of a row in one struct; names may hold dots."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; undetermined ones and those with a score under one half go.

    Null and empty texts and texts without a letter are undetermined and go; a null language or id is not learned from
    but judged like any row; ties go to the first language in order; repeated rows stay or go together; very long texts
    are read whole; without any labelled row all rows are undetermined; an empty table stays empty; further columns,
    whatever their names, pass unchanged.
    """
    model = langid.train(docs, fold_of("doc_id", 4) != 2)
    judged = langid.predict(docs.select(F.col("text"), _whole(docs).alias("_doc")), model, id_col="_doc")
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go; null ids are judged by text alone; null labels are not trusted; ties
    at the threshold stay; repeated rows stay or go together; very long texts are read whole; without trusted rows only
    the base rules decide; an empty table stays empty; further columns pass unchanged.
    """
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply_rules(docs, trusted).where("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null, empty and wordless texts have the empty set of shingles and are copies of each other; a text of fewer than five
    words is one shingle; a null id comes after all others, equal ids go by row number, so of repeated rows one stays;
    very long texts are read whole; an empty table stays empty; further columns pass unchanged.
    """
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that stand elsewhere too.

    Null and empty texts and texts of fewer words stay as they are, and so does a text that loses nothing; others become
    their kept words joined by spaces, possibly none, and ``n_chars`` follows. All places of a passage lose it, those in
    repeated rows too; very long texts are read whole; null ids do not matter; an empty table stays empty; further
    columns pass unchanged.
    """
    cleaned = substrings.remove_repeats(docs)
    doc, less = F.col("doc"), F.col("n_removed") > 0
    text = F.when(less, F.col("kept")).otherwise(doc["text"])
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(less, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(doc["n_chars"])
    return cleaned.select(*[changed.get(c, doc[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; long texts are cut; ties in likeness go by row order; repeated rows are
    packed each; null ids stay null; an empty table gives no piece; further columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]
#: Hashing, retrieval order and tokenizers lie outside SQL; tests hold the stages against brute-force versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
