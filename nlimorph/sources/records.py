"""Prediction records parsed once and kept typed, so that evaluations read only the fields they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.sources.jsonl import prediction_fields


def write_records(rows: DataFrame, path: str) -> None:
    """Parsed lines (model, dataset, mr, v) as typed Parquet columns by dataset.

    status, task, gold, reply and the token counts stand in columns of their own, what else an evaluation may group by
    stays in ``example`` as it was.
    """
    example = F.try_variant_get("v", "$.example", "variant").alias("example")
    index = F.try_variant_get("v", "$.index", "long").alias("index")
    typed = rows.select("model", "dataset", "mr", index, prediction_fields(F.col("v")).alias("p"), example).select("model", "dataset", "mr", "index", "p.*", "example")
    typed.write.partitionBy("dataset").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
