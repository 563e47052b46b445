"""Prompt tables, resuming, and scoring with a caller's model."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from nlimorph.functions.labels import PROMPTS, prompt
from nlimorph.sources.scratch import discard, exists, new_folder


def with_index(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``index`` from 1 inside a dataset and relation, where rows have none yet.

    Rows of a table have no order of their own; they are numbered by the hash of the columns ``order`` and then by these.
    Even hash buckets are counted first and numbered inside, so that no task takes a whole dataset.
    """
    if "index" in df.columns:
        return df
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    rows = df.withColumn("_b", F.substring(digest, 1, 3))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_bucket"), F.coalesce(ahead, F.lit(0)).alias("_offset"))  # 4096 rows a group at most
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_b") == F.col("_bucket"))
    number = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *order))
    dealt = rows.repartition(*by, "_b").withColumn("_h", digest)  # made again: digests can't be compressed, and would be a third of what is shuffled
    numbered = dealt.withColumn("_inside", number).join(F.broadcast(offsets), same)
    return numbered.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias("index"))


def prompts(df: DataFrame, templates: dict[str, str] = PROMPTS) -> DataFrame:
    return df.withColumn("prompt", prompt(F.col("premise"), F.col("hypothesis"), F.col("task"), templates))


def pending(rows: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("dataset", "index")) -> DataFrame:
    """Rows whose keys are not done; nulls are keys like others."""
    finished = done.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return rows.join(finished, functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


Predict = Callable[[list[str]], list[str]]
_models: dict[str, Predict] = {}


def model_of(name: str, factory: Callable[[], Predict]) -> Predict:
    """The model of this name, made by the first task of a worker process that needs it and kept for all later ones."""
    if name not in _models:
        _models[name] = factory()
    return _models[name]


def score(df: DataFrame, predict: Predict | None = None, batch_size: int = 32, factory: Callable[[], Predict] | None = None, name: str = "model") -> DataFrame:
    """df with ``pred`` from a model over prompts; a batch that fails, or gets too few or too many replies, is marked ERROR and the job goes on.

    The model is ``predict`` itself or what ``factory`` makes, once a worker process and ``name``; a factory that fails ends the job.
    """
    if (predict is None) == (factory is None):
        raise ValueError("give either predict or factory")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            model = predict or model_of(name, factory)
            out: list[str] = []
            for at in range(0, len(frame), batch_size):
                batch = frame["prompt"].iloc[at : at + batch_size].tolist()
                try:
                    replies = list(model(batch))
                except Exception:  # the model is the caller's; its failures belong in the result
                    replies = []
                out += replies if len(replies) == len(batch) else ["ERROR"] * len(batch)
            yield frame.assign(pred=out)

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", pred string")


def scored_so_far(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``score_into`` has written to a folder; no rows before its first run."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def score_into(df: DataFrame, path: str, factory: Callable[[], Predict], keys: tuple[str, ...] = ("dataset", "index"), waves: int = 16, batch_size: int = 32, name: str = "model") -> DataFrame:
    """All rows of df scored, in the folder ``path``, each once, whatever ended earlier runs; ``keys`` tell rows apart.

    Rows that the folder lacks are written out by wave, a hash of their keys; then each wave is a job that is
    scored and committed to ``wave=<number>``. A run that is lost keeps its finished waves, and the next one scores
    the rest: at most one wave is scored again. Rows that come to df later are scored by the next run.
    """
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField("pred", StringType()), StructField("wave", IntegerType())])
    missing = pending(df, scored_so_far(spark, path, schema), keys) if exists(spark, path) else df  # the first run has nothing to be held against
    todo = missing.withColumn("wave", F.pmod(F.xxhash64(*keys), F.lit(waves)).cast("int"))
    folder = new_folder(spark, "todo")
    todo.write.partitionBy("wave").parquet(folder)
    left = spark.read.schema(todo.schema).parquet(folder)
    for wave in range(waves):
        rows = left.where(F.col("wave") == wave).drop("wave")
        if not rows.isEmpty():
            score(rows, batch_size=batch_size, factory=factory, name=name).write.mode("append").parquet(f"{path}/wave={wave}")
    discard(spark, folder)
    return scored_so_far(spark, path, schema).drop("wave")
