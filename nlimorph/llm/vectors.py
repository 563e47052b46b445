"""Numeric vectors of a table as exact integers, with rows numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nlimorph.llm._shared import materialize

LONG = 2.0**63


def integers(df: DataFrame, vector_col: str, keep: dict[str, str], scale: int, shift: int = 0) -> DataFrame:
    """Columns ``keep`` (new name: old name) and ``x``, floor(scale * c) + shift of each entry c as a long.

    Rows go whose vector is null, has no entry or holds an entry that is null, not finite, or too large for a long.
    """
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * scale)
    rows = df.select(*[F.col(f"`{old}`").alias(new) for new, old in keep.items()], vector.alias("_scaled"))
    whole = F.forall("_scaled", lambda c: c.isNotNull() & (F.abs(c) < LONG - 2 * abs(shift) - 1024))  # NaN is above every number
    sound = rows.where((F.size("_scaled") > 0) & whole)
    return sound.select(*keep, F.transform("_scaled", lambda c: F.floor(c) + F.lit(shift).cast("long")).alias("x"))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose ``x`` has the commonest length, the larger of equally common ones, and that length (0: no rows)."""
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("x") == lengths.d), lengths.d) if lengths else (rows, 0)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """df written out, with ``row``, a number from 0 without gaps."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = materialize(df.select("*", F.spark_partition_id().alias("_task"), inside.alias("_inside")), label)
    ahead = F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = table.groupBy("_task").agg(F.count("*").alias("n")).select("_task", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    return table.join(F.broadcast(offsets), "_task").select(*df.columns, (F.col("_ahead") + F.col("_inside")).alias("row"))  # a row a task
