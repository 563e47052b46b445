"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a further column that later filters and projections cannot pull apart and evaluate anew."""
    return df.select("*", F.explode(F.array(value)).alias(name))
