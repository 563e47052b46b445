"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlimorph.llm._shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node passes its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node passes its smallest smaller neighbour to its other smaller neighbours and itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def components(edges: DataFrame, label: str) -> DataFrame:
    """(u, v): every node u that is not the smallest of its component, with that smallest node v.

    ``edges`` has long columns u and v; each round is written out, so a lost executor repeats one round at most, and
    takes the place of the one before. The table ends as stars, which is when a round changes nothing; the number of
    rounds grows with the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    now, path = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = _mark(now)
    while mark[0]:
        last, last_mark = path, mark
        now, path = written(_small_star(_large_star(now)), label)
        mark = _mark(now)
        discard(spark, last)
        if mark == last_mark:
            break
    return now
