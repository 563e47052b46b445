"""Reports on built tables: lengths, label counts, signatures."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlimorph.sources.scratch import written


def label_dist(df: DataFrame, label: Column) -> DataFrame:
    return df.groupBy(label.alias("label_name")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, length: Column, cutoff: int | None = None) -> DataFrame:
    """Smallest, upper median and largest length, from a histogram; with a cutoff, how many lie above it."""
    hist = df.groupBy(length.cast("long").alias("len")).agg(F.count("*").alias("n"))
    upto = hist.withColumn("c", F.sum("n").over(Window.orderBy("len"))).withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row a length
    median = F.min(F.when(F.col("c") >= F.floor(F.col("total") / 2) + 1, F.col("len")))
    above = [F.sum(F.when(F.col("len") > cutoff, F.col("n")).otherwise(0)).alias("n_above")] if cutoff is not None else []
    return upto.agg(F.sum("n").alias("n_rows"), F.min("len").alias("min_len"), median.alias("median_len"), F.max("len").alias("max_len"), *above)


def first_k(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows in an order, for reports."""
    return df.orderBy(*order).limit(k)


def data_signature(df: DataFrame) -> DataFrame:
    """A digest of the rows that no order or partitioning changes: count, XOR and sum of row digests."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sums = df.select(number.alias("x")).agg(F.count("*").alias("n_rows"), F.bit_xor("x").alias("bits"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
    return sums.select("n_rows", F.substring(F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("bits").cast("string"), F.col("total").cast("string")), 256), 1, 16).alias("signature"))


def merkle_tree(df: DataFrame, file: str, position: str, value: Column, fan: int = 1024) -> DataFrame:
    """(file, level, at, n, digest): digests of ranges of a file's rows in order; see ``signatures``.

    ``position`` numbers the rows of a file from 1. On level 1 range ``at`` holds the digests of the rows fan * at + 1 to fan * (at + 1), on level
    2 those of ``fan`` ranges of level 1, and so on, until one range is left. No group has more than ``fan`` members.
    """
    rows = df.select(F.col(file).alias("file"), (F.col(position) - 1).cast("long").alias("child"), F.sha2(value, 256).alias("digest"), F.lit(1).cast("long").alias("n"))
    levels, made = [], 0
    while True:
        in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "digest"))), lambda c: c["digest"]), "")
        ranges = rows.groupBy("file", F.floor(F.col("child") / fan).alias("at")).agg(F.sum("n").alias("n"), F.sha2(in_order, 256).alias("digest"))
        made += 1
        level = written(ranges.select("file", F.lit(made).alias("level"), "at", "n", "digest"), "ranges")
        levels.append(level)
        if not level.where("at > 0").head(1):
            return functools.reduce(DataFrame.unionByName, levels)
        rows = level.select("file", F.col("at").alias("child"), "digest", "n")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, n_rows, signature) of ranges that come by file and in order; one digest is held at a time."""
    last, total, ranges, single, chain = None, 0, 0, None, hashlib.sha256()

    def made() -> pa.RecordBatch:
        whole = single if ranges == 1 else chain.hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([total], pa.int64()), pa.array([whole[:16]])], ["file", "n_rows", "signature"])

    for batch in batches:
        kind = batch.column("file").type
        for file, n, digest in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "digest")), strict=True):
            if ranges and file != last:
                yield made()
                total, ranges, chain = 0, 0, hashlib.sha256()
            last, single = file, digest
            total, ranges = total + n, ranges + 1
            chain.update(digest.encode())
    if ranges:
        yield made()


def signatures(tree: DataFrame) -> DataFrame:
    """(file, n_rows, signature): what rows each file holds, and in which order.

    The signature is the digest of all digests of level 1 in order, or the only one, whatever the height of the tree. They stream
    through one task a file: 64 bytes for each ``fan`` rows, hashed as they come.
    """
    ranges = tree.where(F.col("level") == 1).select("file", "at", "n", "digest")
    kind = tree.schema["file"].dataType.simpleString()
    return ranges.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_chained, f"file {kind}, n_rows long, signature string")


def first_difference(a: DataFrame, b: DataFrame, fan: int = 1024) -> DataFrame:
    """(file, first_row, last_row): the first range of level 1 in which two trees differ, of each file that they hold otherwise.

    From the top only the children of the range that differs are compared, so what is read of a level is ``fan`` rows a file.
    """
    highest = max(a.agg(F.max("level")).first()[0] or 0, b.agg(F.max("level")).first()[0] or 0)
    found = None
    for level in range(highest, 0, -1):
        one, other = (t.where(F.col("level") == level).select("file", "at", F.col("digest").alias(c)) for t, c in ((a, "_one"), (b, "_other")))
        if found is not None:
            inside = found.select("file", F.col("at").alias("_parent"))
            one, other = (t.withColumn("_parent", F.floor(F.col("at") / fan)).join(inside, ["file", "_parent"], "left_semi").drop("_parent") for t in (one, other))
        met = one.join(other, ["file", "at"], "full").where(~F.col("_one").eqNullSafe(F.col("_other")))
        here = met.groupBy("file").agg(F.min("at").alias("at"))
        found = written(here, "differing")
    if found is None:
        return a.select("file", F.lit(0).cast("long").alias("first_row"), F.lit(0).cast("long").alias("last_row")).limit(0)
    return found.select("file", (F.col("at") * fan + 1).alias("first_row"), ((F.col("at") + 1) * fan).alias("last_row"))
