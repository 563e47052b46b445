"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlimorph.sources.scratch import discard, new_folder, scratch_dir

__all__ = ["WordHashes", "discard", "first_by_hash", "fold_of", "materialize", "mix64", "new_folder", "rolling_hash", "scratch_dir", "split_batch", "written"]

def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to a new Parquet folder in the shared scratch folder and read back, and that folder."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to a new Parquet folder in the shared scratch folder and read it back.

    Lineage ends there, so lost executors cost no recomputation of what came before.
    """
    return written(df, label)[0]


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def first_by_hash(ids: DataFrame, id_col: str, limit: int, salt: str) -> DataFrame:
    """The first ``limit`` rows in the order of a hash of their id, which no two of them share.

    A histogram of the hashes' first 16 bits (65,536 rows at most) tells below which bound they lie; only rows under it are sorted.
    """
    order = F.xxhash64(F.lit(salt), F.col(id_col))
    bucket = F.shiftright(order, 48).cast("int")
    total, bound = 0, None
    for r in sorted(ids.groupBy(bucket.alias("b")).count().collect()):
        total, bound = total + r[1], r.b
        if total >= limit:
            break
    return ids.limit(0) if bound is None else ids.where(bucket <= bound).orderBy(order, id_col).limit(limit)


def split_batch(batch: pa.RecordBatch, text_col: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch holding about ``max_bytes`` of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class WordHashes(dict):
    """word bytes -> 64-bit hash; remembers a bounded number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hash(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring 64-bit values (polynomial, modulo 2**64)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(base)
        out += values[k : k + n]
    return mix64(out)
