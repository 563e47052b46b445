"""Files read by byte ranges: what a range holds in file order, and what all ranges before it hold.

Spark cuts text files into ranges and reads the pieces between separators in order; a range begins behind the first separator
at or after its first byte. So what lies before a range depends on its start alone, not on how the rest is cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nlimorph.functions.settle import settled
from nlimorph.sources.json_text import only_value, with_end
from nlimorph.sources.scratch import written


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, path, size) of all files; ``file`` is a hash of the path. Nothing is read."""
    found = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path)
    return found.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))


def pieces(spark: SparkSession, path: str | list[str], separator: str, larger_than: int = -1, only: list[str] | Column | None = None) -> DataFrame:
    """(file, start, path, value): pieces between separators in file order, in files of more than so many bytes; with ``only``, paths or a condition over ``_metadata.file_path``, in those alone."""
    text = spark.read.option("recursiveFileLookup", True).text(path, lineSep=separator)
    if only is not None:  # other files are not opened: one may be a single line of any length
        text = text.where(F.col("_metadata.file_path").isin(only) if isinstance(only, list) else only)
    return text.where(F.col("_metadata.file_size") > larger_than).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_path").alias("path"), "value")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices of the batch that lie in one range; the first two columns are file and start."""
    file, start = (batch.column(k).to_numpy() for k in (0, 1))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in itertools.pairwise([0, *edges.tolist(), batch.num_rows]):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def with_place(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Rows of ``pieces``, in their order, with ``place`` from 0 inside their range; ``kept``, of rows where the boolean ``keep`` holds, counts those alone."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, good = None, 0, 0
        for batch in batches:
            for key, rows in runs(batch):
                if key != last:
                    last, seen, good = key, 0, 0
                place = seen + np.arange(rows.num_rows)
                flags = np.ones(rows.num_rows, dtype=bool) if keep is None else rows.column(keep).to_numpy(zero_copy_only=False).astype(bool)
                kept = good + np.cumsum(flags) - 1
                seen, good = seen + rows.num_rows, good + int(flags.sum())
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(place, pa.int64()), pa.array(kept, pa.int64(), mask=~flags)], [*rows.schema.names, "place", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(number, f"{fields}, place long, kept long")


def ahead(counts: DataFrame, *columns: str) -> DataFrame:
    """(file, start, ahead_<column>...): sums over the ranges of a file that lie ahead; a row a range."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "start", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"ahead_{c}") for c in columns])


def at_range(df: DataFrame, of_range: DataFrame, *columns: str) -> DataFrame:
    """df with what ``of_range`` says of each row's range: 40 bytes or so a range are broadcast, 40 MB for 100 TB in ranges of 128 MB.

    A range without a row is an error: the files, or the way that Spark cuts them, changed meanwhile.
    """
    told = of_range.select(F.col("file").alias("_file"), F.col("start").alias("_start"), *columns, F.lit(True).alias("_told"))
    met = df.join(F.broadcast(told), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left")
    known = F.when(F.col("_told"), F.col(columns[0])).otherwise(F.raise_error(F.lit("a file or its ranges changed while it was read")).cast(of_range.schema[columns[0]].dataType))
    return met.withColumn(columns[0], known).drop("_file", "_start", "_told")


def _lines(spark: SparkSession, path: str | list[str], larger_than: int, only: list[str] | Column | None) -> DataFrame:
    value = F.col("value")
    return pieces(spark, path, "\n", larger_than, only).withColumn("value", F.when(F.endswith(value, F.lit("\r")), F.left(value, F.length(value) - 1)).otherwise(value))


def _numbered(lines: DataFrame, placed: DataFrame, wanted: Column, value: str) -> DataFrame:
    """Rows of ``placed`` with their numbers from sums over the ranges ahead of theirs; ``lines`` has the rows to be counted."""
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("lines"), F.count_if(wanted).alias("items"))
    at = at_range(placed, ahead(counts, "lines", "items"), "ahead_lines", "ahead_items")
    return at.select("path", (F.col("ahead_lines") + F.col("place") + 1).alias("line"), (F.col("ahead_items") + F.col("kept")).alias("item"), value)


def numbered_lines(spark: SparkSession, path: str | list[str], larger_than: int = -1, keep: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """(path, line, item, value): lines of files with their number from 1 in file order, blank ones included.

    ``item`` numbers, from 0, the lines on which ``keep``, a column over ``value``, holds; it is null on others, and without ``keep`` on none.
    Lines are counted by range first; sums over the ranges ahead then place each of them, so a file is read by many tasks.
    """
    lines = _lines(spark, path, larger_than, only)
    if keep is not None:
        lines = lines.withColumn("keep", F.coalesce(keep, F.lit(False)))
    return _numbered(lines, with_place(lines, "keep" if keep is not None else None), F.col("keep") if keep is not None else F.lit(True), "value")


def numbered_rows(spark: SparkSession, path: str | list[str], larger_than: int = -1, only: list[str] | Column | None = None) -> DataFrame:
    """(path, line, item, v): the lines that are one JSON value, parsed, with their number as a line from 1 and among these rows from 0.

    Files are read once: lines are judged, and written out with their places in their ranges; they are counted there without their
    text. It is the text that is passed on, as a VARIANT costs more on its way through Python and Parquet than to parse it again.
    """
    lines = settled(_lines(spark, path, larger_than, only), "_parsed", with_end(F.col("value")))
    judged = settled(lines, "keep", only_value(F.col("_parsed"), F.col("value")).isNotNull())  # a JSON null is a value, not a null
    placed = written(with_place(judged.select("file", "start", F.when(F.col("keep"), F.col("value")).alias("value"), "keep"), "keep"), "rows")
    paths = spark.createDataFrame(files(spark, path).select("file", "path").toArrow())  # names only, as Spark's own listing
    rows = _numbered(placed, placed.where("keep").join(F.broadcast(paths), "file"), F.col("keep"), "value")
    return settled(rows, "v", F.try_parse_json("value")).select("path", "line", "item", "v")
