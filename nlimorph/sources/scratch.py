"""A shared folder for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own in local mode (tests), an error on a cluster."""
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-")
    return _own


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a new folder and read back: lineage ends there, and lost executors cost no recomputation of what came before."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The Hadoop path and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written folder that no later step reads."""
    at, files = _files(spark, path)
    files.delete(at, True)


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The part files of a written folder, in depth; paths relative to it, with partition folders."""
    at, files = _files(spark, path)
    found, folders = [], [(at, "")]
    while folders:  # not listFiles, which asks a local file system for the owner of each file by a command of its own
        folder, below = folders.pop()
        for each in files.listStatus(folder):
            name = each.getPath().getName()
            if each.isDirectory():
                folders.append((each.getPath(), f"{below}{name}/"))
            elif name.startswith("part-"):
                found.append(below + name)
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder to a path that is free; an error if that fails."""
    at, files = _files(spark, old)
    target = _files(spark, new)[0]
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(at, target):
        raise OSError(f"{old} can't be moved to {new}")
