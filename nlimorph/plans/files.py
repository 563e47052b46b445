"""Queries over files of the samples, written to the shared folder and read back."""

from __future__ import annotations

import functools
import operator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.operators import evaluate
from nlimorph.plans import fixtures as fx
from nlimorph.sources import jsonl, ranges
from nlimorph.sources.scratch import new_folder

#: What stands before and behind the rows of a file, by its form; every row but those of lines ends in a comma.
FORMS = {"array": ("[", "null]"), "one_line": ("[", "null]"), "data": ('{"about": {"form": "list, in an object"}, "data": [', "null]}"), "tests": ('{"data": 1, "tests": [', 'null], "more": [{"premise": 1}]}'), "lines": ("", "null")}
_FORM = "case cast(pair_key as bigint) % 5 when 0 then 'array' when 1 then 'one_line' when 2 then 'data' when 3 then 'tests' else 'lines' end"
_SIZE = "case when cast(pair_key as bigint) // 5 % 40 = 0 then 'small' else 'large' end"
_FILES = fx.with_sql("samples") + f", files as (select *, {_FORM} as form, {_SIZE} as size from samples)"
WHOLE_UP_TO = 1 << 16


def _write(spark: SparkSession, sf_dir: str) -> str:
    """The samples as JSON files by dataset, form and size, rows in the order of their keys.

    Rows are dealt to their files and sorted as they stand in the table; their text is made behind that, so it is neither shuffled nor spilled.
    """
    keys = {"in_set": fx.DATASET, "form": _FORM, "size": _SIZE}
    table = fx.table(spark, sf_dir, "lineitem").select("*", *[F.expr(x.replace("cast(pair_key as bigint)", "l_orderkey").replace("//", "div")).alias(c) for c, x in keys.items()])
    ends = table.groupBy(*keys).agg(F.min("l_orderkey").alias("l_orderkey")).withColumn("part", F.explode(F.array(F.lit(0), F.lit(2))))
    dealt = table.withColumn("part", F.lit(1)).unionByName(ends, allowMissingColumns=True).repartition(200, *keys)
    placed = fx.samples_of(dealt.withColumn("at", F.expr(fx.ROW_KEY)).sortWithinPartitions(*keys, "part", "at"), *keys, "part")  # sorted by folder first, else the writer would sort anew
    texts = F.create_map(*[F.lit(x) for f, (head, tail) in FORMS.items() for x in (f, F.struct(F.lit(head).alias("head"), F.lit(tail).alias("tail")))])[F.col("form")]
    row = F.concat(F.to_json(F.struct("premise", "hypothesis", "label", "row_key")), F.when(F.col("form") == "lines", "").otherwise(","))
    lines = placed.select(F.when(F.col("part") == 1, row).when(F.col("part") == 0, texts["head"]).otherwise(texts["tail"]).alias("value"), F.col("in_set").alias("dataset"), "form", "size")
    root = new_folder(spark, "json")

    def write(group: tuple[str, Column, str]) -> None:
        name, of, separator = group
        lines.where(of).write.partitionBy("dataset", "form", "size").option("lineSep", separator).text(f"{root}/{name}")

    with ThreadPoolExecutor(2) as pool:  # a file is written by one task; both groups at once keep more cores busy
        list(pool.map(write, (("some", F.col("form") != "one_line", "\n"), ("other", F.col("form") == "one_line", " "))))
    return root


def _placed(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Rows with what the paths of their files say; these are taken apart once a file."""
    names = ranges.files(spark, root).select("path", *[F.regexp_extract("path", f"/{c}=([^/]+)/", 1).alias(c) for c in ("dataset", "form", "size")])
    return rows.join(F.broadcast(names), "path").select("dataset", "form", "size", "item", _key())


def _key():
    return F.try_variant_get("v", "$.row_key", "string").alias("row_key")


def read_json_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five forms and two sizes, those above the bound cut between tasks."""
    root = _write(spark, sf_dir)
    return _placed(spark, root, jsonl.valid_samples(jsonl.read_json_any(spark, root, whole_up_to=WHOLE_UP_TO)))


def cut_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every file cut between tasks, whatever its size."""
    root = _write(spark, sf_dir)
    return _placed(spark, root, jsonl.valid_samples(jsonl.read_json_any(spark, root, whole_up_to=-1)))


_ITEMS = _FILES + " select dataset, form, size, row_number() over (partition by dataset, form, size order by row_key) - 1 as item, row_key from files"


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """The samples as one JSON lines file for each dataset and relation, in the order of their keys, with blank and broken lines."""
    s = fx.samples(spark, sf_dir)
    row = F.to_json(F.struct("row_key", "premise"))
    odd = F.substring(F.md5(F.concat(F.lit("b|"), "row_key")), 1, 1)
    line = F.when(odd == "0", "").when(odd == "1", F.concat(row, F.lit(", {"))).otherwise(row)
    root = new_folder(spark, "lines")
    s.select(line.alias("value"), "row_key", "dataset", "mr_id").repartition("dataset", "mr_id").sortWithinPartitions("dataset", "mr_id", "row_key").drop("row_key").write.partitionBy("dataset", "mr_id").text(root)
    return root


_NUMBERED = fx.with_sql("samples") + """, n as (select *, substr(md5('b|'||row_key),1,1) as odd, row_number() over (partition by dataset, mr_id order by row_key) as line from samples),
i as (select dataset, mr_id, line, row_number() over (partition by dataset, mr_id order by line) as index, row_key from n where odd not in ('0', '1'))"""


def _in_order(spark: SparkSession, sf_dir: str, *datasets: str) -> DataFrame:
    """Rows with their numbers in their files: all, or those of the files of some datasets."""
    only = [F.col("_metadata.file_path").contains(f"/dataset={d}/") for d in datasets]
    rows = jsonl.read_jsonl_in_order(spark, _lines(spark, sf_dir), functools.reduce(operator.or_, only) if only else None)
    return rows.select(*[F.regexp_extract("path", f"/{c}=([^/]+)/", 1).alias(c) for c in ("dataset", "mr_id")], "line", "index", _key())


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of the line and of the row among those that parse, in file order."""
    return _in_order(spark, sf_dir)


def first_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the files of some datasets."""
    return evaluate.first_n(_in_order(spark, sf_dir, "mnlim", "rte"), 100).select("dataset", "mr_id", "index", "row_key")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file by their numbers: how many, the last and their sum."""
    lines = ranges.numbered_lines(spark, _lines(spark, sf_dir))
    at = [F.regexp_extract("path", f"/{c}=([^/]+)/", 1).alias(c) for c in ("dataset", "mr_id")]
    return lines.groupBy(*at).agg(F.count("*").alias("n"), F.max("line").alias("last"), F.sum("line").alias("total"))


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (read_json_any, _ITEMS),
        (cut_json_files, _ITEMS),
        (file_order, _NUMBERED + " select * from i"),
        (first_file_rows, _NUMBERED + " select dataset, mr_id, index, row_key from i where index <= 100 and dataset in ('mnlim', 'rte')"),
        (line_counts, fx.with_sql("samples") + " select dataset, mr_id, count(*) as n, count(*) as last, count(*) * (count(*) + 1) // 2 as total from samples group by all"),
    )
}
