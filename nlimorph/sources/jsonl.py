"""JSON lines and JSON files to VARIANT rows, and the fields taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.functions.labels import py_strip
from nlimorph.functions.settle import settled
from nlimorph.sources.documents import read_documents
from nlimorph.sources.json_text import LISTS, alone, closed, is_json_value, only_value, with_end
from nlimorph.sources.ranges import files, numbered_rows

#: Key names by preference.
PREMISE = ("premise", "sentence1", "sentence1_text", "text_a")
HYPOTHESIS = ("hypothesis", "sentence2", "sentence2_text", "text_b")
LABEL = ("label", "gold_label", "annotator_labels")
TEXT = ("input", "prompt", "text", "source")
#: Larger files are read by several tasks.
WHOLE_UP_TO = 16 << 20


def parse_lines(df: DataFrame, col: str = "value", mode: str = "drop") -> DataFrame:
    """df with ``v``, the parsed line; blank lines go. ``mode``: drop malformed lines, flag them, or fail.

    A line is parsed once.
    """
    if mode not in ("drop", "flag", "fail"):
        raise ValueError(f"unknown mode {mode}")
    lines = settled(df, "_text", F.col(col))  # else filters are pushed into what made the text, and it is made several times
    parsed = settled(lines.where(F.col("_text").rlike(r"(?U)\S")), "_parsed", with_end(F.col("_text")))
    read = settled(parsed, "_v", only_value(F.col("_parsed"), F.col("_text")))  # a JSON null is a value, not a null
    v, ok = F.col("_v"), F.col("_v").isNotNull()
    if mode == "fail":
        v = F.when(ok, v).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col(col))))
    out = read.where(ok) if mode == "drop" else read
    return out.select(*df.columns, v.alias("v"), *([(~ok).alias("malformed")] if mode == "flag" else []))


def read_jsonl(spark: SparkSession, path: str | list[str], mode: str = "drop") -> DataFrame:
    """(path, value, v[, malformed]) of JSON lines files; folders are read in depth."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return parse_lines(lines.select(F.col("_metadata.file_path").alias("path"), "value"), mode=mode)


def parse_whole(df: DataFrame, col: str = "value") -> DataFrame:
    """Items of whole files: those of an array, of an object's list, the object itself, or of JSON lines; with ``item``, the number inside."""
    rest = [c for c in df.columns if c != col]
    rows = df.withColumn("_items", alone(F.col(col)))
    whole = F.when((F.size("_items") == 1) & closed(F.col(col)), F.get("_items", F.lit(0)))
    read = settled(rows, "_file", F.struct(whole.alias("v"), F.col(col).alias("text")))
    v = F.col("_file.v")
    array = F.try_variant_get(v, "$", "array<variant>")
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in LISTS]
    lines = F.filter(F.transform(F.split(F.col("_file.text"), r"\r?\n"), lambda s: F.when(is_json_value(s), F.try_parse_json(s))), lambda x: x.isNotNull())
    items = F.when(v.isNotNull(), F.coalesce(array, *lists, F.array(v))).otherwise(lines)
    return read.select(*rest, F.posexplode(items).alias("item", "v"))


def read_json_any(spark: SparkSession, path: str | list[str], whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """(path, item, v) of JSON files of any form, items numbered from 0 in file order.

    Files of up to ``whole_up_to`` bytes are parsed as one text, larger ones are cut between tasks; the rows are the same.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    small = text.where(F.col("_metadata.file_size") <= whole_up_to).select(F.col("_metadata.file_path").alias("path"), "value")
    items = parse_whole(small).withColumn("item", F.col("item").cast("long"))
    if files(spark, path).where(F.col("size") > whole_up_to).isEmpty():
        return items
    return items.unionByName(read_documents(spark, path, whole_up_to))


def read_jsonl_in_order(spark: SparkSession, path: str | list[str], only: Column | None = None) -> DataFrame:
    """(path, line, index, v) of JSON lines files: number of the line in its file, and of the row among those that parse, both from 1.

    With ``only``, a condition over ``_metadata.file_path``, other files are not opened; numbers count inside a file.
    """
    return numbered_rows(spark, path, only=only).select("path", "line", (F.col("item") + 1).alias("index"), "v")


def _present(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in keys])


def text_of(v: Column) -> Column:
    """A scalar as its text, anything else as JSON; null stays null."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v)))


def nli_fields(v: Column) -> Column:
    """premise, hypothesis and label from the first key present; of a list label its first item."""
    label = _present(v, LABEL)
    first = F.coalesce(F.try_variant_get(label, "$[0]", "variant"), label)
    return F.struct(text_of(_present(v, PREMISE)).alias("premise"), text_of(_present(v, HYPOTHESIS)).alias("hypothesis"), text_of(first).alias("label"))


def generic_text(v: Column) -> Column:
    """Text of a row that is no sentence pair: the first text key present, else the row as JSON with sorted keys."""
    return F.coalesce(text_of(_present(v, TEXT)), F.to_json(v))


def valid_samples(df: DataFrame) -> DataFrame:
    """Rows with all of premise, hypothesis and label."""
    has = [F.try_variant_get("v", f"$.{k}", "variant").isNotNull() for k in ("premise", "hypothesis", "label")]
    return df.where(has[0] & has[1] & has[2])


def samples_of(df: DataFrame, source_file: Column) -> DataFrame:
    """Typed training rows; whether the label was a number and whether a pair id was there are kept."""
    v = F.col("v")
    label, pair = F.try_variant_get(v, "$.label", "variant"), F.try_variant_get(v, "$.pair_id", "variant")
    return valid_samples(df).select(
        source_file.alias("source_file"),
        text_of(F.try_variant_get(v, "$.premise", "variant")).alias("premise"),
        text_of(F.try_variant_get(v, "$.hypothesis", "variant")).alias("hypothesis"),
        text_of(label).alias("label"),
        (F.schema_of_variant(label) == "BIGINT").alias("label_is_int"),
        py_strip(text_of(pair)).alias("pair_id"),
        pair.isNotNull().alias("pair_id_present"),
        text_of(F.coalesce(F.try_variant_get(v, "$.mr_id", "variant"))).alias("mr_id"),
    )


def prediction_fields(v: Column) -> Column:
    """status, task, gold, reply and token counts of a prediction record."""
    response = F.try_variant_get(v, "$.response", "variant")
    said = F.coalesce(F.try_variant_get(v, "$.response.choices[0].message.content", "string"), F.when(F.schema_of_variant(response) == "STRING", F.try_variant_get(response, "$", "string")))
    usage = F.try_variant_get(v, "$.response.usage", "variant").isNotNull()

    def tokens(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.response.usage.{path}", "long"), F.lit(0).cast("long"))

    return F.struct(
        F.try_variant_get(v, "$.status", "string").alias("status"),
        F.coalesce(F.try_variant_get(v, "$.meta.task", "string"), F.lit("nli")).alias("task"),
        F.try_variant_get(v, "$.meta.gold_label", "string").alias("gold"),
        F.try_variant_get(v, "$.meta.gold_label", "variant").isNotNull().alias("gold_present"),
        said.alias("reply"),
        usage.alias("has_usage"),
        tokens("prompt_tokens").alias("prompt_tokens"),
        tokens("completion_tokens").alias("completion_tokens"),
        tokens("prompt_tokens_details.cached_tokens").alias("cached_tokens"),
    )


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), compression: str = "none") -> None:
    """Rows as JSON lines; compressed files are smaller, but each is read by one task."""
    df.write.option("ignoreNullFields", "false").option("compression", compression).partitionBy(*partition_by).json(path)
