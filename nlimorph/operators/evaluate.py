"""Evaluation of predictions: filters, confusion, per-class and overall metrics, error-rate tables.

A scored table has dataset, mr, task, status, gold and reply (and what else the caller keeps); ``pred`` is added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlimorph.functions.labels import LABELS_2, LABELS_3, cleaned, label_of, rate, rate_band, token_cost
from nlimorph.functions.settle import settled


def scorable(df: DataFrame, null_gold: str = "drop") -> DataFrame:
    """Rows with status 200 and a gold label; ``keep`` lets an explicit null label pass (column gold_present)."""
    has_gold = F.col("gold").isNotNull() if null_gold == "drop" else F.col("gold_present")
    return df.where((F.col("status").cast("string") == "200") & has_gold)


def with_prediction(df: DataFrame, rule: str = "strict") -> DataFrame:
    """df with ``pred``; the reply is cleaned once and its label found once, whatever filters follow."""
    text = df.withColumn("_reply", cleaned(F.col("reply"), rule))
    return settled(text, "pred", label_of(F.col("_reply"), F.col("task"), rule)).drop("_reply")


def with_correct(df: DataFrame) -> DataFrame:
    """df with ``correct``: whether pred is the gold label in small letters; a null on either side is not."""
    return df.withColumn("correct", F.coalesce(F.col("pred") == F.lower("gold"), F.lit(False)))


def mr_type_or_stem(df: DataFrame) -> DataFrame:
    """``mr_type``: the row's own if it is not empty, else the file stem."""
    return df.withColumn("mr_type", F.coalesce(F.nullif(F.col("mr_type"), F.lit("")), F.col("stem")))


def only(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of the named datasets or experiments."""
    return df.where(F.col(column).isin(names))


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by ``index`` of whatever the index counts in."""
    return df.where(F.col("index") <= n)


def parsed(df: DataFrame) -> DataFrame:
    return df.where(F.col("pred").isNotNull())


def wrong() -> Column:
    return ~F.col("gold").eqNullSafe(F.col("pred"))


def error_cases(df: DataFrame, *keep: str) -> DataFrame:
    return df.where(wrong()).select("dataset", "mr", *keep, "gold", "pred")


def status_summary(df: DataFrame) -> DataFrame:
    """Records and their share by status."""
    by = df.groupBy("status").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _pairs(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts by gold and predicted label, with the label set of each group: 2-way if any of its rows is.

    A wrong reply that is no label counts as ``?``, so that a group has as many rows as it has kinds of labels.
    """
    plain = F.col("pred").isin(*LABELS_3, *LABELS_2) | ~wrong() | F.col("pred").isNull()
    counts = df.groupBy(*by, "gold", F.when(plain, F.col("pred")).otherwise("?").alias("pred"), "task").agg(F.count("*").alias("n"))
    two = F.bool_or(F.col("task") == "nli-binary").over(Window.partitionBy(*by))
    names = [F.array(*map(F.lit, labels)) for labels in (LABELS_2, LABELS_3)]
    return counts.withColumn("labels", F.when(two, names[0]).otherwise(names[1])).groupBy(*by, "labels", "gold", "pred").agg(F.sum("n").alias("n"))


def confusion(df: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Counts over label x label, zeros included."""
    inside = F.array_contains("labels", F.col("gold")) & F.array_contains("labels", F.col("pred"))
    cells = _pairs(df, by).groupBy(*by, "labels").agg(F.collect_list(F.when(inside, F.struct("gold", "pred", "n"))).alias("cells"))  # a cell a pair of labels
    grid = cells.select("*", F.explode("labels").alias("gold")).select("*", F.explode("labels").alias("pred"))
    n = F.get(F.filter("cells", lambda c: (c["gold"] == F.col("gold")) & (c["pred"] == F.col("pred"))), F.lit(0))["n"]
    return grid.select(*by, "gold", "pred", F.coalesce(n, F.lit(0)).alias("n"))


def _per_class(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Measures of every label, and the group's ``total`` and ``correct`` beside each of them."""
    cell = _pairs(df, by).select(*by, "gold", "pred", "n", F.explode("labels").alias("label"))
    is_gold, is_pred = F.col("gold").eqNullSafe(F.col("label")), F.col("pred").eqNullSafe(F.col("label"))

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    tests = {"tp": is_gold & is_pred, "fp": ~is_gold & is_pred, "fn": is_gold & ~is_pred, "support": is_gold, "correct": ~wrong(), "total": F.lit(True)}
    counts = cell.groupBy(*by, "label").agg(*[total(t).alias(c) for c, t in tests.items()])
    out = counts.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics_per_class(df: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and support of every label of the set."""
    return _per_class(df, by).drop("total", "correct")


def metrics_overall(df: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Totals, accuracy and macro means, from the measures of the labels."""
    means = [F.round(F.avg(c), 12).alias(f"{c}_macro") for c in ("precision", "recall", "f1")]
    out = _per_class(df, by).groupBy(*by).agg(F.max("total").alias("total"), F.max("correct").alias("correct"), *means)
    return out.withColumn("accuracy", rate(F.col("correct"), F.col("total")))


def breakdown(df: DataFrame, *fields: str) -> DataFrame:
    """Correct, total and accuracy by any fields; a missing value counts as ``?``."""
    keys = [F.coalesce(F.col(f).cast("string"), F.lit("?")).alias(f) for f in fields]
    out = df.groupBy(*keys).agg(F.count_if(~wrong()).alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", rate(F.col("correct"), F.col("total"))).orderBy(*fields)


def token_usage(df: DataFrame, price_prompt: float = 0.0, price_completion: float = 0.0) -> DataFrame:
    """Token totals over records with usage, their mean and cost at prices a million tokens."""
    has = F.col("has_usage")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(has, F.col(c))), F.lit(0)).cast("long").alias(c)

    sums = df.agg(F.count_if(has).alias("n_usage"), *[total(f"{k}_tokens") for k in ("prompt", "completion", "cached")])
    both = F.col("prompt_tokens") + F.col("completion_tokens")
    cost = token_cost(F.col("prompt_tokens"), price_prompt) + token_cost(F.col("completion_tokens"), price_completion)
    return sums.select("*", both.alias("total_tokens"), rate(both, F.col("n_usage")).alias("avg_tokens"), cost.alias("cost"))


def _error_columns() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(wrong()).alias("errors")]


def _cells(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "mr").agg(*_error_columns())


def _error_sums() -> list[Column]:
    return [F.grouping_id().alias("g"), F.sum("total").alias("total"), F.sum("errors").alias("errors")]


def _level(df: DataFrame) -> DataFrame:
    names = {0: "cell", 1: "dataset", 2: "mr", 3: "all"}
    level = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("g").cast("int"))
    return df.withColumn("level", level).withColumn("error_rate", rate(F.col("errors"), F.col("total"))).drop("g")


def mrv(df: DataFrame) -> DataFrame:
    """Error rate by dataset and relation, by dataset, and over all; rows without a relation are a cell of their own."""
    return _level(_cells(df).rollup("dataset", "mr").agg(*_error_sums()))


def mrv_cube(df: DataFrame) -> DataFrame:
    """As ``mrv``, with the relations over all datasets."""
    return _level(_cells(df).cube("dataset", "mr").agg(*_error_sums()))


def mrv_with_empty(df: DataFrame, datasets: DataFrame) -> DataFrame:
    """Error rate of every listed dataset; 0 of 0 where nothing could be scored."""
    by = df.groupBy("dataset").agg(*_error_columns())
    out = datasets.join(by, "dataset", "left").na.fill(0, ["total", "errors"])
    return out.withColumn("error_rate", rate(F.col("errors"), F.col("total")))


def mrv_matrix(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Datasets as rows, relations as columns in a fixed order; blank where there is no row."""
    return df.groupBy("dataset").pivot("mr", list(order)).agg(F.round(F.count_if(wrong()) / F.count(F.lit(1)), 4))


def mrv_detail(df: DataFrame) -> DataFrame:
    out = _cells(df).withColumn("correct", F.col("total") - F.col("errors")).withColumn("error_rate", F.round(rate(F.col("errors"), F.col("total")), 4))
    return out.withColumn("accuracy", F.round(rate(F.col("correct"), F.col("total")), 4)).withColumn("band", rate_band(F.col("error_rate")))


def combine(parts: list[DataFrame]) -> DataFrame:
    """Prediction tables one after the other, in order of dataset, relation and index."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("dataset", "mr", "index")
