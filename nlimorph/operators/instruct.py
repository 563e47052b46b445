"""Source join and instruction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlimorph.functions.labels import fill, label_name, py_strip
from nlimorph.operators.groups import KEY

MODES = ("none", "operation_only", "pair_only", "pair_operation", "shuffled_operation", "relation_aware", "full_oracle")
#: Default wording, a parameter of build_instructions.
TEMPLATES = {
    "task": {"nli": "Decide whether the hypothesis follows from the premise. Reply entailment, neutral or contradiction.", "nli-binary": "Decide whether the hypothesis follows from the premise. Reply entailment or not_entailment."},
    "pair": "Earlier premise: {p}\nEarlier hypothesis: {h}\n",
    "label": "Earlier reply: {l}\n",
    "operation": "Change made since: {o}\n",
    "effect": "What the change does: {e}\n",
}
#: Default wording of what each relation does and how it bears on the label.
CATALOG = [
    ("negation_flip", "a negation was added or taken away", "the reply may turn around"),
    ("antonym_substitution", "a word gave way to one of opposite sense", "the reply may turn around"),
    ("synonym_replacement", "a word gave way to one of like sense", "the reply stays"),
    ("voice_switch", "active and passive voice were exchanged", "the reply stays"),
    ("conditional_clause", "a condition was put before the sentence", "the reply tends to neutral"),
    ("uninformative", "a remark without bearing was added", "the reply stays"),
    ("adding_contradiction", "a clause that contradicts the premise was added", "the reply becomes contradiction"),
    ("pronoun_substitution", "a noun gave way to a pronoun", "the reply stays"),
]


def source_table(df: DataFrame) -> DataFrame:
    """The only source row of each group that has exactly one."""
    columns = ["premise", "hypothesis", "label", "label_is_int"]
    grouped = df.where(F.col("mr_id") == "none").groupBy(*KEY).agg(F.count("*").alias("n"), *[F.first(c).alias(f"source_{c}") for c in columns])
    return grouped.where(F.col("n") == 1).drop("n").withColumn("has_source", F.lit(True))


def attach_source(df: DataFrame) -> DataFrame:
    """df with source_premise, source_hypothesis, source_label and has_source; groups of none or several sources get none."""
    return df.join(source_table(df), KEY, "left").withColumn("has_source", F.coalesce("has_source", F.lit(False)))


def attach_source_clustered(df: DataFrame) -> DataFrame:
    """As ``attach_source``, by a window over the group: for a clustered table, whose rows need no exchange for it and are read once."""
    group = Window.partitionBy(*KEY)
    source = F.col("mr_id") == "none"
    one = F.count_if(source).over(group) == 1
    columns = ["premise", "hypothesis", "label", "label_is_int"]
    given = F.first(F.when(source, F.struct(*columns)), ignorenulls=True).over(group)
    rows = df.withColumn("_one", one).withColumn("_source", given)
    return rows.select(*df.columns, *[F.when(F.col("_one"), F.col("_source")[c]).alias(f"source_{c}") for c in columns], F.coalesce("_one", F.lit(False)).alias("has_source"))


def source_problems(df: DataFrame) -> DataFrame:
    """Groups whose number of sources is not one."""
    return df.groupBy(*KEY).agg(F.count_if(F.col("mr_id") == "none").alias("n_sources")).where(F.col("n_sources") != 1).withColumn("problem", F.when(F.col("n_sources") == 0, "no source").otherwise("several sources"))


def attach_mr_texts(df: DataFrame, catalog: DataFrame, key: str = "mr_id") -> DataFrame:
    """Operation and effect texts of the relation; empty where the catalogue lacks it."""
    texts = catalog.select(F.col("mr_id").alias(key), "operation_text", "effect_text")
    out = df.drop("operation_text", "effect_text").join(texts, key, "left")
    return out.na.fill("", ["operation_text", "effect_text"])


def shuffle_operations(df: DataFrame, seed: int, row_key: str, data: DataFrame | None = None) -> DataFrame:
    """``shown_mr``: another relation of the data, drawn by seed and row; ``none`` stays, and so does an only relation.

    ``data`` has the relations to draw from, of df itself where it is not given: where df is joined to more, its table before that
    has the same ones, and the joins need not be done twice.
    """
    pool = (df if data is None else data).where(F.col("mr_id") != "none").agg(F.array_sort(F.collect_set("mr_id")).alias("pool"))
    others = F.array_except("pool", F.array("mr_id"))
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_key))), 1, 8), 16, 10).cast("long") % F.greatest(F.size(others), F.lit(1))
    drawn = F.coalesce(F.get(others, at.cast("int")), F.col("mr_id"))
    return df.crossJoin(F.broadcast(pool)).withColumn("shown_mr", F.when(F.col("mr_id") == "none", "none").otherwise(drawn)).drop("pool")


def build_instructions(df: DataFrame, mode: str, templates: dict = TEMPLATES) -> DataFrame:
    """instruction, input and output of each row of ``attach_source`` and ``attach_mr_texts``.

    Source rows, validation rows (column split, if there is one) and rows that need a source pair and have none
    get the plain task.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    task = F.when(F.col("task") == "nli-binary", templates["task"]["nli-binary"]).otherwise(templates["task"]["nli"])
    pair = fill(templates["pair"], p=py_strip(F.col("source_premise")), h=py_strip(F.col("source_hypothesis")))
    operation, effect = fill(templates["operation"], o=F.col("operation_text")), fill(templates["effect"], e=F.col("effect_text"))
    label = fill(templates["label"], l=label_name(F.col("source_label").cast("string"), F.col("source_label_is_int"), F.col("task")))
    parts = {
        "none": [], "operation_only": [operation], "pair_only": [pair], "pair_operation": [pair, operation], "shuffled_operation": [pair, operation],
        "relation_aware": [pair, operation, effect], "full_oracle": [pair, label, operation, effect],
    }[mode]
    plain = F.col("mr_id") == "none"
    if "split" in df.columns:
        plain = plain | (F.col("split") == "val")
    if mode not in ("none", "operation_only"):
        plain = plain | ~F.col("has_source")
    instruction = F.when(plain, task).otherwise(F.concat(*parts, task)) if parts else task
    text = F.concat(F.lit("Premise: "), py_strip(F.col("premise")), F.lit("\nHypothesis: "), py_strip(F.col("hypothesis")))
    return df.withColumn("instruction", instruction).withColumn("input", text).withColumn("output", label_name(F.col("label").cast("string"), F.col("label_is_int"), F.col("task")))


def mr_id_audit(df: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """Relation ids that are not known, with their counts; strict raises if there are any."""
    out = df.join(F.broadcast(known.select("mr_id")), "mr_id", "left_anti").groupBy("mr_id").agg(F.count("*").alias("n"))
    if strict and not out.isEmpty():
        raise ValueError("unknown relation ids")
    return out


def leak_audit(df: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """Rows whose instruction names the relation id, the effect, the row's own pair or, before the closing task text, its source's label."""
    text = F.col("instruction")
    named = {"names_mr": text.contains(F.col("mr_id")), "shows_effect": (F.col("effect_text") != "") & text.contains(F.col("effect_text")), "shows_own_pair": text.contains(F.col("premise")) & text.contains(F.col("hypothesis"))}
    own_task = F.when(F.col("task") == "nli-binary", templates["task"]["nli-binary"]).otherwise(templates["task"]["nli"])
    before_task = F.when(text.endswith(own_task), F.expr("left(instruction, length(instruction) - length(own_task))")).otherwise(text)
    source = label_name(F.col("source_label").cast("string"), F.col("source_label_is_int"), F.col("task"))
    named["names_source_label"] = F.coalesce(F.col("has_source") & F.lower(before_task).contains(F.lower(source)), F.lit(False))
    df = df.withColumn("own_task", own_task)
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in named.items()])


def conversion_report(df: DataFrame) -> DataFrame:
    """Rows by relation and output label with all margins, and how many fell back or lack a text."""
    cells = df.cube("mr_id", "output").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if((F.col("mr_id") != "none") & ~F.col("has_source")).alias("n_fallback"), F.count_if((F.col("mr_id") != "none") & (F.col("operation_text") == "")).alias("n_without_text"))
    return cells.withColumn("g", F.col("g").cast("long"))
