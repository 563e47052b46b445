"""Operator 4: quality rules, in DataFrame functions only.

Base measures of each text, and a hashed n-gram log-likelihood ratio between two multinomials: that of
a trusted target and that of the raw corpus. Words and word pairs fall into ``buckets`` by XXH64; a
document's score is the mean of log(target share / raw share) over its n-grams, and it is kept if the
score reaches a threshold: ``spread`` standard deviations below the mean of the target's own scores.

Raw counts cover all documents. The target is given as ids (see ``trusted_ids``), and all of its rows are counted; their texts are
written once to the shared folder.

Defined results: null text counts as no words (all measures 0, failed); ties and repeated rows are
scored alike; very long texts are read whole, in the row that holds them; a null id stays null, is judged by its text and never trusted; an empty table gives an empty result; without any trusted row the
threshold is minus infinity, so that only the base rules decide; columns of other names pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from nlimorph.functions.settle import settled
from nlimorph.llm._shared import first_by_hash, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 10
WINDOW = 5
FILTER_BITS = 1 << 26


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _most(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def hashed(df: DataFrame, text_col: str) -> DataFrame:
    """df with ``_words``, their hashes ``_h`` and those of neighbouring pairs ``_p``; each is read more than once, so each is a column."""
    out = df.withColumn("_words", words_of(F.col(text_col))).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    pairs = F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1)))
    return out.withColumn("_p", F.slice(pairs, 1, _most(F.size("_h") - 1)))


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df of ``hashed`` with ``m``, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("_h")
    windows = F.transform("_p", lambda x, i: F.xxhash64(x, F.get("_p", i + 2), F.get("_h", i + 4)))
    out = df.withColumn("_windows", F.slice(windows, 1, _most(n - WINDOW + 1)))
    win = F.col("_windows")
    repeated = F.size(F.array_distinct(win)) < F.size(win)
    out = out.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(s, j)["i"]))
    out = out.withColumn("_starts", F.when(s.isNotNull(), starts))
    p = F.col("_starts")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("_repeat", F.coalesce(covered, F.lit(0).cast("long"))).withColumn("_lines", lines)
    n = n.cast("long")
    return settled(
        out,
        "m",
        F.struct(
            n.alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, SYMBOL)) - 1).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.col("_repeat").alias("n_repeat_words"),
            ((n < MIN_WORDS) | (F.col("_repeat") * 100 > n * 20)).alias("base_failed"),
        ),
    ).drop("_windows", "_sorted", "_starts", "_repeat", "_lines")


def grams_of(buckets: int) -> Column:
    """Bucket numbers of the words and of their neighbouring pairs."""
    return F.transform(F.concat("_h", "_p"), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, limit: int | None = None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """All different ids labelled 1; a caller who wants a sample names its ``limit`` and gets the first by hash order."""
    ids = labels.where(F.col(label_col) == 1).where(F.col(id_col).isNotNull()).select(id_col).distinct()
    return ids if limit is None else first_by_hash(ids, id_col, limit, "target")


def near_trusted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``_id`` has its bit set in a bitmap of the ids' hashes (8 MB at most, broadcast): all with one of the ids and few others."""

    def place(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))

    bits = ids.select(place(F.col("_id")).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    placed = rows.withColumn("_p", place(F.col("_id")))
    met = placed.join(F.broadcast(bits), F.bitmap_bucket_number("_p") == F.col("_bucket"))
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = met.where(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1).select(*rows.columns)
    return settled(found.withColumnRenamed("_id", "_own"), "_id", F.col("_own")).select(*rows.columns)  # else joins by the id are pushed below the filter


def target_texts(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of the trusted rows, column ``_text``.

    One and the same join at any size, so that what is shuffled grows with the input; the bitmap keeps back most texts that it would shuffle in vain.
    """
    ids = trusted.select(F.col(id_col).alias("_id"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType
    if kind == ids.schema["_id"].dataType and isinstance(kind, IntegralType | StringType):  # equal ids have equal hashes
        rows = near_trusted(rows, ids)
    return rows.join(ids.hint("merge"), "_id", "left_semi").select("_text")


def _counts(df: DataFrame, text_col: str, buckets: int) -> dict[int, int]:
    grams = hashed(df.select(text_col), text_col).select(F.explode(grams_of(buckets)).alias("b"))
    return dict(map(tuple, grams.groupBy("b").count().collect()))  # a row a bucket


def log_ratios(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, target: DataFrame | None = None) -> list[float]:
    """log(target share / raw share) of each bucket; raw counts over all rows, target counts over all trusted ones, both smoothed by one."""
    target = target_texts(df, trusted, id_col, text_col) if target is None else target
    raw, target = _counts(df, text_col, buckets), _counts(target, "_text", buckets)
    all_raw, all_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return [round(math.log((target.get(b, 0) + 1) / all_target) - math.log((raw.get(b, 0) + 1) / all_raw), 5) for b in range(buckets)]


def with_score(df: DataFrame, ratios: list[float]) -> DataFrame:
    """df of ``hashed`` with ``llr``, the mean log ratio over its n-grams (null without words)."""
    table = F.expr("array(" + ", ".join(f"{x:.5f}D" for x in ratios) + ")")
    grams = F.concat("_h", "_p")
    total = F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.get(table, F.pmod(x, F.lit(len(ratios))).cast("int")))
    return settled(df, "llr", F.when(F.size("_h") > 0, total / F.size(grams)))


def threshold_of(target: DataFrame, ratios: list[float], spread: float) -> float:
    """``spread`` standard deviations below the mean of the trusted rows' scores."""
    got = with_score(hashed(target, "_text"), ratios).agg(F.avg("llr").alias("m"), F.stddev_samp("llr").alias("s")).first()
    return -math.inf if got.m is None else got.m - spread * (got.s or 0.0)


def apply_rules(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8_192, spread: float = 4.0) -> DataFrame:
    """Every row of df as struct ``doc``, with ``m`` (base measures), ``llr`` and ``kept``."""
    target = materialize(target_texts(df, trusted, id_col, text_col), "target")  # read twice, joined once
    ratios = log_ratios(df, trusted, id_col, text_col, buckets, target)
    limit = threshold_of(target, ratios, spread)
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(df.columns)], F.col(text_col).alias("_text"))
    scored = with_score(base_measures(hashed(rows, "_text"), "_text"), ratios)
    doc = F.struct(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)])
    kept = ~F.col("m.base_failed") & F.coalesce(F.col("llr") >= F.lit(limit), F.lit(False))
    return scored.select(doc.alias("doc"), "m", "llr", kept.alias("kept"))
