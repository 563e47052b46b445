"""Operator 8: language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its positions holds a bitmask with one bit a language, in
several words above 64 languages. The AND of an n-gram's positions names every language that has the n-gram. For each document the bits
are counted by language, the counts are corrected for the filter's false positives, and the largest
corrected share decides.

Training uses labelled rows outside the held-out fold: about ``docs_per_language`` rows of each
language, chosen by a hash of id and text (a documented bound of the classifier's sample). Of each language
all n-grams are learned that stand in a share ``least_share`` of its sampled rows, so that a foreign
line in one of a thousand documents teaches nothing and a language of few rows is learned whole. The
filter has four positions or more for each of these n-grams, up to ``1 << 22``; beyond that its
false-positive rate rises, which the correction takes off. Prediction reads whole texts of all rows.

Defined results: null text, or text without a letter: ``und`` with score 0; text with letters but no
known n-gram: the first language in sorted order with score 0; ties: the first in sorted order; no
training rows: ``und`` for all; repeated rows give repeated results; very long texts are read whole; a null id is in no fold (held_out null in
the query), not learned from and predicted like any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlimorph.llm._shared import mix64, split_batch

GRAM = 4
UNDETERMINED = "und"
_letter_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter_table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text number of each, and which texts have a letter.

    Letters are lower-cased; a run of other characters counts as one space; a space stands at both ends.
    """
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[points]
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    has_letter = np.bincount(owner, weights=letter, minlength=len(texts)) > 0
    points, owner = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64), owner[keep]
    n = len(points) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has_letter
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        packed = packed * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
    whole = owner[:n] == owner[GRAM - 1 :]
    return mix64(packed[whole]), owner[:n][whole], has_letter


@dataclass
class LanguageFilter:
    """languages in sorted order; masks: one bitmask a position; expected: false-positive rate by language."""

    languages: list[str]
    masks: np.ndarray
    probes: int
    expected: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: dict[int, np.ndarray], positions: int, probes: int) -> LanguageFilter:
        """A filter of the hashes of each language's n-grams, by its number."""
        kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= bits), np.uint64)
        made = cls(languages, np.zeros((-(-len(languages) // 64), positions), dtype=kind), probes, np.zeros(len(languages)))
        for bit, hashes in members.items():
            for at in made._places(hashes):
                made.masks[bit // 64][at] |= kind(1 << bit % 64)
            made.expected[bit] = np.mean(made.has(made.masks, bit)) ** probes
        return made

    @staticmethod
    def has(found: np.ndarray | list[np.ndarray], bit: int) -> np.ndarray:
        """Whether each mask has the bit of a language."""
        word = found[bit // 64]
        return (word >> word.dtype.type(bit % 64)) & word.dtype.type(1)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        size, step = np.uint64(self.masks.shape[1]), (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            yield ((hashes + step * np.uint64(k)) % size).astype(np.int64)

    def languages_of(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The bitmasks of languages that hold each n-gram, one array for every 64 languages."""
        places = list(self._places(hashes))
        return [functools.reduce(np.bitwise_and, (word[at] for at in places)) for word in self.masks]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        hashes, owner, has_letter = grams(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        found = self.languages_of(hashes)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        shares = np.empty((len(self.languages), len(texts)))
        for bit, rate in enumerate(self.expected):
            hits = np.bincount(owner, weights=self.has(found, bit), minlength=len(texts)) / total
            shares[bit] = np.clip((hits - rate) / max(1 - rate, 1e-9), 0, 1)
        best = shares.argmax(axis=0)
        labels = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
        return labels, np.where(has_letter, shares.max(axis=0), 0.0)


def train(df: DataFrame, in_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 2_000, least_share: float = 0.001, probes: int = 3) -> LanguageFilter:
    """A filter from about ``docs_per_language`` training rows of each language."""
    rows = df.where(in_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter.build([], {}, 1, probes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, docs_per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col), F.col(text_col)), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < share[F.col(lang_col)]).select(lang_col, text_col)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: k for k, lang in enumerate(languages)}
        for whole in batches:
            for batch in split_batch(whole, text_col, 4 << 20):
                bit = np.array([number[x] for x in batch.column(0).to_pylist()])
                hashes, owner, _ = grams(batch.column(1).to_pylist())
                once = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1) if len(hashes) else np.empty((2, 0), np.uint64)
                for b in np.unique(bit):
                    values, counts = np.unique(once[1][bit[once[0].astype(np.int64)] == b], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"bit": np.full(len(values), b, np.int32), "gram": values.view(np.int64), "docs": counts.astype(np.int64)})

    enough = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (k, math.ceil(least_share * min(docs_per_language, sizes[lang])))])
    counts = sample.mapInArrow(tally, "bit int, gram long, docs long").groupBy("bit", "gram").agg(F.sum("docs").alias("docs"))
    known = counts.where(F.col("docs") >= enough[F.col("bit")])
    word = F.floor(F.col("bit") / 64).cast("int").alias("word")
    got = known.groupBy("gram", word).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")).toPandas()
    gram, mask, number = (got[c].to_numpy(dtype=np.int64) for c in ("gram", "mask", "word"))
    members = {b: gram[(number == b // 64) & (mask.view(np.uint64) >> np.uint64(b % 64) & np.uint64(1) > 0)].view(np.uint64) for b in range(len(languages))}
    return LanguageFilter.build(languages, members, 1 << min(22, max(16, (4 * len(gram)).bit_length())), probes)


def predict(df: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) of every row; ``keep`` passes further columns through."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    passed = [id_col, *keep]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "_text", 2 << 20):
                labels, scores = shared.value.predict([t or "" for t in batch.column(0).to_pylist()])
                rest = [batch.column(k + 1) for k in range(len(passed))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*passed, "lang_pred", "score"])

    return df.select(F.col(text_col).alias("_text"), *passed).mapInArrow(run, f"{fields}, lang_pred string, score double")
