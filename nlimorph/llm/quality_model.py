"""Operator 10: quality classifier on random-indexing word vectors.

Every word has a fixed sparse index vector, drawn by hash. A word's vector is the sum of the index vectors
of its neighbours (up to two words away) in the training sample, scaled to length one. The same is done for
the shapes of words (letters, digits and signs in runs), which carries over to words never seen. A document
is pooled to the mean and the spread of its word and shape vectors; a two-layer network turns that into a
logit, and a temperature fitted on a held-back fifth of the sample turns the logit into a probability. Its targets
are a little inside 0 and 1, by the number of held-back rows of each label (Platt's rule), so that no score is surer
than these rows allow.

The fit takes at most ``sample_rows`` labelled rows outside the held-out fold, chosen by a hash of the id:
the documented bound of the sample, and so of the one task that fits. Scoring reads every whole text.

Defined results: null or empty text is scored as a document of no words; ties do not arise (a score is a
function of the text alone); repeated rows score alike; a null label is not learned from, of several labels of an id the largest counts; very long texts are scored whole, and learned from
if they fit the sample's bytes; a null id is in no fold (held_out null in the query) and scored like any; of the rows of one id the
first text in order is learned from; without rows to
learn from every score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlimorph.llm._shared import first_by_hash, materialize, split_batch

ROWS = 1 << 15
DIMS = 48
HIDDEN = 32
SLICE_WORDS = 1 << 16
LETTERS, CAPITALS, DIGITS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shape_of(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; other signs stay, at most two alike in a row."""
    short = DIGITS.sub("0", CAPITALS.sub("A", LETTERS.sub("a", word)))
    return re.sub(r"(.)\1{2,}", r"\1\1", short)


class Rows(dict):
    """word -> (row of the word, row of its shape), in one number; remembers a bounded number of words."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        value = (xxhash.xxh3_64_intdigest(word.lower().encode()) % ROWS) << 32 | (xxhash.xxh3_64_intdigest(shape_of(word).encode(), 1) % ROWS)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of all texts, and the number of words of each."""
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = [w for words in split for w in words]
        return np.fromiter(map(self.__getitem__, flat), dtype=np.int64, count=len(flat)), n


def index_vectors(seed: int) -> np.ndarray:
    """Sparse ternary index vectors: four places of each row are plus or minus one."""
    draw = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIMS), dtype=np.float32)
    for _ in range(4):
        out[np.arange(ROWS), draw.integers(0, DIMS, ROWS)] += draw.choice([-1, 1], ROWS)
    return out


def context_vectors(rows: np.ndarray, owner: np.ndarray, seed: int) -> np.ndarray:
    index, total = index_vectors(seed), np.zeros((ROWS, DIMS), dtype=np.float64)
    for far in (1, 2):
        same = owner[far:] == owner[:-far]
        a, b = rows[:-far][same], rows[far:][same]
        pairs, times = np.unique(np.r_[a * ROWS + b, b * ROWS + a], return_counts=True)
        word, near = pairs // ROWS, pairs % ROWS
        for at in range(0, len(pairs), 1 << 16):
            part = slice(at, at + (1 << 16))
            heads = np.flatnonzero(np.r_[True, word[part][1:] != word[part][:-1]])
            total[word[part][heads]] += np.add.reduceat(index[near[part]] * np.log1p(times[part])[:, None], heads, axis=0)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(length > 0, length, 1)).astype(np.float32)


def scaled(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as the network takes them, in training and in scoring alike."""
    return np.clip((x - center) / scale, -8, 8)


def temperature_of(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss against smoothed targets."""
    good, grid = y.sum(), np.geomspace(0.02, 50, 391)
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    loss = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class QualityModel:
    words: np.ndarray
    shapes: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def features(self, texts: list[str], rows: Rows) -> np.ndarray:
        packed, n = rows.of(texts)
        out = np.zeros((len(texts), 4 * DIMS + 2))
        for column, (vectors, values) in enumerate(((self.words, packed >> 32), (self.shapes, packed & 0xFFFFFFFF))):
            total, square = np.zeros((len(texts), DIMS)), np.zeros((len(texts), DIMS))
            owner = np.repeat(np.arange(len(texts)), n)
            for at in range(0, len(values), SLICE_WORDS):
                found, who = vectors[values[at : at + SLICE_WORDS]], owner[at : at + SLICE_WORDS]
                heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                total[who[heads]] += np.add.reduceat(found, heads, axis=0)
                square[who[heads]] += np.add.reduceat(found * found, heads, axis=0)
            mean = total / np.maximum(n, 1)[:, None]
            out[:, 2 * column * DIMS : (2 * column + 1) * DIMS] = mean
            out[:, (2 * column + 1) * DIMS : (2 * column + 2) * DIMS] = np.sqrt(np.maximum(square / np.maximum(n, 1)[:, None] - mean * mean, 0))
        out[:, -2] = np.log1p(n)
        out[:, -1] = n == 0
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        center, scale, w1, b1, w2, b2 = self.layers
        return np.maximum(scaled(x, center, scale) @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, texts: list[str], rows: Rows) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts, rows)) / self.temperature, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = 120) -> QualityModel:
    """A model from texts and 0/1 labels; a fifth of the rows is held back for the temperature."""
    model = QualityModel(np.zeros((ROWS, DIMS), np.float32), np.zeros((ROWS, DIMS), np.float32), [], 1.0)
    if len(texts) < 20 or labels.min() == labels.max():
        return model
    rows = Rows()
    packed, n = rows.of(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    model.words, model.shapes = context_vectors(packed >> 32, owner, seed), context_vectors(packed & 0xFFFFFFFF, owner, seed + 1)
    x, y = model.features(texts, rows), labels.astype(float)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    center, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    weights = [draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    z = scaled(x, center, scale)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        shuffled = draw.permutation(train)
        for at in range(0, len(shuffled), 128):
            part = shuffled[at : at + 128]
            w1, b1, w2, b2 = weights
            h = np.maximum(z[part] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30)))
            d = (p - y[part]) / len(part)
            back = np.outer(d, w2) * (h > 0)
            step += 1
            for k, g in enumerate([z[part].T @ back + 1e-3 * w1, back.sum(axis=0), h.T @ d + 1e-3 * w2, np.array([d.sum()])]):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 2e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = [center, scale, *weights]
    model.temperature = temperature_of(model.logits(x[held]), y[held])
    return model


def within_bytes(sample: DataFrame, most: int) -> DataFrame:
    """Rows of the sample in hash order until their texts hold ``most`` bytes; the driver gets a length for each of its ids."""
    sizes = sample.select("_id", F.octet_length("_text").alias("n")).orderBy(F.xxhash64(F.lit("quality"), F.col("_id")), "_id").collect()
    taken = [r._id for r, total in zip(sizes, itertools.accumulate(r.n for r in sizes), strict=True) if total <= most]
    return sample if len(taken) == len(sizes) else sample.where(F.col("_id").isin(taken))


def train(df: DataFrame, labels: DataFrame, in_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6_000, sample_bytes: int = 256 << 20) -> QualityModel:
    """Fit on labelled rows for which ``in_training`` (over the labels' id) holds: at most ``sample_rows`` ids in hash order, of whose texts those up to ``sample_bytes`` in all are taken.

    Of several labels of an id the largest counts, of several texts the first in their order.
    """
    ids = labels.where(in_training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    drawn = first_by_hash(ids, id_col, sample_rows, "quality")
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(drawn.select(F.col(id_col).alias("_id"), "label")), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(i, t, y) for b in batches for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        got.sort()
        m = fit([t for _, t, _ in got], np.array([y for _, _, y in got]))
        parts = [m.words, m.shapes, *m.layers, np.array([m.temperature])]
        yield pa.RecordBatch.from_pydict({"part": np.arange(len(parts)), "shape": pa.array([list(p.shape) for p in parts], pa.list_(pa.int64())), "data": pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())})

    one_each = materialize(rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("label").alias("label")), "quality-sample")  # an id may have any number of rows
    sample = within_bytes(one_each, sample_bytes)
    parts = sample.select("_id", "_text", "label").repartition(1).mapInArrow(run, "part long, shape array<long>, data binary").orderBy("part").collect()
    if not parts:
        return fit([], np.empty(0))
    arrays = [np.frombuffer(bytes(p.data), dtype=np.float32).reshape(p.shape) for p in parts]
    return QualityModel(arrays[0], arrays[1], list(arrays[2:-1]), float(arrays[-1][0]))


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for whole in batches:
            for batch in split_batch(whole, text_col, 2 << 20):
                scores = shared.value.scores([t or "" for t in batch.column(1).to_pylist()], rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int")
