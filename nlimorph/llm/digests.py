"""Operator 3: document fingerprints as improbable-feature digests.

Every run of ``WINDOW`` bytes is a window. The entropy of its bytes falls into one of ``CLASSES`` classes; how often each class
occurs over all documents ranks the classes, rarest first, and a hash of the bytes orders windows of one class. A window is a
feature if it comes first in a span of ``SPAN`` neighbouring windows, so no part of a text goes without one. A text of few windows
has shorter spans, ``LEAST`` to a text; what is first in a span is first in a shorter one too, so these features include the
others. Features enter a chain of Bloom filters of ``FILTER_BYTES``
bytes, the next one when ``PER_FILTER`` are in. Two digests are compared filter by filter: the bits that both
have set, less what chance would give, over the most there can be; each filter of the shorter chain takes its
best partner and their mean, weighted by features, is the likeness.

Defined results: null text counts as empty; an empty text has an empty digest, like to another empty one (1)
and unlike all others (0); a text shorter than a window is one feature; equal texts have equal digests and
likeness 1; ties in the order of ids go by the hash of the text and then by the text; null ids come last in the descending order;
repeated rows follow each other; very long texts are read whole, and their filters compared some at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nlimorph.llm._shared import materialize, mix64, split_batch

WINDOW = 16
SPAN = 64
LEAST = 16
CLASSES = 128
FILTER_BYTES, PER_FILTER, PROBES = 256, 160, 5
#: n log2 n in whole parts of 2**-24, so that sums do not depend on where a window stands.
_GAIN = np.r_[0, np.rint(np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2)) * (1 << 24))].astype(np.int64)
_STEP = np.r_[0, np.diff(_GAIN)]
_WHOLE = _GAIN[WINDOW]
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and entropy classes of the windows of a text, from its first byte on; at least one."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < WINDOW:
        raw = np.r_[raw, np.zeros(WINDOW - len(raw), dtype=np.uint8)]
    return window_hashes(raw), entropy_classes(raw)


def windows_after_edit(own: tuple[np.ndarray, np.ndarray], kept: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``data``, whose first ``kept`` bytes are those of the text with windows ``own``."""
    same = kept - WINDOW + 1
    if same < 1 or len(data) - same < WINDOW:
        return windows_of(data)
    hashes, classes = windows_of(data[same:])
    return np.r_[own[0][:same], hashes], np.r_[own[1][:same], classes]


def window_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every window (polynomial, modulo 2**64)."""
    out, base, size = _BYTES[raw], 0x9E3779B97F4A7C15, 1
    while size < WINDOW:
        out = out[:-size] * np.uint64(base) + out[size:]
        base, size = base * base % (1 << 64), 2 * size
    return mix64(out)


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """Shannon entropy of the bytes of every window, in ``CLASSES`` equal steps."""
    ahead, behind = (np.ones(len(raw), dtype=np.uint8) for _ in range(2))
    for k in range(1, WINDOW):  # how often the first byte of a window, and the last, stands in it
        same = raw[:-k] == raw[k:]
        ahead[:-k] += same
        behind[k:] += same
    first = int(_GAIN[np.bincount(raw[:WINDOW])].sum())
    n = len(raw) - WINDOW + 1
    total = np.cumsum(np.r_[first, _STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]]])
    entropy = _WHOLE - total  # times WINDOW
    return np.minimum(entropy * CLASSES // _WHOLE, CLASSES - 1)


def class_ranks(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy class over all documents, the rarest 0; classes that never occur rank last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.as_py():
                    total += np.bincount(windows_of(text.as_py().encode())[1], minlength=CLASSES)
        yield pa.RecordBatch.from_pydict({"c": np.arange(CLASSES), "n": total})

    rows = df.select(text_col).mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, dtype=np.int64)
    for r in rows:
        counts[r.c] = r.n
    ranks = np.empty(CLASSES, dtype=np.int64)
    ranks[np.lexsort((np.arange(CLASSES), counts, counts == 0))] = np.arange(CLASSES)
    return ranks


SLICE = 512  # filters of a text that are compared at a time


class Digest:
    """A chain of Bloom filters with the number of features in each."""

    def __init__(self, filters: np.ndarray, counts: np.ndarray):
        self.filters, self.counts = filters, counts

    @classmethod
    def of(cls, windows: tuple[np.ndarray, np.ndarray] | None, ranks: np.ndarray) -> Digest:
        if windows is None:
            return cls(np.zeros((0, FILTER_BYTES), dtype=np.uint8), np.zeros(0, dtype=np.int64))
        hashes, classes = windows
        best = (ranks[classes].astype(np.uint64) << np.uint64(57)) | (hashes >> np.uint64(7))
        span, reach = min(SPAN, max(1, len(best) // LEAST)), 1
        while reach < span:  # the first of every span, by spans of twice the length
            step = min(reach, span - reach)
            best = np.minimum(best[:-step], best[step:])
            reach += step
        feature = best[np.r_[True, best[1:] != best[:-1]]]
        _, first = np.unique(feature, return_index=True)
        feature = mix64(feature[np.sort(first)])
        chain = np.arange(len(feature)) // PER_FILTER
        bits = np.zeros((int(chain[-1]) + 1, FILTER_BYTES * 8), dtype=np.uint8)
        for k in range(PROBES):
            bits[chain, (feature >> np.uint64(11 * k)).astype(np.int64) % (FILTER_BYTES * 8)] = 1
        return cls(np.packbits(bits, axis=1), np.bincount(chain))

    def likeness(self, other: Digest) -> float:
        a, b = (self, other) if len(self.counts) <= len(other.counts) else (other, self)
        if not len(a.counts):
            return 1.0 if not len(b.counts) else 0.0
        if a.filters.shape == b.filters.shape and (a.filters == b.filters).all():
            return 1.0
        score = np.zeros(len(a.counts), dtype=np.float32)
        for i in range(0, len(a.counts), SLICE):
            wide_a = np.unpackbits(a.filters[i : i + SLICE], axis=1).astype(np.float32)
            one = wide_a.sum(axis=1)[:, None]
            for j in range(0, len(b.counts), SLICE):
                wide_b = np.unpackbits(b.filters[j : j + SLICE], axis=1).astype(np.float32)
                two = wide_b.sum(axis=1)[None, :]
                chance, most = one * two / (FILTER_BYTES * 8), np.minimum(one, two)
                best = np.clip((wide_a @ wide_b.T - chance) / np.maximum(most - chance, 1e-6), 0, 1).max(axis=1)
                score[i : i + SLICE] = np.maximum(score[i : i + SLICE], best)
        return float(min(1.0, (score * a.counts).sum() / a.counts.sum()))

    def __bytes__(self) -> bytes:
        return b"".join(bytes([n]) + f.tobytes() for n, f in zip(self.counts.tolist(), self.filters, strict=True))

    def __str__(self) -> str:
        return ".".join(f"{n:02x}{f.tobytes().hex()}" for n, f in zip(self.counts.tolist(), self.filters, strict=True))


def edited(text: str, following: str) -> str:
    """The last third of the text gives way to as much of the following text's start."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class Pairs:
    """Result columns for rows with the text that follows each."""

    NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    SCHEMA = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def __init__(self, ranks: np.ndarray):
        self.ranks, self.last = ranks, None

    def _own(self, text: str) -> tuple:
        """The text, its windows and digest; the following text of one row is the text of the next."""
        if self.last is None or self.last[0] != text:
            windows = windows_of(text.encode()) if text else None
            return text, windows, Digest.of(windows, self.ranks)
        return self.last

    def row(self, text: str, following: str) -> tuple:
        _, windows, own = self._own(text)
        changed = edited(text, following)
        data = changed.encode()
        kept = len(text[: len(text) - len(text) // 3].encode())
        other = Digest.of(windows_after_edit(windows, kept, data) if data else None, self.ranks)
        self.last = self._own(following)
        return len(text), hashlib.sha256(data).digest(), bytes(own), bytes(other), own.likeness(other), own.likeness(self.last[2])


def _batch(ids: pa.Array, rows: list[tuple], extra: dict) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    made = {"id": ids} | {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(Pairs.NAMES, kinds, strict=True))}
    return pa.RecordBatch.from_pydict(made | extra)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Rows are ranged by descending id, rows of one id by the hash of their text and then the text, so that an id of many
    rows is dealt to many ranges; within a range each row meets the next one as the rows stream by. The last
    row of each range and the first of the next, a pair a range, are joined afterwards.
    """
    shared = df.sparkSession.sparkContext.broadcast(class_ranks(df, text_col))
    kind = df.schema[id_col].dataType.simpleString()
    ordered = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = ordered.withColumn("at", F.xxhash64("text"))
    order = [F.desc_nulls_last("id"), F.asc("at")]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order, F.asc("text")).drop("at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, part = Pairs(shared.value), TaskContext.get().partitionId()
        held, head = None, None
        for whole in batches:
            for batch in split_batch(whole, "text", 1 << 20):
                texts = batch.column(1).to_pylist()
                if held is None:
                    head, ids = texts[0], batch.column(0).slice(0, batch.num_rows - 1)
                    chain = texts
                else:
                    chain = [held[1], *texts]
                    ids = pa.concat_arrays([held[0], batch.column(0).slice(0, batch.num_rows - 1)])
                rows = [pairs.row(a, b) for a, b in zip(chain, chain[1:], strict=False)]
                n = len(rows)
                if n:
                    yield _batch(ids, rows, {"part": pa.array([part] * n, pa.int32()), "head": pa.nulls(n, pa.string()), "tail": pa.nulls(n, pa.string())})
                held = (batch.column(0).slice(batch.num_rows - 1), texts[-1])
        if held is not None:
            yield _batch(held[0], [(None,) * 6], {"part": pa.array([part], pa.int32()), "head": pa.array([head], pa.string()), "tail": pa.array([held[1]], pa.string())})

    done = materialize(ordered.mapInArrow(stream, f"id {kind}, {Pairs.SCHEMA}, part int, head string, tail string"), "digests")
    ends = done.where(F.col("tail").isNotNull())
    parts = ends.select("part")
    by_part = Window.orderBy("part")  # as many rows as there are ranges
    following = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next"))
    heads = ends.select(F.col("part").alias("next"), F.col("head").alias("following"))
    met = ends.select("id", "part", "tail").join(following, "part").join(heads, "next").select("id", "tail", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(shared.value)
        for batch in batches:
            yield _batch(batch.column(0), [pairs.row(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], {})

    rest = met.mapInArrow(finish, f"id {kind}, {Pairs.SCHEMA}")
    made = done.where(F.col("tail").isNull()).select("id", *Pairs.NAMES).union(rest)
    named = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    for c in ("fingerprint", "edited_fingerprint"):  # written as bytes, named as text: a dot between filters
        named[c] = F.regexp_replace(named[c], f"(.{{{2 * FILTER_BYTES + 2}}})(?=.)", "$1.")
    return made.withColumns(named).withColumnRenamed("id", id_col)
