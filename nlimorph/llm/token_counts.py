"""Operator 1: token counts by a map-side two-tier lookup.

A tokenizer that drops white space encodes each run between ASCII white space on its own, so a
document's count is the sum over its runs. Tier one is a broadcast table of the lengths of frequent
runs; tier two is each worker's own cache, filled by the tokenizer. No run is ever shuffled.

The table holds at most ``frequent`` runs, the most frequent of a sample: of the first ``SAMPLED_TASKS`` partitions, whole documents
until ``SAMPLED_BYTES`` of text are met in each. Each of these tasks sends its ``SENT`` most frequent runs to the driver, one row a task.
The table is a cache and cannot change a count, so it need not hold the most frequent runs of all.

Defined results: null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole, run by run; repeated rows give repeated results;
a null id stays null; an empty table gives an empty result; only the id and the text are read, so
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlimorph.llm._shared import split_batch

CACHE_ENTRIES = 700_000
LONGEST_CACHED = 64
SAMPLED_TASKS = 256
SAMPLED_BYTES = 1 << 20
SENT = 4096
_tokenizers: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a .json file without truncation or padding, one per process."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _tokenizers[path] = tok
    return _tokenizers[path]


def runs_of(text: str) -> list[str]:
    """The runs between space, tab, newline and return (some may be empty)."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class _Cache(dict):
    """A dictionary that fills itself; it starts anew when it has ``CACHE_ENTRIES``."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class RunEncoder:
    """Token ids of a run, as little-endian 32-bit integers, remembered in a cache of bounded size.

    Runs of Latin-1 characters are lower-cased and cut here into the tokenizer's words, which its model
    encodes; words have a cache of their own. All other runs, and runs that may hold a special string,
    are left to the tokenizer as a whole. Where the tokenizer is not of this build, all runs are.
    """

    #: The build that ``_latin`` follows, on characters below U+0100.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa00-9a-zªµºß-öø-ÿ²³¹¼-¾]+")

    def __init__(self, path: str):
        self.tok, self.runs, self.words = load_tokenizer(path), _Cache(self.encode), _Cache(self._word)
        spec = json.loads(self.tok.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.latin = (spec["normalizer"] or {}).get("normalizers") == self.NORMALIZER and steps[0].get("pattern", {}).get("Regex") == self.SPLIT and len(steps) == 2 and not steps[1]["use_regex"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()

    def encode(self, run: str) -> bytes:
        """Ids of one run that the cache does not hold."""
        if self.latin and "<|" not in run and (run.isascii() or max(run) < "\u0100"):
            low = run.lower()
            if low.isalpha() and low.isascii():
                return self.words[low]
            return b"".join(map(self.words.__getitem__, self.LATIN_WORDS.findall(low)))
        return array("I", self.tok.encode(run, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.runs.__getitem__, runs_of(text)))

    def count(self, text: str, frequent: dict[str, int]) -> int:
        """Number of ids of a whole text: the broadcast table first, then this worker's cache."""
        n, table, known = 0, frequent.get, self.runs
        for r in runs_of(text):
            v = table(r)
            n += v if v is not None else len(known[r]) >> 2
        return n


_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """The encoder of a .json file with its caches, one per process."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def _frequent_table(df: DataFrame, path: str, text_col: str, frequent: int) -> tuple[str, bytes]:
    """Frequent runs, at most ``frequent``, joined by spaces, and their lengths as bytes."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        met = 0
        for batch in batches:
            for part in split_batch(batch, text_col, 64 << 10) if met < SAMPLED_BYTES else ():
                for text in part.column(0).to_pylist():
                    if text and met < SAMPLED_BYTES:
                        met += len(text)
                        seen.update(runs_of(text))
        top = [(r, n) for r, n in seen.most_common(SENT) if 0 < len(r) <= LONGEST_CACHED]
        if top:
            yield pa.RecordBatch.from_pydict({"runs": [" ".join(r for r, _ in top)], "times": pa.array([[n for _, n in top]], pa.list_(pa.int64()))})

    sampled = df.where(F.spark_partition_id() < SAMPLED_TASKS).select(text_col).mapInArrow(tally, "runs string, times array<long>")
    times: Counter[str] = Counter()
    for r in sampled.collect():  # a row a sampled task
        times.update(dict(zip(r.runs.split(" "), r.times, strict=True)))
    runs = [r for r, _ in sorted(times.items(), key=lambda x: (-x[1], x[0]))[:frequent]]
    lengths = [len(e) for e in load_tokenizer(path).encode_batch_fast(runs, add_special_tokens=False)]
    kept = [(r, n) for r, n in zip(runs, lengths, strict=True) if n < 256]
    return " ".join(r for r, _ in kept), bytes(n for _, n in kept)


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 65_536) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of df, as the tokenizer counts the whole text."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"
    table = df.sparkSession.sparkContext.broadcast(_frequent_table(df, tokenizer_path, text_col, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lengths = table.value
        frequent = {"": 0} | (dict(zip(runs.split(" "), lengths, strict=True)) if lengths else {})
        runs_encoder = encoder(tokenizer_path)
        for whole in batches:
            for batch in split_batch(whole, text_col, 2 << 20):
                counts = [runs_encoder.count(t or "", frequent) for t in batch.column(1).to_pylist()]
                n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(count, schema)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
