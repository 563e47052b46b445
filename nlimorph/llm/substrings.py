"""Operator 5: removal of repeated passages by fixed-block anchors.

A passage is a window of ``window`` words. Each document is cut into non-overlapping blocks of half a
window, so that every window holds one whole block of its own document. The blocks are indexed by hash;
every rolling window of block length, of every document, probes the index. Where a probe meets a block
that stands anywhere else, the windows around the hit are candidates: they are extended to their full
length by a 128-bit hash and counted. Neighbouring windows that repeat join to maximal exact repeats, and
their words are removed.

Both look-ups run as exchanges of packed arrays. Documents are first packed into chunks (about
``CHUNK_BYTES`` of text) in a written table. A chunk sends each bucket of the hash space its distinct
hashes, so a passage that a third of all documents share costs one entry a chunk; the bucket answers with
one bit an entry. Buckets are numerous enough to hold about ``BUCKET_WORDS`` entries each.

Defined results: null text has no words (kept text ``''``); documents shorter than a window keep all
words; very long texts are a chunk of their own and judged whole; repeated rows count as copies of each other;
null ids and other columns pass through unchanged in the struct ``doc``; an empty table gives an empty result. Words are compared through 64-bit hashes, and
windows through 128 bits of them.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlimorph.llm._shared import WordHashes, materialize, rolling_hash, split_batch

CHUNK_BYTES = 2 << 20
BUCKET_WORDS = 2_000_000
BASE_BLOCK, BASE_ONE, BASE_TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def pack(df: DataFrame, text_col: str) -> DataFrame:
    """(chunk, n_bytes, body): rows of df, all columns, as compressed record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        number = 0
        for whole in batches:
            for batch in split_batch(whole, text_col, CHUNK_BYTES):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch)
                size = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text_col)))).as_py() or 0
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([first + number], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "body": pa.array([sink.getvalue()], pa.binary())})
                number += 1

    return df.mapInArrow(run, "chunk long, n_bytes long, body binary")


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


class ChunkWords:
    """The words of a chunk's documents that are at least one window long, end to end."""

    def __init__(self, texts: list[str | None], window: int, hashes: WordHashes):
        split = [t.encode().split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.window, self.block = window, (window + 1) // 2
        self.long = np.flatnonzero(self.sizes >= window)
        self.words = split
        lengths = self.sizes[self.long]
        self.starts = np.cumsum(lengths) - lengths
        self.values = np.concatenate([hashes.of(split[k]) for k in self.long]) if len(self.long) else np.empty(0, np.uint64)
        self.place = np.arange(len(self.values)) - np.repeat(self.starts, lengths)  # word number inside its document
        self.left = np.repeat(lengths, lengths) - self.place  # words from here to the end

    def block_probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and whether it is an indexed block, of every rolling block."""
        at = np.flatnonzero(self.left >= self.block)
        return at, rolling_hash(self.values, self.block, BASE_BLOCK)[at], self.place[at] % self.block == 0

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit; ``hit`` marks positions where a block probe was met."""
        n = len(self.values) - self.window + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        total = np.r_[0, np.cumsum(hit)]
        inside = self.window - self.block + 1
        return np.flatnonzero((self.left[:n] >= self.window) & (total[inside : inside + n] > total[:n]))

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return rolling_hash(self.values, self.window, BASE_ONE)[at], rolling_hash(self.values, self.window, BASE_TWO)[at]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


class Distinct:
    """Distinct (first, second) hash pairs of one chunk in bucket order, and the way back to the entries."""

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int):
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        self.of = np.empty(len(first), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first, self.second = a[heads], b[heads]
        self.several = np.diff(np.r_[heads, len(a)]) > 1
        bucket = _bucket(self.first, buckets)
        self.buckets, at = np.unique(bucket, return_index=True)
        self.ends = np.r_[at, len(bucket)]

    def answers(self, replies: list[dict]) -> np.ndarray:
        """The bit that the buckets sent back, for each entry."""
        masks = {r["bucket"]: r["mask"] for r in replies}
        bits = [_flags(masks[int(b)], n) for b, n in zip(self.buckets, np.diff(self.ends), strict=True)]
        return (np.concatenate(bits) if bits else np.empty(0, bool))[self.of]


def _answer(hash_kind: str):
    """Reducer of one bucket: which entries stand at two places or more, one of them indexed."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        first = np.frombuffer(b"".join(table.column("first").to_pylist()), dtype=hash_kind)
        second = np.frombuffer(b"".join(table.column("second").to_pylist()), dtype=np.uint64)
        several = np.concatenate([_flags(x, n) for x, n in zip(table.column("several").to_pylist(), sizes, strict=True)])
        indexed = np.concatenate([_flags(x, n) for x, n in zip(table.column("indexed").to_pylist(), sizes, strict=True)])
        order = np.lexsort((second, first)) if len(second) else np.argsort(first, kind="stable")
        a = first[order]
        new = np.r_[True, a[1:] != a[:-1]]
        if len(second):
            b = second[order]
            new[1:] |= b[1:] != b[:-1]
        heads = np.flatnonzero(new)
        repeated = (np.diff(np.r_[heads, len(a)]) > 1) | np.logical_or.reduceat(several[order], heads)
        repeated &= np.logical_or.reduceat(indexed[order], heads)
        out = np.empty(len(a), dtype=bool)
        out[order] = repeated[np.cumsum(new) - 1]
        masks = [_bits(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return run


PAYLOAD = "chunk long, bucket int, n int, first binary, second binary, several binary, indexed binary"
REPLIES = "chunk long, bucket int, mask binary"


def _exchange(payload: DataFrame, hash_kind: str, label: str) -> DataFrame:
    replies = payload.groupBy("bucket").applyInArrow(_answer(hash_kind), REPLIES)
    return materialize(replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias(label)), label)


def _payload(chunk: int, d: Distinct, first: np.ndarray, second: np.ndarray, indexed: np.ndarray) -> pa.RecordBatch:
    cuts = list(zip(d.ends[:-1].tolist(), d.ends[1:].tolist(), strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "chunk": pa.array([chunk] * len(cuts), pa.int64()),
            "bucket": pa.array(d.buckets.astype(np.int32)),
            "n": pa.array([b - a for a, b in cuts], pa.int32()),
            "first": pa.array([first[a:b].tobytes() for a, b in cuts], pa.binary()),
            "second": pa.array([second[a:b].tobytes() for a, b in cuts], pa.binary()),
            "several": pa.array([_bits(d.several[a:b]) for a, b in cuts], pa.binary()),
            "indexed": pa.array([_bits(indexed[a:b]) for a, b in cuts], pa.binary()),
        }
    )


def _probe(text_col: str, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                words = ChunkWords(unpack(body.as_py()).column(text_col).to_pylist(), window, hashes)
                _, probe, aligned = words.block_probes()
                d = Distinct(probe, np.zeros(len(probe), dtype=np.uint64), buckets)
                indexed = np.zeros(len(d.first), dtype=bool)
                indexed[d.of[aligned]] = True
                # inside a bucket 32 bits of the hash do: a chance meeting only adds a candidate
                yield _payload(chunk, d, d.first.astype(np.uint32), np.empty(0, np.uint64), indexed)

    return run


def _hits(words: ChunkWords, replies: list[dict], buckets: int) -> np.ndarray:
    at, probe, _ = words.block_probes()
    hit = np.zeros(len(words.values), dtype=bool)
    hit[at] = Distinct(probe, np.zeros(len(probe), dtype=np.uint64), buckets).answers(replies)
    return words.candidates(hit)


def _extend(text_col: str, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row in batch.select(["chunk", "body", "blocks"]).to_pylist():
                words = ChunkWords(unpack(row["body"]).column(text_col).to_pylist(), window, hashes)
                d = Distinct(*words.window_hashes(_hits(words, row["blocks"], buckets)), buckets)
                yield _payload(row["chunk"], d, d.first, d.second, np.ones(len(d.first), dtype=bool))

    return run


def _remove(text_col: str, window: int, buckets: int, schema: pa.Schema, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row in batch.select(["body", "blocks", "windows"]).to_pylist():
                docs = unpack(row["body"]).combine_chunks()
                words = ChunkWords(docs.column(text_col).to_pylist(), window, hashes)
                at = _hits(words, row["blocks"], buckets) if row["blocks"] else np.empty(0, dtype=np.int64)
                if len(at):
                    at = at[Distinct(*words.window_hashes(at), buckets).answers(row["windows"])]
                edge = np.zeros(len(words.values) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept, removed, spans = [b" ".join(w) for w in words.words], np.zeros(len(words.words), dtype=np.int64), [[] for _ in words.words]
                for k, start in zip(words.long.tolist(), words.starts.tolist(), strict=True):
                    mine = gone[start : start + len(words.words[k])]
                    if mine.any():
                        kept[k] = b" ".join([w for w, g in zip(words.words[k], mine.tolist(), strict=True) if not g])
                        removed[k] = mine.sum()
                        turns = np.flatnonzero(np.diff(np.r_[False, mine, False])).tolist()
                        spans[k] = [{"start": a, "stop": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                doc = pa.StructArray.from_arrays([docs.column(k).combine_chunks() if docs.num_rows else pa.array([], f.type) for k, f in enumerate(docs.schema)], fields=list(schema.field("doc").type))
                out = [hashlib.sha256(x).hexdigest() for x in kept] if digests else [x.decode() for x in kept]
                yield pa.RecordBatch.from_arrays([doc, pa.array(words.sizes), pa.array(removed), pa.array(out, pa.string()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return run


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = 35, digests: bool = False) -> DataFrame:
    """(doc, n_words, n_removed, kept, spans) of every row of df, ``doc`` holding all its columns.

    ``kept`` is the text of the kept words joined by spaces, or with ``digests`` its SHA-256; ``spans`` lists
    the removed runs as word numbers (start, stop).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    chunks = materialize(pack(df, text_col), "chunks").select("chunk", "n_bytes", "body")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-size // (6 * BUCKET_WORDS)))
    blocks = _exchange(chunks.select("chunk", "body").mapInArrow(_probe(text_col, window, buckets), PAYLOAD), "<u4", "blocks")
    met = chunks.select("chunk", "body").join(blocks, "chunk")
    windows = _exchange(met.mapInArrow(_extend(text_col, window, buckets), PAYLOAD), "<u8", "windows")
    spark_schema = T.StructType().add("doc", df.schema).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType()).add("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())))
    full = chunks.select("chunk", "body").join(blocks.join(windows, "chunk", "left"), "chunk", "left")
    return full.mapInArrow(_remove(text_col, window, buckets, to_arrow_schema(spark_schema), digests), spark_schema)


def remove_repeats_sql(window: int = 35) -> str:
    """Digests of the kept texts of ``documents``, as DuckDB SQL: every window spelled out and counted."""
    return f"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select r, i, array_to_string(w[i:i + {window - 1}], ' ') as s from d, unnest(generate_series(1, len(w) - {window - 1})) t(i)),
hit as (select r, i from win semi join (select s from win group by s having count(*) > 1) using (s)),
gone as (select distinct r, j from hit, unnest(generate_series(i, i + {window - 1})) t(j)),
word as (select r, unnest(w) as word, unnest(generate_series(1, len(w))) as j from d),
kept as (select r, string_agg(word, ' ' order by j) as text from word anti join gone using (r, j) group by r),
n as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join n using (r) left join kept using (r)"""
