"""Operator 9: packing by lexical retrieval.

Documents are encoded once into a written table of token ids. They are put in order of their ``ROUTE`` highest token ids
(in a merge vocabulary the latest merges, so its rarest words), cut into ranges of rows, and each range is cut into shards
of ``SHARD_TOKENS`` as its rows stream by. So documents that share rare words meet in a shard however many shards there
are, and words that very many documents share are split by the words after them and by row. Documents of more than ``LONG``
tokens have rare words of every kind and fill windows by themselves; they are dealt evenly, by a hash of their row. Each shard holds an inverted
index with BM25 weights over token ids; document frequencies, the number of documents and their mean length are those of
all documents. A seed document starts a window; the index returns the unused documents nearest to it, which fill the
window greedily in order of score. What still is open is filled by the head of the best neighbour that did not fit; its
rest is the next seed. So only the end of a shard leaves a window open, and that is cut into sequences whose lengths are
powers of two.

Terms that stand in more than half of all documents are kept as rows of weights over all documents of the shard, others
as lists of documents; both count alike.

Defined results: null or empty text is the end id alone; very long texts are cut into windows of their own; every id lies in exactly one piece; ties in score
go by row order; repeated rows are packed each; null ids stay null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlimorph.llm._shared import materialize, mix64, split_batch
from nlimorph.llm.token_counts import encoder

SHARD_TOKENS = 2_000_000
ROUTE, LONG = 3, 8_192
NEIGHBOURS = 64
K1, B = 1.2, 0.75
TOKENS = ["row", "doc", "n", "ids", "r1", "r2", "r3", "counts"]


def distinct(ids: np.ndarray) -> np.ndarray:
    """The different ids of a document, which has one at least, in order."""
    ids = np.sort(ids)
    first = np.ones(len(ids), dtype=bool)
    np.not_equal(ids[1:], ids[:-1], out=first[1:])
    return ids[first]


def token_table(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, ids, r1, r2, r3, counts): the ids of every row with the end id, two bytes each where they fit, and its route.

    Each partition ends with a row of negative number whose ``counts`` are pairs of token id and number of its documents that have it;
    as a column of their own they are read without the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        vocabulary = enc.tok.get_vocab_size()
        kind = "<u4" if vocabulary > 1 << 16 else "<u2"
        part = TaskContext.get().partitionId()
        row, docs, doc_type = part << 33, np.zeros(1, dtype=np.int64), None
        for whole in batches:
            for batch in split_batch(whole, text_col, 2 << 20):
                ids = [np.frombuffer(enc.text(t or "") + end, dtype="<u4").astype(kind) for t in batch.column(1).to_pylist()]
                terms, doc_type = [distinct(x) for x in ids], batch.column(0).type
                held = np.bincount(np.concatenate(terms))
                docs = np.pad(docs, (0, max(0, len(held) - len(docs))))
                docs[: len(held)] += held
                route = np.array([[*x[: -ROUTE - 1 : -1].tolist(), *[-1] * (ROUTE - len(x))] for x in terms])
                numbers = np.arange(row, row + batch.num_rows)
                long = np.array([len(x) > LONG for x in ids])
                route[long] = np.stack([mix64(numbers[long].astype(np.uint64)) % np.uint64(vocabulary), *[np.zeros(long.sum(), dtype=np.uint64)] * (ROUTE - 1)], axis=1).astype(np.int64)
                rows = pa.array(numbers)
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *(pa.array(r, pa.int32()) for r in route.T), pa.nulls(batch.num_rows, pa.binary())], TOKENS)
        if doc_type is not None:
            at = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int64()), pa.nulls(1, doc_type), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int32()) for _ in range(ROUTE)), pa.array([np.stack([at, docs[at]]).astype("<u8").tobytes()], pa.binary())], TOKENS)

    return df.select(id_col, text_col).mapInArrow(run, f"row long, doc {df.schema[id_col].dataType.simpleString()}, n long, ids binary, r1 int, r2 int, r3 int, counts binary")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each token id stands; its length is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                token, docs = np.frombuffer(data.as_py(), dtype="<u8").astype(np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"token": token, "docs": docs})

    counts = tokens.where(F.col("row") < 0).select("counts").mapInArrow(run, "token long, docs long")
    out = np.zeros(vocabulary, dtype=np.int64)
    for r in counts.groupBy("token").agg(F.sum("docs").alias("docs")).collect():
        out[r.token] = r.docs
    return out


class Index:
    """Inverted index of one shard: for each term its documents and their BM25 weights (frequent terms: weights of all documents)."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, docs: np.ndarray, n_docs: int, mean: float):
        n = len(sizes)
        kind = np.uint32 if len(docs) * n < 1 << 32 else np.uint64  # shorter keys sort faster
        pairs, tf = np.unique(flat.astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), sizes), return_counts=True)
        term, doc = (pairs // kind(n)).astype(np.int64), (pairs % kind(n)).astype(np.int64)
        idf = np.log1p((n_docs - docs[term] + 0.5) / (docs[term] + 0.5))
        weight = (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))).astype(np.float32)
        often = docs[term] * 2 > n_docs
        terms, number = np.unique(term[often], return_inverse=True)
        self.frequent = np.zeros((len(terms), n), dtype=np.float32)
        self.frequent[number, doc[often]] = weight[often]
        term, self.doc, self.weight, self.n = term[~often], doc[~often], weight[~often].astype(np.float64), n  # summed as such
        terms, self.start = np.unique(term, return_index=True)
        self.length = np.diff(np.r_[self.start, len(term)])
        order = np.argsort(self.doc.astype(np.uint16) if n < 1 << 16 else self.doc, kind="stable")
        self.terms_of = np.searchsorted(terms, term)[order]  # term numbers, document by document
        self.bounds = np.searchsorted(self.doc[order], np.arange(n + 1))

    def leave_out(self, unused: np.ndarray) -> None:
        """Forget the postings of used documents; scores of the others stay as they are."""
        left = unused[self.doc]
        ahead = np.r_[0, np.cumsum(left)]
        start = ahead[self.start]
        self.start, self.length = start, ahead[self.start + self.length] - start
        self.doc, self.weight = self.doc[left], self.weight[left]

    def scores(self, seed: int) -> np.ndarray:
        """The summed weights, in each document, of the terms that the seed has."""
        mine = self.terms_of[self.bounds[seed] : self.bounds[seed + 1]]
        length = self.length[mine]
        at = np.repeat(self.start[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n) + self.frequent[self.frequent[:, seed] > 0].sum(axis=0)


def neighbours(scores: np.ndarray, unused: np.ndarray) -> Iterator[list[int]]:
    """Unused documents by falling score, NEIGHBOURS at a time; first few, then more, then all of them are ordered.

    What is given out is used up before the next are asked for.
    """
    given = 0
    for most in (NEIGHBOURS, 64 * NEIGHBOURS, len(scores)):
        free = np.flatnonzero(unused)
        wanted = most - given
        if not len(free):
            return
        best = free[np.argpartition(-scores[free], wanted)[:wanted]] if len(free) > wanted else free
        best = best[np.lexsort((best, -scores[best]))]
        for at in range(0, len(best), NEIGHBOURS):
            yield best[at : at + NEIGHBOURS].tolist()
        given += len(best)


def with_bare(windows: list[list[tuple[int, int, int]]], whole: np.ndarray, bare: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows over the documents ``whole``, and those of one id, which have no term to be found by, behind them in order."""
    out = [[(int(whole[d]), start, length) for d, start, length in pieces] for pieces in windows]
    left = bare.tolist()
    space = window - sum(p[2] for p in out[-1]) if out else 0
    if space and out:
        out[-1] += [(d, 0, 1) for d in left[:space]]
        left = left[space:]
    return out + [[(d, 0, 1) for d in left[at : at + window]] for at in range(0, len(left), window)]


def fill(sizes: np.ndarray, index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length); all but the last are full."""
    unused, indexed = np.ones(len(sizes), dtype=bool), len(sizes)
    sizes = sizes.tolist()  # plain numbers are compared faster one by one
    windows: list[list[tuple[int, int, int]]] = []
    seed, start, following = -1, 0, 0
    while True:
        if seed < 0:
            while following < len(sizes) and not unused[following]:
                following += 1
            if following == len(sizes):
                return windows
            seed, start = following, 0
            unused[seed] = False
        while sizes[seed] - start >= window:
            windows.append([(seed, start, window)])
            start += window
        if start == sizes[seed]:
            seed = -1
            continue
        now = [(seed, start, sizes[seed] - start)]
        space = window - now[0][2]
        if np.count_nonzero(unused) < 0.8 * indexed:
            index.leave_out(unused)
            indexed = np.count_nonzero(unused)
        nearest = neighbours(index.scores(seed), unused)
        seed = -1
        while space and seed < 0:
            best = next(nearest, None)
            if best is None:
                break
            left_over = -1
            for d in best:
                if sizes[d] <= space:
                    now.append((d, 0, sizes[d]))
                    unused[d] = False
                    space -= sizes[d]
                    if not space:
                        break
                elif left_over < 0:
                    left_over = d
            if space and left_over >= 0:
                now.append((left_over, 0, space))
                unused[left_over] = False
                seed, start, space = left_over, space, 0
        windows.append(now)


def powers_of_two(window: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of an open window, cut into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in window)
    if total == size:
        return [window]
    out: list[list[tuple[int, int, int]]] = []
    rest, space = list(reversed(window)), 0
    while rest:
        doc, start, length = rest.pop()
        if not space:
            space = 1 << (total.bit_length() - 1)
            total -= space
            out.append([])
        take = min(length, space)
        out[-1].append((doc, start, take))
        space -= take
        if take < length:
            rest.append((doc, start + take, length - take))
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    tokens = materialize(token_table(df, tokenizer_path, end_id, id_col, text_col), "tokens")
    held = tokens.where(F.col("row") >= 0)
    facts = held.agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
    n_docs, n_tokens = facts.docs, facts.n or 0
    shared = df.sparkSession.sparkContext.broadcast((document_frequencies(tokens, max(encoder(tokenizer_path).tok.get_vocab_size(), end_id + 1)), n_docs, n_tokens / max(n_docs, 1)))
    ranges = max(1, -(-n_tokens // (2 * SHARD_TOKENS)))
    kind, shard_tokens = tokens.schema["doc"].dataType, SHARD_TOKENS
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def packed(table: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of one shard, and how many sequences they fill."""
        sizes = table.column("n").to_numpy()
        data = b"".join(table.column("ids").to_pylist())
        flat = np.frombuffer(data, dtype="<u2" if len(data) == 2 * sizes.sum() else "<u4")
        begin = np.cumsum(sizes) - sizes
        bare = np.flatnonzero(sizes == 1)
        if len(bare):
            whole = np.flatnonzero(sizes > 1)
            terms = flat[np.repeat(sizes > 1, sizes)]
            windows = with_bare(fill(sizes[whole], Index(terms, sizes[whole], *shared.value), window), whole, bare, window) if len(whole) else with_bare([], whole, bare, window)
        else:
            windows = fill(sizes, Index(flat, sizes, *shared.value), window)
        windows[-1:] = powers_of_two(windows[-1], window)
        doc, start, length, crc, sequence, offset, ids = [], [], [], [], [], [], []
        for k, pieces in enumerate(windows):
            at = 0
            for d, s, n in pieces:
                part = flat[begin[d] + s : begin[d] + s + n].astype("<u4")
                for column, value in ((doc, d), (start, s), (length, n), (crc, zlib.crc32(part)), (sequence, first + k), (offset, at)):
                    column.append(value)
                if with_ids:
                    ids.append(part.astype(np.int32))
                at += n
        doc = pa.array(doc, pa.int64())
        columns = [table.column("doc").combine_chunks().take(doc), *(pa.array(x, pa.int64()) for x in (start, length, crc)), table.column("n").combine_chunks().take(doc), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names), len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, tokens_waiting, sequence = [], 0, TaskContext.get().partitionId() << 33
        for whole in batches:
            ends = np.cumsum(whole.column("n").to_numpy())
            start = 0
            while start < whole.num_rows:
                before = ends[start - 1] if start else 0
                stop = min(whole.num_rows, int(np.searchsorted(ends, before + shard_tokens - tokens_waiting)) + 1)
                waiting.append(whole.slice(start, stop - start))
                tokens_waiting += int(ends[stop - 1] - before)
                start = stop
                if tokens_waiting >= shard_tokens:
                    batch, filled = packed(pa.Table.from_batches(waiting), sequence)
                    yield batch
                    waiting, tokens_waiting, sequence = [], 0, sequence + filled
        if waiting:
            yield packed(pa.Table.from_batches(waiting), sequence)[0]

    order = ["r1", "r2", "r3", "row"]
    ranged = held.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return ranged.select("doc", "n", "ids").mapInArrow(run, schema)
