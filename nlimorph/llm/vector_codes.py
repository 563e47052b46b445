"""Operator 13: compression of vectors to codes of parts (product quantisation), by equal-average search.

Components become integers and vectors are cut into equal parts, each with a codebook. The nearest entry of a part is
found without comparing all: entries are sorted by the sum of their components; by Cauchy and Schwarz the squared gap
between two sums, over the number of components, is at most the squared distance. So the search starts at the part's own
sum, goes outward on both sides, and a side ends when its gap says that strictly less than the best distance is out of
reach there and an equal one too. All parts of a batch step together; those whose sides have ended leave.

Every round, tasks send the sums of the parts of each entry, one row an entry of a codebook, and the driver
holds the codebooks. All arithmetic is on integers and exact: 64-bit ones while squared distances fit them, else
Python's own.

Defined results: vectors that are null, empty or hold components that are null, not finite or too large for a long are left out, and
so are vectors of another length than the commonest; a length that is no multiple of the number of parts is filled up
with zeros; with fewer vectors than entries the codebooks are that short; first entries go by id and then by vector, null
ids last, repeated ids give an entry each; equal entries: the lower index; labels that are null are one label; repeated
rows keep a row each; an error that does not fit a long is null; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlimorph.llm._shared import materialize
from nlimorph.llm.vectors import integers, of_one_length

BATCH = 4_096  # vectors that step together


def _reach(values: np.ndarray) -> float:
    return float(np.abs(values.astype(float)).max(initial=0))


class Codebook:
    """Entries of one part in the order of their sums."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.size, self.reach = entries, entries.shape[1], _reach(entries)
        self._order()

    def _order(self) -> None:
        sums = self.entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def _wide(self) -> Codebook:
        """The same with Python's integers."""
        made = Codebook.__new__(Codebook)
        made.entries, made.size, made.reach = self.entries.astype(object), self.size, 0
        made._order()
        return made

    def nearest(self, parts: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, the lower of equally near ones, and its squared distance.

        ``compared`` gets the numbers of distances made.
        """
        if parts.dtype != object and self.size * (self.reach + _reach(parts)) >= 3e9:  # squared gaps leave 64 bits
            return self._wide().nearest(parts.astype(object), compared)
        n, last = len(parts), len(self.order) - 1
        own = parts.sum(axis=1)
        start = np.searchsorted(self.sums, own)
        best, index = np.zeros(n, dtype=parts.dtype), np.full(n, -1)
        sides = [(start - 1, -1), (start.copy(), 1)]
        live = [np.arange(n), np.arange(n)]
        while len(live[0]) or len(live[1]):
            for side, (at, step) in enumerate(sides):
                rows = live[side]
                rows = rows[(at[rows] >= 0) & (at[rows] <= last)]
                gap = own[rows] - self.sums[at[rows]]
                rows = rows[(index[rows] < 0) | (gap * gap <= self.size * best[rows])]
                entry = self.order[at[rows]]
                off = parts[rows] - self.entries[entry]
                far = (off * off).sum(axis=1)
                won = (index[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (entry < index[rows]))
                best[rows[won]], index[rows[won]] = far[won], entry[won]
                at[rows] += step
                live[side] = rows
                if compared is not None:
                    compared.append(len(rows))
        return index, best


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as (part, vector, component)."""
    filled = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % parts)))
    return filled.reshape(len(filled), parts, -1).transpose(1, 0, 2)


class Codes:
    """Codebooks of all parts; ``entries`` is (part, entry, component)."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.books = entries, [Codebook(e) for e in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts of the vectors, index and squared distance of each, by part."""
        parts = _cut(vectors, len(self.books))
        found = [book.nearest(p) for book, p in zip(self.books, parts, strict=True)]
        return parts, np.stack([i for i, _ in found]), np.stack([d.astype(object) for _, d in found])

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codes:
        """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
        entries = self.entries.copy()
        for (part, entry), (count, total) in sums.items():
            entries[part, entry] = [t // count for t in total]
        return Codes(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _batches(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of up to BATCH rows and their vectors, the last column."""
    for frame in frames:
        for at in range(0, frame.num_rows, BATCH):
            rows = frame.slice(at, BATCH)
            x = rows.column(rows.num_columns - 1)
            yield rows, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _tally(shared):
    """Numbers and sums of the parts that each entry gets in a task, for mapInArrow."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        shape = codes.entries.shape
        counts, sums = np.zeros(shape[:2], dtype=np.int64), np.zeros(shape, dtype=object)
        for _, vectors in _batches(frames):
            parts, index, _ = codes.assign(vectors)
            batch = np.zeros(shape, dtype=np.int64 if _reach(parts) < 1 << 50 else object)
            for k in range(shape[0]):
                counts[k] += np.bincount(index[k], minlength=shape[1])
                np.add.at(batch[k], index[k], parts[k].astype(batch.dtype))
            sums += batch
        part, entry = np.nonzero(counts)
        total = pa.array([sums[p, e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), total], ["part", "entry", "n", "total"])

    return run


def _round(rows: DataFrame, codes: Codes) -> Codes:
    """Codebooks after one assignment of all parts."""
    made = rows.select("x").mapInArrow(_tally(rows.sparkSession.sparkContext.broadcast(codes)), "part int, entry int, n long, total array<decimal(38,0)>")
    size = codes.entries.shape[2]
    sums = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(size)]).alias("total"))
    return codes.moved({(r.part, r.entry): (r.n, [int(t) for t in r.total]) for r in sums.collect()})  # a row an entry


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector: two hex digits a part, and the squared distances that the code leaves."""
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    rows, d = of_one_length(integers(df, vector_col, {"_id": id_col, "_label": label_col}, scale))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    codes = Codes(_cut(np.array([r.x for r in first], dtype=np.int64), parts))
    for _ in range(rounds):
        codes = _round(rows, codes)
    shared = df.sparkSession.sparkContext.broadcast(codes)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _batches(frames):
            _, index, far = shared.value.assign(vectors)
            text = [bytes(row).hex() for row in index.T.astype(np.uint8)]
            error = [e if e < 1 << 63 else None for e in map(int, far.sum(axis=0))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["_id", "_label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    coded = materialize(rows.mapInArrow(encode, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"), "codes")
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    labels = materialize(coded.groupBy(F.col("_label").alias("_of")).agg(total.alias("label_error")), "label-errors")
    met = coded.join(labels, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return met.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def compress_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same over ``embeddings``, as DuckDB SQL, every part compared with every entry; for vectors of one length that ``parts`` divides."""

    def assigned(k: int) -> str:
        """The nearest entry of each part under the codebooks of round k."""
        squares = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"
        return f"a{k} as materialized (select r, part, min((far, e)) as best from (select r, p.part, c.e, {squares} as far from p join c{k} c using (part)) group by r, part)"

    def moved(k: int) -> str:
        """Codebooks of round k from the assignment before."""
        each = f"select a.part, a.best[2] as e, unnest(p.v) as x, generate_subscripts(p.v, 1) as i from a{k - 1} a join p using (r, part)"
        sums = f"select part, e, i, sum(x)::bigint as s, count(*) as n from ({each}) group by part, e, i"
        new = f"select part, e, list((s - ((s % n) + n) % n) // n order by i) as v from ({sums}) group by part, e"
        return f"c{k} as materialized (select part, e, coalesce(m.v, c.v) as v from c{k - 1} c left join ({new}) m using (part, e))"

    steps = ", ".join([assigned(0), *[f(k) for k in range(1, rounds + 1) for f in (moved, assigned)]])
    return f"""
with k as (select row_number() over (order by vec_id nulls last, x) - 1 as r, vec_id, label, x from (
  select vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding))),
p as materialized (select r, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) as v from (select *, unnest(range({parts})) as part from k)),
c0 as materialized (select part, r as e, v from p where r < {entries}), {steps},
s as (select sha256(string_agg(x::varchar, ',' order by part, e, i)) as codebooks_sha256 from (select part, e, unnest(v) as x, generate_subscripts(v, 1) as i from c{rounds})),
f as (select r, string_agg(lower(lpad(to_hex(best[2]), 2, '0')), '' order by part) as code, sum(best[1])::bigint as error from a{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from f join k using (r) cross join s"""
