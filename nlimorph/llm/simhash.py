"""Operator 2: SimHash near-duplicates by anchor-point covering.

Anchors are the words of a perfect covering code on a block of fingerprint bits: every block lies within
the code's radius R of exactly one anchor, its home. Two blocks that differ in at most t bits then share
the home of either within R + t, so each distinct fingerprint is replicated to all anchors within R + t of
its blocks and compared there. A fingerprint has several blocks; if two fingerprints differ in at most
T bits, some block pair differs in at most T // blocks.

Rows sorted by anchor are compared as they stream by. Anchors met by more than ``GROUP`` fingerprints are cut into
sub-blocks that meet pairwise, so no group grows with the data. Of the links only enough edges leave a task to keep
the components: a few for each fingerprint and block, however many copies there are.

Defined results: null or wordless text has fingerprint 0 and is linked like any other; exact copies share
a fingerprint; very long texts are read whole, one at a time; a null id gets a component like any row (null only if all ids of it are null); repeated rows
give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlimorph.llm._shared import materialize, mix64, split_batch
from nlimorph.llm.components import components

GROUP = 2048
SEED = 42


class CoveringCode:
    """A cyclic perfect code: Hamming (31, 26), of radius 1."""

    #: Length, generator polynomial, covering radius.
    KINDS = {"hamming31": (31, 0b100101, 1)}

    def __init__(self, kind: str, within: int):
        self.n, self.generator, self.radius = self.KINDS[kind]
        self.checks = self.generator.bit_length() - 1
        self.column = np.array([self._syndrome(1 << k) for k in range(self.n)], dtype=np.uint32)
        reach = self.radius + within
        found: dict[int, list[tuple[int, int]]] = {}
        for weight in range(reach + 1):
            for bits in combinations(range(self.n), weight):
                found.setdefault(int(np.bitwise_xor.reduce(self.column[list(bits)], initial=0)), []).append((weight, sum(1 << b for b in bits)))
        width = max(map(len, found.values()))
        self.patterns = np.zeros((1 << self.checks, width), dtype=np.uint64)
        self.counts = np.zeros(1 << self.checks, dtype=np.int64)
        for s, rows in found.items():
            self.counts[s] = len(rows)
            self.patterns[s, : len(rows)] = [p for _, p in rows]  # in order of weight: the home comes first
        self.tables = [self._byte_table(8 * k) for k in range((self.n + 7) // 8)]

    def _syndrome(self, word: int) -> int:
        for k in range(self.n - 1, self.checks - 1, -1):
            if word >> k & 1:
                word ^= self.generator << (k - self.checks)
        return word

    def _byte_table(self, shift: int) -> np.ndarray:
        table = np.zeros(256, dtype=np.uint32)
        for k in range(min(8, self.n - shift)):
            table[np.arange(256) >> k & 1 == 1] ^= self.column[shift + k]
        return table

    def anchors(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the block, anchor, whether it is the block's home) of every anchor in reach."""
        s = np.zeros(len(blocks), dtype=np.uint32)
        for k, table in enumerate(self.tables):
            s ^= table[(blocks >> np.uint64(8 * k)).astype(np.int64) & 255]
        counts = self.counts[s]
        row = np.repeat(np.arange(len(blocks)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return row, blocks[row] ^ self.patterns[s[row], nth], nth == 0


@functools.cache
def covering_code(kind: str, within: int) -> CoveringCode:
    """The code with its patterns, made once a process."""
    return CoveringCode(kind, within)


def _bits_over_half(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text (A-Z only), repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[size - 1 :].tolist() if len(words) >= size else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, lo): the 64-bit SimHash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, text_col, 4 << 20):
                values = [_bits_over_half(h) if len(h := shingle_hashes(t or "", shingle)) else 0 for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], [id_col, "lo"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, lo long")


def _nearest_smaller(node: np.ndarray, lo: np.ndarray, block: np.ndarray, home: np.ndarray, within: int, most: int) -> tuple[list[int], list[int]]:
    """Edges of one group: each home to linked members of smaller number, one of each bunch that is linked among itself.

    A member left out is linked, and as close in this block, to one that is kept; those two meet at the home of
    the larger of them. By induction over node numbers the components are those of all links.
    """
    u, v = [], []
    for at in np.flatnonzero(home).tolist():
        near = np.flatnonzero((node < node[at]) & (np.bitwise_count(block ^ block[at]) <= within) & (np.bitwise_count(lo ^ lo[at]) <= most))
        near = near[np.argsort(node[near])]
        while len(near):
            u.append(int(node[at]))
            v.append(int(node[near[0]]))
            near = near[(np.bitwise_count(lo[near] ^ lo[near[0]]) > most) | (np.bitwise_count(block[near] ^ block[near[0]]) > within)]
    return u, v


MET = "u long, v long, anchor long, node long, lo long, place long"


def _met(u: list[int], v: list[int], hot: list[np.ndarray]) -> pa.RecordBatch:
    """Edges, then rows of anchors too large for one group."""
    rows = np.concatenate(hot, axis=1) if hot else np.empty((4, 0), dtype=np.int64)
    n, m = len(u), rows.shape[1]
    columns = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (u, v)]
    columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in rows]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in MET.split(", ")])


def _edges_of(rows: np.ndarray, within: int, most: int) -> tuple[list[int], list[int]]:
    _, node, lo, place = rows
    return _nearest_smaller(node, lo.view(np.uint64), place >> 1, (place & 1).astype(bool), within, most)


def _compare(batches: Iterator[pa.RecordBatch], within: int, most: int, group: int) -> Iterator[pa.RecordBatch]:
    """Groups of rows sorted by anchor, as they stream by; a group over ``group`` passes on its rows."""
    held, hot = np.empty((4, 0), dtype=np.int64), None
    for batch in _with_end(batches):
        u, v, large = [], [], []
        if batch is not None:
            held = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns])], axis=1)
        edge = np.flatnonzero(np.r_[True, held[0, 1:] != held[0, :-1]]) if held.shape[1] else np.empty(0, np.int64)
        stops = np.r_[edge[1:], held.shape[1]] if len(edge) else edge
        last = len(edge) - (batch is not None)
        for a, b in zip(edge[:last][(stops - edge)[:last] > 1].tolist(), stops[:last][(stops - edge)[:last] > 1].tolist(), strict=True):
            if held[0, a] == hot or b - a > group:
                large.append(held[:, a:b])
            else:
                x, y = _edges_of(held[:, a:b], within, most)
                u += x
                v += y
        if last and held[0, edge[0]] == hot and stops[0] - edge[0] == 1:
            large.append(held[:, :1])
        held = held[:, edge[last] :].copy() if last < len(edge) else held[:, :0]
        if held.shape[1] > group or held.shape[1] and held[0, 0] == hot:
            hot = held[0, 0]
            large.append(held)
            held = held[:, :0]
        yield _met(u, v, large)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _compare_parts(batches: Iterator[pa.RecordBatch], within: int, most: int) -> Iterator[pa.RecordBatch]:
    """Edges of groups that come as arrays of members."""
    for batch in batches:
        u, v = [], []
        members = batch.column(0)
        offsets, flat = members.offsets.to_numpy() - members.offsets[0].as_py(), members.flatten()
        rows = np.stack([np.asarray(flat.field(k)) for k in ("node", "node", "lo", "place")])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            x, y = _edges_of(rows[:, a:b], within, most)
            u += x
            v += y
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def links(prints: DataFrame, words: list[str], most: int, within: int = 1) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs with at most ``most`` differing bits in ``lo`` that meet.

    ``prints`` has the distinct long column node, the long column lo and the columns ``words``, each of which gives two
    blocks of 31 bits. Two rows meet if one block of theirs differs in at most ``within`` bits.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = covering_code("hamming31", within)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                node, lo, *columns = (np.asarray(c) for c in whole.slice(at, 4096).columns)
                for number, (bits, shift) in enumerate((c, s) for c in columns for s in (0, 32)):
                    block = (bits.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << code.n) - 1)
                    row, anchor, home = code.anchors(block)
                    place = (block[row] << np.uint64(1) | home).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(number << 40)).view(np.int64)), pa.array(node[row]), pa.array(lo[row]), pa.array(place)], ["anchor", "node", "lo", "place"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = prints.select("node", "lo", *[F.col(w).alias(f"w{k}") for k, w in enumerate(words)]).repartition(parts)  # few bytes now, many rows soon; by key it would be left out, as the rows come by that key
    return _edges(even.mapInArrow(replicate, "anchor long, node long, lo long, place long"), within, most)


def band_links(prints: DataFrame) -> DataFrame:
    """Edges as of ``links``, of rows (node, sketch, bands) that share a band and differ in at most ``SKETCH_BITS`` bits of the sketch."""
    return _edges(prints.select(F.explode("bands").alias("anchor"), "node", F.col("sketch").alias("lo"), F.lit(1).cast("long").alias("place")), 0, SKETCH_BITS)


def _edges(rows: DataFrame, within: int, most: int) -> DataFrame:
    """Rows (anchor, node, lo, place) compared anchor by anchor; no group grows with the data."""
    sorted_rows, group = rows.repartition("anchor").sortWithinPartitions("anchor"), GROUP
    met = materialize(sorted_rows.mapInArrow(lambda batches: _compare(batches, within, most, group), MET), "met")
    large = met.where(F.col("anchor").isNotNull())
    parts = large.groupBy("anchor").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = large.join(parts, "anchor").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = dealt.groupBy("anchor", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(F.struct("node", "lo", "place")).alias("members"))
    more = groups.select("members").mapInArrow(lambda batches: _compare_parts(batches, within, most), "u long, v long")
    return met.where(F.col("u").isNotNull()).select("u", "v").union(more).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row; links are fingerprints with at most ``most`` (3 or fewer) differing bits."""
    if most > 3:
        raise ValueError("two blocks of radius one cover at most 3 differing bits")
    prints = materialize(fingerprints(df, id_col, text_col, shingle), "prints")
    classes = prints.groupBy("lo").agg(F.min(id_col).alias("least"))
    edges = links(classes.select(F.col("lo").alias("node"), "lo"), ["lo"], most)
    stars = components(edges, "simhash")
    labelled = classes.join(stars.select(F.col("u").alias("lo"), F.col("v").alias("root")), "lo", "left").withColumn("root", F.coalesce("root", "lo"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("lo", "root").join(least, "root").select("lo", "component_id")
    named = F.lower(F.lpad(F.hex("lo"), 16, "0")).alias("fingerprint")
    return prints.join(by_print, "lo").select(id_col, named, "component_id")


#: The general form: a 256-bit SimHash of the set of shingles, with eight blocks and a looser bound on its first 64 bits.
WORDS = ["lo", "s1", "s2", "s3"]
LOOSE_BITS = 16
#: A group of texts that are verified together: so many texts, or so many bytes of them.
VERIFY_GROUP, VERIFY_BYTES = 512, 4 << 20
#: MinHash of the shingle sets, for edits that change whole passages: pairs at similarity 0.8 share a band but for one in 20,000.
BAND, BANDS = 5, 25
FACTORS = mix64(np.arange(1, BAND * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
SKETCH_BITS = 18


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of a shingle set under each of ``BAND * BANDS`` orders (the largest number for an empty set)."""
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (hashes[at : at + 1024, None] * FACTORS).min(axis=0), out=out)
    return out


def bands_of(least: np.ndarray) -> tuple[int, np.ndarray]:
    """One bit of each of the first 64 least values, and a key for every band of them."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        key = mix64(key ^ column)
    return int(np.packbits((least[:64] & np.uint64(1)).astype(np.uint8)).view(np.int64)[0]), key.view(np.int64)


def _sketches(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Every row as struct ``doc`` with a row number, the bytes of its text, and SimHash, digest and MinHash of its set of shingles."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType().add("doc", df.schema).add("row", T.LongType()).add("lo", T.LongType()).add("s1", T.LongType()).add("s2", T.LongType()).add("s3", T.LongType())
    schema = schema.add("content", T.StringType()).add("sketch", T.LongType()).add("bands", T.ArrayType(T.LongType())).add("bytes", T.LongType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in split_batch(whole, text_col, 2 << 20):
                sketches, content, bits, bands, sizes = [], [], [], [], []
                for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                    shingles = np.unique(shingle_hashes(text or "", shingle))
                    hashes, sketch = shingles, []
                    for _ in WORDS:
                        sketch.append(_bits_over_half(hashes) if len(hashes) else 0)
                        hashes = mix64(hashes)
                    sketches.append(sketch)
                    sizes.append(len(text) if text else 0)
                    content.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()))
                    one, keys = bands_of(min_hashes(shingles))
                    bits.append(one)
                    bands.append(keys)
                rows = pa.array(np.arange(row, row + batch.num_rows))
                row += batch.num_rows
                doc = pa.StructArray.from_arrays(batch.columns, fields=list(arrow.field("doc").type))
                columns = [doc, rows, *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in zip(*sketches, strict=True)), pa.array(content, pa.string()), pa.array(bits, pa.int64())]
                columns += [pa.array(bands, arrow.field("bands").type), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges between members of a group whose shingle sets are alike enough; members already joined are not compared."""
    for batch in batches:
        u, v = [], []
        for members in batch.column(0):
            rows = sorted(members.as_py(), key=lambda m: m["node"])
            sets = [np.unique(shingle_hashes(m["text"] or "", shingle)) for m in rows]
            size = np.array([len(s) for s in sets])
            begin = np.cumsum(size) - size
            _, number, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            holder = np.repeat(np.arange(len(rows), dtype=np.int32), size)[np.argsort(number, kind="stable")]
            first = np.cumsum(holders) - holders
            label = np.unique([m["label"] for m in rows], return_inverse=True)[1]
            for i in range(len(rows) - 1):
                near = np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i])
                if not (near & (label[i + 1 :] != label[i])).any():
                    continue
                mine = number[begin[i] : begin[i] + size[i]]
                length = holders[mine]
                at = np.repeat(first[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                common = np.bincount(holder[at], minlength=len(rows))[i + 1 :]
                near &= common >= similarity * (size[i] + size[i + 1 :] - common) - 1e-9
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    if label[j] != label[i]:
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
                        u.append(rows[j]["node"])
                        v.append(rows[i]["node"])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _part(share: Column) -> Column:
    """One of ``share`` parts, by node."""
    return F.pmod(F.xxhash64("node"), share).cast("int")


def _parts() -> Column:
    """How many groups the counted texts need."""
    return F.ceil(F.greatest(F.count("*") / VERIFY_GROUP, F.sum("bytes") / VERIFY_BYTES)).cast("int")


def _compared(members: DataFrame, texts: DataFrame, keys: list[str], shingle: int, similarity: float) -> DataFrame:
    """Verified edges inside each group of (keys, node, label)."""
    rows = members.join(texts, "node").groupBy(*keys).agg(F.collect_list(F.struct("node", "label", "text")).alias("members"))
    return rows.select("members").mapInArrow(lambda batches: _verified(batches, shingle, similarity), "u long, v long")


def verified_links(candidates: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stars (u, v) of the verified links inside each group of candidates.

    ``candidates`` has node, group and bytes, ``texts`` node and text. Groups are cut into parts of bounded size and each
    part is compared inside. Where a group has several parts, those of different labels (what the first step has joined)
    then meet: a label of many texts fills parts of its own, small labels share some. Parts of one label never meet, so a
    large group of copies costs each of its texts one comparison, and what does not belong to it meets all its parts.
    """
    sizes = candidates.groupBy("group").agg(_parts().alias("parts"))
    cut = candidates.join(sizes, "group").withColumn("part", _part(F.col("parts")))
    inside = materialize(_compared(cut.withColumn("label", F.col("node")), texts, ["group", "part"], shingle, similarity), "inside")
    stars = components(inside, "inside")
    several = cut.where(F.col("parts") > 1).select("group", "node", "bytes").join(stars.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = several.groupBy("group", "label").agg(_parts().alias("parts"), F.count("*").alias("n"))
    mixed = (F.col("parts") == 1) & (F.col("n") < VERIFY_GROUP // 2)
    bins = several.join(labels.withColumn("kind", F.when(mixed, F.lit(None).cast("long")).otherwise(F.col("label"))).select("group", "label", "kind"), ["group", "label"])
    shares = bins.groupBy("group", "kind").agg(_parts().alias("share"))
    placed = bins.alias("b").join(shares.alias("s"), (F.col("b.group") == F.col("s.group")) & F.col("b.kind").eqNullSafe(F.col("s.kind"))).select("b.group", "b.node", "b.label", "b.kind", _part(F.col("share")).alias("at"))
    bin_of = F.struct(F.col("kind"), F.col("at"))
    placed = materialize(placed.select("group", "node", "label", bin_of.alias("bin")), "placed")
    every = placed.select("group", "bin").distinct()
    met = every.alias("x").join(every.select("group", F.col("bin").alias("other")).alias("y"), "group").where((F.col("bin") <= F.col("other")) & (F.col("bin.kind").isNull() | ~F.col("bin.kind").eqNullSafe(F.col("other.kind"))))
    numbered = materialize(met.select("group", "bin", "other", F.monotonically_increasing_id().alias("meeting")), "meetings")
    both = numbered.select("group", "meeting", F.explode(F.array_distinct(F.array("bin", "other"))).alias("bin"))
    across = _compared(both.join(placed, ["group", "bin"]).select("meeting", "node", "label"), texts, ["meeting"], shingle, similarity)
    return components(stars.union(across), "copies")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df without near copies: of every group the row with the smallest id stays (null ids last).

    Two rows are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``similarity`` and their SimHashes meet at an anchor or their MinHashes in a band; groups are the components of
    links. Links are verified on whole texts, class representatives only, in groups of bounded size.
    """
    rows = materialize(_sketches(df, text_col, shingle), "sketches")
    rank = F.struct(F.col("doc")[id_col].isNull().alias("null_id"), F.col("doc")[id_col].alias("id"), F.col("row").alias("row"))
    facts = [*WORDS, "sketch", "bands", "bytes"]
    classes = materialize(rows.groupBy("content").agg(F.min(rank).alias("first"), *[F.first(w).alias(w) for w in facts]).select("content", F.col("first.row").alias("node"), "first", *facts), "classes")
    near = components(links(classes.select("node", *WORDS), WORDS, LOOSE_BITS).union(band_links(classes)), "near")
    member = near.select(F.col("u").alias("node"), F.col("v").alias("group")).union(near.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())
    candidates = materialize(member.join(classes.select("node", "bytes"), "node"), "candidates")
    texts = rows.select(F.col("row").alias("node"), F.col("doc")[text_col].alias("text"))
    stars = verified_links(candidates, texts, shingle, similarity)
    labelled = classes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = labelled.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
