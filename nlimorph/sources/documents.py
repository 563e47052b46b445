"""JSON documents of any size, read by many tasks.

A file may hold one array, one object with a list of rows, one object, or JSON lines; the name does not tell. It is read as pieces
between commas, in three steps:

1. Each byte range is summed up without knowing what lies ahead, once as if it began outside a string and once as if
   inside: whether it ends inside, how far the depth of brackets moves and falls, and how many commas stand at each depth.
2. The sums of a file's ranges are put together in order. That gives the state at each range, and whether the file is one
   bracketed value: nothing before its first bracket, nothing behind the bracket that closes it.
3. Each range is cut at the commas between items: those of depth 1, in objects also those of depth 2. What begins
   in one range and ends in another is put together; all else stays where it is.

Every item is then parsed on its own. A file with an item that is no JSON is no document; its lines are read as JSON lines.

Most JSON lines are told without all this: where only a line break lies between a bracket that closes and one that opens, there
is no document, as neither a value nor a string (whose line breaks are escaped) can hold that.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.functions.settle import settled
from nlimorph.sources import ranges
from nlimorph.sources.json_text import LISTS, is_json_value, only_value, parsed_array, with_end
from nlimorph.sources.scratch import written

OPEN, CLOSE, COMMA, QUOTE = 1, 2, 3, 4
SPACE = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
BETWEEN_LINES = r"[}\]]\s*\n\s*[{\[]"
KEY = r'^\s*("(?:[^"\\]++|\\.)*+")\s*:\s*'
_KIND = np.zeros(256, dtype=np.uint8)
for _letters, _kind in ((b"[{", OPEN), (b"]}", CLOSE), (b",", COMMA), (b'"', QUOTE)):
    _KIND[list(_letters)] = _kind
_STEP = np.array([0, 1, -1, 0])


def _joined(values: pa.Array) -> bytes:
    """The pieces with the commas between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b",")[0].as_py()


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, bytes]]:
    """What ranges hold, part by part: the range, whether it begins there, and bytes. The comma ahead of a range belongs to it."""
    last = None
    for batch in batches:
        for key, rows in ranges.runs(batch):
            held = _joined(rows.column("value"))
            yield key, key != last, b"," + held if key == last or key[1] else held
            last = key


def _marks(data: bytes, odd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, their kinds, whether an odd number of quotes lies ahead, and that at the end."""
    b = np.frombuffer(data, dtype=np.uint8)
    kinds = _KIND[b]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    quote = kinds == QUOTE
    if b"\\" in data:
        slashes = np.flatnonzero(b == 92)
        begins = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)  # of runs of backslashes
        ahead = np.searchsorted(slashes, at[quote]) - 1  # the last backslash ahead
        near = np.flatnonzero((ahead >= 0) & (slashes[ahead] == at[quote] - 1))
        run = begins[np.searchsorted(begins, ahead[near], side="right") - 1]
        escaped = np.flatnonzero(quote)[near[(ahead[near] - run) % 2 == 0]]  # behind an odd run
        at, kinds, quote = (np.delete(x, escaped) for x in (at, kinds, quote))
    met = odd + np.cumsum(quote)
    return at[~quote], kinds[~quote], met[~quote] & 1, int(met[-1] if len(met) else odd) & 1


class _Summary:
    """What a range does to the state, for a start outside (0) and inside (1) a string."""

    def __init__(self):
        self.odd, self.depth, self.low, self.lows, self.commas = 0, [0, 0], [None, None], [0, 0], [Counter(), Counter()]
        self.first, self.last, self.size = None, None, 0

    def add(self, data: bytes) -> None:
        _, kinds, within, self.odd = _marks(data, self.odd)
        for side in (0, 1):
            own = kinds[within == side]
            if len(own):
                depth = self.depth[side] + np.cumsum(_STEP[own])
                self.depth[side] = int(depth[-1])
                closed = depth[own == CLOSE]
                if len(closed):
                    low = int(closed.min())
                    times = int((closed == low).sum())
                    if self.low[side] is None or low < self.low[side]:
                        self.low[side], self.lows[side] = low, times
                    elif low == self.low[side]:
                        self.lows[side] += times
                for level, n in zip(*np.unique(depth[own == COMMA], return_counts=True), strict=True):
                    self.commas[side][int(level)] += int(n)
        bare = data.strip(SPACE)
        if bare:
            self.first = bare[:1].decode("latin-1") if self.first is None else self.first
            self.last = bare[-1:].decode("latin-1")
        self.size += len(data)

    def text(self) -> str:
        return json.dumps({**vars(self), "commas": [sorted(c.items()) for c in self.commas]})


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, summary = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "start": [key[1]], "summary": [summary.text()]})

    for now, first, data in _buffers(batches):
        if first:
            if summary:
                yield made()
            key, summary = now, _Summary()
        summary.add(data)
    if summary:
        yield made()


def _states(of_file: pd.DataFrame) -> pd.DataFrame:
    """State at each range of one file, and the file's form."""
    rows = of_file.sort_values("start")
    inside, depth, lowest, closed, seen, first, last, size = 0, 0, 0, 0, Counter(), None, None, 0
    out = []
    for start, text in zip(rows["start"], rows["summary"], strict=True):
        s = json.loads(text)
        out.append((start, inside, depth, seen[1], seen[2]))
        if s["low"][inside] is not None:
            low = depth + s["low"][inside]
            lowest = min(lowest, low)
            closed += s["lows"][inside] if low == 0 else 0
        for level, n in s["commas"][inside]:
            seen[depth + level] += n
        depth += s["depth"][inside]
        inside ^= s["odd"]
        first = s["first"] if first is None else first
        last = last if s["last"] is None else s["last"]
        size += s["size"]
    all_read = size == rows["size"].iloc[0] or rows["path"].iloc[0].endswith(COMPRESSED)  # else a comma ends the file
    one = all_read and (inside, depth, lowest, closed) == (0, 0, 0, 1) and first in ("[", "{") and last in ("]", "}")
    form = ("array" if first == "[" else "object") if one else "lines"
    made = pd.DataFrame(out, columns=["start", "inside", "depth", "members", "second"])
    number = made["members"] + (made.pop("second") if form == "object" else 0)
    return made.assign(file=rows["file"].iloc[0], form=form, number=number)[["file", "start", "inside", "depth", "members", "number", "form"]]


def _cut(batches: Iterator[pa.RecordBatch], told: Broadcast) -> Iterator[pa.RecordBatch]:
    """Fragments between cuts; ``opened`` and ``closed`` are the depths of the cuts around one, 0 at the file's begin, null beyond the range."""
    names = ["file", "start", "number", "member", "opened", "closed", "text"]
    states = told.value
    key, tail = None, []

    def made(numbers: np.ndarray, members: np.ndarray, depths: list, texts: pa.Array) -> pa.RecordBatch:
        here = [pa.array(np.full(len(texts), k), pa.int64()) for k in key]
        return pa.RecordBatch.from_arrays([*here, pa.array(numbers, pa.int64()), pa.array(members, pa.int64()), *[pa.array(d, pa.int32()) for d in (depths[:-1], depths[1:])], texts], names)

    def last() -> pa.RecordBatch:
        return made(np.array([number]), np.array([member]), [opened, None], pa.array([b"".join(tail)], pa.binary()))

    for now, first, data in _buffers(batches):
        if first:
            if key:
                yield last()
            key, tail = now, []
            if key not in states.index:
                raise ValueError("a file or its ranges changed while it was read")
            odd, depth, member, number, deepest = (int(x) for x in states.loc[key, ["inside", "depth", "members", "number", "deepest"]])
            opened = None if key[1] else 0
        at, mark, within, odd = _marks(data, odd)
        at, mark = at[within == 0], mark[within == 0]
        depths = depth + np.cumsum(_STEP[mark])
        depth = int(depths[-1]) if len(depths) else depth
        cuts = (mark == COMMA) & (depths >= 1) & (depths <= deepest)
        places, levels = at[cuts], depths[cuts]
        if not len(places):
            tail.append(data)
            continue
        whole = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places + 1).astype(np.int32)), pa.py_buffer(data)])  # with the comma behind each
        texts = pa.concat_arrays([pa.array([b"".join([*tail, data[: places[0]]])], pa.binary()), pc.binary_slice(whole, 0, -1)])
        passed = np.cumsum(levels == 1)
        yield made(number + np.arange(len(places)), member + np.concatenate([[0], passed[:-1]]), [opened, *levels.tolist()], texts)
        tail, opened, number, member = [data[places[-1] + 1 :]], int(levels[-1]), number + len(places), member + int(passed[-1])
    if key:
        yield last()


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE.decode()))


def _without_last(text: Column) -> Column:
    return F.substring(_bare(text), F.lit(1), F.length(_bare(text)) - 1)


def _fragments(spark: SparkSession, pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Whole fragments of documents: file, number, member, opened, closed, text, and of those between two cuts of one depth whether they are ``fine``, one JSON value."""
    deepest = F.when(F.col("form") == "object", 2).otherwise(1).alias("deepest")
    told = states.where("form <> 'lines'").select("file", "start", "inside", "depth", "members", "number", deepest).toPandas().set_index(["file", "start"])
    held = spark.sparkContext.broadcast(told)  # 48 bytes a range
    cut = pieces.select("file", "start", F.col("value").cast("binary")).mapInArrow(lambda b: _cut(b, held), "file long, start long, number long, member long, opened int, closed int, text binary")
    between = F.when(F.col("opened") == F.col("closed"), F.col("text").cast("string"))
    judged = settled(settled(cut, "_between", between), "_parsed", with_end(F.col("_between")))
    cut = written(judged.select(*cut.columns, F.when(F.col("_between").isNotNull(), only_value(F.col("_parsed"), F.col("_between")).isNotNull()).alias("fine")), "fragments")
    kept = ["file", "number", "member", "opened", "closed"]
    here = F.col("opened").isNotNull() & F.col("closed").isNotNull()
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    over = cut.where(~here).groupBy("file", "number").agg(F.max("member").alias("member"), F.max("opened").alias("opened"), F.max("closed").alias("closed"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "")
    joined = over.select(*kept, text.alias("text"), F.when(F.col("opened") == F.col("closed"), is_json_value(text)).alias("fine"))
    return cut.where(here).select(*kept, F.col("text").cast("string").alias("text"), "fine").unionByName(joined)


def _between(depth: int) -> Column:
    """Whether a fragment lies between two cuts of this depth: all of it is the text of an item then."""
    return F.coalesce((F.col("opened") == depth) & (F.col("closed") == depth), F.lit(False))


def _array_items(fragments: DataFrame) -> DataFrame:
    """Fragments of arrays with ``inner``, the text of the item; none for an empty array."""
    began = F.when(F.col("opened") == 0, F.substring(_bare(F.col("text")), 2, 1 << 30)).otherwise(F.col("text"))
    inner = F.when(F.col("closed").isNull(), _without_last(began)).otherwise(began)
    empty = (F.col("opened") == 0) & F.col("closed").isNull() & (_bare(F.col("inner")) == "")
    return fragments.withColumn("inner", inner).where(~empty)


def _members(fragments: DataFrame, *more: str) -> DataFrame:
    """Fragments of objects: key and first letter of a member's value, ``inner``, the text inside the value's brackets if it was cut, else the value, and whether it was."""
    began = F.when(F.col("opened") == 0, F.substring(_bare(F.col("text")), 2, 1 << 30)).otherwise(F.col("text"))
    body = F.when(F.col("closed").isNull(), _without_last(began)).otherwise(began)
    first, last = F.col("opened") < 2, F.coalesce(F.col("closed") < 2, F.lit(True))
    rows = fragments.select("*", body.alias("body"), first.alias("first"), last.alias("last"))
    rows = rows.where(~(F.col("first") & F.col("last") & (F.col("opened") == 0) & F.col("closed").isNull() & (_bare(F.col("body")) == "")))  # an object without members
    rows = rows.withColumn("lead", F.when(F.col("first"), F.regexp_extract("body", KEY, 0)))
    key = F.when(F.col("lead") != "", F.try_variant_get(F.try_parse_json(F.regexp_extract("body", KEY, 1)), "$", "string"))
    rest = F.when(F.col("first"), F.substring(F.col("body"), F.length("lead") + 1, F.lit(1 << 30))).otherwise(F.col("body"))
    rows = rows.select("*", key.alias("key"), rest.alias("rest"), (~(F.col("first") & F.col("last"))).alias("cut"))
    opener, closer = F.when(F.col("first"), F.substring("rest", 1, 1)), F.when(F.col("last") & F.col("cut"), F.right(_bare(F.col("rest")), F.lit(1)))
    inner = F.when(F.col("cut") & F.col("first"), F.substring("rest", 2, 1 << 30)).when(F.col("cut") & F.col("last"), _without_last(F.col("rest"))).otherwise(F.col("rest"))
    return rows.select("file", "number", "member", "key", "first", "cut", opener.alias("opener"), closer.alias("closer"), inner.alias("inner"), *more)


def _verdicts(fragments: DataFrame, states: DataFrame) -> DataFrame:
    """(file, form, member, ahead, single): what each document is in the end. A list of an object has its member and the number of its first fragment."""
    forms = states.select("file", "form").distinct()
    of = {form: fragments.join(F.broadcast(forms.where(F.col("form") == form)), "file") for form in ("array", "object")}  # a row a file
    ends = _array_items(of["array"].where(~_between(1))).select("file", is_json_value(F.col("inner")).alias("fine"))
    sound_arrays = of["array"].where(_between(1)).select("file", "fine").unionByName(ends).groupBy("file").agg(F.bool_and("fine").alias("sound"))
    plain = _between(2) & F.col("fine")  # judged when they were cut; no pair of an object is one value
    parts = _members(of["object"].where(~plain))
    pair = F.col("cut") & F.col("inner").rlike(KEY)
    text = F.when(pair, F.concat(F.lit("{"), F.col("inner"), F.lit("}"))).otherwise(F.col("inner"))
    judged = parts.select("*", pair.alias("pair"), (is_json_value(text) & ~(F.col("first") & F.col("key").isNull())).alias("ok"))
    columns = ["file", "number", "member", "key", "opener", "closer", "cut", "pair", "ok"]
    items = of["object"].where(plain).select("file", "number", "member", F.lit(True).alias("cut"), F.lit(False).alias("pair"), F.lit(True).alias("ok"))
    judged = judged.select(*columns).unionByName(items, allowMissingColumns=True)
    ends = F.concat("opener", F.coalesce("closer", F.lit("")))
    by = judged.groupBy("file", "member").agg(
        F.max("key").alias("key"), F.max("opener").alias("opener"), F.max("closer").alias("closer"), F.bool_or("cut").alias("cut"), F.min("number").alias("ahead"),
        F.bool_and("ok").alias("ok"), F.bool_or("pair").alias("some"), F.bool_and("pair").alias("all"),
    )
    shape = ~F.col("cut") | ((ends == "[]") & ~F.col("some")) | ((ends == "{}") & F.col("all"))
    is_list = F.col("opener") == "["
    found = [F.max(F.when(F.col("key") == k, F.struct("member", is_list.alias("is_list"), "ahead", (~F.col("cut")).alias("single")))).alias(k) for k in LISTS]
    objects = by.groupBy("file").agg(F.bool_and(F.col("ok") & shape).alias("sound"), *found)
    chosen = F.coalesce(*[F.when(F.col(k)["is_list"], F.col(k)) for k in LISTS])
    met = forms.join(sound_arrays.unionByName(objects.select("file", "sound", chosen.alias("chosen")), allowMissingColumns=True), "file", "left")
    sound = F.coalesce("sound", F.lit(True))  # no item at all
    form = F.when((F.col("form") == "lines") | ~sound, "lines").when(F.col("chosen").isNotNull(), "list").otherwise(F.col("form"))
    return met.select("file", form.alias("form"), "chosen.member", "chosen.ahead", "chosen.single")


def _lines_for_sure(pieces: DataFrame) -> list[str]:
    """Paths of files with a line break between brackets where a document would have a comma."""
    between = F.contains("value", F.lit("\n")) & F.col("value").rlike(BETWEEN_LINES)
    return [r.path for r in pieces.where(between).select("path").distinct().collect()]  # names only, as Spark's own listing


def _from_lines(spark: SparkSession, path: str | list[str], larger_than: int, only: list[str]) -> DataFrame:
    return ranges.numbered_rows(spark, path, larger_than, only).select("path", "item", "v")


def read_documents(spark: SparkSession, path: str | list[str], larger_than: int = -1) -> DataFrame:
    """(path, item, v) of all files of more than ``larger_than`` bytes; items are numbered from 0 in file order."""
    names = ranges.files(spark, path).where(F.col("size") > larger_than)
    found = sorted(r.path for r in names.select("path").collect())
    known = set(_lines_for_sure(ranges.pieces(spark, path, ",", larger_than)))
    others = [p for p in found if p not in known]
    if not others:
        return _from_lines(spark, path, larger_than, found)
    names = names.where(F.col("path").isin(others))
    pieces = ranges.pieces(spark, path, ",", larger_than, others if known else None)
    sums = pieces.select("file", "start", F.col("value").cast("binary")).mapInArrow(_summaries, "file long, start long, summary string")
    states = written(sums.join(F.broadcast(names), "file").groupBy("file").applyInPandas(_states, "file long, start long, inside int, depth long, members long, number long, form string"), "states")
    path_of = F.broadcast(names.select("file", "path"))
    bracketed = sorted(r.path for r in states.where("form <> 'lines'").select("file").distinct().join(path_of, "file").select("path").collect())
    if not bracketed:
        return _from_lines(spark, path, larger_than, found)
    fragments = _fragments(spark, ranges.pieces(spark, path, ",", larger_than, bracketed), states)
    verdicts = written(_verdicts(fragments, states), "documents")

    def of(form: str) -> DataFrame:
        return fragments.join(F.broadcast(verdicts.where(F.col("form") == form).select("file", F.col("member").alias("chosen"), "ahead", "single")), "file")

    def in_list(single: bool) -> Column:
        return (F.col("member") == F.col("chosen")) & (F.col("single") == single)

    items = of("array").where(_between(1)).select("file", F.col("number").alias("item"), F.col("text").alias("inner"))
    items = items.unionByName(of("list").where(in_list(single=False) & _between(2)).select("file", (F.col("number") - F.col("ahead")).alias("item"), F.col("text").alias("inner")))
    items = items.unionByName(_array_items(of("array").where(~_between(1))).select("file", F.col("number").alias("item"), "inner"))
    ends = _members(of("list").where(in_list(single=False) & ~_between(2)).drop("chosen", "single"), "ahead")
    items = items.unionByName(ends.select("file", (F.col("number") - F.col("ahead")).alias("item"), "inner"))
    rows = settled(items, "v", F.try_parse_json("inner")).select("file", "item", "v")  # parsed once, whatever is asked of v
    short = _members(of("list").where(in_list(single=True)).drop("chosen", "ahead", "single")).select("file", F.posexplode(parsed_array(F.col("inner"))).alias("item", "v")).withColumn("item", F.col("item").cast("long"))
    whole = of("object").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("parts"))
    objects = settled(whole, "v", F.try_parse_json(F.array_join(F.transform("parts", lambda p: p["text"]), ","))).select("file", F.lit(0).cast("long").alias("item"), "v")
    documents = rows.unionByName(short).unionByName(objects).join(path_of, "file").select("path", "item", "v")
    in_lines = [*known, *[r.path for r in verdicts.where(F.col("form") == "lines").join(path_of, "file").select("path").collect()]]
    return documents.unionByName(_from_lines(spark, path, larger_than, in_lines)) if in_lines else documents
