"""JSON documents cut between tasks against whole parsing, and line numbers in file order."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from nlimorph.sources import jsonl, ranges
from nlimorph.sources.scratch import scratch_dir

ROW = {"premise": 'a "quoted", [b] {c}', "hypothesis": "back\\slash\\", "n": [1, [2, {"k": "],}"}]], "é": "日本, 語"}
ROWS = [{**ROW, "i": k} for k in range(8)]
DOCUMENTS = {
    "array": json.dumps(ROWS), "pretty": json.dumps(ROWS, indent=2, ensure_ascii=False), "data": json.dumps({"data": ROWS}), "indented": json.dumps({"about": {"a": 1, "b": {"c": [1, 2]}}, "data": ROWS, "tests": [1, 2]}, indent=1),
    "examples": json.dumps({"data": {"x": 1, "y": 2}, "tests": [0], "examples": ROWS[:3], "more": "x, y"}), "tests": json.dumps({"n": 1, "tests": ROWS[:7]}), "one_item": json.dumps({"data": [ROW]}), "one_row": json.dumps([ROW]),
    "no_items": json.dumps({"data": [], "examples": ROWS}), "empty_array": " [ ] ", "empty_object": "{ }", "object": json.dumps(ROW, indent=1), "flat": '{"a": 1, "b": [1, 2, 3], "c": {"d": 1, "e": 2}}', "lines": "\n".join(map(json.dumps, ROWS)), "scalar": "3", "word": '"a, b"',
    "mixed_lines": '{"a": 1}\r\n\r\nnot json, at all\n[1, 2]\n{"a": 2}, \n3\n', "nulls": "[null, 1, null]", "nested": "[[1, 2], [3, [4, 5]], []]", "twice": "[1, 2]\n[3, 4]", "blank": " \n ", "nothing": "",
    "comma_at_end": "[1, 2],", "comma_inside": "[1, 2, ]", "no_value": '{"data": [1, 2], "b": }', "wrong_bracket": '{"data": [1, 2}, "b": 3]', "pair_in_list": '{"b": [1, "a": 2]}', "item_in_object": '{"b": {"a": 2, 3}}', "tail": "[1, 2] x", "two": "[1][2, 3]", "open": "[1, 2", "closed": "1, 2]",
    "quotes": json.dumps(['\\"', "\\\\", '"', ",", "\\\\\\,", '\\\\",'] * 9), "spaces": "  [ 1 ,\n\t2 , {} , [ ] ]\n\n", "strings": json.dumps(["x, " * 60, "[" * 150, "}" * 50, "y"]), "key_escape": '{"d\\u0061ta": [1, 2], "b": 1}', "deep": "[" * 60 + "1, 2" + "]" * 60 + "",
}


@pytest.fixture(scope="module")
def folder(spark):
    import os

    at = f"{scratch_dir(spark)}/documents-{uuid.uuid4().hex}"
    os.makedirs(f"{at}/deep")
    for name, text in DOCUMENTS.items():
        with open(f"{at}/deep/{name}.json", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return at


def rows_of(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.item, r.v) for r in df.select("path", "item", F.to_json("v").alias("v")).collect())


def plain(text):
    """Python's reading of a file: one document, else lines."""
    text = text.strip()
    try:
        data = json.loads(text)
        if isinstance(data, list):
            return data
        if isinstance(data, dict):
            return next((data[k] for k in jsonl.LISTS if isinstance(data.get(k), list)), [data])
    except ValueError:
        pass
    out = []
    for line in text.splitlines():
        try:
            out.append(json.loads(line.strip()))
        except ValueError:
            pass
    return out


@pytest.mark.parametrize("split", ["300b", "16m"])
def test_cut_documents_equal_whole_ones(spark, folder, split):
    want = sorted((f"{name}.json", k, json.dumps(v, sort_keys=True)) for name, text in DOCUMENTS.items() for k, v in enumerate(plain(text)))
    bare = lambda rows: sorted((p, k, json.dumps(json.loads(v), sort_keys=True)) for p, k, v in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "8b")
    try:
        whole = rows_of(jsonl.read_json_any(spark, folder))
        cut = rows_of(jsonl.read_json_any(spark, folder, whole_up_to=-1))
        some = rows_of(jsonl.read_json_any(spark, folder, whole_up_to=300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert bare(whole) == want
    assert bare(cut) == want
    assert cut == some == whole


def test_one_line_array_is_read_by_several_tasks(spark):
    import os

    at = f"{scratch_dir(spark)}/large-{uuid.uuid4().hex}"
    os.makedirs(at)
    text = json.dumps([{"k": k, "text": "x, y " * 40} for k in range(20_000)])
    with open(f"{at}/a.json", "w") as f:
        f.write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert ranges.pieces(spark, at, ",").rdd.getNumPartitions() >= 4
        rows = jsonl.read_json_any(spark, at, whole_up_to=1000)
        got = rows.agg(F.count("*"), F.count_if(F.try_variant_get("v", "$.k", "long") == F.col("item"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (20_000, 20_000)


@pytest.mark.parametrize("split", ["150b", "16m"])
def test_line_numbers(spark, split):
    import os

    r = random.Random(3)
    at = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    os.makedirs(at)
    texts = {}
    for name in "abc":
        lines = [r.choice(["", " ", '{"a": %d}' % r.randrange(9), "broken {", "é" * r.randrange(50), '"word"', "[1, 2]"]) for _ in range(60)]
        texts[name] = r.choice(["\n", "\r\n"]).join(lines)
        with open(f"{at}/{name}.jsonl", "w", newline="") as f:
            f.write(texts[name])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "8b")
    try:
        lines = sorted((x.path[-7], x.line, x.value) for x in ranges.numbered_lines(spark, at).collect())
        rows = sorted((x.path[-7], x.line, x["index"], x.v) for x in jsonl.read_jsonl_in_order(spark, at).select("path", "line", "index", F.to_json("v").alias("v")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lines == [(n, k, v) for n in "abc" for k, v in enumerate(texts[n].removesuffix("\n").replace("\r\n", "\n").split("\n"), 1)]
    want = []
    for n in "abc":
        good = [(k, json.loads(v)) for k, v in enumerate(texts[n].replace("\r\n", "\n").split("\n"), 1) if v[:1] in ("{", '"', "[")]
        want += [(n, k, i, v) for i, (k, v) in enumerate(good, 1)]
    assert [(n, k, i, json.loads(v)) for n, k, i, v in rows] == want


def test_only_files_of_lines_are_opened_as_lines(spark, monkeypatch):
    """A one-line file of any length is never one record; before, all files were read as lines and most rows thrown away."""
    import os

    at = f"{scratch_dir(spark)}/one line-{uuid.uuid4().hex}"
    os.makedirs(at)
    with open(f"{at}/a b.json", "w") as f:
        f.write(json.dumps([{"k": k, "text": "x, y " * 40} for k in range(20_000)]))
    with open(f"{at}/lines.json", "w") as f:
        f.write("".join(json.dumps({"k": k}) + "\n" for k in range(50)))
    read, pieces = [], ranges.pieces

    def seen(spark, path, separator, *more, **named):
        found = pieces(spark, path, separator, *more, **named)
        read.extend([found] if separator == "\n" else [])
        return found

    monkeypatch.setattr(ranges, "pieces", seen)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = jsonl.read_json_any(spark, at, whole_up_to=-1)
        got = sorted((r.path.rsplit("/", 1)[-1], r.n) for r in rows.groupBy("path").agg(F.count("*").alias("n")).collect())
        longest = [r.agg(F.max(F.length("value"))).first()[0] for r in read]
        parts = [r.rdd.getNumPartitions() for r in read]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [n for _, n in got] == [20_000, 50]
    assert longest and max(longest) < 100 and parts == [1]


def test_lines_are_told_without_sums(spark, monkeypatch):
    """Files of JSON lines are not summed up and cut as documents; before, all their commas were."""
    import os

    from nlimorph.sources import documents

    at = f"{scratch_dir(spark)}/told-{uuid.uuid4().hex}"
    os.makedirs(at)
    texts = {"plain": "\n".join(map(json.dumps, ROWS)), "blank_lines": '{"a": 1}\r\n \r\n\t[2, 3]\r\nbad, \n{"a": 4}', "arrays": "[1, 2]\n[3]\n"}
    for name, text in texts.items():
        with open(f"{at}/{name}", "w", newline="") as f:
            f.write(text)
    made = []
    monkeypatch.setattr(documents, "written", lambda df, label: made.append(label) or df)
    got = {}
    for path, item, v in rows_of(documents.read_documents(spark, at)):
        got.setdefault(path, []).append((item, json.loads(v)))
    assert got == {"plain": list(enumerate(ROWS)), "blank_lines": list(enumerate([{"a": 1}, [2, 3], {"a": 4}])), "arrays": [(0, [1, 2]), (1, [3])]}
    assert made == []


def test_text_that_looks_like_lines_inside_a_string(spark):
    """Line breaks of strings are escaped, so brackets around them tell nothing; raw ones are no JSON."""
    import os

    at = f"{scratch_dir(spark)}/told-{uuid.uuid4().hex}"
    os.makedirs(at)
    rows = ["}\n{", "]\n\n[", "x"]
    for name, text in (("escaped", json.dumps(rows, indent=1)), ("between", '[{"a": 1}\n,\n{"a": 2}\n]')):
        with open(f"{at}/{name}", "w") as f:
            f.write(text)
    got = [(p, i, json.loads(v)) for p, i, v in rows_of(jsonl.read_json_any(spark, at, whole_up_to=-1))]
    assert got == [("between", 0, {"a": 1}), ("between", 1, {"a": 2}), *[("escaped", i, v) for i, v in enumerate(rows)]]


def test_lines_in_order_are_read_once(spark):
    """The files are read and judged once, then rows come from the written table; files that are left out are not opened."""
    import os

    at = f"{scratch_dir(spark)}/once-{uuid.uuid4().hex}"
    os.makedirs(at)
    for name in "ab":
        with open(f"{at}/{name}.jsonl", "w") as f:
            f.write('{"a": 1}\nbad\n\n{"a": 2}\n')
    df = jsonl.read_jsonl_in_order(spark, at, F.col("_metadata.file_path").endswith("/b.jsonl"))
    os.remove(f"{at}/a.jsonl")
    os.remove(f"{at}/b.jsonl")
    assert [(r.path[-7:], r.line, r["index"]) for r in df.orderBy("line").collect()] == [("b.jsonl", 1, 1), ("b.jsonl", 4, 2)]


def test_rows_of_documents_are_not_shuffled(spark, folder):
    """Names and verdicts, a row a file, are broadcast whatever the sizes of the files; before, all rows were sorted by their few files to be given their paths."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jsonl.valid_samples(jsonl.read_json_any(spark, folder, whole_up_to=-1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_escaped_quotes_and_long_runs_of_backslashes(spark):
    """Marks of random bytes against a letter-by-letter reading."""
    from nlimorph.sources.documents import CLOSE, COMMA, OPEN, _marks

    r = random.Random(5)
    for n in range(300):
        text = "," * (n % 2) + "".join(r.choice('\\\\\\"",[]{}a') for _ in range(r.randrange(60)))
        for odd in (0, 1):
            inside, run, want = odd, 0, []
            for k, c in enumerate(text):
                if c == '"' and run % 2 == 0:
                    inside ^= 1
                elif c in ",[]{}":
                    want.append((k, COMMA if c == "," else OPEN if c in "[{" else CLOSE, inside))
                run = run + 1 if c == "\\" else 0
            at, kinds, within, end = _marks(text.encode(), odd)
            assert (list(zip(at.tolist(), kinds.tolist(), within.tolist(), strict=True)), end) == (want, inside)


def test_text_of_files_is_made_behind_their_shuffle(spark, monkeypatch):
    """Rows are dealt to their files and sorted as the table has them; before, their JSON text was shuffled, and sorted, and spilled."""
    from pyspark.sql import DataFrameWriter

    from nlimorph.plans import files

    plans, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or text(self, *a, **k))
    files._write(spark, "/root/testdata/sf0.001")
    for plan in plans:
        assert plan.index("supplied") < plan.index("Sort [") < plan.index("RepartitionByExpression") and "supplied" not in plan[plan.index("Sort [") :]
    assert len(plans) == 2


def test_large_files_of_the_query_are_compressed(spark, monkeypatch):
    """Plain JSON lines of all columns took most of the disk that the query used."""
    from nlimorph.plans import registry
    from nlimorph.sources.scratch import part_files

    read, made = jsonl.read_json_any, []
    monkeypatch.setattr(jsonl, "read_json_any", lambda spark, path, **k: made.extend(part_files(spark, path)) or read(spark, path, **k))
    rows = registry.queries()["large_json_files"](spark, "/root/testdata/sf0.001")
    assert made and all(f.endswith(".gz") for f in made)
    assert sorted(r.dataset for r in rows.collect()) == ["mnlim", "mnlimm", "rte", "sick", "snli"]
