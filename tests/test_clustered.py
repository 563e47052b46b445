"""Clustered tables, signatures in order, and layouts."""

import uuid

import pytest
from pyspark.sql import functions as F

from nlimorph.operators import audit, groups, instruct
from nlimorph.sources import clustered, layouts
from nlimorph.sources.scratch import exists, scratch_dir


def table(spark, n=3000):
    return spark.range(n).selectExpr("'f' as source_file", "cast(id div 6 as string) as pair_key", "case when id % 6 = 0 or id % 42 = 5 then 'none' when id % 90 = 12 then null else 'x' end as mr_id", "cast(id as string) as premise", "'h' as hypothesis", "cast(id % 3 as int) as label", "true as label_is_int", "id")


def above(plan: str, column: str) -> list[str]:
    """The steps above the scan that reads a column, in a plan drawn as a tree."""
    lines = plan.split("\n")
    at = next(k for k, x in enumerate(lines) if "FileScan" in x and column in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    steps, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            steps.append(x)
            level = depth(x)
    return steps


def test_no_exchange_of_rows(spark):
    t = clustered.write_clustered(table(spark), f"t_{uuid.uuid4().hex}", 4, f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in groups.pair_groups(t)._jdf.queryExecution().executedPlan().toString()
        whole = instruct.attach_source_clustered(t)
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        picked = groups.sample_groups(groups.pair_groups(t), 600, 5)
        plan = instruct.attach_source_clustered(groups.rows_of(t, picked))._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in step for step in above(plan, "premise"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {tuple(r) for r in instruct.attach_source(table(spark)).select("id", "source_premise", "source_label", "has_source").collect()}
    assert {tuple(r) for r in whole.select("id", "source_premise", "source_label", "has_source").collect()} == want
    assert any(r[1] for r in want) and any(not r[3] for r in want)


def test_signature_sees_order_and_not_partitioning(spark):
    rows = [("f", k + 1, f"row {k}") for k in range(500)] + [("g", k + 1, "same") for k in range(7)]
    schema = "path string, line long, value string"

    def tree(data, parts=3):
        return audit.merkle_tree(spark.createDataFrame(data, schema).repartition(parts), "path", "line", F.col("value"), fan=8)

    a = tree(rows)
    first = {r.file: (r.n_rows, r.signature) for r in audit.signatures(a).collect()}
    assert {f: n for f, (n, _) in first.items()} == {"f": 500, "g": 7}
    assert {r.file: (r.n_rows, r.signature) for r in audit.signatures(tree(rows[::-1], 7)).collect()} == first
    turned = [(p, {124: 125, 125: 124}.get(k, k) if p == "f" else k, v) for p, k, v in rows]
    b = tree(turned)
    second = {r.file: (r.n_rows, r.signature) for r in audit.signatures(b).collect()}
    assert second["g"] == first["g"] and second["f"] != first["f"]
    assert [tuple(r) for r in audit.first_difference(a, b, fan=8).collect()] == [("f", 121, 128)]
    longer = tree([*rows, ("f", 501, "more")])
    assert [tuple(r) for r in audit.first_difference(a, longer, fan=8).collect()] == [("f", 497, 504)]
    assert audit.first_difference(a, tree(rows, 5), fan=8).count() == 0


def test_failed_layout_leaves_nothing(spark):
    root = f"{scratch_dir(spark)}/layout-{uuid.uuid4().hex}"
    df = spark.createDataFrame([("{}", "a"), ("{}", "b")], "value string, dataset string")
    with pytest.raises(OSError, match="moved"):
        layouts.write_layout(df, root, ["dataset"], lambda v, k: "one_name.jsonl")
    assert not any(exists(spark, f"{root}{end}") for end in ("", ".parts", ".named"))
    layouts.write_layout(df, root, ["dataset"], lambda v, k: f"m/{v['dataset']}/x.jsonl")
    assert layouts.read_predictions(spark, root).count() == 2


def test_only_named_folders_are_listed(spark):
    root = f"{scratch_dir(spark)}/layout-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(f'{{"k": {k}}}', f"d{k}", mr) for k in range(4) for mr in ("p", "q", "d_all")], "value string, dataset string, mr string")
    layouts.write_layout(df, root, ["dataset", "mr"], lambda v, k: f"m/{v['dataset']}/{v['mr']}.jsonl")
    assert layouts.read_predictions(spark, root).count() == 8
    some = layouts.read_predictions(spark, root, datasets=["d1", "d3"])
    assert sorted((r.dataset, r.mr) for r in some.select("dataset", "mr").collect()) == [("d1", "p"), ("d1", "q"), ("d3", "p"), ("d3", "q")]
    assert len(some.inputFiles()) == 6
    assert layouts.read_predictions(spark, root, relations=["q"]).count() == 4


def test_signature_is_that_of_two_levels_at_any_height(spark):
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("f", k, f"v{k}") for k in range(1, 301)] + [("g", k, f"w{k}") for k in range(1, 4)]
    tree = audit.merkle_tree(spark.createDataFrame(rows, "path string, line long, value string").repartition(5), "path", "line", F.col("value"), fan=4)
    assert tree.agg(F.max("level")).first()[0] > 2  # before, the third level and those above changed the signature
    firsts = [digest("".join(digest(f"v{k}") for k in range(a, a + 4))) for a in range(1, 301, 4)]
    want = {"f": (300, digest("".join(firsts))[:16]), "g": (3, digest("".join(digest(f"w{k}") for k in (1, 2, 3)))[:16])}
    assert {r.file: (r.n_rows, r.signature) for r in audit.signatures(tree).collect()} == want


def test_buckets_grow_with_the_rows():
    assert [clustered.buckets_for(n) for n in (0, 600_000, 36_000_000, 216_000_000)] == [8, 8, 144, 864]


def test_compressed_layout(spark):
    """Files in gzip keep the names of their layout and are read as plain ones; the combined file is left out in either form."""
    root = f"{scratch_dir(spark)}/packed-{uuid.uuid4().hex}"
    df = spark.createDataFrame([("d1", "p", '{"k": 1}'), ("d1", "q", '{"k": 2}'), ("d2", "p", '{"k": 3}'), ("d2", "x_all", '{"k": 4}')], "dataset string, mr string, value string").coalesce(1)
    layouts.write_layout(df, root, ["dataset", "mr"], lambda v, k: f"m/{v['dataset']}/{v['mr']}.jsonl", compression="gzip")
    layouts.write_layout(df, f"{root}/m/plain", ["dataset", "mr"], lambda v, k: f"n/{v['dataset']}/{v['mr']}.jsonl")
    packed = layouts.read_predictions(spark, root, models=["m"], relations=["p", "q"])
    assert sorted((r.dataset, r.mr, r.path.split("/", 3)[-1].rsplit("/m/", 1)[1]) for r in packed.collect()) == [(d, m, f"{d}/{m}.jsonl.gz") for d, m in (("d1", "p"), ("d1", "q"), ("d2", "p"))]
    assert sorted((r.model, r.dataset, r.mr) for r in layouts.read_predictions(spark, root).collect()) == [(k, d, m) for k in "mn" for d, m in (("d1", "p"), ("d1", "q"), ("d2", "p"))]


def test_lines_of_a_layout_are_written_by_the_batch(spark):
    """Lines of one file are handed to the writer as one text; their number, blank ones and nulls stay as they are."""
    import pyarrow as pa

    batch = pa.record_batch({"value": ["a", "b", None, "", "c"], "dataset": ["x", "y", "x", "x", None], "k": [1, 1, 1, 1, 2]})
    (got,) = layouts._joined(iter([batch]))
    assert got.to_pylist() == [{"value": "a\n\n", "dataset": "x", "k": 1}, {"value": "b", "dataset": "y", "k": 1}, {"value": "c", "dataset": None, "k": 2}]
    root = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id"))).alias("value"), (F.col("id") % 3).alias("k"))
    layouts.write_layout(rows, root, ["k"], lambda v, n: f"{v['k']}/{n}.jsonl")
    files = spark.read.option("recursiveFileLookup", True).text(root).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("k"), "value")
    assert sorted((r.k, r.value) for r in files.collect()) == sorted((str(k % 3), f"v{k}" if k % 7 else "") for k in range(5000))


def test_files_are_numbered_by_their_values(spark):
    """A number for each file of a layout made a folder for each; now files of one task share theirs, and few folders are listed."""
    root = f"{scratch_dir(spark)}/numbers-{uuid.uuid4().hex}"
    rows = spark.range(40).select(F.lit("{}").alias("value"), F.expr("id % 4").alias("k")).repartition(2)
    layouts.write_layout(rows, root, ["k"], lambda v, n: f"{n}/{v['k']}.jsonl", compression="gzip")
    names = spark.read.option("recursiveFileLookup", True).text(root).select(F.substring_index("_metadata.file_path", "/", -2).alias("name"))
    assert sorted(r.name for r in names.distinct().collect()) == sorted(f"{n}/{k}.jsonl.gz" for n in range(2) for k in range(4))
