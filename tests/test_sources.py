import json

from pyspark.sql import functions as F

from nlimorph.sources import jsonl, layouts


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_only_whole_json_values_count(spark):
    good = ['{"a": 1}', " [1, 2] ", "3", '"x"', "null", '{"a": 1, "a": 2}']
    bad = ['{"a": 1} tail', "{", '{"a": 1}\n{"b": 2}', "1, 2", "", "'x'"]
    got = {r.value: r.ok for r in lines(spark, *good, *bad).select("value", jsonl.is_json_value(F.col("value")).alias("ok")).collect()}
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert all(got[g] for g in good[:5])
    assert not any(got[b] for b in bad)


def test_modes(spark):
    df = lines(spark, '{"a": 1}', "", "  ", "{oops")
    assert jsonl.parse_lines(df).count() == 1
    assert sorted(r.malformed for r in jsonl.parse_lines(df, mode="flag").collect()) == [False, True]


def test_fields_by_preference(spark):
    df = jsonl.parse_lines(lines(spark, json.dumps({"sentence1": "p", "text_b": "h", "annotator_labels": ["neutral", "x"]}), json.dumps({"premise": "p", "sentence1": "q", "hypothesis": "h", "label": 2}), json.dumps({"text": "t"}), json.dumps({"b": 1, "a": 2})))
    got = df.select(jsonl.nli_fields(F.col("v")).alias("f"), jsonl.generic_text(F.col("v")).alias("g")).collect()
    assert [tuple(r.f) for r in got] == [("p", "h", "neutral"), ("p", "h", "2"), (None, None, None), (None, None, None)]
    assert [r.g for r in got][2:] == ["t", '{"a":2,"b":1}']


def test_whole_files(spark):
    texts = ['[{"a": 1}, {"a": 2}]', '{"data": [{"a": 3}]}', '{"a": 4}', '{"a": 5}\nbad\n{"a": 6}']
    got = jsonl.parse_whole(lines(spark, *texts)).select(F.try_variant_get("v", "$.a", "int").alias("a")).collect()
    assert sorted(r.a for r in got) == [1, 2, 3, 4, 5, 6]


def test_labels_keep_their_kind(spark):
    df = jsonl.parse_lines(lines(spark, '{"premise": "p", "hypothesis": "h", "label": 0, "pair_id": 7}', '{"premise": "p", "hypothesis": "h", "label": "0", "pair_id": null}', '{"premise": "p", "label": 1}'))
    got = jsonl.samples_of(df, F.lit("f")).collect()
    assert [(r.label, r.label_is_int, r.pair_id, r.pair_id_present) for r in got] == [("0", True, "7", True), ("0", False, None, True)]


def test_paths(spark):
    df = spark.createDataFrame([("/x/snli_test_MR/snli_test_voice_switch_1.json",), ("/x/rte_test_mr/other.json",)], "path string")
    got = layouts.with_path_fields(df).collect()
    assert [(r.dataset, r.mr, r.task) for r in got] == [("snli", "voice_switch", "nli"), ("rte", None, "nli-binary")]


def test_folders(spark, tmp_path):
    for model, ds, mr, n in (("m", "rte", "negation_flip", 2), ("m", "rte", "rte_all", 2), ("m", "sick", "voice_switch", 1)):
        f = tmp_path / "p" / model / ds / f"{mr}.jsonl"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text('{"status": 200, "meta": {"task": "nli"}, "response": "e"}\n' * n)
    assert sorted((r.dataset, r["count"]) for r in layouts.read_predictions(spark, str(tmp_path / "p")).groupBy("dataset").count().collect()) == [("rte", 2), ("sick", 1)]
    f = tmp_path / "e" / "exp_seed42" / "tests" / "mr" / "snli.jsonl"
    f.parent.mkdir(parents=True)
    f.write_text('{"correct": true}\n{"correct": 1}\nbad\n')
    got = layouts.read_experiment_tests(spark, str(tmp_path / "e")).collect()
    assert len(got) == 3 and got[0].experiment == "exp" and got[0].seed == 42
    assert sum(r.malformed for r in got) == 1


def test_configuration(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"experiments": [{"name": "a", "target": 5}], "test_sets": {"mr": {"snli": "x", "rte": "y"}}}, indent=1))
    experiments, tests = layouts.read_config(spark, str(f))
    assert experiments.first().name == "a" and tests.count() == 2


def test_round_trip(spark, tmp_path):
    jsonl.write_jsonl(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "o"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "o")).first().value == '{"x":"a","y":null}'


def test_evaluations_read_the_fields_they_name(spark, tmp_path):
    from nlimorph.operators import evaluate
    from nlimorph.sources import records

    line = '{"index": 1, "status": 200, "meta": {"task": "nli", "premise": "p", "gold_label": "neutral"}, "example": {"a": 1}, "response": {"choices": [{"message": {"content": "Neutral."}}], "usage": {"prompt_tokens": 3}}}'
    rows = jsonl.parse_lines(spark.createDataFrame([("m", "snli", "x", line), ("m", "rte", "y", '{"status": "error"}')], "model string, dataset string, mr string, value string"))
    records.write_records(rows, str(tmp_path / "r"))
    read = records.read_records(spark, str(tmp_path / "r"))
    assert read.where("dataset = 'snli'").select("index", "reply", "prompt_tokens", F.to_json("example").alias("e")).first() == (1, "Neutral.", 3, '{"a":1}')
    scored = evaluate.parsed(evaluate.with_prediction(evaluate.scorable(read)))
    plan = evaluate.mrv(scored)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"mr", "status", "task", "gold", "reply"}
    only = scored.where("dataset = 'rte'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in only


def test_lines_are_parsed_once_to_their_end(spark):
    end = "7306126530274"
    good = ["1", " [1, 2] ", "null", '{"a": "]"}', end, f"[{end}]", f'{{"a": {end}}}', '"x"']
    bad = ["1]", "1],[2", f"1,{end}]", f"1, {end}", "1, 2", "1] x", "{", "1,", '1,7.306126530274e12],[0', '"a', "]", f"1,{end}],[2,{end}", "1 2"]
    df = spark.createDataFrame([(t,) for t in good + bad], "value string")
    got = {r.value: r.malformed for r in jsonl.parse_lines(df, mode="flag").select("value", "malformed").collect()}
    assert got == {**dict.fromkeys(good, False), **dict.fromkeys(bad, True)}
    assert sorted(r.t for r in jsonl.parse_lines(df).select(F.to_json("v").alias("t")).collect()) == sorted(["1", "[1,2]", "null", '{"a":"]"}', end, f"[{end}]", f'{{"a":{end}}}', '"x"'])


def test_lines_made_by_long_expressions_are_made_once(spark):
    from nlimorph.plans import fixtures

    plan = jsonl.parse_lines(fixtures.prediction_lines(fixtures.predictions(spark, "/root/testdata/sf0.001"))).select("v")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert max(map(len, filters)) < 2000  # before, the filter held what makes the line


def test_compressed_lines_are_read_back(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "repeat('text ', 20) as text", "cast(id % 3 as string) as part")
    for how in ("none", "gzip"):
        jsonl.write_jsonl(df, f"{tmp_path}/{how}", ("part",), compression=how)
    size = {how: sum(f.stat().st_size for f in (tmp_path / how).rglob("part-*")) for how in ("none", "gzip")}
    assert size["gzip"] * 5 < size["none"]
    assert jsonl.read_jsonl(spark, f"{tmp_path}/gzip", mode="fail").count() == 1000


def test_paths_are_taken_apart_once_a_file(spark, tmp_path):
    """Fields of the path are joined to the rows; before, they were made for each row."""
    f = tmp_path / "rte_test_MR" / "rte_test_voice_switch 1.json"
    f.parent.mkdir()
    f.write_text('{"premise": "a"}\n{"premise": "b"}\n')
    rows = layouts.read_mr_dir(spark, str(tmp_path))
    got = rows.select("dataset", "mr", "stem", "task", F.try_variant_get("v", "$.premise", "string").alias("p")).collect()
    assert sorted(map(tuple, got)) == [("rte", "voice_switch", "rte_test_voice_switch%201", "nli-binary", p) for p in "ab"]
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
