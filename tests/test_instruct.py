import pytest
from pyspark.sql import functions as F

from nlimorph.operators import instruct

SCHEMA = "source_file string, pair_key string, row_key string, mr_id string, premise string, hypothesis string, label int, label_is_int boolean, task string"


def table(spark):
    data = [("f", "a", "1", "none", "P0", "H0", 0), ("f", "a", "2", "negation_flip", "P1", "H1", 2), ("f", "b", "3", "none", "P2", "H2", 1), ("f", "b", "4", "none", "P3", "H3", 1), ("f", "b", "5", "voice_switch", "P4", "H4", 1), ("f", "c", "6", "odd_one", "P5", "H5", 0)]
    df = spark.createDataFrame([(*r, True, "nli") for r in data], SCHEMA)
    catalog = spark.createDataFrame(instruct.CATALOG, "mr_id string, operation_text string, effect_text string")
    return instruct.attach_mr_texts(instruct.attach_source(df), catalog)


def test_only_single_sources_attach(spark):
    got = {r.row_key: r.source_premise for r in table(spark).collect()}
    assert got == {"1": "P0", "2": "P0", "3": None, "4": None, "5": None, "6": None}
    assert {r.pair_key: r.n_sources for r in instruct.source_problems(table(spark)).collect()} == {"b": 2, "c": 0}


@pytest.mark.parametrize("mode", instruct.MODES)
def test_modes(spark, mode):
    got = {r.row_key: r for r in instruct.build_instructions(table(spark), mode).collect()}
    plain = instruct.TEMPLATES["task"]["nli"]
    assert all(got[k].instruction == plain for k in ("1", "3", "4"))
    text = got["2"].instruction
    assert ("P0" in text) == (mode not in ("none", "operation_only"))
    assert ("negation was added" in text) == (mode not in ("none", "pair_only"))
    assert ("may turn around" in text) == (mode in ("relation_aware", "full_oracle"))
    assert ("Earlier reply: entailment" in text) == (mode == "full_oracle")
    assert "P1" not in text and "negation_flip" not in text
    assert got["2"].input == "Premise: P1\nHypothesis: H1" and got["2"].output == "contradiction"


def test_validation_rows_are_plain(spark):
    got = instruct.build_instructions(table(spark).withColumn("split", F.lit("val")), "full_oracle")
    assert {r.instruction for r in got.collect()} == {instruct.TEMPLATES["task"]["nli"]}


def test_shuffled_texts_differ(spark):
    got = {r.row_key: (r.mr_id, r.shown_mr) for r in instruct.shuffle_operations(table(spark), 3, "row_key").collect()}
    assert got["1"] == ("none", "none")
    assert all(a != b for a, b in got.values() if a != "none")
    one = instruct.shuffle_operations(table(spark).where("mr_id in ('none', 'odd_one')"), 3, "row_key")
    assert {r.shown_mr for r in one.where("mr_id = 'odd_one'").collect()} == {"odd_one"}


def test_audits(spark):
    known = spark.createDataFrame([("none",), ("negation_flip",), ("voice_switch",)], "mr_id string")
    assert [tuple(r) for r in instruct.mr_id_audit(table(spark), known).collect()] == [("odd_one", 1)]
    with pytest.raises(ValueError, match="unknown"):
        instruct.mr_id_audit(table(spark), known, strict=True)
    built = instruct.build_instructions(table(spark), "pair_operation")
    assert tuple(instruct.leak_audit(built).first()) == (6, 0, 0, 0, 0)
    oracle = instruct.leak_audit(instruct.build_instructions(table(spark), "full_oracle")).first()
    assert (oracle.shows_effect, oracle.names_source_label, oracle.names_mr) == (1, 1, 0)


def test_relations_to_draw_from_need_no_joins(spark):
    """The table before its joins gives the same draw, and its joins are not done twice."""
    whole = table(spark)
    before = whole.select("mr_id")
    got = instruct.shuffle_operations(whole, 3, "row_key", data=before)
    assert sorted(map(tuple, got.select("row_key", "shown_mr").collect())) == sorted(map(tuple, instruct.shuffle_operations(whole, 3, "row_key").select("row_key", "shown_mr").collect()))
    from nlimorph.plans import registry

    plan = registry.queries()["instructions_shuffled"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") == 1 and "Join" not in plan.split("collect_set")[1].split("LogicalRDD")[0]  # behind the list of relations stand the samples alone
