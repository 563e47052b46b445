import pytest

from nlimorph.operators import evaluate, seeds

#: Published error rates: errors / rows by dataset and relation.
CELLS = {
    "mnlim": {"adding_contradiction": (315, 1000), "antonym_substitution": (134, 923), "synonym_replacement": (225, 1000)},
    "mnlimm": {"adding_contradiction": (312, 1000), "antonym_substitution": (150, 1000), "conditional_clause": (184, 1000), "negation_flip": (8, 140), "pronoun_substitution": (125, 1000), "synonym_replacement": (201, 1000), "uninformative": (97, 1000), "voice_switch": (65, 286)},
    "rte": {"adding_contradiction": (0, 146), "antonym_substitution": (1, 101), "conditional_clause": (6, 132), "negation_flip": (0, 6), "pronoun_substitution": (6, 64), "synonym_replacement": (37, 213), "uninformative": (0, 146), "voice_switch": (1, 4)},
    "sick": {"adding_contradiction": (255, 1000), "antonym_substitution": (29, 800), "conditional_clause": (284, 1000), "pronoun_substitution": (112, 1000), "synonym_replacement": (365, 1000), "uninformative": (46, 1000), "voice_switch": (2, 9)},
    "snli": {"adding_contradiction": (202, 999), "antonym_substitution": (106, 1000), "conditional_clause": (131, 1000), "negation_flip": (2, 547), "pronoun_substitution": (93, 1000), "synonym_replacement": (197, 1000), "uninformative": (206, 1000), "voice_switch": (99, 350)},
}
TOTALS = {"mnlim": (674, 2923), "mnlimm": (1142, 6426), "rte": (51, 812), "sick": (1093, 5809), "snli": (1036, 6896)}


@pytest.fixture(scope="module")
def golden(spark):
    data = [(d, m, "entailment", "neutral" if k < e else "entailment") for d, row in CELLS.items() for m, (e, n) in row.items() for k in range(n)]
    return spark.createDataFrame(data, "dataset string, mr string, gold string, pred string").cache()


def test_error_rate_tables(golden):
    cube = {(r.dataset, r.mr): (r.errors, r.total, r.level) for r in evaluate.mrv_cube(golden).collect()}
    assert cube[None, None] == (3996, 22866, "all")
    for d, row in CELLS.items():
        assert cube[d, None] == (*TOTALS[d], "dataset")
        for m, cell in row.items():
            assert cube[d, m] == (*cell, "cell")
    assert len([k for k, v in cube.items() if v[2] == "mr"]) == 8
    rollup = evaluate.mrv(golden).collect()
    assert len(rollup) == 1 + 5 + sum(map(len, CELLS.values()))


def test_matrix_leaves_blanks(golden):
    order = tuple(sorted({m for row in CELLS.values() for m in row}))
    got = {r.dataset: r for r in evaluate.mrv_matrix(golden, order).collect()}
    assert got["mnlim"].voice_switch is None and got["rte"].negation_flip == 0.0 and got["mnlim"].adding_contradiction == 0.315


def test_metrics_of_a_published_confusion(spark):
    cells = {("entailment", "entailment"): 109, ("entailment", "not_entailment"): 39, ("not_entailment", "entailment"): 12, ("not_entailment", "not_entailment"): 652}
    df = spark.createDataFrame([("rte", "x", "nli-binary", g, p) for (g, p), n in cells.items() for _ in range(n)], "dataset string, mr string, task string, gold string, pred string")
    per = {r.label: r for r in evaluate.metrics_per_class(df).collect()}
    shown = {k: (round(r.precision * 100, 2), round(r.recall * 100, 2), round(r.f1 * 100, 2), r.support) for k, r in per.items()}
    assert shown == {"entailment": (90.08, 73.65, 81.04, 148), "not_entailment": (94.36, 98.19, 96.24, 664)}
    all_ = evaluate.metrics_overall(df).first()
    assert [round(x * 100, 2) for x in (all_.accuracy, all_.precision_macro, all_.recall_macro, all_.f1_macro)] == [93.72, 92.22, 85.92, 88.64]
    assert {(r.gold, r.pred): r.n for r in evaluate.confusion(df).collect()} == cells


def test_null_gold_is_an_error_or_dropped(spark):
    df = spark.createDataFrame([("d", "m", 200, None, True, "e", "nli"), ("d", "m", 200, "entailment", True, "e", "nli"), ("d", "m", 0, "neutral", True, "e", "nli")], "dataset string, mr string, status int, gold string, gold_present boolean, reply string, task string")
    assert evaluate.scorable(df).count() == 1
    kept = evaluate.with_prediction(evaluate.scorable(df, "keep"))
    assert evaluate.error_cases(kept).count() == 1


def test_rows_without_relation_count(spark):
    df = spark.createDataFrame([("d", None, "e", "e"), ("d", None, "e", "n"), ("d", "m", "e", "e")], "dataset string, mr string, gold string, pred string")
    got = {(r.dataset, r.mr, r.level): (r.total, r.errors) for r in evaluate.mrv_cube(df).collect()}
    assert got["d", None, "dataset"] == (3, 1) and got["d", None, "cell"] == (2, 1) and got[None, None, "all"] == (3, 1)


def test_suffixes_are_no_patterns(spark):
    rows = [("e_3.5b", 1, "mr", "snli", 80.0), ("e_375b", 1, "mr", "snli", 10.0), ("e_4+b", 1, "mr", "snli", 70.0)]
    cells = spark.createDataFrame(rows, "experiment string, seed int, test_type string, dataset string, accuracy double")
    assert seeds.compare_models(cells, "_3.5b", "_4+b", 1).first().delta == 10.0


def test_index_by_hash_order(spark):
    import hashlib

    from nlimorph.operators import score

    df = spark.createDataFrame([("d" if k % 3 else None, f"r{k}") for k in range(500)], "dataset string, row_key string")
    got = {(r.dataset, r.row_key): r["index"] for r in score.with_index(df.repartition(7), ("dataset",), ("row_key",)).collect()}
    for d in ("d", None):
        names = sorted((k for x, k in got if x == d), key=lambda k: hashlib.md5(k.encode()).hexdigest())
        assert [got[d, k] for k in names] == list(range(1, len(names) + 1))


def test_seeds(spark):
    rows = [("e_one", s, "mr", "snli", a) for s, a in ((42, 80.0), (43, 82.0), (44, 84.0))] + [("e_two", s, "mr", "snli", a) for s, a in ((42, 70.0), (43, 71.0))]
    cells = spark.createDataFrame(rows, "experiment string, seed int, test_type string, dataset string, accuracy double")
    strict = {r.experiment: (r["mean"], r.deviation) for r in seeds.seed_summary(cells, 3).collect()}
    assert strict == {"e_one": (82.0, 2.0), "e_two": (70.5, None)}
    lenient = {r.experiment: r.deviation for r in seeds.seed_summary(cells, 3, require_all=False).collect()}
    assert lenient["e_two"] == pytest.approx(0.707107)
    assert seeds.compare_models(cells, "_one", "_two", 3).count() == 0
    assert seeds.compare_models(cells.where("seed < 44"), "_one", "_two", 2).first().delta == 10.5


def test_scoring_survives_a_failing_batch(spark):
    from nlimorph.operators import score

    def predict(batch):
        if "bad" in batch:
            raise RuntimeError("no model")
        return ["e"] * len(batch)

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "prompt string").coalesce(1)
    assert {r.pred for r in score.score(df, lambda batch: ["e"] * (len(batch) + 1)).collect()} == {"ERROR"}
    assert [r.pred for r in score.score(df, predict, batch_size=1).collect()] == ["e", "ERROR", "e"]
