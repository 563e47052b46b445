import pytest
from pyspark.sql import functions as F

from nlimorph.operators import groups

SCHEMA = "source_file string, pair_key string, mr_id string, label int"


def rows(spark, sizes):
    return spark.createDataFrame([("f", f"g{k}", "none" if i == 0 else "x", i % 3) for k, n in enumerate(sizes) for i in range(n)], SCHEMA)


def in_order(g, seed):
    import hashlib

    return sorted(g, key=lambda r: (hashlib.md5(f"{seed}|{r.pair_key}".encode()).hexdigest(), r.pair_key))


@pytest.mark.parametrize("seed", [1, 42, 99])
@pytest.mark.parametrize("target", [0, 1, 7, 10_000])
def test_sample_and_cap(spark, seed, target):
    g = groups.pair_groups(rows(spark, [3, 2, 4, 1, 1, 5]))
    want_sample, want_cap, total = set(), set(), 0
    for k, r in enumerate(in_order(g.collect(), seed)):
        if total < max(target, 1):
            want_sample.add(r.pair_key)
        total += r.n_rows
        if total <= target or k == 0:
            want_cap.add(r.pair_key)
    assert {r.pair_key for r in groups.sample_groups(g, target, seed).collect()} == want_sample
    assert {r.pair_key for r in groups.cap_groups(g, target, seed).collect()} == want_cap


@pytest.mark.parametrize(("n", "want"), [(1, 0), (3, 1), (40, 2)])
def test_split(spark, n, want):
    g = groups.pair_groups(rows(spark, [2] * n))
    got = groups.split_groups(g, 0.05, 7)
    assert got.where("split = 'val'").count() == want and got.count() == n
    again = groups.split_groups(g.repartition(7), 0.05, 7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}


def test_stratified_shares(spark):
    data = [("f", f"{lab}-{k}", "none", lab) for lab in range(3) for k in range(20)]
    g = groups.primary_label(spark.createDataFrame(data, SCHEMA))
    got = groups.sample_groups_stratified(g, 10, 5).groupBy("primary_label").count().collect()
    assert sorted((r.primary_label, r["count"]) for r in got) == [(0, 4), (1, 3), (2, 3)]


def test_primary_label(spark):
    data = [("f", "a", "x", 1), ("f", "a", "x", 2), ("f", "b", "x", 2), ("f", "b", "x", 2), ("f", "b", "x", 0)]
    got = {r.pair_key: r.primary_label for r in groups.primary_label(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {"a": 1, "b": 2}


def test_rows_without_id_get_their_own(spark):
    df = spark.createDataFrame([("f", " 0 ", "p"), ("f", "0", "q"), ("f", None, "r"), ("f", None, "r")], "source_file string, pair_id string, premise string")
    got = groups.ensure_pair_id(df, ["premise"])
    assert got.select("pair_key").distinct().count() == 3
    assert got.count() == 4


def test_manifest(spark, tmp_path):
    df = rows(spark, [2] * 10)
    m = groups.split_groups(groups.pair_groups(df), 0.2, 3)
    groups.write_manifest(m, str(tmp_path / "m"))
    back = groups.read_manifest(spark, str(tmp_path / "m"))
    got = groups.split_from_manifest(df, back)
    assert got.count() == 20 and got.where("split = 'val'").select("pair_key").distinct().count() == 2
    assert groups.verify_manifest(groups.pair_groups(df), back).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        groups.split_from_manifest(df.where("pair_key <> 'g0'"), back)
    assert groups.verify_manifest(groups.pair_groups(df).where("pair_key <> 'g0'"), back).first().side == "manifest"


def test_integrity(spark):
    df = rows(spark, [2, 3])
    got = {r.pair_key: r.whole for r in groups.check_group_integrity(df, df.where(~((F.col("pair_key") == "g1") & (F.col("label") == 2)))).collect()}
    assert got == {"g0": True, "g1": False}


def test_large_and_word_labels(spark):
    data = [("f", "a", "5000000001", True), ("f", "a", "5000000001", True), ("f", "a", "1", True), ("f", "b", "word", False), ("f", "b", "-2", True), ("f", "b", "-2", True)]
    got = groups.primary_label(spark.createDataFrame(data, "source_file string, pair_key string, label string, label_is_int boolean")).collect()
    assert {r.pair_key: r.primary_label for r in got} == {"a": 5000000001, "b": -2}


def test_parts_share_no_group_and_manifests_tell_splits_apart(spark):
    g = groups.split_groups(groups.pair_groups(rows(spark, [2] * 10)), 0.2, 3)
    train, val = g.where("split = 'train'"), g.where("split = 'val'")
    assert groups.shared_groups(train, val).count() == 0 and groups.shared_groups(train, g).count() == 8
    turned = g.withColumn("split", F.when(F.col("pair_key") == "g0", "other").otherwise(F.col("split")))
    assert [tuple(r) for r in groups.verify_manifest(turned, g).collect()] == [("f", "g0", "split")]


@pytest.mark.parametrize("parts", [1, 2, 3, 200])
def test_own_keys_do_not_change_with_partitioning(spark, parts):
    df = spark.range(5000).selectExpr("'f' as source_file", "cast(null as string) as pair_id", "cast(id % 7 * (id % 3) as string) as premise")
    keys = sorted(r.pair_key for r in groups.ensure_pair_id(df.repartition(parts), ["premise"]).select("pair_key").collect())
    assert len(set(keys)) == 5000
    assert keys == sorted(r.pair_key for r in groups.ensure_pair_id(df, ["premise"]).select("pair_key").collect())


def test_a_million_equal_rows(spark, monkeypatch):
    df = spark.range(0, 1_000_000, 1, 5).selectExpr("'f' as source_file", "cast(null as string) as pair_id", "'same' as premise")
    got = groups.ensure_pair_id(df, ["premise"]).select(F.split("pair_key", "_").alias("k")).select(F.element_at("k", -1).cast("long").alias("n"))
    assert tuple(got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()) == (1_000_000, 1_000_000, 1, 1_000_000)


def test_selection_refines_and_orders_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(groups, "FEW", 3)
    g = spark.range(3000).selectExpr("'f' as source_file", "cast(id as string) as pair_key", "id % 5 + 1 as n_rows", "id % 3 as primary_label").cache()
    in_hash_order = in_order(g.collect(), 7)
    for target in (1, 50, 4000, 8999, 9000, 9001, 20_000):
        want, total = set(), 0
        for r in in_hash_order:
            if total < target:
                want.add(r.pair_key)
            total += r.n_rows
        assert {r.pair_key for r in groups.sample_groups(g, target, 7).collect()} == want
    got = groups.sample_groups_stratified(g, 100, 7).collect()
    for label, share in ((0, 34), (1, 33), (2, 33)):
        want, total = set(), 0
        for r in (x for x in in_hash_order if x.primary_label == label):
            if total < share:
                want.add(r.pair_key)
            total += r.n_rows
        assert {r.pair_key for r in got if r.primary_label == label} == want
    chosen = groups.Selection(g, 7, F.col("n_rows"), F.lit(4000).cast("long"))
    assert chosen.cuts.first().n <= 3 and chosen._parts()[1].count() <= 3
    plan = chosen.first()._jdf.queryExecution().executedPlan().toString()
    assert "startswith" not in plan and plan.count("Window [") == 1 and plan.count("hashpartitioning(") <= 1


def test_equal_manifests_join_no_row(spark):
    g = groups.pair_groups(rows(spark, [2] * 50))
    assert groups.differing_buckets(g, g.repartition(3), groups.KEY, 64).count() == 0
    assert groups.differing_buckets(g, g.where("pair_key <> 'g7'"), groups.KEY, 64).count() == 1
