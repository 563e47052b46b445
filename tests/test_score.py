"""Scoring: models kept by worker processes, failures, and runs that are lost and resumed."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from nlimorph.operators import score
from nlimorph.sources.scratch import scratch_dir


def prompts(spark, n):
    return spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").alias("index"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))


def counting(folder, fail_on=None):
    """A model that leaves a file for each time it is made and for each prompt it sees."""

    def factory():
        open(f"{folder}/made-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(batch):
            for p in batch:
                if p == fail_on:
                    os._exit(1)  # the worker is lost
                with open(f"{folder}/seen-{p}", "a") as f:
                    f.write("x")
            return [p.upper() for p in batch]

        return predict

    return factory


def folder_of(spark):
    at = f"{scratch_dir(spark)}/score-{uuid.uuid4().hex}"
    os.makedirs(f"{at}/log")
    return at


def test_a_lost_run_is_resumed(spark):
    at = folder_of(spark)
    rows = prompts(spark, 400).repartition(4)
    with pytest.raises(Exception):  # noqa: B017, PT011
        score.score_into(rows, f"{at}/out", counting(f"{at}/log", "p399"), waves=8, name=at)
    wave = rows.where("index = 399").select(F.pmod(F.xxhash64("dataset", "index"), F.lit(8))).first()[0]
    kept = score.scored_so_far(spark, f"{at}/out", rows.withColumn("pred", F.lit("")).withColumn("wave", F.lit(0)).schema) if wave else None
    assert kept is None or {r.wave for r in kept.select("wave").distinct().collect()} == set(range(wave))
    done = score.score_into(rows, f"{at}/out", counting(f"{at}/log"), waves=8, name=at)
    got = done.collect()
    assert sorted((r["index"], r.pred) for r in got) == [(k, f"P{k}") for k in range(400)]
    before = {f: os.path.getsize(f"{at}/log/{f}") for f in os.listdir(f"{at}/log")}
    more = score.score_into(prompts(spark, 410), f"{at}/out", counting(f"{at}/log"), waves=8, name=at)
    assert more.count() == 410
    after = {f: os.path.getsize(f"{at}/log/{f}") for f in os.listdir(f"{at}/log")}
    assert {f for f in after if f.startswith("seen") and before.get(f) != after[f]} == {f"seen-p{k}" for k in range(400, 410)}


def test_one_model_a_worker_process(spark):
    at = folder_of(spark)
    rows = prompts(spark, 2000).repartition(40)
    assert score.score(rows, factory=counting(f"{at}/log"), name=at).where("pred like 'P%'").count() == 2000
    made = [f.split("-")[1] for f in os.listdir(f"{at}/log") if f.startswith("made")]
    assert 0 < len(made) == len(set(made)) <= 8


def test_failed_and_short_batches_are_marked(spark):
    def predict(batch):
        if "p3" in batch:
            raise RuntimeError("no answer")
        return batch[1:] if "p8" in batch else batch

    got = {r["index"]: r.pred for r in score.score(prompts(spark, 12).coalesce(1), predict, batch_size=4).collect()}
    assert [k for k, v in got.items() if v == "ERROR"] == [0, 1, 2, 3, 8, 9, 10, 11]


def test_pending_takes_nulls_for_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("d", None), ("d", 2)], "dataset string, index long")
    assert [tuple(r) for r in score.pending(rows, rows.limit(2)).collect()] == [("d", 2)]
    with pytest.raises(ValueError, match="either"):
        score.score(rows)


def test_a_first_run_joins_nothing(spark, monkeypatch):
    """Where nothing is scored yet, rows are not held against it."""
    at, calls = folder_of(spark), []
    whole = score.pending
    monkeypatch.setattr(score, "pending", lambda *a, **k: calls.append(1) or whole(*a, **k))
    for n, times in ((5, 0), (7, 1)):
        done = score.score_into(prompts(spark, n), f"{at}/out", counting(f"{at}/log"), waves=2, name=at)
        assert (done.count(), len(calls)) == (n, times)


def test_rows_are_numbered_behind_one_shuffle(spark):
    """Rows are dealt once, without their digests; before, these were shuffled and the rows once more for the offsets."""
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("string").alias("dataset"), F.when(F.col("id") < 0, "x").alias("mr"), F.col("id").cast("string").alias("row_key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = score.with_index(rows, ("dataset", "mr"), ("row_key",))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.index("AS _h") < plan.index("Exchange hashpartitioning(") and plan.count("AS _h") == 1
    got = sorted((str(r.dataset), r["index"], r.row_key) for r in numbered.collect())
    want = [(d, sorted((hashlib.md5(str(k).encode()).hexdigest(), str(k)) for k in range(1000) if k % 3 == n)) for d, n in (("1", 1), ("2", 2), ("None", 0))]
    assert got == [(d, i, k) for d, ks in want for i, (_, k) in enumerate(ks, 1)]
