"""Scorers that are set up once in a worker, stores that are read by index, sealed mappings and hidden labels."""

import os

from pyspark.sql import functions as F

from scoregate.operators import contracts as c, hooks
from scoregate.sources import bundles


def test_a_scorer_is_set_up_once_in_a_worker(spark, tmp_path):
    log = str(tmp_path / "setups")

    def setup():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return {"scale": 2.0}

    items = spark.range(400).select(F.col("id").alias("item"), (F.col("id") * 1.0).alias("value"), F.lit("x").alias("score")).repartition(12)
    got = {r["item"]: r["score"] for r in hooks.score_with_state(items, "item", "value", setup, lambda state, v: state["scale"] * v).collect()}
    assert got == {i: 2.0 * i for i in range(400)}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= 4  # twelve tasks, no more workers than cores


def test_failures_of_setup_and_scorer_are_rows(spark):
    items = spark.createDataFrame([(1, 1.0), (2, None), (None, 0.0)], "item int, value double")

    def broken():
        raise OSError("no model")

    rows = hooks.score_with_state(items, "item", "value", broken, lambda s, v: v).collect()
    assert {r["failure_code"] for r in rows} == {"SETUP_ERROR:OSError"} and len(rows) == 3
    rows = {
        r["item"]: (r["score_status"], r["failure_code"])
        for r in hooks.score_with_state(items, "item", "value", lambda: 1.0, lambda s, v: s / v).collect()
    }
    assert rows[1] == ("ok", None) and rows[None] == ("failed", "SCORER_ERROR:ZeroDivisionError") and rows[2][0] == "failed"
    assert hooks.score_with_state(items.limit(0), "item", "value", broken, lambda s, v: v).collect() == []


def test_a_fetch_reads_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundles, "GROUP_BYTES", 64 << 10)
    path = f"file://{tmp_path}/store"
    rows = spark.range(40_000).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.rand(3) + k).alias("v"))
    bundles.write_indexed(rows, "i", "v", path)
    found = bundles.fetch(spark, path, [12_345])
    assert [(r["item"], r["verified"], len(r["values"])) for r in found.collect()] == [(12_345, True, 8)]
    assert "In(item" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(item" in found._jdf.queryExecution().executedPlan().toString()
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    assert plan.metrics().apply("numOutputRows").value() < 8_000  # of 40,000
    assert bundles.fetch(spark, path, [-1]).collect() == []


def test_sealed_mappings(spark):
    schema = "asset_id string, source_path string, class_label string"
    good = [(f"asset-{i:06d}", f"a/{i}", "x") for i in range(4)]
    broken = lambda rows: sorted((r["rule"], r["key"]) for r in c.sealed_violations(spark.createDataFrame(rows, schema)).collect())
    assert broken(good) == []
    assert broken([]) == [("empty", "0")]
    assert broken(good[1:]) == [("asset_gap", "3")]
    assert broken([*good, good[1]]) == [("asset_repeated", "asset-000001"), ("path_repeated", "a/1")]
    assert broken([*good[:3], ("asset-3", "/a", None)]) == [("asset_malformed", "asset-3"), ("class_missing", "asset-3"), ("unsafe_path", "asset-3")]
    assert broken([*good[:3], (None, None, "")]) == [("asset_malformed", None), ("class_missing", None), ("unsafe_path", None)]


def test_labels_of_the_final_test_are_hidden(spark):
    rows = spark.createDataFrame([("reference", "n"), ("final-test", "a"), (None, "a")], "partition string, label string")
    assert [r["label"] for r in c.with_partition_labels(rows).collect()] == ["n", None, None]
