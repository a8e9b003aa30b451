"""What the plans of some queries must and must not hold."""

import re

from pyspark.sql import functions as F

from scoregate.operators import evaluation as ev, reproduce, scores as sc
from scoregate.plans import inputs as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_the_columns_they_need(spark, sf_dir):
    text = plan(I.raw_scores(spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["doc_id:bigint,n_chars:bigint"]


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(I.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))
    assert "EqualTo(lang,en)" in text


def test_worst_cases_are_cut_before_the_shuffle(spark, sf_dir):
    rows = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("method"),
        F.col("id").alias("item"),
        F.rand(1).alias("score"),
        F.lit(True).alias("is_anomalous"),
        F.lit("normal").alias("true_class")
    )
    assert plan(ev.error_cases(rows)).count("WindowGroupLimit") == 2
    assert plan(reproduce.first_items(rows, 3)).count("WindowGroupLimit") == 2


def test_methods_are_not_ordered_in_one_task_each(spark):
    rows = spark.range(100).select(
        (F.col("id") % 2).cast("string").alias("method"),
        F.col("id").alias("item"),
        F.rand(1).alias("score"),
        F.when(F.col("id") % 3 == 0, "anomaly").otherwise("normal").alias("true_class")
    )
    for df in (sc.thresholds(rows), ev.ranking_quality(rows)):
        text = plan(df)
        assert "CartesianProduct" not in text
        # Rows are ordered by method and range; by method alone only the 64 range sums are.
        for dealt in re.findall(r"Window \[(?:row_number|sum\((?:pos|neg))[^\n]*?\], \[([^\]]*)\]", text):
            assert "__sg_range" in dealt


def test_thresholds_are_broadcast(spark):
    rows = spark.range(10).select(
        (F.col("id") % 2).cast("string").alias("method"),
        F.col("id").alias("item"),
        F.lit("ok").alias("score_status"),
        F.rand(1).alias("score")
    )
    cuts = spark.createDataFrame([("m", 0.5)], "method string, threshold double")
    assert "BroadcastHashJoin" in plan(sc.classify(rows, cuts))
