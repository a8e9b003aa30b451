"""The pipeline's stages over nulls, empty, very long and repeated texts, empty tables and clashing columns, and run() as a whole."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scoregate.llm.common import Scratch

GOOD = "the quick fox number {} jumps over a lazy dog near the old river while seven birds sing songs about summer rain and quiet hills of home"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = [
        GOOD.format(i) + f" word{i} thing{i * 7} place{i * 13}" for i in range(60)
    ] + [GOOD.format(1) + " word1 thing7 place13"] * 3 + [None, "", " \n", "x " * 30, "one two"] + [
        " ".join(f"w{k % 997}x{k}" for k in range(30_000))
    ]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), "own", i) for i, t in enumerate(texts)] + [
        (None, GOOD.format(99) + " nothing like the others at all in its second half or so", "en", "a", 1, "own", 0)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rules string, words long")
    base = f"file://{tmp_path_factory.mktemp('tables')}"
    for name, n in (("full", None), ("empty", 0)):
        (docs if n is None else docs.limit(0)).write.parquet(f"{base}/{name}/documents.parquet")
        labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (66, 0, 0), (67, None, 0)], "doc_id long, quality int, toxic int")
        (labels if n is None else labels.limit(0)).write.parquet(f"{base}/{name}/labels.parquet")
    return base


def test_stages_keep_columns_and_run_applies_them_all(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    scratch, held = Scratch(spark), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, held = held, scratch.table(stage(spark, held, f"{folder}/full"), "stage")
        assert held.columns == docs.columns, name
        assert held.exceptAll(before).where("doc_id is not null").dropDuplicates(["doc_id"]).join(
            before.select("doc_id"), "doc_id", "left_anti"
        ).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, held, f"{folder}/full")
    count = lambda df: collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in df.select("doc_id", "ids", "decoded").collect())
    whole = count(corpus_pipeline.run(spark, f"{folder}/full"))
    assert whole == count(last) and whole
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(decoded == texts[i] for i, _, decoded in whole)
    assert sum(n > 0 for (i, _, _), n in whole.items() if texts[i] == texts[60]) <= 1  # one of the exact copies at most


def test_stages_over_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/empty/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{folder}/empty").count() == 0
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_rows_without_an_id_and_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(docs.where("doc_id is null"))
    kept = corpus_pipeline.deduplicate(spark, twice, f"{folder}/full")
    n = {r["doc_id"]: r["n"] for r in kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[3] == n[4] == n[None] == 2 and n[1] == 1 and not {60, 61, 62} & n.keys()
