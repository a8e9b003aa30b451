"""The quality ratio over all words and pairs of adjacent words, as op3 and the pipeline use it."""

import collections
import math

import corpus_pipeline
from pyspark.sql import functions as F

from scoregate.llm import quality_rules, queries

TEXTS = [
    "the nation was reading about motion and station " * 4,
    "zzing qqion wwent kkion " * 8,
    "station and motion about reading was nation the " * 4,
    "one",
    None,
    "  "
]


def written(spark, folder):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_query_counts_words_and_pairs(spark, tmp_path):
    folder = written(spark, tmp_path)
    found = [(t or "").split() for t in TEXTS]
    grams = [[(w,) for w in ws] + list(zip(ws, ws[1:], strict=False)) for ws in found]
    n = quality_rules.BUCKETS
    singles = spark.createDataFrame([(w,) for ws in found for w in ws], "w string").distinct()
    h = {r["w"]: r["h"] for r in singles.select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = spark.createDataFrame(list({(h[a], h[b]) for g in grams for a, b in [x for x in g if len(x) == 2]}), "a long, b long")
    p = {(r["a"], r["b"]): r["h"] for r in pairs.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    bucket = lambda g: (h[g[0]] if len(g) == 1 else p[h[g[0]], h[g[1]]]) % n
    raw, target = collections.Counter(bucket(g) for gs in grams for g in gs), collections.Counter(bucket(g) for g in grams[0])
    log = {b: math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n)) for b in raw}
    got = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, folder).collect()}
    for i, gs in enumerate(grams):
        assert math.isclose(got[i]["ratio"], sum(log[bucket(g)] for g in gs) / len(gs) if gs else 0.0, rel_tol=1e-9, abs_tol=1e-12), i
    assert got[0]["ratio"] > got[2]["ratio"] > got[1]["ratio"]  # the same words in another order, and junk with the same endings
    kept = corpus_pipeline.rules(spark, queries.table(spark, folder, "documents"), folder)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
